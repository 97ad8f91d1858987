"""A training corpus from `documents`: five stages, each over all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loadscope.llm import bpe, decontam, nearcopies, pii, quality
from loadscope.llm.common import stored, table
from loadscope.llm.queries import QUALITY_CUT, quality_model, vocabulary


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject."""
    scored = quality.score(docs, quality_model(spark, sf_dir, docs), out="_score")
    return scored.where(F.col("_score") >= QUALITY_CUT).drop("_score")


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: links of SimHash fingerprints, then what these leave apart; each link has a five-word Jaccard similarity of 0.8 or more."""
    return nearcopies.keep_one(docs)


def uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by its kind; n_chars follows."""
    return pii.redact(docs).withColumn("n_chars", F.char_length("text").cast("long"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's token ids, and a digest of them and of the text they decode to."""
    path = vocabulary()
    return bpe.digest(docs, path).select("doc_id", "lang", "source", "n_chars", "bpe.*")


STAGES = [("quality", good), ("simhash", distinct), ("decontamination", uncontaminated), ("pii", private), ("bpe", tokens)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs)
    return docs


#: The classifier, the fingerprints and the automaton can't be written in SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None
