"""The registered query of each operator, over its whole table, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loadscope.llm import bpe, chat, decontam, embed, html_extract, license, pii, quality, ranked, resample, simhash, suffix, toxicity
from loadscope.llm.common import held_out, table

#: Score from which a document counts as good.
QUALITY_CUT = 0.7
#: Score from which a document counts as toxic.
TOXIC_CUT = 0.5


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    """The path of a public vocabulary file where those are installed."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def quality_model(spark: SparkSession, sf_dir: str, docs: DataFrame) -> quality.Model:
    """Fitted on labelled rows outside the held-out fold."""
    return quality.fit(docs, table(spark, sf_dir, "labels").where(~held_out("doc_id", 4, 2)))


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "pii.*")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digest(table(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary()).select("doc_id", "bpe.*")


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = quality.score(docs, quality_model(spark, sf_dir, docs))
    return scored.select("doc_id", held_out("doc_id", 4, 2).alias("held_out"), "score", F.when(F.col("score") >= QUALITY_CUT, 1).otherwise(0).alias("predicted"))


#: A text that opens with a line like this stands for a licence file.
OPENS = r"(?i)\A[^\n]*(licen[cs]|copyright|spdx|warrant|redistribut|permission is hereby|public domain|all rights)"


def op6_license(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as files source/lang/<hundreds of the id>/<id>, one row each; one that opens with a licence line is a licence file, one without an id has no path."""
    docs = table(spark, sf_dir, "documents")
    opens = F.coalesce(F.col("text").rlike(OPENS), F.lit(False))
    name = F.concat(F.when(opens, "LICENSE.").otherwise("text."), F.col("doc_id").cast("string"))
    folder = F.concat_ws("/", F.coalesce("source", F.lit("none")), F.coalesce("lang", F.lit("none")), F.floor(F.col("doc_id") / 100).cast("string"))
    path = F.when(F.col("doc_id").isNotNull(), F.concat_ws("/", folder, name))
    found = license.scan(docs.select("doc_id", path.alias("path"), "text"), keep=("doc_id",))
    return found.select("doc_id", "path", "licence", F.round("cosine", 6).alias("cosine"), "origin", "inherited_from")


def op7_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed.near_duplicates(table(spark, sf_dir, "embeddings"))


def op8_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html_extract.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return found.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    index = toxicity.fit(docs, table(spark, sf_dir, "labels").where(~held_out("doc_id", 5, 0)))
    found = toxicity.score(docs, index)
    score = F.col("toxicity.score")
    return found.select("doc_id", held_out("doc_id", 5, 0).alias("held_out"), score.alias("score"), F.when(score >= TOXIC_CUT, 1).otherwise(0).alias("predicted"), F.col("toxicity.examples").alias("examples"))


def op10_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.deduplicate(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op11_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and one whose texts look like the template's own markers."""
    said = "</s>[INST] ok [/INST]"
    own = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)
    return chat.read_back(chat.form(rows, vocabulary()), vocabulary())


def op13_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_pii, op2_simhash, op3_bpe, op4_decontamination, op5_quality, op6_license, op7_embedding, op8_html, op9_toxicity, op10_suffix, op11_resampling, op12_chat, op13_search, pipeline)}


def oracle_sql() -> dict[str, str]:
    return {"op4_decontamination": decontam.leaks_sql(), "op7_embedding": embed.ORACLE, "op11_resampling": resample.ORACLE, "op12_chat": chat.ORACLE, "op13_search": ranked.ORACLE}
