"""SimHash near-duplicates through an inverted index of positional bytes."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loadscope.llm.common import components, stored, text_of

BYTES = 8
#: Longest posting whose pairs are listed; longer ones are linked through one-bit neighbours instead.
LONGEST_POSTING = 48
#: Hashes whose bits are counted at once.
CHUNK = 1 << 16


def hashes(text: str, n_words: int = 3) -> np.ndarray:
    """Of the text's shingles in turn, repeats included; a shorter text is one shingle, a wordless one has none."""
    words = text.encode("utf-8", "replace").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    n = min(n_words, len(words))
    starts = [0, *(ends[: len(words) - n] + 1).tolist()]
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(line[s:e], 42) for s, e in zip(starts, ends[n - 1 :].tolist(), strict=True)), np.uint64, len(starts))


def fingerprint_of(own: np.ndarray) -> int:
    """The 64-bit fingerprint of these hashes, as a signed integer; that of none is 0."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(own), CHUNK):
        part = own[at : at + CHUNK].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(own), bitorder="little").view(np.int64)[0])


def fingerprint(text: str, n_words: int = 3) -> int:
    return fingerprint_of(hashes(text, n_words))


def fingerprints(docs: DataFrame, text: str = "text", n_words: int = 3, out: str = "fp") -> DataFrame:
    """docs with a bigint column `out`. A null or wordless text has fingerprint 0."""

    @F.pandas_udf("long")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([fingerprint(t, n_words) for t in batch], dtype="int64")

    return docs.withColumn(out, of(text_of(text)))


def key_positions(max_bits: int) -> list[tuple[int, ...]]:
    """Byte positions of the index's keys.

    Fingerprints at max_bits differing bits share BYTES - max_bits positional bytes at
    least. The keys are a small family of position sets such that whichever bytes those
    are, one set lies within them: greedy cover, over 70 subsets at most.
    """
    least = BYTES - max_bits
    if least < 2:
        raise ValueError("max_bits can be 6 at most")
    width = max(1, least - 2 if least > 4 else least - 1 if least > 3 else least)
    left = set(combinations(range(BYTES), least))
    chosen: list[tuple[int, ...]] = []
    while left:
        best = max(combinations(range(BYTES), width), key=lambda s: sum(set(s) <= set(x) for x in left))
        chosen.append(best)
        left = {x for x in left if not set(best) <= set(x)}
    return chosen


def _byte(column: str | Column, p: int) -> Column:
    c = F.col(column) if isinstance(column, str) else column
    return F.shiftrightunsigned(c, 8 * p).bitwiseAND(255)


def shared_bytes(a: str, b: str) -> Column:
    """How many positional bytes two fingerprints have in common."""
    x = F.col(a).bitwiseXOR(F.col(b))
    return sum((F.when(_byte(x, p) == 0, 1).otherwise(0) for p in range(BYTES)), F.lit(0))


def links(fps: DataFrame, max_bits: int = 2) -> DataFrame:
    """Edges (u, v) over a table of distinct fingerprints `fp` that join all those reachable by max_bits differing bits.

    Postings of (key number, its bytes) up to LONGEST_POSTING long give candidate pairs;
    a pair is kept if its tally of shared positional bytes reaches the guaranteed
    minimum, and then verified bit by bit. A longer posting isn't cut: each of its
    fingerprints is joined to the smallest one of all those that lie within one bit of
    the same value (half of max_bits, in general), which links exactly those that are
    max_bits apart or less, with a fixed number of rows for each fingerprint.
    """
    if max_bits % 2:
        raise ValueError("max_bits has to be even")
    mask = lambda ps: int(np.array([sum(255 << (8 * p) for p in ps)], np.uint64).view(np.int64)[0])
    keys = [F.struct(F.lit(i).alias("k"), F.col("fp").bitwiseAND(F.lit(mask(ps)).cast("long")).alias("v")) for i, ps in enumerate(key_positions(max_bits))]
    postings = fps.select("fp", F.explode(F.array(*keys)).alias("key"))
    sizes = postings.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    postings = stored(postings.join(sizes, "key"))
    short = (
        postings.where(F.col("n") <= LONGEST_POSTING)
        .groupBy("key")
        .agg(F.collect_list("fp").alias("fps"))
        .select("fps", F.explode("fps").alias("u"))
        .select("u", F.explode("fps").alias("v"))
        .where("u < v")
        .withColumn("tally", shared_bytes("u", "v"))
        .where(F.col("tally") >= BYTES - max_bits)
        .where(F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= max_bits)
        .select("u", "v")
    )
    # at max_bits or fewer apart: both lie within half as many bits of some value
    flips = [sum(1 << b for b in bits) for k in range(max_bits // 2 + 1) for bits in combinations(range(64), k)]
    flips = np.array(flips, np.uint64).view(np.int64).tolist()
    long_ = postings.where(F.col("n") > LONGEST_POSTING).select("fp").distinct()
    around = long_.select("fp", F.explode(F.array(*[F.lit(x).cast("long") for x in flips])).alias("flip")).select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("value"))
    heads = around.groupBy("value").agg(F.min("fp").alias("head"), F.count("*").alias("n")).where("n > 1").select("value", "head")
    hubs = around.join(heads, "value").where("fp <> head").select(F.col("head").alias("u"), F.col("fp").alias("v"))
    return short.unionByName(hubs).distinct()


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", n_words: int = 3, max_bits: int = 2) -> DataFrame:
    """One row for each row of docs: doc_id, fingerprint (16 hex digits), component_id.

    component_id is the smallest id reachable over links of max_bits (an even number) or
    fewer differing bits, the own one included. Null, empty and wordless texts have
    fingerprint zero and link like any other; repeated rows and ties share their
    fingerprint's component; a null id is never a component's id unless it is alone.
    Other columns are ignored; an empty table gives an empty result.
    """
    marked = stored(fingerprints(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), n_words=n_words).select("doc_id", "fp"))
    classes = marked.groupBy("fp").agg(F.min("doc_id").alias("first"))
    found = components(links(classes.select("fp"), max_bits)).select(F.col("node").alias("fp"), F.col("component"))
    of = stored(classes.join(found, "fp", "left").withColumn("component", F.coalesce("component", "fp")))
    least = of.groupBy("component").agg(F.min("first").alias("component_id"))
    ids = of.join(least, "component").select("fp", "component_id")
    return marked.join(ids, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
