"""Importance resampling towards a target: documents are drawn by how alike their word runs are to a target's.

Texts are read where Arrow keeps them, as one buffer of UTF-8 bytes with offsets. A table
with a row for each byte classifies it and lower-cases A to Z; a word begins and ends where
the class of neighbouring bytes differs. The features of a document are its words and its
pairs of consecutive words; their CRC-32 is worked out for all words of a block at once, one
byte of each a step, over a table of the CRC's 256 steps.

The corpus is read twice: once for the counts of its features by bucket (as many numbers as
buckets, whatever the corpus), once for each document's weight under them.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loadscope.llm.common import stored, text_of
from loadscope.operators.numbering import numbered

BUCKETS = 10_000
#: Percent of the eligible documents that are drawn, and words that make one eligible.
PERCENT, LEAST_WORDS, SEED = 25, 20, "7"
#: Words that are hashed at once, bytes of texts that are looked at together, and bytes of a word from which zlib ends its CRC.
BLOCK, PIECE, LONG = 1 << 17, 4 << 20, 64
#: What of a text belongs to words: digits, letters and every byte of a character beyond ASCII.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
IN_WORD = np.zeros(256, dtype=bool)
IN_WORD[[*b"0123456789abcdefghijklmnopqrstuvwxyz", *range(128, 256)]] = True


def crc_steps() -> np.ndarray:
    """The reflected CRC-32's state after each byte value, from state 0."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, table >> 1 ^ np.uint32(0xEDB88320), table >> 1)
    return table


STEPS = crc_steps()


def advance(state: np.ndarray, data: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """CRC states after reading length bytes from each start, all starts a byte at a time.

    Words are put in the order of their length, so those still being read are the first ones.
    Few words are longer than LONG; zlib reads what is left of each.
    """
    key = -np.minimum(length, LONG + 1).astype(np.int16)
    order = np.argsort(key, kind="stable")
    key, now, at, size = key[order], state[order], start[order], length[order]
    for k in range(LONG):
        if not (n := int(np.searchsorted(key, -k, "left"))):
            break
        now[:n] = STEPS[(now[:n] ^ data[at[:n] + k]) & 255] ^ now[:n] >> 8
    for i in range(np.count_nonzero(size > LONG)):
        now[i] = ~np.uint32(zlib.crc32(data[at[i] + LONG : at[i] + size[i]], int(~now[i])))
    out = np.empty_like(now)
    out[order] = now
    return out


def words(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(lower-cased bytes, starts of words, ends of words) of documents that lie one after the other between starts and ends."""
    data = LOWER[raw]
    inside = IN_WORD[data]
    before, after = np.zeros_like(inside), np.zeros_like(inside)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    some = ends > starts
    before[starts[some]] = after[ends[some] - 1] = False
    return data, np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1


def features(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(documents, buckets of their words, buckets of the pairs that end in them or -1), a block of words at a time."""
    data, begin, end = words(raw, starts, ends)
    owner = np.searchsorted(starts, begin, "right") - 1
    # of documents that start at one place only the last isn't empty, and that is the one found
    last, last_owner = np.empty(0, np.uint32), -1
    for at in range(0, len(begin), BLOCK):
        b, n, doc = begin[at : at + BLOCK], (end - begin)[at : at + BLOCK], owner[at : at + BLOCK]
        single = advance(np.full(len(b), 0xFFFFFFFF, np.uint32), data, b, n)
        previous = np.concatenate([last if at else single[:1], single[:-1]])
        joined = np.concatenate([[last_owner], doc[:-1]]) == doc
        spaced = STEPS[(previous ^ np.uint32(32)) & 255] ^ previous >> 8
        pair = np.full(len(b), -1, np.int64)
        pair[joined] = ~advance(spaced[joined], data, b[joined], n[joined]) % np.uint32(buckets)
        yield doc, (~single % np.uint32(buckets)).astype(np.int64), pair
        last, last_owner = single[-1:], doc[-1]


def _pieces(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(bytes, starts, ends) of texts in turn: about PIECE bytes of them, or one longer text."""
    texts = texts.cast(pa.large_binary())
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    i = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(at, at[i] + PIECE, "right")) - 1)
        yield raw[at[i] : at[j]], at[i:j] - at[i], at[i + 1 : j + 1] - at[i]
        i = j


def counts(docs: DataFrame, text: str = "text", buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n): how many features of all texts fall into each bucket; buckets without any have no row.

    A null or empty text has no features; repeated rows count each time; an empty table gives
    an empty one. Each partition hands on one number a bucket.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for piece in _pieces(batch.column(0)):
                for _, single, pair in features(*piece, buckets):
                    total += np.bincount(single, minlength=buckets) + np.bincount(pair[pair >= 0], minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], ["bucket", "n"])

    return docs.select(text_of(text).alias("text")).mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(docs: DataFrame, target: DataFrame, text: str = "text", target_text: str = "text", buckets: int = BUCKETS) -> np.ndarray:
    """What a feature of each bucket adds to a weight: a thousand times the logarithm of how much likelier the target has it, with one more in each bucket.

    One number a bucket is brought to the driver.
    """
    both = counts(docs, text, buckets).select("bucket", F.col("n").alias("s"), F.lit(0).cast("long").alias("t"))
    both = both.unionByName(counts(target, target_text, buckets).select("bucket", F.lit(0).cast("long").alias("s"), F.col("n").alias("t")))
    s, t = np.zeros(buckets), np.zeros(buckets)
    for row in both.groupBy("bucket").agg(F.sum("s").alias("s"), F.sum("t").alias("t")).collect():
        s[row["bucket"]], t[row["bucket"]] = row["s"], row["t"]
    ratio = (t + 1) * (s.sum() + buckets) / ((s + 1) * (t.sum() + buckets))
    return np.array([math.floor(1000 * math.log(r)) for r in ratio], np.int64)


def weigh(docs: DataFrame, gain: np.ndarray, text: str = "text", out: str = "importance") -> DataFrame:
    """docs with a struct `out` of n_words, n_features and weight, the mean gain of the features rounded down.

    A null or empty text has no features and weight 0. Rows are independent: repeated ones get
    equal results; a column `out` that is there already is replaced, others stay; an empty
    table gives an empty one.
    """
    shared = docs.sparkSession.sparkContext.broadcast(gain)
    kind = pa.struct([("n_words", pa.int64()), ("n_features", pa.int64()), ("weight", pa.int64())])

    def one(texts: pa.Array) -> pa.Array:
        gain, rows = shared.value, []
        for raw, starts, ends in _pieces(texts):
            n, pairs, total = (np.zeros(len(starts), np.int64) for _ in range(3))
            for doc, single, pair in features(raw, starts, ends, len(gain)):
                some = pair >= 0
                n += np.bincount(doc, minlength=len(n))
                pairs += np.bincount(doc[some], minlength=len(n))
                np.add.at(total, doc, gain[single])
                np.add.at(total, doc[some], gain[pair[some]])
            rows.append((n, n + pairs, total // np.maximum(n + pairs, 1)))
        columns = [np.concatenate(c) for c in zip(*rows, strict=True)] if rows else [np.empty(0, np.int64)] * 3
        return pa.StructArray.from_arrays([pa.array(c) for c in columns], fields=list(kind))

    @F.arrow_udf("n_words long, n_features long, weight long")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield one(batch)

    return docs.withColumn(out, run(text_of(text)))


def chance(doc_id: Column, seed: str = SEED) -> Column:
    """A thousand times a Gumbel variate, rounded down, from the id's hash; adding it to weights makes the highest ones a draw without replacement. A null id counts as an empty one."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("long")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0)))).cast("long")


def resample(docs: DataFrame, target: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: str = SEED) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of every row of docs, in the order of a draw towards the texts of target.

    Of the rows with at least least_words words, percent in a hundred (rounded down) are drawn:
    those of the highest score, of equals the smaller id, a null id before all others; they
    have a rank from 1, the others none. A null or empty text has weight 0. Repeated rows are
    drawn each for itself. An empty table gives an empty one; an empty target makes no feature
    likelier than its bucket's share.
    """
    kept = docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_of(text).alias("text"))
    found = weigh(kept, gains(kept, target, "text", text)).select("doc_id", "importance.*")
    scored = stored(found.select("doc_id", "n_words", "n_features", "weight", (F.col("weight") + chance(F.col("doc_id"), seed)).alias("score")))
    eligible = scored.where(F.col("n_words") >= least_words)
    drawn = percent * eligible.count() // 100
    ranked = numbered(eligible.withColumn("down", -F.col("score")), ["down", "doc_id", "n_features", "weight"], "place")
    rank = F.when(F.col("place") <= drawn, F.col("place")).cast("long")
    rest = scored.where(F.col("n_words") < least_words)
    columns = ["doc_id", "n_features", "weight", "score"]
    return ranked.select(*columns, rank.alias("rank")).unionByName(rest.select(*columns, F.lit(None).cast("long").alias("rank")))


def _runs(table: str, key: str) -> str:
    """SQL of (row, key, f): the words of each text of a table, and its pairs of consecutive words."""
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    listed = rf"SELECT row_number() OVER () AS row, {key}, coalesce(regexp_extract_all({lower}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM {table}"
    return f"SELECT row, {key}, w, w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) AS f FROM ({listed})"


#: The SQL of what op11_resampling returns; the CRC is reduced over the bytes of each distinct feature.
ORACLE = f"""
WITH steps AS (SELECT list(x ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS x FROM range(256) r(i))),
d AS (SELECT row, doc_id, len(w) AS n_words, f FROM ({_runs("documents", "doc_id")})),
df AS (SELECT row, unnest(f) AS f FROM d), tf AS (SELECT unnest(f) AS f FROM ({_runs("benchmark", "item_id")})),
b AS (SELECT f, xor(list_reduce(list_prepend(4294967295, list_transform(range(1, len(hex(f)), 2), lambda i: ('0x' || substr(hex(f), i, 2))::BIGINT)), lambda c, x: xor(t[(xor(c, x) & 255) + 1], c >> 8)), 4294967295) % {BUCKETS} AS b FROM (SELECT f FROM df UNION SELECT f FROM tf), steps),
s AS (SELECT b, count(*) AS n FROM df JOIN b USING (f) GROUP BY b), t AS (SELECT b, count(*) AS n FROM tf JOIN b USING (f) GROUP BY b),
g AS (SELECT b.b, floor(1000 * ln((coalesce(t.n, 0) + 1)::DOUBLE * ((SELECT count(*) FROM df) + {BUCKETS}) / ((coalesce(s.n, 0) + 1)::DOUBLE * ((SELECT count(*) FROM tf) + {BUCKETS}))))::BIGINT AS g FROM (SELECT DISTINCT b FROM b) b LEFT JOIN s USING (b) LEFT JOIN t USING (b)),
m AS (SELECT row, sum(g)::BIGINT AS total, count(*) AS n FROM df JOIN b USING (f) JOIN g USING (b) GROUP BY row),
w AS (SELECT doc_id, n_words, len(f) AS n_features, CASE WHEN n IS NULL THEN 0 ELSE (total - ((total % n) + n) % n) // n END AS weight FROM d LEFT JOIN m USING (row)),
c AS (SELECT *, (weight + floor(-1000 * ln(-ln((('0x' || substr(sha256('{SEED}:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296))))::BIGINT AS score FROM w),
r AS (SELECT *, CASE WHEN n_words >= {LEAST_WORDS} THEN row_number() OVER (PARTITION BY n_words >= {LEAST_WORDS} ORDER BY score DESC, doc_id NULLS FIRST, n_features, weight) END AS place FROM c)
SELECT doc_id, n_features::BIGINT AS n_features, weight, score, CASE WHEN place <= {PERCENT} * (SELECT count(*) FROM c WHERE n_words >= {LEAST_WORDS}) // 100 THEN place END AS rank FROM r
"""
