"""Ranked lexical search over a bit-sliced impact index.

Documents come in blocks, in the order of their ids. A term's impacts on the documents of a
block, its weight times its quotient of frequency and length, are kept by their bits: a slice for each
binary digit, a bitmap over documents. Only words of 64 documents that hold the term are kept. An item's
scores are sums of its terms' impacts, made for all documents at once by adding slices with a
carry bitmap. The highest are found from the most significant slice down: candidates that
have the digit, where they aren't more than asked for, are in; where they are more, they alone go on.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loadscope.llm.common import stored, text_of

TOP = 50
#: Terms of a lower-cased text: digits, letters, bytes of characters beyond ASCII.
TERM = re.compile(rb"[0-9a-z\x80-\xff]+")
#: Bytes of a text whose terms are listed at once.
PIECE = 1 << 20
#: A block ends at so many documents or postings.
MOST_DOCS, MOST_POSTINGS = 16_384, 1 << 20
#: Items and bytes of their texts that are answered in one pass over the documents.
MOST_ITEMS, MOST_BYTES = 1024, 8 << 20
#: Tasks that an item's candidates meet in before the last.
SLOTS = 64
#: The SQL of what op13_search returns.
ORACLE = rf"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
tf AS (SELECT row, doc_id, term, count(*) AS tf FROM d GROUP BY ALL),
n AS (SELECT row, sum(tf)::BIGINT AS n FROM tf GROUP BY row),
s AS (SELECT count(*)::BIGINT AS n_docs, sum(n)::BIGINT AS l FROM n),
w AS (SELECT term, floor(1000 * ln((2 * n_docs + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM tf, s GROUP BY term, n_docs),
i AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
m AS (SELECT row, 100 - 50 + (50 * n * n_docs) // l AS m FROM n, s),
x AS (SELECT item_id, row, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m)))::BIGINT AS score FROM i JOIN w USING (term) JOIN tf USING (term) JOIN m USING (row) GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank FROM x WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= {TOP}
"""


def terms(raw: bytes) -> Iterator[list[bytes]]:
    """The terms of a text, A to Z lower-cased, some PIECE bytes of it at a time."""
    at = 0
    while at < len(raw):
        end = at + PIECE
        if end < len(raw):
            while end < len(raw) and (raw[end] >= 128 or raw[end : end + 1].isalnum()):
                end += 1
        yield TERM.findall(raw[at:end].lower())
        at = end


def postings(docs: DataFrame, known: list[bytes], doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n, terms, tfs): of every text that has a term, how many it has, and which of the known ones how often. Stored."""
    number = docs.sparkSession.sparkContext.broadcast({t: i for i, t in enumerate(known)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = number.value
        for batch in batches:
            ids, sizes, found, often, ends = [], [], [], [], [0]
            for doc, raw in zip(batch.column(0), batch.column(1), strict=True):
                every: Counter[bytes] = Counter()
                n = 0
                for part in terms(raw.as_py()):
                    n += len(part)
                    # of a long text only the known terms are carried on
                    counted = Counter(part)
                    for t in counted.keys() & of.keys():
                        every[t] += counted[t]
                if n:
                    ids.append(doc.as_py())
                    sizes.append(n)
                    found += [of[t] for t in every]
                    often += every.values()
                    ends.append(len(found))
            offsets = pa.array(ends, pa.int32())
            columns = [pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.ListArray.from_arrays(offsets, pa.array(found, pa.int32())), pa.ListArray.from_arrays(offsets, pa.array(often, pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n", "terms", "tfs"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_of(text).cast("binary").alias("text"))
    return stored(rows.mapInArrow(run, "doc_id long, n long, terms array<int>, tfs array<long>"))


class Block:
    """The index of one block: for each term the words of 64 documents it is in, and its impacts' slices over them."""

    def __init__(self, ids: np.ndarray, null: np.ndarray, lengths: np.ndarray, term: np.ndarray, impact: np.ndarray):
        """Documents are put in the order of their ids, a null one first; of the postings (term, impact) each document has lengths in turn."""
        order = np.lexsort((ids, ~null))
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        self.ids, self.null = ids[order], null[order]
        self.words = -(-len(ids) // 64)
        at = np.repeat(place, lengths)
        some = impact > 0
        term, at, impact = term[some], at[some], impact[some]
        by = np.lexsort((at, term))
        term, at, impact = term[by], at[by], impact[by]
        cuts = [*np.flatnonzero(np.diff(term, prepend=-1)), len(term)]
        self.terms: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for a, b in pairwise(cuts):
            self.terms[int(term[a])] = self.sliced(at[a:b], impact[a:b])

    @staticmethod
    def sliced(at: np.ndarray, impact: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(words, slices): bit d of word w of slice b is bit b of the impact on document 64 * words[w] + d."""
        words, place = np.unique(at >> 6, return_inverse=True)
        slices = np.zeros((int(impact.max()).bit_length(), len(words)), np.uint64)
        bit = np.uint64(1) << (at & 63).astype(np.uint64)
        for b in range(len(slices)):
            has = (impact >> b & 1).astype(bool)
            np.bitwise_or.at(slices[b], place[has], bit[has])
        return words, slices

    def add(self, wanted: list[int]) -> np.ndarray:
        """The slices of the sums of these terms' impacts on every document of the block."""
        found = [self.terms[t] for t in wanted if t in self.terms]
        height = sum(1 << len(s) for _, s in found).bit_length()
        total = np.zeros((height, self.words), np.uint64)
        for words, slices in found:
            whole = len(words) == self.words
            carry = np.zeros(len(words), np.uint64)
            for b in range(height):
                row = total[b]
                if b >= len(slices) and not carry.any():
                    break
                own = row if whole else row[words]
                if b < len(slices):
                    half = own ^ slices[b]
                    row[... if whole else words], carry = half ^ carry, own & slices[b] | half & carry
                else:
                    row[... if whole else words], carry = own ^ carry, own & carry
        return total

    def top(self, total: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(places, scores) of the k documents with the highest sum above zero, of equals those with the smaller id; in no order."""
        inside = np.zeros(self.words, np.uint64)
        equal = np.bitwise_or.reduce(total, axis=0) if len(total) else inside
        n = 0
        for row in total[::-1]:
            has = equal & row
            if n + (some := int(np.bitwise_count(has).sum())) > k:
                equal = has
            else:
                inside |= has
                equal &= ~row
                n += some
        rest = _places(equal)[: k - n]
        at = np.concatenate([_places(inside), rest])
        shift = (at & 63).astype(np.uint64)
        scores = np.zeros(len(at), np.int64)
        for b, row in enumerate(total):
            scores |= (row[at >> 6] >> shift & np.uint64(1)).astype(np.int64) << b
        some = scores > 0
        return at[some], scores[some]


def _places(bitmap: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(bitmap.astype("<u8").view(np.uint8), bitorder="little"))


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows of postings together until one of a block's bounds is reached."""
    held, docs, entries = [], 0, 0
    for batch in batches:
        ends = np.cumsum(batch.column(2).value_lengths().to_numpy(zero_copy_only=False)) if len(batch) else np.empty(0, np.int64)
        at = 0
        while at < len(batch):
            before = ends[at - 1] if at else 0
            to = min(len(batch), at + MOST_DOCS - docs, max(at + 1, int(np.searchsorted(ends, before + MOST_POSTINGS - entries, "right"))))
            held.append(batch.slice(at, to - at))
            docs, entries, at = docs + to - at, entries + int(ends[to - 1] - before), to
            if docs >= MOST_DOCS or entries >= MOST_POSTINGS or at < len(batch):
                yield pa.Table.from_batches(held)
                held, docs, entries = [], 0, 0
    if held:
        yield pa.Table.from_batches(held)


def best(found: DataFrame, items: list[list[int]], weights: np.ndarray, n_docs: int, n_terms: int, top: int) -> DataFrame:
    """(item, doc_id, score): the top documents of each item, given as numbers of terms, in each partition of postings."""
    shared = found.sparkSession.sparkContext.broadcast((items, weights))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, weights = shared.value
        kept: list[pd.DataFrame] = []
        for part in _blocks(batches):
            part = part.combine_chunks()
            ids, n = part["doc_id"].fill_null(0).to_numpy(), part["n"].to_numpy()
            lists = part["terms"].combine_chunks()
            lengths = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            term, tf = lists.flatten().to_numpy(), part["tfs"].combine_chunks().flatten().to_numpy()
            m = np.repeat(50 + np.array([50 * int(x) * n_docs // n_terms for x in n], np.int64), lengths)
            impact = weights[term] * (1_000_000_000 * tf // (1000 * tf + 20 * m))
            block = Block(ids, part["doc_id"].is_null().to_numpy(), lengths, term, impact)
            for i, wanted in enumerate(items):
                at, score = block.top(block.add(wanted), top)
                kept.append(pd.DataFrame({"item": np.full(len(at), i), "null": block.null[at], "doc_id": block.ids[at], "score": score}))
            if len(kept) > 8 * len(items):
                kept = [_first(kept, top)]
        last = _first(kept, top) if kept else pd.DataFrame({"item": [], "null": [], "doc_id": [], "score": []})
        ids = pa.array(last["doc_id"].to_numpy(np.int64), mask=last["null"].to_numpy(bool))
        yield pa.RecordBatch.from_arrays([pa.array(last["item"].to_numpy(np.int32)), ids, pa.array(last["score"].to_numpy(np.int64))], ["item", "doc_id", "score"])

    return found.mapInArrow(run, "item int, doc_id long, score long")


def _first(kept: list[pd.DataFrame], top: int) -> pd.DataFrame:
    every = pd.concat(kept, ignore_index=True).sort_values(["item", "score", "null", "doc_id"], ascending=[True, False, False, True], kind="stable")
    return every[every.groupby("item").cumcount() < top]


def _passes(items: DataFrame) -> Iterator[list]:
    """Items in turn, as many as one pass answers."""
    held, size = [], 0
    for row in items.toLocalIterator():
        if held and (len(held) >= MOST_ITEMS or size + len(row["text"]) > MOST_BYTES):
            yield held
            held, size = [], 0
        held.append(row)
        size += len(row["text"])
    if held:
        yield held


def search(docs: DataFrame, items: DataFrame, top: int = TOP, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): the documents of the highest score above zero for each item, `top` at most.

    Of equal scores the smaller doc_id ranks first, a null one before all others. A null or empty text has no
    terms: such a document is not counted, such an item has no rows. Repeated rows are
    documents, or items, each for itself; other columns are left out; an empty table on either
    side gives an empty result. Items are a stated set: they are answered MOST_ITEMS at a time, each time
    against all documents.
    """
    spark = docs.sparkSession
    out = None
    for rows in _passes(items.select(F.col(item_id).alias("item_id"), text_of(item_text).cast("binary").alias("text"))):
        words = [{t for part in terms(bytes(r["text"])) for t in part} for r in rows]
        known = sorted(set().union(*words))
        number = {t: i for i, t in enumerate(known)}
        found = postings(docs, known, doc_id, text)
        n_docs, n_terms = found.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        holding = np.zeros(len(known), np.int64)
        for r in found.select(F.explode("terms").alias("term")).groupBy("term").count().collect():
            holding[r["term"]] = r["count"]
        weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(df) + 1))) for df in holding], np.int64)
        # blocks are worth their slices when they are full
        tasks = max(spark.sparkContext.defaultParallelism, -(-n_docs // MOST_DOCS))
        parts = best(found.coalesce(tasks), [sorted(number[t] for t in w) for w in words], weights, n_docs, n_terms, top)
        order = [F.col("score").desc(), F.col("doc_id").asc_nulls_first()]
        few = parts.withColumn("slot", F.spark_partition_id() % SLOTS).withColumn("place", F.row_number().over(Window.partitionBy("item", "slot").orderBy(*order))).where(F.col("place") <= top)
        rank = few.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).where(F.col("rank") <= top)
        kind = f"item int, item_id {items.schema[item_id].dataType.simpleString()}"
        names = spark.createDataFrame([(i, r["item_id"]) for i, r in enumerate(rows)], kind)
        one = rank.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")
        out = one if out is None else out.unionByName(one)
    if out is None:
        kind = items.schema[item_id].dataType.simpleString()
        out = spark.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")
    return out
