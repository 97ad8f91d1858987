"""Toxicity by the nearest labelled examples under TF-IDF cosine, found with a block-max inverted index.

The examples are a bounded sample of labelled rows, and every word of theirs is a term: none
is left out. A term weighs its inverse document frequency over all documents, more if its
presence goes with either label among the examples and a fraction of that (FLOOR) if not.
Vectors are over the examples' terms. The index keeps each term's postings by blocks of like
examples, with the largest weight of each block. A text's nearest examples are exact: a few
blocks of the largest bound are looked at first, then all whose bound reaches the last of the
nearest so far.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loadscope.llm.common import labelled, text_of
from loadscope.llm.embed import centres, unit
from loadscope.llm.quality import _platt, _sigmoid

#: Labelled rows in the index at most, those of the smallest hash of their id, and bytes of their texts together.
MAX_EXAMPLES, MAX_BYTES = 4000, 32 << 20
#: Share of its idf that a term keeps whose presence says nothing, and the standard errors from and over which it says more.
FLOOR, FROM, OVER = 0.05, 3.0, 3.0
#: Neighbours that vote, examples of a block, and blocks that are looked at first.
NEIGHBOURS, BLOCK, FIRST = 15, 32, 4
#: One of how many examples has a term whose postings are a dense row; texts looked up at once.
FREQUENT, BATCH = 16, 128

WORD = re.compile(r"[^\W\d_]+")


def words(text: str) -> list[str]:
    return WORD.findall(text.lower())


def label_weights(rows: Sequence[np.ndarray], y: np.ndarray, n_terms: int) -> np.ndarray:
    """Of each term a factor from FLOOR to 1 by the log odds of the labels where it is present, in standard errors; texts of the same terms and label count once."""
    seen = {(row.tobytes(), label): row for row, label in zip(rows, y.tolist(), strict=True)}
    counts, sizes = np.zeros((2, n_terms)), np.zeros(2)
    for (_, label), row in seen.items():
        counts[label, row] += 1
        sizes[label] += 1
    a, b = counts[1] + 0.5, counts[0] + 0.5
    errors = np.abs(np.log(a / (sizes[1] + 1)) - np.log(b / (sizes[0] + 1))) / np.sqrt(1 / a + 1 / b)
    return FLOOR + (1 - FLOOR) * np.clip((errors - FROM) / OVER, 0, 1)


def _spread(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The numbers of all ranges, one after the other."""
    n = ends - starts
    return np.arange(n.sum()) + np.repeat(starts - np.cumsum(n) + n, n)


@dataclass
class Index:
    """Examples as unit TF-IDF vectors, in postings by term and block."""

    terms: dict[str, int]
    weights: np.ndarray
    ids: np.ndarray
    labels: np.ndarray
    slope: float = 1.0
    offset: float = 0.0
    row_of: np.ndarray = field(default=None)  # of a term: its dense row, or -1
    dense: np.ndarray = field(default=None)
    of_term: np.ndarray = field(default=None)  # where another term's entries begin
    blocks: np.ndarray = field(default=None)  # of an entry: its block, largest weight and where its postings begin
    tops: np.ndarray = field(default=None)
    begins: np.ndarray = field(default=None)
    who: np.ndarray = field(default=None)  # of a posting: the example and its weight
    what: np.ndarray = field(default=None)

    def vector(self, tokens: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Term numbers in order and their weights, (1 + log tf) times the term's, of length 1."""
        known = self.terms
        tf = {known[w]: n for w, n in Counter(tokens).items() if w in known}
        at = np.fromiter(tf.keys(), np.int64, len(tf))
        order = np.argsort(at)
        at = at[order]
        v = (1 + np.log(np.fromiter(tf.values(), np.float64, len(tf))[order])) * self.weights[at]
        return at, v / np.sqrt((v * v).sum()) if len(at) else v

    def build(self, rows: Sequence[str]) -> Index:
        """Like examples stand together, so that block bounds are tight: by label, then by k-means cell of the vectors folded to 256 places."""
        vectors = [self.vector(words(r)) for r in rows]
        folded = np.zeros((len(rows), 256))
        for i, (at, v) in enumerate(vectors):
            np.add.at(folded[i], at % 256, v)
        cells = (folded @ centres(unit(folded), max(1, len(rows) // BLOCK)).T).argmax(axis=1) if len(rows) else np.empty(0, np.int64)
        order = np.lexsort((self.ids, cells, self.labels))
        self.ids, self.labels = self.ids[order], self.labels[order]
        vectors = [vectors[i] for i in order.tolist()]
        term = np.concatenate([np.empty(0, np.int64), *[at for at, _ in vectors]])
        who = np.repeat(np.arange(len(vectors)), [len(at) for at, _ in vectors])
        what = np.concatenate([np.empty(0), *[v for _, v in vectors]])
        frequent = np.flatnonzero(np.bincount(term, minlength=len(self.terms)) * FREQUENT > len(rows))
        self.row_of = np.full(len(self.terms), -1)
        self.row_of[frequent] = np.arange(len(frequent))
        self.dense = np.zeros((len(frequent), -(-len(rows) // BLOCK) * BLOCK))
        own = self.row_of[term] >= 0
        self.dense[self.row_of[term[own]], who[own]] = what[own]
        order = np.lexsort((who[~own], term[~own]))
        term, self.who, self.what = term[~own][order], who[~own][order], what[~own][order]
        key = term * (len(rows) // BLOCK + 1) + self.who // BLOCK
        self.begins = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.empty(0, np.int64)
        self.tops = np.maximum.reduceat(self.what, self.begins) if len(key) else np.empty(0)
        self.blocks = self.who[self.begins] // BLOCK
        self.of_term = np.searchsorted(term[self.begins], np.arange(len(self.terms) + 1))
        self.begins = np.append(self.begins, len(key))
        return self

    def nearest(self, vectors: list[tuple[np.ndarray, np.ndarray]], k: int = NEIGHBOURS, skip: Sequence[int] = ()) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each vector the k examples of the largest cosine above 0 (ties: the smallest id) and their cosines; its example of skip is left out."""
        n = self.dense.shape[1]
        for first in range(0, len(vectors), BATCH):
            some = vectors[first : first + BATCH]
            known = np.zeros((len(some), len(self.dense)))
            for i, (at, v) in enumerate(some):
                rows = self.row_of[at]
                known[i, rows[rows >= 0]] = v[rows >= 0]
            base = known @ self.dense
            tops = base.reshape(len(some), n // BLOCK, BLOCK).max(axis=2) if n else base
            for i, (at, v) in enumerate(some):
                rare = self.row_of[at] < 0
                yield self._nearest(at[rare], v[rare], base[i], tops[i], k, skip[first + i] if len(skip) else -1)

    def _nearest(self, at: np.ndarray, v: np.ndarray, base: np.ndarray, tops: np.ndarray, k: int, skip: int) -> tuple[np.ndarray, np.ndarray]:
        starts, ends = self.of_term[at], self.of_term[at + 1]
        entries = _spread(starts, ends)
        x = np.repeat(v, ends - starts)
        block = self.blocks[entries]
        bound = tops + np.bincount(block, x * self.tops[entries], len(tops))
        sims = np.zeros(len(base))

        def add(chosen: np.ndarray) -> float:
            own = chosen[block]
            s, e = self.begins[entries[own]], self.begins[entries[own] + 1]
            p = _spread(s, e)
            found = np.bincount(self.who[p], np.repeat(x[own], e - s) * self.what[p], len(base)) + base
            by_block = sims.reshape(-1, BLOCK)
            by_block[chosen] = found.reshape(-1, BLOCK)[chosen]
            if skip >= 0:
                sims[skip] = 0
            return float(np.partition(sims, -k)[-k]) if len(sims) >= k else 0.0

        first = np.zeros(len(tops), bool)
        first[np.argpartition(-bound, FIRST)[:FIRST] if len(bound) > FIRST else slice(None)] = True
        last = add(first)
        last = add(~first & (bound > 0) & (bound >= last - 1e-9))
        found = np.flatnonzero((sims > 1e-12) & (sims >= last - 1e-12))
        near = np.round(sims[found], 12)
        order = np.lexsort((self.ids[found], -near))[:k]
        return found[order], near[order]

    def margin(self, who: np.ndarray, near: np.ndarray) -> float:
        """Votes by the square of the cosine: from -1 to 1, and 0 without a neighbour."""
        if not len(who):
            return 0.0
        w = near * near
        return float((w * (2 * self.labels[who] - 1)).sum() / w.sum())

    def calibrate(self, rows: Sequence[str]) -> Index:
        """The logistic curve through each example's margin among the others; rows: the examples' texts by id."""
        place = {int(i): k for k, i in enumerate(self.ids)}
        margins = np.zeros(len(self.ids))
        vectors = [self.vector(words(text)) for _, text in rows]
        own = [place[i] for i, _ in rows]
        for i, found in zip(own, self.nearest(vectors, skip=own), strict=True):
            margins[i] = self.margin(*found)
        if 0 < self.labels.sum() < len(self.labels):
            self.slope, self.offset = _platt(margins, np.where(self.labels > 0, 1.0, -1.0))
        else:
            self.slope, self.offset = 0.0, (30.0 if len(self.labels) and self.labels[0] else -30.0 if len(self.labels) else 0.0)
        return self

    def score(self, texts: Sequence[str]) -> list[tuple[float, list[int], list[float]]]:
        found = self.nearest([self.vector(words(t)) for t in texts])
        return [(float(_sigmoid(np.array(self.slope * self.margin(who, near) + self.offset))), self.ids[who].tolist(), near.tolist()) for who, near in found]


def document_frequencies(docs: DataFrame, terms: list[str], text: str = "text") -> tuple[int, np.ndarray]:
    """Of all documents: how many there are, and how many have each term."""
    shared = docs.sparkSession.sparkContext.broadcast({w: i for i, w in enumerate(terms)})

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, n, found = shared.value, 0, np.zeros(len(shared.value), np.int64)
        for batch in batches:
            n += len(batch)
            for t in batch["text"]:
                found[[known[w] for w in set(words(t)) if w in known]] += 1
        at = np.flatnonzero(found)
        yield pd.DataFrame({"term": np.append(at, -1), "n": np.append(found[at], n)})

    # as many rows as terms, which the bytes of the sample bound
    sums = docs.select(text_of(text).alias("text")).mapInPandas(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(len(terms), np.int64)
    known = sums[sums["term"] >= 0]
    out[known["term"].to_numpy(np.int64)] = known["n"].to_numpy(np.int64)
    return int(sums.loc[sums["term"] < 0, "n"].sum()), out


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", doc_id: str = "doc_id", text: str = "text", max_examples: int = MAX_EXAMPLES, max_bytes: int = MAX_BYTES) -> Index:
    """An index over labelled rows, max_examples and max_bytes of text at most (labels: rows that may be learnt from; see common.labelled)."""
    found = labelled(docs, labels, label, doc_id, text, max_examples, max_bytes).select("key", "y", "text").toPandas().sort_values("key")
    rows, y = found["text"].tolist(), (found["y"].to_numpy(np.int64) > 0).astype(np.int64)
    tokens = [set(words(r)) for r in rows]
    terms = {w: i for i, w in enumerate(sorted(set().union(*tokens)))}
    n, df = document_frequencies(docs, list(terms), text)
    sets = [np.sort(np.fromiter((terms[w] for w in t), np.int64, len(t))) for t in tokens]
    weights = (np.log((n + 1) / (df + 1)) + 1) * label_weights(sets, y, len(terms))
    ids = found["key"].to_numpy(np.int64)
    return Index(terms, weights, ids, y).build(rows).calibrate(list(zip(ids.tolist(), rows, strict=True)))


def score(docs: DataFrame, index: Index, text: str = "text", out: str = "toxicity") -> DataFrame:
    """docs with a struct `out` of each whole text: score from 0 to 1, its nearest examples' ids and their cosines.

    A text without any word of the examples (a null or empty one too) has no neighbours and
    scores what that means in the sample. Rows are independent; an empty table gives an
    empty one; a column `out` that is there already is replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(index)

    @F.pandas_udf("score double, examples array<long>, cosines array<double>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame(shared.value.score(batch.tolist()), columns=["score", "examples", "cosines"])

    return docs.withColumn(out, run(text_of(text)))
