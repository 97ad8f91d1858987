"""Quality: a linear hinge-loss model over n-gram indicators scaled by naive Bayes log-count ratios.

A text's n-grams are taken over three streams: its characters by shape (letters by case,
digits, white space, each punctuation mark as itself), its words by shape, and whether
each word repeats the one before. No word is seen as itself, and n-grams share BUCKETS
hashed places, so some collide. An n-gram counts once a text. Weights come from dual
coordinate descent over a bounded sample of labelled rows; scores are its margins through
a logistic curve fitted on the same sample's left-out margins.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loadscope.llm.common import each_value, labelled, text_of

#: Buckets of the hashed n-grams.
BUCKETS = 1 << 16
#: Labelled rows that the model is fitted on at most: those of the smallest hash of their id.
MAX_TRAIN = 6000
#: Bytes of their texts at most.
MAX_BYTES = 32 << 20
#: Characters shaped at once, with an overlap, whatever a text's length.
CHUNK = 1 << 20
CHAR_N, WORD_N, REPEAT_N = (1, 2, 3, 4), (1, 2), (2, 4, 8, 16)


def _shapes() -> np.ndarray:
    table = np.arange(256, dtype=np.uint64)
    table[ord("a") : ord("z") + 1] = ord("a")
    table[ord("A") : ord("Z") + 1] = ord("A")
    table[ord("0") : ord("9") + 1] = ord("0")
    table[128:192] = 2  # continues a character
    table[192:] = ord("a")
    for c in b" \t\r\x0b\x0c":
        table[c] = ord(" ")
    return table


SHAPES = _shapes()
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def _bucket(codes: np.ndarray, salt: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return ((codes + np.uint64(salt)) * MULTIPLIER >> np.uint64(48)).astype(np.int64) % BUCKETS


def indicators(text: str, seen: np.ndarray) -> np.ndarray:
    """The sorted buckets of a whole text's n-grams. seen: BUCKETS bools, all False, and left so."""
    raw = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    for at in range(0, len(raw), CHUNK):
        s = SHAPES[raw[max(0, at - 64) : at + CHUNK]]
        s = s[s != 2]
        code = np.zeros(len(s), np.uint64)
        for n in range(1, max(CHAR_N) + 1):
            if len(s) < n:
                break
            code = (code[: len(s) - n + 1] << np.uint64(8)) | s[n - 1 :]
            if n in CHAR_N:
                seen[_bucket(code, n * 7919)] = True
    words = text.split()
    if words:
        # a word's shape: its first and last character's, and its length up to 15
        size = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(size)
        flat = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
        shape = SHAPES[np.where(flat < 128, flat, 255)]
        token = shape[ends - size] << np.uint64(16) | shape[ends - 1] << np.uint64(8) | np.minimum(size, 15).astype(np.uint64)
        code = np.zeros(len(words), np.uint64)
        for n in range(1, max(WORD_N) + 1):
            if len(words) < n:
                break
            code = (code[: len(words) - n + 1] << np.uint64(24)) | token[n - 1 :]
            seen[_bucket(code, n * 104729)] = True
        same = np.fromiter((a == b for a, b in zip(words, words[1:], strict=False)), np.int64, len(words) - 1)
        total = np.concatenate([[0], np.cumsum(same)])
        for n in REPEAT_N:
            if len(same) >= n:
                for all_same in np.unique(total[n:] - total[:-n] == n).tolist():
                    seen[int(_bucket(np.array([n * 2 + all_same], np.uint64), 1299709)[0])] = True
    out = np.flatnonzero(seen)
    seen[out] = False
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _platt(margins: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the logistic curve through margins, by Newton steps on smoothed targets."""
    up, down = (y > 0).sum(), (y <= 0).sum()
    t = np.where(y > 0, (up + 1) / (up + 2), 1 / (down + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = _sigmoid(a * margins + b)
        w = p * (1 - p) + 1e-9
        g = np.array([((t - p) * margins).sum() - 1e-3 * a, (t - p).sum()])
        h = np.array([[(w * margins * margins).sum() + 1e-3, (w * margins).sum()], [(w * margins).sum(), w.sum() + 1e-9]])
        step = np.linalg.solve(h, g)
        a, b = a + step[0], b + step[1]
        if abs(step).max() < 1e-8:
            break
    return float(max(a, 0.0)), float(b)


def log_count_ratios(rows: list[np.ndarray], y: np.ndarray) -> np.ndarray:
    counts = np.ones((2, BUCKETS))
    for x, label in zip(rows, y, strict=True):
        counts[int(label > 0), x] += 1
    counts /= counts.sum(axis=1, keepdims=True)
    return np.log(counts[1] / counts[0])


def descend(rows: list[np.ndarray], y: np.ndarray, r: np.ndarray, cost: float, passes: int = 20, seed: int = 1) -> np.ndarray:
    """Weights of the scaled indicators (the last is the offset): min |w|^2/2 + cost * hinge loss, by dual coordinate descent."""
    w, alpha = np.zeros(BUCKETS + 1), np.zeros(len(rows))
    values = [np.append(r[x], 1.0) / np.sqrt((r[x] ** 2).sum() + 1) for x in rows]
    places = [np.append(x, BUCKETS) for x in rows]
    diagonal = np.array([(v * v).sum() for v in values])
    rnd = np.random.default_rng(seed)
    upper = np.where(y > 0, cost * len(y) / (2 * max(1, (y > 0).sum())), cost * len(y) / (2 * max(1, (y <= 0).sum())))
    for _ in range(passes):
        most = 0.0
        for i in rnd.permutation(len(rows)).tolist():
            g = y[i] * (w[places[i]] @ values[i]) - 1
            a = min(max(alpha[i] - g / diagonal[i], 0.0), upper[i])
            if (d := a - alpha[i]) != 0:
                w[places[i]] += d * y[i] * values[i]
                alpha[i] = a
                most = max(most, abs(d))
        if most < 1e-3:
            break
    return w


@dataclass(frozen=True)
class Model:
    ratios: np.ndarray
    weights: np.ndarray
    slope: float
    offset: float

    def margin(self, x: np.ndarray) -> float:
        r = self.ratios[x]
        return float((r * self.weights[x]).sum() + self.weights[BUCKETS]) / float(np.sqrt((r**2).sum() + 1))

    def score(self, margins: np.ndarray) -> np.ndarray:
        return _sigmoid(self.slope * margins + self.offset)


def fit_rows(rows: list[np.ndarray], labels: list[int], cost: float = 1.0) -> Model:
    """Fitted on these rows. Without both labels every score is their mean (0.5 without rows)."""
    y = np.where(np.array(labels, int) > 0, 1.0, -1.0)
    if len(set(y.tolist())) < 2:
        return Model(np.zeros(BUCKETS), np.zeros(BUCKETS + 1), 0.0, {1.0: 30.0, -1.0: -30.0}.get(y[0], 0.0) if len(y) else 0.0)
    folds = np.arange(len(rows)) % 3
    margins = np.zeros(len(rows))
    for k in range(3):
        own = [i for i in range(len(rows)) if folds[i] != k]
        r = log_count_ratios([rows[i] for i in own], y[own])
        m = Model(r, descend([rows[i] for i in own], y[own], r, cost), 1.0, 0.0)
        for i in np.flatnonzero(folds == k):
            margins[i] = m.margin(rows[i])
    r = log_count_ratios(rows, y)
    return Model(r, descend(rows, y, r, cost), *_platt(margins, y))


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", doc_id: str = "doc_id", text: str = "text", max_train: int = MAX_TRAIN, max_bytes: int = MAX_BYTES) -> Model:
    """Fitted on labelled rows, max_train and max_bytes of text at most (labels: rows that may be learnt from; see common.labelled).

    Only the rows' n-grams reach the driver, a text's number of them at most its bytes times four.
    """

    def begin() -> Callable[[str], np.ndarray]:
        seen = np.zeros(BUCKETS, bool)
        return lambda t: indicators(t, seen).astype(np.int32)

    grams = each_value(F.col("text"), "array<int>", pa.list_(pa.int32()), begin)
    found = labelled(docs, labels, label, doc_id, text, max_train, max_bytes).select("key", "y", grams.alias("x")).toPandas().sort_values("key")
    return fit_rows([np.asarray(x, np.int64) for x in found["x"]], found["y"].tolist())


def score(docs: DataFrame, model: Model, text: str = "text", out: str = "score") -> DataFrame:
    """docs with the double `out` from 0 to 1 of each whole text: higher, label 1 is likelier.

    A null or empty text scores what no n-gram at all does. Rows are independent; an empty
    table gives an empty one; a column `out` that is there already is replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def begin() -> Callable[[str], float]:
        seen, m = np.zeros(BUCKETS, bool), shared.value
        return lambda t: m.score(np.array([m.margin(indicators(t, seen))]))[0]

    return docs.withColumn(out, each_value(text_of(text), "double", pa.float64(), begin))
