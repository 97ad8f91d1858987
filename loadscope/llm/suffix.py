"""Removal of long repeated byte strings by suffix arrays.

Of the pieces of PIECE bytes in a string of `length` bytes, the one with the smallest
hash (the first of equals) is its minimizer. Equal strings have equal minimizers at equal
offsets, so strings are dealt out by their minimizer's hash. Neighbouring strings mostly
share theirs: a run of them is one context, `length` - 1 bytes longer than the run, and
each string of a document lies in one context only. Contexts whose hash occurs once in
the corpus hold no repeat. Of the others, equal ones become one row with their count, and
the rows of a hash meet in a shard whose suffix array is sorted: a string repeats if it
starts in a context that stands for two places or more, or has a common prefix of
`length` bytes with a neighbour in the array.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loadscope.llm.common import stored, text_of

LENGTH = 200
#: Bytes of a piece: a power of two.
PIECE = 32
#: Bytes of a suffix array at most, unless one hash's contexts alone have more.
SHARD = 1 << 19
#: Contexts of one hash in a suffix array at most; the strings of a hash with more are counted by their own hashes.
BLOCK = 4000
#: Bytes of a text looked at together (and their strings' tails).
CHUNK = 1 << 20
#: Texts whose contexts are handed on at once.
HANDED = 500
#: Of places and symbols in suffix arrays: half the memory of numpy's default, and a shard has far fewer than 2^29 bytes.
PLACE = np.int32
#: Bits of the filter that spares documents without a match the join: its size doesn't depend on the data.
FILTER_BITS = 1 << 24


# ---- suffix arrays by induced sorting ----


def _types(t: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than the next (type S). The last symbol is a unique smallest one."""
    n = len(t)
    rises = np.ones(n, np.int8)
    d = np.sign(t[1:] - t[:-1]).astype(np.int8)
    rises[:-1] = d
    at = np.where(rises != 0, np.arange(n, dtype=PLACE), PLACE(n - 1))
    following = np.minimum.accumulate(at[::-1])[::-1]
    return rises[following] > 0


def _induce(t: np.ndarray, s_type: np.ndarray, lms: np.ndarray, symbols: np.ndarray) -> np.ndarray:
    """The suffix array that follows from an order of the leftmost S-suffixes.

    Bucket after bucket, upwards for L-suffixes and downwards for S-suffixes: a bucket's
    suffixes put those one place to the left into their buckets, in order; within one
    bucket this repeats along runs of its symbol.
    """
    size = int(symbols[-1]) + 1
    seeds: list[list[np.ndarray]] = [[] for _ in range(size)]
    order = np.argsort(t[lms], kind="stable")
    firsts = t[lms][order]
    for group in np.split(lms[order], np.flatnonzero(np.diff(firsts)) + 1):
        if len(group):
            seeds[t[group[0]]].append(group)

    def pushed(found: np.ndarray, want: bool, bucket: int, into: list[list[np.ndarray]]) -> np.ndarray:
        """Those one to the left of `found` and of the wanted type: other buckets' go `into` them; this bucket's are returned."""
        left = found[found > 0] - 1
        left = left[s_type[left] == want]
        c = t[left]
        own = left[c == bucket]
        left, c = left[c != bucket], c[c != bucket]
        order = np.argsort(c.astype(np.int16) if size < 32000 else c, kind="stable")
        left, c = left[order], c[order]
        cuts = np.flatnonzero(np.diff(c)) + 1
        for group in np.split(left, cuts):
            if len(group):
                into[t[group[0]]].append(group)
        return own

    larger: list[list[np.ndarray]] = [[] for _ in range(size)]
    large: list[np.ndarray] = [np.empty(0, PLACE)] * size
    for b in symbols.tolist():
        level = np.concatenate(larger[b]) if larger[b] else np.empty(0, PLACE)
        larger[b] = []
        whole = []
        while len(level):
            whole.append(level)
            level = pushed(level, False, b, larger)
        large[b] = np.concatenate(whole) if whole else np.empty(0, PLACE)
        if seeds[b]:
            pushed(np.concatenate(seeds[b]), False, b, larger)
    smaller: list[list[np.ndarray]] = [[] for _ in range(size)]
    out: list[np.ndarray] = []
    for b in symbols.tolist()[::-1]:
        # from the right: each list is in descending order
        level = np.concatenate(smaller[b]) if smaller[b] else np.empty(0, PLACE)
        smaller[b] = []
        whole = []
        while len(level):
            whole.append(level)
            level = pushed(level, True, b, smaller)
        down = large[b][::-1]
        pushed(down, True, b, smaller)
        out += [*whole, down]
        if b == 0:
            out.append(np.array([len(t) - 1], PLACE))
    return np.concatenate(out)[::-1]


def _ranked(names: np.ndarray) -> np.ndarray:
    """Suffix array of a string of names by repeated doubling: ranks of 2^i names, until all differ."""
    n = len(names)
    rank, h = names.astype(np.int64), 1
    while True:
        after = np.zeros(n, np.int64)
        after[:-h] = rank[h:] + 1
        key = rank * (n + 2) + after
        order = np.argsort(key, kind="stable")
        sorted_ = key[order]
        new = np.empty(n, np.int64)
        new[order] = np.concatenate([[0], np.cumsum(sorted_[1:] != sorted_[:-1])])
        rank = new
        if rank[order[-1]] == n - 1:
            return order.astype(PLACE)
        h *= 2


def suffix_array(t: np.ndarray) -> np.ndarray:
    """Of a string of symbols whose last is 0 and occurs once."""
    n = len(t)
    t = t.astype(PLACE)
    if n < 3:
        return np.arange(n, dtype=PLACE)[::-1].copy()
    s_type = _types(t)
    lms = np.flatnonzero(s_type[1:] & ~s_type[:-1]).astype(PLACE) + PLACE(1)
    symbols = np.unique(t)
    sorted_ = _induce(t, s_type, lms, symbols)
    is_lms = np.zeros(n, bool)
    is_lms[lms] = True
    sorted_ = sorted_[is_lms[sorted_]]
    # names of the substrings from one leftmost S-suffix to the next
    ends = np.full(n, n - 1, PLACE)
    ends[lms[:-1]] = lms[1:]
    a, b = sorted_[:-1], sorted_[1:]
    size = ends[a] - a
    differ = size != ends[b] - b
    live, k = np.flatnonzero(~differ), 0
    while len(live):
        bad = t[a[live] + k] != t[b[live] + k]
        differ[live[bad]] = True
        live = live[~bad & (k < size[live])]
        k += 1
    names = np.empty(n, PLACE)
    names[sorted_] = np.concatenate([[0], np.cumsum(differ)])
    if len(sorted_) and names[sorted_[-1]] == len(sorted_) - 1:
        return _induce(t, s_type, sorted_, symbols)
    reduced = names[lms]
    del ends, names, is_lms, sorted_, a, b, size, differ, live
    # the recursion: induced sorting again while there are few names, else doubling of their ranks
    order = suffix_array(reduced) if reduced.max() < 256 and (reduced == 0).sum() == 1 else _ranked(reduced)
    return _induce(t, s_type, lms[order], symbols)


def common_prefixes(t: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Permuted: for each place, the common prefix of its suffix with the one before it in the array.

    Only where the symbols to the left differ is it counted; elsewhere it is one less than at the place to the left.
    """
    n = len(t)
    before = np.full(n, n - 1, PLACE)
    before[order[1:]] = order[:-1]
    place = np.arange(n, dtype=PLACE)
    left = np.where(place > 0, t[place - 1], -1)
    left_before = np.where(before > 0, t[before - 1], -2)
    own = np.flatnonzero(left != left_before).astype(PLACE)
    own = own[own != order[0]]
    del left, left_before
    padded = np.concatenate([t.astype(np.uint8) if t.max() < 256 else t, np.zeros(8, t.dtype if t.max() >= 256 else np.uint8)])
    found = np.zeros(len(own), PLACE)
    live = np.arange(len(own), dtype=PLACE)
    if padded.dtype == np.uint8:  # eight at a time
        words = np.lib.stride_tricks.as_strided(padded, (n + 1, 8), (1, 1))
        while len(live):
            a, b = own[live] + found[live], before[own[live]] + found[live]
            fits = (a <= n) & (b <= n)
            live, a, b = live[fits], a[fits], b[fits]
            same = (words[a] == words[b]).all(axis=1)
            live = live[same]
            found[live] += 8
        live = np.arange(len(own), dtype=PLACE)
    while len(live):
        a, b = own[live] + found[live], before[own[live]] + found[live]
        fits = (a < n) & (b < n)
        live, a, b = live[fits], a[fits], b[fits]
        live = live[t[a] == t[b]]
        found[live] += 1
    out = np.full(n, np.iinfo(PLACE).min // 2, PLACE)
    out[own] = found + own
    out = np.maximum.accumulate(out) - place
    out[order[0]] = 0
    return np.maximum(out, 0)


def repeated_starts(contexts: list[bytes], length: int = LENGTH) -> list[np.ndarray]:
    """For each context, which of its places start a string of `length` bytes that starts at another place of the contexts too."""
    sizes = np.fromiter(map(len, contexts), np.int64, len(contexts)) + 1
    raw = np.frombuffer(b"\x00".join([*contexts, b""]), np.uint8).astype(PLACE) + PLACE(2)
    ends = np.cumsum(sizes) - 1
    raw[ends] = 1
    t = np.append(raw, PLACE(0))
    order = suffix_array(t)
    shared = common_prefixes(t, order)
    room = np.repeat(ends.astype(PLACE), sizes) - np.arange(len(raw), dtype=PLACE)  # bytes up to the context's end
    long_ = np.zeros(len(t), bool)
    # equal for `length` symbols, and none of them an end: then none of the neighbour's is
    inside = np.append(room >= length, False)
    at = order[1:][(shared[order[1:]] >= length)]
    long_[at] = True
    before = np.empty(len(t), PLACE)
    before[order[1:]] = order[:-1]
    long_[before[at]] = True
    long_ &= inside
    return np.split(long_[:-1], np.cumsum(sizes)[:-1])


# ---- contexts ----


def contexts(raw: bytes, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Minimizer hash, first string's place and number of strings of each context of a text, in order."""
    n, window = len(raw), length - PIECE + 1
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for at in range(0, n - length + 1, CHUNK):
        b = np.frombuffer(raw, np.uint8, min(n, at + CHUNK + length - 1) - at, at)
        with np.errstate(over="ignore"):
            h = (b.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
            span, factor = 1, 0x100000001B3
            while span < PIECE:
                h = h[:-span] * np.uint64(pow(factor, span, 1 << 64)) + h[span:]
                span *= 2
            h = (h ^ (h >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
            h ^= h >> np.uint64(29)
        # least of each window, by hash and then place: prefix and suffix minima over blocks of the window's size
        m = len(h)
        key = (h >> np.uint64(24) << np.uint64(24)) | np.arange(m, dtype=np.uint64)
        blocks = -(-m // window)
        padded = np.full(blocks * window, np.iinfo(np.uint64).max)
        padded[:m] = key
        padded = padded.reshape(blocks, window)
        up = np.minimum.accumulate(padded, axis=1).ravel()
        down = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
        least = np.minimum(down[: m - window + 1], up[window - 1 : m])
        starts = np.concatenate([[0], np.flatnonzero(least[1:] != least[:-1]) + 1])
        places = (least[starts] & np.uint64((1 << 24) - 1)).astype(np.int64)
        found.append((h[places].view(np.int64), starts + at, np.diff(np.append(starts, len(least)))))
    if not found:
        return (np.empty(0, np.int64),) * 3
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _keyed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    kept = docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_of(text).alias("text"))
    return kept.withColumn("key", F.xxhash64("doc_id", "text"))


def _scan(batches: Iterator[pd.DataFrame], with_places: bool) -> Iterator[pd.DataFrame]:
    for batch in (whole.iloc[i : i + HANDED] for whole in batches for i in range(0, len(whole), HANDED)):
        parts = []
        for key, text in zip(batch["key"], batch["text"], strict=True):
            raw = text.encode("utf-8", "replace")
            if len(raw) < LENGTH:
                continue
            anchor, start, size = contexts(raw)
            if with_places:
                digest = xxhash.xxh3_64_intdigest
                own = np.fromiter((digest(raw[s:e]) for s, e in zip(start.tolist(), (start + size + LENGTH - 1).tolist(), strict=True)), np.uint64, len(start))
                parts.append((anchor, own.view(np.int64), np.full(len(start), key), start, size))
            else:
                parts.append((anchor,))
        if parts:
            names = ["anchor", "context", "key", "start", "size"][: len(parts[0])]
            yield pd.DataFrame({name: np.concatenate(x) for name, x in zip(names, zip(*parts, strict=True), strict=True)})


def _may_hold(docs: DataFrame, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """docs whose key may be among keys, and those whose key isn't for certain: a Bloom filter of FILTER_BITS."""
    bit = F.pmod(F.col("key"), F.lit(FILTER_BITS))
    words = keys.select(bit.alias("bit")).groupBy(F.shiftright("bit", 5).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 31 as int))")).alias("bits")).toPandas()
    table = np.zeros(FILTER_BITS >> 5, np.uint32)
    table[words["word"].to_numpy(np.int64)] = words["bits"].to_numpy(np.int64).astype(np.uint32)
    shared = docs.sparkSession.sparkContext.broadcast(table)

    @F.pandas_udf("boolean")
    def holds(keys: pd.Series) -> pd.Series:
        at = np.mod(keys.to_numpy(np.int64), FILTER_BITS)
        return pd.Series((shared.value[at >> 5] >> (at & 31).astype(np.uint32) & 1).astype(bool))

    return docs.where(holds("key")), docs.where(~holds("key"))


def _shards(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows in order of their hash, in pieces of whole hashes: of SHARD bytes at most, or of one hash."""
    rows: pd.DataFrame | None = None

    def cut(ends: list[int]) -> Iterator[pd.DataFrame]:
        nonlocal rows
        upto, begun, last = [0, *np.cumsum(rows["bytes"].map(len)).tolist()], 0, 0
        for end in ends:
            if last > begun and upto[end] - upto[begun] > SHARD:
                yield rows.iloc[begun:last]
                begun = last
            last = end
        rows = rows.iloc[begun:]

    for batch in batches:
        rows = batch if rows is None else pd.concat([rows, batch])
        anchor = rows["anchor"].to_numpy()
        yield from cut((np.flatnonzero(anchor[1:] != anchor[:-1]) + 1).tolist())
    if rows is not None and len(rows):
        anchor = rows["anchor"].to_numpy()
        yield from cut([*(np.flatnonzero(anchor[1:] != anchor[:-1]) + 1).tolist(), len(rows)])
        yield rows


def _sorted_shards(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of rows in order of their hash: which strings of the contexts that occur once are repeated, as (key, start, end) of bytes."""
    for rows in _shards(batches):
        out = []
        for starts, key, start, n in zip(repeated_starts(rows["bytes"].tolist()), rows["key"], rows["start"], rows["n"], strict=True):
            if n == 1 and len(at := np.flatnonzero(starts)):
                cuts = np.flatnonzero(np.diff(at) > 1)
                first, last = at[np.append(0, cuts + 1)], at[np.append(cuts, len(at) - 1)]
                out += [(key, start + int(a), start + int(b) + LENGTH) for a, b in zip(first, last, strict=True)]
        if out:
            yield pd.DataFrame(out, columns=["key", "start", "end"])


def repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """The documents with their keys, and (key, start, end) of bytes covered by repeated strings; spans may overlap."""
    keyed = _keyed(docs, doc_id, text)
    only = keyed.select("key", "text")
    # written first: a join of two tables can be split where one hash has many places, one with an aggregate in it can't
    seen = stored(only.mapInPandas(lambda it: _scan(it, False), "anchor long").groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1").select("anchor"))
    places = only.mapInPandas(lambda it: _scan(it, True), "anchor long, context long, key long, start long, size long")
    places = stored(places.join(seen, "anchor", "left_semi"))
    classes = stored(places.groupBy("anchor", "context").agg(F.count("*").alias("n"), F.min_by(F.struct("key", "start", "size"), F.struct("key", "start")).alias("at")))
    groups = classes.groupBy("anchor").agg(F.count("*").alias("m"), F.min("n").alias("least")).where("m > 1 and least = 1").select("anchor", "m")
    whole = places.join(classes.where("n > 1").select("anchor", "context"), ["anchor", "context"], "left_semi").select("key", "start", (F.col("start") + F.col("size") + LENGTH - 1).alias("end"))
    wanted = stored(classes.join(groups, "anchor").select("anchor", "m", "n", "at.*"))

    @F.pandas_udf("array<binary>")
    def cut(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for text, asked in batches:
            raws = [t.encode("utf-8", "replace") for t in text]
            yield pd.Series([[raw[x["start"] : x["start"] + x["size"] + LENGTH - 1] for x in xs] for raw, xs in zip(raws, asked, strict=True)], dtype=object)

    sources, _ = _may_hold(only, wanted)
    asked = wanted.groupBy("key").agg(F.collect_list(F.struct("anchor", "m", "n", "start", "size")).alias("asked"))
    # rows that repeat id and text have the same key: one of them is enough
    cuts = sources.join(asked, "key").dropDuplicates(["key"]).select("key", F.arrays_zip("asked", cut("text", "asked").alias("bytes")).alias("x"))
    cuts = cuts.select("key", F.explode("x").alias("x")).select("key", "x.asked.*", "x.bytes")
    cuts = stored(cuts)
    sorted_ = cuts.where(F.col("m") <= BLOCK).select("anchor", "key", "start", "n", "bytes").repartition("anchor").sortWithinPartitions("anchor").mapInPandas(_sorted_shards, "key long, start long, end long")

    def strings(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for key, start, n, raw in zip(batch["key"], batch["start"], batch["n"], batch["bytes"], strict=True):
                size = len(raw) - LENGTH + 1
                own = b"".join(xxhash.xxh3_128_digest(raw[i : i + LENGTH]) for i in range(size))
                halves = np.frombuffer(own, np.int64).reshape(-1, 2)
                yield pd.DataFrame({"a": halves[:, 0], "b": halves[:, 1], "key": key, "start": start + np.arange(size), "n": n})

    listed = cuts.where(F.col("m") > BLOCK).select("key", "start", "n", "bytes").mapInPandas(strings, "a long, b long, key long, start long, n long")
    common = listed.groupBy("a", "b").agg(F.sum("n").alias("places")).where("places > 1").select("a", "b")
    counted = listed.where("n = 1").join(common, ["a", "b"], "left_semi").select("key", "start", (F.col("start") + LENGTH).alias("end"))
    return keyed, whole.unionByName(sorted_).unionByName(counted)


def _covered(starts: np.ndarray, ends: np.ndarray) -> list[tuple[int, int]]:
    """Maximal runs of bytes under spans."""
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.maximum.accumulate(ends[order])
    cuts = np.flatnonzero(starts[1:] > ends[:-1])
    return [*zip(starts[np.append(0, cuts + 1)].tolist(), ends[np.append(cuts, len(ends) - 1)].tolist(), strict=True)]


def deduplicate(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row of docs: doc_id, kept (the bytes that stay), n_bytes, n_removed, n_spans.

    Removed is every byte covered by a string of LENGTH bytes that starts at another
    place as well, in the same text or another one. A null or empty text has no bytes; a
    text shorter than LENGTH keeps all. Rows that repeat an id and a text are two places
    of each of its strings. kept is bytes, since a cut may split a character. Other
    columns are ignored; an empty table gives an empty result.
    """
    keyed, spans = repeats(docs, doc_id, text)
    spans = stored(spans.groupBy("key").agg(F.collect_list("start").alias("starts"), F.collect_list("end").alias("ends")))

    @F.pandas_udf("kept binary, n_removed long, n_spans long")
    def without(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for text, starts, ends in batches:
            out = []
            for t, s, e in zip(text, starts, ends, strict=True):
                raw = t.encode("utf-8", "replace")
                runs = _covered(np.asarray(s), np.asarray(e)) if s is not None and len(s) else []
                kept = b"".join(raw[a:b] for a, b in zip([0, *(e for _, e in runs)], [*(s for s, _ in runs), len(raw)], strict=True))
                out.append((kept, len(raw) - len(kept), len(runs)))
            yield pd.DataFrame(out, columns=["kept", "n_removed", "n_spans"])

    some, none = _may_hold(keyed, spans)
    size = F.octet_length("text").cast("long").alias("n_bytes")
    none = none.select("doc_id", F.encode("text", "UTF-8").alias("kept"), size, F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"))
    some = some.join(spans, "key", "left").select("doc_id", "text", without("text", "starts", "ends").alias("x")).select("doc_id", "x.kept", size, "x.n_removed", "x.n_spans")
    return some.unionByName(none)
