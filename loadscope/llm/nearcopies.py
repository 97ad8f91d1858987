"""Near copies: SimHash fingerprints by their inverted index first, then whole five-word shingle sets of the rest.

Fingerprints at two or fewer differing bits give links, each held against the Jaccard
similarity of the shingle sets. At Jaccard 0.8 two fingerprints are expected to differ in about ten of
64 bits, more than an index over their positional bytes can reach. So sets that SimHash leaves in
different components meet by MinHash bands as well: two texts at 0.8 share one of the bands with a
probability of 0.99997.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loadscope.llm import simhash
from loadscope.llm.common import PIECE, components, each_value, stored, text_of

N_WORDS, JACCARD = 5, 0.8
#: Bits in which the fingerprints of SimHash's links differ at most.
MAX_BITS = 2
BANDS, ROWS = 20, 4
#: Longest band whose pairs are all listed; members of longer ones are held against heads.
LONGEST_BAND = 48
#: Shingles that are hashed at once.
CHUNK = 1 << 13
#: Counters by which shingles are put in order; the order is the same for all sets, so results don't depend on them.
COUNTERS = 1 << 20
#: Words of 64 bits of a set's parity sketch. A bit is flipped by each shingle that falls to it, so two sets differ in at least as many shingles as their sketches in bits.
SKETCH = 8
#: Times that sets are held against heads of the lists they stand in, before those still apart are joined.
HEADS = 2

_RANDOM = np.random.default_rng(20)
FACTORS, SHIFTS = (_RANDOM.integers(0, 1 << 64, BANDS * ROWS, dtype=np.uint64) for _ in range(2))
FACTORS |= np.uint64(1)


def shingles(text: str, n_words: int = N_WORDS) -> np.ndarray:
    """The hashes of the text's different shingles, in order; a shorter text is one shingle, a wordless one has none."""
    return np.unique(simhash.hashes(text, n_words))


def bands(own: np.ndarray) -> list[int]:
    """A key for each band of the set's MinHash signature; none for an empty set."""
    if not len(own):
        return []
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max)
    for at in range(0, len(own), CHUNK):
        np.minimum(least, (own[at : at + CHUNK, None] * FACTORS + SHIFTS).min(axis=0), out=least)
    return np.array([xxhash.xxh64_intdigest(row.tobytes(), k) for k, row in enumerate(least.reshape(BANDS, ROWS))], np.uint64).view(np.int64).tolist()


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) or len(b) else 1.0


def _marks(text: Column) -> Column:
    """A struct of the digest of the text's shingle set, of the set's band keys and of its fingerprint."""

    def of(t: str) -> tuple[str, list[int], int]:
        own = shingles(t)
        return xxhash.xxh128_hexdigest(own.tobytes()), bands(own), simhash.fingerprint_of(own)

    kinds = pa.struct([("set", pa.string()), ("bands", pa.list_(pa.int64())), ("fp", pa.int64())])
    return each_value(text, "set string, bands array<long>, fp long", kinds, lambda: of)


def _sets(text: Column) -> Column:
    return each_value(text, "binary", pa.binary(), lambda: lambda t: shingles(t).tobytes())


def _alike(a: Column, b: Column) -> Column:
    own = lambda x: np.frombuffer(x.as_py(), np.uint64)

    @F.arrow_udf("boolean")
    def of(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for left, right in batches:
            for at in range(0, len(left), PIECE):
                yield pa.array([jaccard(own(x), own(y)) >= JACCARD for x, y in zip(left.slice(at, PIECE), right.slice(at, PIECE), strict=True)], pa.bool_())

    return of(a, b)


def _by_simhash(classes: DataFrame) -> DataFrame:
    """Candidate pairs (u, v), u < v, of sets (set, fp): those of one fingerprint with its smallest one, and the smallest ones of linked fingerprints."""
    heads = stored(classes.groupBy("fp").agg(F.min("set").alias("head")))
    same = classes.join(heads, "fp").where("set <> head").select(F.col("head").alias("u"), F.col("set").alias("v"))
    linked = simhash.links(heads.select("fp"), MAX_BITS)
    near = linked.join(heads.select(F.col("fp").alias("u"), F.col("head").alias("a")), "u").join(heads.select(F.col("fp").alias("v"), F.col("head").alias("b")), "v")
    return same.unionByName(near.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")))


def _apart(pairs: DataFrame, edges: DataFrame) -> DataFrame:
    """Pairs (u, v) that aren't of one component of the edges already."""
    of = stored(components(edges))
    side = lambda x: of.select(F.col("node").alias(x), F.col("component").alias(f"of_{x}"))
    return pairs.join(side("u"), "u", "left").join(side("v"), "v", "left").where("of_u is null or of_v is null or of_u <> of_v").select("u", "v")


def _listed(postings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Candidate pairs (u, v), u < v, of postings (set, key), and the sets of long bands."""
    sizes = postings.groupBy("key").agg(F.count("*").alias("n"), F.min("set").alias("least"), F.max("set").alias("most")).where("n > 1")
    sized = stored(postings.join(sizes, "key"))
    short = sized.where(F.col("n") <= LONGEST_BAND).groupBy("key").agg(F.collect_list("set").alias("sets"))
    short = short.select("sets", F.explode("sets").alias("u")).select("u", F.explode("sets").alias("v")).where("u < v")
    long_ = sized.where(F.col("n") > LONGEST_BAND)
    heads = long_.select(F.col("least").alias("u"), F.col("set").alias("v")).unionByName(long_.select(F.col("set").alias("u"), F.col("most").alias("v"))).where("u < v")
    return short.unionByName(heads).distinct(), long_.select("set").distinct()


def _counters(sets: DataFrame) -> np.ndarray:
    """How many of the shingles of all sets (own) fall to each counter; each partition hands on one number a counter."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(COUNTERS, np.int64)
        for batch in batches:
            for own in batch["own"]:
                np.add.at(total, (np.frombuffer(own, np.uint64) % np.uint64(COUNTERS)).astype(np.int64), 1)
        some = np.flatnonzero(total)
        yield pd.DataFrame({"counter": some.astype(np.int32), "n": total[some]})

    out = np.zeros(COUNTERS, np.int64)
    found = sets.select("own").mapInPandas(count, "counter int, n long").groupBy("counter").agg(F.sum("n").alias("n")).toPandas()
    out[found["counter"]] = found["n"]
    return out


def prefix_lengths(n: int) -> tuple[int, int]:
    """Shingles of a set of n that it is known by to sets of its size or more, and to sets of its size or less: n less the overlap that JACCARD asks for at least, and one."""
    return n - -(-8 * n // 9) + 1, n - -(-4 * n // 5) + 1


def _prefixes(sets: DataFrame, counters: np.ndarray) -> DataFrame:
    """(shingle, set, n, i, first): the rarest shingles of sets (set, own) with their places."""
    shared = sets.sparkSession.sparkContext.broadcast(counters)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for key, own in zip(batch["set"], batch["own"], strict=True):
                own = np.frombuffer(own, np.uint64)
                first, every = prefix_lengths(len(own))
                rare = own[np.lexsort((own, shared.value[(own % np.uint64(COUNTERS)).astype(np.int64)]))[:every]]
                at = np.arange(len(rare))
                yield pd.DataFrame({"shingle": rare.view(np.int64), "set": key, "n": len(own), "i": at.astype(np.int32), "first": at < first})

    return sets.select("set", "own").mapInPandas(run, "shingle long, set string, n int, i int, first boolean")


def _majors(postings: DataFrame) -> DataFrame:
    """(shingle, major, head): of each shingle's list that holds several components, the most frequent one and one of its sets, another one for each shingle."""
    one = postings.groupBy("shingle", "component").agg(F.count("*").alias("n"), F.min(F.struct(F.xxhash64("set", "shingle"), "set"))["set"].alias("head"))
    best = one.groupBy("shingle").agg(F.max_by(F.struct("component", "head"), F.struct("n", "component")).alias("m"), F.count("*").alias("components"))
    return best.where("components > 1").select("shingle", F.col("m.component").alias("major"), "m.head")


def _to_heads(postings: DataFrame) -> DataFrame:
    """Pairs (u, v), u < v, of the sets outside each list's most frequent component with one of that: no more than postings."""
    met = postings.join(_majors(postings), "shingle").where("component <> major")
    return met.select(F.least("set", "head").alias("u"), F.greatest("set", "head").alias("v")).distinct()


def sketch(own: np.ndarray) -> np.ndarray:
    """The parity sketch of a set; its bits are chosen by other digits of the hash than its counter."""
    odd = np.bincount((own >> np.uint64(40)).astype(np.int64) % (64 * SKETCH), minlength=64 * SKETCH) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _sketches(own: Column) -> Column:
    return each_value(own, "array<long>", pa.list_(pa.int64()), lambda: lambda x: sketch(np.frombuffer(x, np.uint64)))


def _across(postings: DataFrame, sets: DataFrame) -> DataFrame:
    """Candidate pairs (u, v), u < v, of prefixes' postings that share a shingle and are of different components.

    Sets whose sketches differ in more bits than near copies can differ in shingles don't meet.

    In each shingle's list the sets outside its most frequent component meet all of
    the list; sets of one component never meet, so a large group of near copies costs its outsiders only.
    """
    rows = postings.join(_majors(postings).drop("head"), "shingle")
    rows = stored(rows.join(sets.select("set", _sketches(F.col("own")).alias("sketch")), "set").select("*", *[F.get("sketch", F.lit(k)).alias(f"s{k}") for k in range(SKETCH)]).drop("sketch"))
    side = lambda rows, name: rows.select("shingle", *[F.col(c).alias(f"{name}_{c}") for c in ("set", "component", "n", "i", "first", *[f"s{k}" for k in range(SKETCH)])])
    met = side(rows.where("component <> major"), "a").join(side(rows, "b"), "shingle").where("a_component <> b_component")
    # the smaller one by its first shingles, sizes within the threshold, and enough shingles left behind the shared one
    fits = lambda x, y: (F.col(f"{x}_n") <= F.col(f"{y}_n")) & F.col(f"{x}_first") & (5 * F.col(f"{x}_n") >= 4 * F.col(f"{y}_n"))
    left = 9 * F.least(F.col("a_n") - F.col("a_i"), F.col("b_n") - F.col("b_i")) >= 4 * (F.col("a_n") + F.col("b_n"))
    apart = sum((F.bit_count(F.col(f"a_s{k}").bitwiseXOR(F.col(f"b_s{k}"))) for k in range(SKETCH)), F.lit(0))
    near = 9 * apart <= F.col("a_n") + F.col("b_n")
    return met.where((fits("a", "b") | fits("b", "a")) & left & near).select(F.least("a_set", "b_set").alias("u"), F.greatest("a_set", "b_set").alias("v")).distinct()


def links(marked: DataFrame) -> DataFrame:
    """Edges (u, v) between the sets of a table (set, bands, fp, text) whose shingles have Jaccard JACCARD or more, enough of them for their components.

    Equal sets are one. SimHash's links come first, those that have the similarity. Every pair of a band whose
    sets these leave apart is held against the threshold; in a band of
    more than LONGEST_BAND sets each is held against the smallest and the largest one. Sets of
    such bands are then held against heads of the lists of their rare shingles, and all that aren't
    of one component by then are joined by prefixes, exactly.
    """
    classes = stored(marked.groupBy("set").agg(F.first("bands").alias("bands"), F.min("fp").alias("fp")))
    pairs, long_ = _listed(classes.select("set", F.explode("bands").alias("key")))

    def owns(wanted: DataFrame) -> DataFrame:
        one = marked.join(wanted, "set", "left_semi").groupBy("set").agg(F.min("text").alias("text"))
        return stored(one.select("set", _sets(F.col("text")).alias("own")))

    def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
        both = pairs.join(sets.select(F.col("set").alias("v"), F.col("own").alias("b")), "v").join(sets.select(F.col("set").alias("u"), F.col("own").alias("a")), "u")
        return stored(both.where(_alike(F.col("a"), F.col("b"))).select("u", "v"))

    def held(pairs: DataFrame) -> DataFrame:
        return verified(pairs, owns(pairs.select(F.col("u").alias("set")).unionByName(pairs.select(F.col("v").alias("set"))).distinct()))

    near = held(stored(_by_simhash(classes.select("set", "fp"))))
    pairs = stored(_apart(pairs, near))
    good = stored(near.unionByName(held(pairs)))
    long_ = stored(long_)
    if long_.isEmpty():
        return good
    sets = owns(long_)
    prefixes = stored(_prefixes(sets, _counters(sets)))

    def placed() -> DataFrame:
        found = components(good).select(F.col("node").alias("set"), "component")
        return stored(prefixes.join(found, "set", "left").withColumn("component", F.coalesce("component", "set")))

    postings = placed()
    for _ in range(HEADS):
        more = verified(_to_heads(postings).join(pairs, ["u", "v"], "left_anti"), sets)
        if more.isEmpty():
            break
        good = stored(good.unionByName(more))
        postings = placed()
    return good.unionByName(verified(_across(postings, sets).join(pairs, ["u", "v"], "left_anti"), sets))


def keep_one(docs: DataFrame) -> DataFrame:
    """docs with one row of each component of near copies: that of the smallest doc_id, a null id last, and of the smallest other values.

    Rows are known by all their values, so different texts under one id, or without an id, stay
    apart. Wordless texts (null and empty ones too) are copies of each other.
    """
    whole = F.sha2(F.to_json(F.struct(*docs.columns), {"ignoreNullFields": "false"}), 256)
    rank = F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("id"), whole.alias("row"))
    held = docs.select(rank.alias("rank"), text_of("text").alias("text"))
    held = stored(held.withColumn("mark", _marks(F.col("text"))).select("rank", "text", "mark.set", "mark.bands", "mark.fp"))
    firsts = held.groupBy("set").agg(F.min("rank").alias("rank"))
    found = components(links(held)).select(F.col("node").alias("set"), "component")
    heads = firsts.join(found, "set", "left").groupBy(F.coalesce("component", "set").alias("component")).agg(F.min("rank").alias("rank")).select(F.col("rank.row").alias("_row"))
    return docs.withColumn("_row", whole).join(heads, "_row", "left_semi").dropDuplicates(["_row"]).select(*docs.columns)
