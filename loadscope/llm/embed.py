"""Near-duplicate vectors: spherical k-means cells, blocked cosines within a cell, one representative a group."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loadscope.llm.common import components, stored

COSINE = 0.95
#: Vectors that the cells are fitted on at most (those of the smallest hash), and rounds.
MAX_FIT, ROUNDS = 20_000, 8
#: Vectors a cell should have, and cells at most: beyond, cells grow, and their blocks with the square of that.
CELL, MAX_CELLS = 256, 4096
#: Cells that a vector is put into: its nearest.
PROBES = 4
#: Vectors compared with as many at once; a larger cell is dealt into blocks, and each pair of blocks is a group of its own.
BLOCK = 1024


def unit(rows: np.ndarray) -> np.ndarray:
    rows = np.asarray(rows, np.float64)
    top = np.abs(rows).max(axis=1, keepdims=True)
    rows = rows / np.where(top > 0, top, 1)  # large and small components neither overflow nor vanish
    return rows / np.maximum(np.sqrt((rows * rows).sum(axis=1, keepdims=True)), 1e-300)


def centres(sample: np.ndarray, k: int, rounds: int = ROUNDS, seed: int = 5) -> np.ndarray:
    """Spherical k-means: unit centres of unit vectors; an empty cell takes the vector farthest from its own centre."""
    rnd = np.random.default_rng(seed)
    c = sample[rnd.choice(len(sample), min(k, len(sample)), replace=False)]
    for _ in range(rounds):
        own, near = np.empty(len(sample), np.int64), np.empty(len(sample))
        for i in range(0, len(sample), 512):  # never all similarities at once
            sims = sample[i : i + 512] @ c.T
            own[i : i + 512], near[i : i + 512] = sims.argmax(axis=1), sims.max(axis=1)
        sums = np.zeros_like(c)
        np.add.at(sums, own, sample)
        empty = np.flatnonzero(np.bincount(own, minlength=len(c)) == 0)
        sums[empty] = sample[np.argsort(near, kind="stable")[: len(empty)]]
        c = unit(sums)
    return c


def _nearest(shared):
    """A function of a vector: the sorted numbers of its PROBES nearest centres."""

    @F.pandas_udf("array<int>")
    def nearest(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            if not len(batch):
                yield pd.Series([], dtype=object)
                continue
            sims = unit(np.stack(batch.to_list())) @ shared.value.T
            k = min(PROBES, sims.shape[1])
            yield pd.Series([*np.sort(np.argpartition(-sims, k - 1, axis=1)[:, :k], axis=1).astype(np.int32)])

    return nearest


def _pairs(rows: pd.DataFrame) -> pd.DataFrame:
    """Links within a group: for each vector with one, the weight of its partners, and the smallest id that links of this group reach."""
    a, b = rows["i"].iloc[0], rows["j"].iloc[0]
    left = rows if a == b else rows[rows["block"] == a]
    right = rows if a == b else rows[rows["block"] == b]
    x, y = unit(np.stack(left["v"].to_list())) if len(left) else None, unit(np.stack(right["v"].to_list())) if len(right) else None
    empty = pd.DataFrame({"id": pd.Series([], dtype="int64"), "n": pd.Series([], dtype="int64"), "head": pd.Series([], dtype="int64")})
    if x is None or y is None:
        return empty
    p, q = np.nonzero(x @ y.T >= COSINE)
    if a == b:
        p, q = p[p < q], q[p < q]
    # a pair counts in the first cell that both are in
    u, v = np.stack(left["cells"].to_list()), np.stack(right["cells"].to_list())
    cell = rows["cell"].iloc[0]
    first = np.ones(len(p), bool)
    for at in range(0, len(p), 1 << 18):
        s = slice(at, at + (1 << 18))
        cu, cv = u[p[s]], v[q[s]]
        both = (cu[:, :, None] == cv[:, None, :]) & (cu[:, :, None] < cell)
        first[s] = ~both.any(axis=(1, 2))
    ids, jds = left["id"].to_numpy(), right["id"].to_numpy()
    names, at = np.unique(np.concatenate([ids, jds]), return_inverse=True)
    lu, lv = at[: len(ids)][p], at[len(ids) :][q]
    n = np.zeros(len(names), np.int64)
    np.add.at(n, lu[first], right["n"].to_numpy()[q[first]])
    np.add.at(n, lv[first], left["n"].to_numpy()[p[first]])
    head = np.arange(len(names))
    while True:
        new = head.copy()
        np.minimum.at(new, lu, head[lv])
        np.minimum.at(new, lv, head[lu])
        new = new[new]
        if (new == head).all():
            break
        head = new
    linked = np.unique(np.concatenate([lu, lv]))
    return pd.DataFrame({"id": names[linked], "n": n[linked], "head": names[head[linked]]}) if len(linked) else empty


def near_duplicates(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """One row for each row of vectors: vec_id, n_links, component_id, kept.

    Vectors at a cosine of COSINE or more link if they share one of their PROBES nearest
    cells (equal vectors always do). Vectors that are null, empty, all zero, or hold null
    or non-finite components link with nothing, and so do vectors of different lengths.
    Repeated rows are linked vectors as any others; rows with a null id count as links and
    are returned, but never name a component. Other columns are ignored; an empty table
    gives an empty result.
    """
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("v"))
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    good = F.coalesce(F.forall("v", finite) & F.exists("v", lambda x: x != 0), F.lit(False))
    rows = rows.withColumn("v", F.when(good, F.transform("v", lambda x: x + F.lit(0.0))))  # no negative zeros
    classes = rows.where("v is not null").groupBy("v").agg(F.min("vec_id").alias("first"), F.count("*").alias("n"))
    # numbered once and for all, since the table is written: no two vectors share an id
    classes = stored(classes.withColumn("id", F.monotonically_increasing_id()))
    total, widths = classes.agg(F.count("*"), F.collect_set(F.size("v"))).first()
    out = None
    for width in sorted(widths):  # as many as there are lengths of vectors
        some = classes.where(F.size("v") == width)
        n = total if len(widths) == 1 else some.count()
        sample = some.orderBy(F.xxhash64("v"), "first").limit(MAX_FIT).select("v").toPandas()["v"]
        c = centres(unit(np.stack(sample.to_list())), max(1, min(MAX_CELLS, -(-n // CELL))))
        shared = vectors.sparkSession.sparkContext.broadcast(c)

        cells = some.select("id", "n", "v", _nearest(shared)("v").alias("cells")).withColumn("width", F.lit(width))
        out = cells if out is None else out.unionByName(cells)
    if out is None:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.col("vec_id").isNotNull().alias("kept"))
    placed = stored(out).withColumn("cell", F.explode("cells"))
    blocks = placed.groupBy("width", "cell").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    # as many rows as cells: not more than MAX_CELLS for each length
    placed = placed.join(F.broadcast(blocks), ["width", "cell"]).withColumn("block", F.pmod(F.xxhash64("id"), "blocks").cast("int"))
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    placed = placed.withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other"))
    linked = placed.select("width", "cell", "i", "j", "block", "id", "n", "v", "cells").groupBy("width", "cell", "i", "j").applyInPandas(_pairs, "id long, n long, head long")
    linked = stored(linked)
    counts = linked.groupBy("id").agg(F.sum("n").alias("linked"))
    of = classes.join(components(linked.select("id", "head")).select(F.col("node").alias("id"), "component"), "id", "left").join(counts, "id", "left")
    of = stored(of.select("v", "first", "n", "linked", F.coalesce("component", "id").alias("component")))
    least = of.groupBy("component").agg(F.min("first").alias("component_id"))
    of = of.join(least, "component").select("v", (F.coalesce("linked", F.lit(0)) + F.col("n") - 1).alias("links"), "component_id")
    done = rows.join(of, "v", "left")
    component = F.when(F.col("links").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return done.select("vec_id", F.coalesce("links", F.lit(0).cast("long")).alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))


ORACLE = f"""
WITH RECURSIVE e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings),
l AS (SELECT a.vec_id AS u, b.vec_id AS w FROM e a JOIN e b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.v, b.v) >= {COSINE}),
r(u, w) AS (SELECT vec_id, vec_id FROM e UNION SELECT r.u, l.w FROM r JOIN l ON r.w = l.u)
SELECT e.vec_id, (SELECT count(*) FROM l WHERE l.u = e.vec_id) AS n_links, c.component_id, e.vec_id = c.component_id AS kept
FROM e JOIN (SELECT u AS vec_id, min(w) AS component_id FROM r GROUP BY u) c USING (vec_id)
"""
