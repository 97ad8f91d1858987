"""The graph from environments over files and loaders to artifacts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loadscope.operators.columns import mapped
from loadscope.operators.shared import shared_dir
from loadscope.plans import dims


def _hops(sites: DataFrame, contexts: DataFrame) -> DataFrame:
    """Each site as the four nodes on its way, distinct before anything is made of it."""
    rows = sites.where("artifact_id is not null").select("file", "loader", "artifact_id", F.col("verdict.behaviour").alias("behaviour")).distinct()
    rows = rows.join(contexts.select("file", "environment", "privileged"), "file")
    node = lambda kind, c: F.concat(F.lit(f"{kind}:"), F.col(c).cast("string"))
    return rows.select(
        F.array(node("env", "environment"), node("file", "file"), F.concat(F.lit("loader:"), F.col("file"), F.lit("#"), F.col("loader")), node("artifact", "artifact_id")).alias("path"), "behaviour", "privileged"
    )


def _exposed() -> tuple[Column, Column]:
    """The most exposed behaviour as a number, and its name."""
    names = F.array(*[F.lit(b) for b, _ in sorted(dims.EXPOSURE.items(), key=lambda x: x[1])])
    return F.max(mapped(F.col("behaviour"), dims.EXPOSURE, -1)).alias("exposure"), F.get(names, F.col("exposure")).alias("behaviour")


def nodes(sites: DataFrame, contexts: DataFrame) -> DataFrame:
    """(id, behaviour, privileged): the most exposed behaviour that passes a node."""
    most, name = _exposed()
    found = _hops(sites, contexts).select(F.explode("path").alias("id"), "behaviour", "privileged").groupBy("id").agg(most, F.bool_or("privileged").alias("privileged"))
    return found.select("id", name, "privileged")


def edges(sites: DataFrame, contexts: DataFrame) -> DataFrame:
    """(from, to, behaviour): one for each pair of neighbours."""
    most, name = _exposed()
    pair = F.array(*[F.struct(F.get("path", i).alias("from"), F.get("path", i + 1).alias("to")) for i in range(3)])
    return _hops(sites, contexts).select(F.explode(pair).alias("e"), "behaviour").groupBy("e.from", "e.to").agg(most).select("from", "to", name)


def component(links: DataFrame, focus: str, farthest: int | None = None) -> DataFrame:
    """(id, distance): nodes reachable from the focus over undirected links, however far, or within `farthest` links.

    A frontier of unseen nodes is joined to the links until it is empty. Each frontier is
    checkpointed in the folder that all executors share, so no node is written twice; what has
    been seen is their union.
    """
    spark = links.sparkSession
    shared_dir(spark)
    both = links.select(F.col("from").alias("a"), F.col("to").alias("b")).unionByName(links.select(F.col("to").alias("a"), F.col("from").alias("b"))).distinct().checkpoint()
    frontier = spark.createDataFrame([(focus, 0)], "id string, distance int")
    layers, step = [frontier], 0
    while not frontier.isEmpty() and (farthest is None or step < farthest):
        step += 1
        found = frontier.join(both, frontier["id"] == both["a"]).select(F.col("b").alias("id")).distinct()
        # a neighbour of the last layer is in it, in the one before, or new
        for layer in layers[-2:]:
            found = found.join(layer.select("id"), "id", "left_anti")
        frontier = found.withColumn("distance", F.lit(step)).checkpoint()
        layers.append(frontier)
    out = layers[0]
    for layer in layers[1:]:
        out = out.unionByName(layer)
    return out
