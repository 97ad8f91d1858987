"""What changed between two bills of materials."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loadscope.operators.columns import first_match, mapped
from loadscope.plans import dims

DIRECTIONS = ("opened", "lateral", "closed")
FIELDS = ("behaviour", "guard", "format", "digest", "sites", "environments", "privileged", "evidence", "alternative")


def status(before: DataFrame, after: DataFrame) -> DataFrame:
    """(artifact_id, status, b, a): both rows of each artifact, and whether it was added, removed, changed or neither."""
    pack = lambda d, name: d.select("artifact_id", F.struct(*FIELDS).alias(name))
    rows = pack(before, "b").join(pack(after, "a"), "artifact_id", "full")
    differs = F.lit(False)
    for f in FIELDS:
        differs = differs | ~F.col(f"a.{f}").eqNullSafe(F.col(f"b.{f}"))
    return rows.withColumn("status", first_match((F.col("b").isNull(), F.lit("added")), (F.col("a").isNull(), F.lit("removed")), (differs, F.lit("changed"))).otherwise("unchanged"))


def _directions() -> dict[str, Column]:
    b, a = (lambda f: F.col(f"b.{f}")), (lambda f: F.col(f"a.{f}"))
    opened = lambda c, otherwise: F.when(c, "opened").otherwise(otherwise)
    exposure = lambda c: mapped(c, dims.EXPOSURE, -1)
    mattering = F.array(*[F.lit(e) for e in dims.MATTERING])
    matters = lambda c: F.arrays_overlap(F.split(c, ","), mattering)
    count = lambda c: F.when(c == "", 0).otherwise(F.size(F.split(c, ",")))
    return {
        "behaviour": opened(exposure(a("behaviour")) > exposure(b("behaviour")), "closed"),
        "guard": opened(a("guard").isNull(), "closed"),
        "format": F.lit("lateral"),
        "digest": F.lit("lateral"),
        "sites": opened(a("sites") > b("sites"), "lateral"),
        "environments": opened(matters(a("environments")) & ~matters(b("environments")), "lateral"),
        "privileged": opened(a("privileged"), "closed"),
        "evidence": opened(F.contains(a("evidence"), F.lit("stale")) | (count(a("evidence")) < count(b("evidence"))), "closed"),
        "alternative": F.lit("lateral"),
    }


def cells() -> Column:
    """Of the rows b and a of an artifact, (field, before, after, direction) of each field that differs."""
    text = lambda c: F.coalesce(c.cast("string"), F.lit("none"))
    every = [
        F.when(~F.col(f"a.{f}").eqNullSafe(F.col(f"b.{f}")), F.struct(F.lit(f).alias("field"), text(F.col(f"b.{f}")).alias("before"), text(F.col(f"a.{f}")).alias("after"), d.alias("direction")))
        for f, d in _directions().items()
    ]
    return F.filter(F.array(*every), lambda x: x.isNotNull())


def changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """(artifact_id, field, before, after, direction): each field that differs in both bills' rows of an artifact."""
    return status(before, after).where("status = 'changed'").select("artifact_id", F.explode(cells()).alias("c")).select("artifact_id", "c.*")


def ranked(changed: DataFrame) -> DataFrame:
    """(artifact_id, rank, fields): anything opened first, then anything lateral."""
    return changed.groupBy("artifact_id").agg(F.min(mapped(F.col("direction"), {d: i for i, d in enumerate(DIRECTIONS)})).alias("rank"), F.count("*").alias("fields"))


def text_lines(before: DataFrame, after: DataFrame) -> DataFrame:
    """(artifact_id, line): + added, - removed, ~ changed with its fields."""
    fields = changes(before, after).groupBy("artifact_id").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws(" ", "field", F.concat(F.col("before"), F.lit(" -> "), F.col("after"))))), "; ").alias("fields"))
    rows = status(before, after).where("status <> 'unchanged'").join(fields, "artifact_id", "left")
    sign = mapped(F.col("status"), {"added": "+", "removed": "-", "changed": "~"})
    return rows.select("artifact_id", F.concat_ws(" ", sign, F.col("artifact_id").cast("string"), "fields").alias("line"))
