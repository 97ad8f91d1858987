"""Counts over records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loadscope.operators.columns import mapped
from loadscope.plans import dims


def environments() -> Column:
    """A record's environments, or unresolved where it has none."""
    return F.when(F.size("environments") == 0, F.array(F.lit("unresolved"))).otherwise(F.array_distinct("environments"))


def matrix(records: DataFrame) -> DataFrame:
    """(behaviour, environment, artifacts): artifacts by what loading them does and where."""
    return records.select("behaviour", F.explode(environments()).alias("environment")).groupBy("behaviour", "environment").agg(F.count("*").alias("artifacts"))


def matrix_pivot(records: DataFrame) -> DataFrame:
    """The matrix with a column for each environment."""
    cells = records.select("behaviour", F.explode(environments()).alias("environment"))
    return cells.groupBy("behaviour").agg(*[F.count_if(F.col("environment") == e).alias(e) for e in dims.REACH])


def matrix_view(records: DataFrame) -> DataFrame:
    """The matrix's cells with the share of the largest one."""
    cells = matrix(records)
    peak = cells.agg(F.max("artifacts").alias("peak"))
    return cells.crossJoin(F.broadcast(peak)).select("behaviour", "environment", "artifacts", F.round(F.col("artifacts") / F.col("peak"), 6).alias("share"))


def summary(records: DataFrame) -> DataFrame:
    """One row of counts."""
    of = lambda b: F.count_if(F.col("behaviour") == b).alias(b)
    return records.agg(
        F.count("*").alias("artifacts"), *[of(b) for b in dims.DISPLAY], F.count_if("privileged").alias("privileged"), F.count_if(F.col("migration") == "available").alias("migrations"),
        F.coalesce(F.sum("sites"), F.lit(0)).alias("sites"), F.coalesce(F.sum("evidence"), F.lit(0)).alias("evidence"), F.count_if(F.array_contains("bindings", "stale")).alias("stale"),
    )


def orphans(sites: DataFrame) -> DataFrame:
    """(behaviour, reason, sites): load sites that no artifact answers to, by what is known of them."""
    return sites.where("artifact_id is null").groupBy("verdict.behaviour", "verdict.reason").agg(F.count("*").alias("sites"))


def by_format(records: DataFrame) -> DataFrame:
    """(label, artifacts); shown the most frequent first, then by label."""
    return records.groupBy(mapped(F.col("format"), dims.LABELS, "").alias("label")).agg(F.count("*").alias("artifacts"))


def by_environment(records: DataFrame) -> DataFrame:
    """(environment, label, short, artifacts): an artifact counts once in each of its environments."""
    counts = records.select(F.explode(environments()).alias("environment")).groupBy("environment").agg(F.count("*").alias("artifacts"))
    name = lambda k: mapped(F.col("environment"), {e: x[k] for e, x in dims.ENVIRONMENTS.items()}, "")
    return counts.select("environment", name(0).alias("label"), name(1).alias("short"), "artifacts")


def by_privilege(records: DataFrame) -> DataFrame:
    """(privilege, label, artifacts): what the files that load an artifact can reach."""
    counts = records.select(F.explode("privileges").alias("privilege")).groupBy("privilege").agg(F.count("*").alias("artifacts"))
    return counts.select("privilege", mapped(F.col("privilege"), dims.PRIVILEGE_LABELS, "").alias("label"), "artifacts")


def frequent(counts: DataFrame, name: str) -> DataFrame:
    """Counts in their shown order: the most frequent first, then by name."""
    return counts.orderBy(F.desc("artifacts"), name)


def indicators(records: DataFrame) -> DataFrame:
    """(indicator, value, of): the counts that are shown, with what they are a part of."""
    shown = [("code", "artifacts"), ("unknown", "artifacts"), ("directive", "artifacts"), ("guarded", "artifacts"), ("data", "artifacts"), ("privileged", "code"), ("migrations", "artifacts"), ("stale", "evidence")]
    rows = F.array(*[F.struct(F.lit(k).alias("indicator"), F.col(k).alias("value"), F.col(of).alias("of")) for k, of in shown])
    return summary(records).select(F.explode(rows).alias("i")).select("i.*")


def distribution(records: DataFrame) -> DataFrame:
    """(behaviour, artifacts, share): behaviours that occur."""
    counts = records.groupBy("behaviour").agg(F.count("*").alias("artifacts"))
    total = counts.agg(F.sum("artifacts").alias("total"))
    return counts.crossJoin(F.broadcast(total)).select("behaviour", "artifacts", F.round(F.col("artifacts") / F.col("total"), 6).alias("share"))


def gate(records: DataFrame, mode: str) -> Column:
    """Whether a record fails the gate; manifests and agents don't count as execution."""
    manifest = F.col("format").isin("mcp-server-manifest", "agent-definition")
    code = F.col("behaviour") == "code"
    return {
        "none": F.lit(False), "any": F.col("behaviour") != "data", "unknown": F.col("behaviour") == "unknown", "privileged": code & F.col("privileged"), "execution": code & ~manifest,
    }[mode]
