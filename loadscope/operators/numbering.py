"""Consecutive numbers over a global order, without bringing all rows into one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loadscope.operators.asof import dealt


def numbered(rows: DataFrame, order: list[str], name: str, prefix: str = "") -> DataFrame:
    """rows with a column `name`: prefix and 1, 2, 3 ... in the given order, whose columns have to tell rows apart.

    Rows are dealt out by ranges of the order; a range's numbers begin after the counts of
    those before it (as many rows as there are ranges), and go on within it.
    """
    spread = dealt(rows, order)
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = spread.groupBy("_range").agg(F.count("*").alias("_n")).withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0))).select("_range", "_start")
    number = F.col("_start") + F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return spread.join(F.broadcast(starts), "_range").withColumn(name, F.concat(F.lit(prefix), number.cast("string")) if prefix else number).drop("_range", "_start")


def numbered_within(rows: DataFrame, group: list[str], order: list[str], name: str) -> DataFrame:
    """rows with a column `name`: 1, 2, 3 ... within each group, in the given order.

    All rows are numbered over group and order together, and each group's first number is
    taken off, so a group of any size is spread over ranges.
    """
    every = numbered(rows, [*group, *order], name)
    firsts = every.groupBy(*group).agg(F.min(name).alias("_first"))
    return every.join(firsts, group).withColumn(name, F.col(name) - F.col("_first") + 1).drop("_first")
