"""Small helpers of the operators."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def mapped(column: Column, values: Mapping[str, object], default: object = None) -> Column:
    """A CASE over a fixed mapping; it stays inside generated code."""
    out = None
    for k, v in values.items():
        out = F.when(column == k, F.lit(v)) if out is None else out.when(column == k, F.lit(v))
    return out.otherwise(F.lit(default)) if out is not None else F.lit(default)


def rank(column: Column, order: Sequence[str]) -> Column:
    """A value's place in a fixed order, the order's length for others."""
    return mapped(column, {x: i for i, x in enumerate(order)}, len(order))


def first_match(*cases: tuple[Column, Column]) -> Column:
    out = None
    for condition, value in cases:
        out = F.when(condition, value) if out is None else out.when(condition, value)
    return out


def unsent(rows: DataFrame) -> DataFrame:
    """rows for a join that doesn't broadcast them: a merge join, whatever Spark takes their size to be.

    For rows that grow with the input. Spark counts a made text as 20 bytes and an exploded row
    as one, so it would gather many times its threshold in the driver.
    """
    return rows.hint("merge")


def firsts(values: Sequence[str], has: Callable[[str], Column], order: Column) -> Column:
    """An aggregate: those of the values that a group has, in the order of the first row that has each.

    It keeps one place for each value of a fixed list, partial results included, and never a
    list of rows.
    """
    places = F.array(*[F.struct(F.min(F.when(has(v), order)).alias("at"), F.lit(i).alias("i"), F.lit(v).alias("value")) for i, v in enumerate(values)])
    return F.transform(F.array_sort(F.filter(places, lambda x: x["at"].isNotNull())), lambda x: x["value"])
