"""Rules as relations: the first rule whose pattern a value matches."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rules that are broadcast at once; more of them are tried in turn, as many at a time.
AT_ONCE = 512


def first_rule(rows: DataFrame, rules: DataFrame, column: str, gives: list[str], same: list[str] = ()) -> DataFrame:
    """rows with the columns `gives` of the first rule, by priority, whose pattern the column matches and whose `same` columns are equal; null where there is none.

    rules has priority (different for each), pattern, gives and same. Each distinct value meets the
    rules once, and of the matches the smallest priority is kept by a partial minimum. Rules are
    counted first; they are broadcast in blocks of AT_ONCE, so a relation of any size is
    never broadcast whole. A null value or pattern matches nothing. Columns of rows that are named as those given are replaced.
    """
    values = rows.select(column, *same).distinct().where(F.col(column).isNotNull())
    ours = rules.where("pattern is not null").select(F.col("priority").alias("_priority"), F.col("pattern").alias("_pattern"), F.struct(*gives).alias("_gives"), *[F.col(c).alias(f"_{c}") for c in same])
    # with priorities spread by their hash a block may be somewhat larger than AT_ONCE
    parts = max(1, -(-ours.count() // AT_ONCE))
    block = F.pmod(F.xxhash64("_priority"), F.lit(parts))
    on = reduce(lambda a, b: a & b, [F.regexp_like(column, F.col("_pattern")), *[F.col(c) == F.col(f"_{c}") for c in same]])
    found = reduce(DataFrame.unionByName, [values.join(F.broadcast(ours.where(block == i)), on) for i in range(parts)])
    best = found.groupBy(column, *same).agg(F.min_by("_gives", "_priority").alias("_gives"))
    kept = rows.drop(*[g for g in gives if g in rows.columns])
    return kept.join(best, [column, *same], "left").select(*kept.columns, *[F.col(f"_gives.{g}").alias(g) for g in gives])
