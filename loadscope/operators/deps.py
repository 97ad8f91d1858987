"""Declared dependencies: lines to constraints, and one winner for each name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loadscope.functions.versions import normalise_name, parse_constraint
from loadscope.operators.columns import mapped

PIN_RANK = {"exact": 2, "range": 1, "unpinned": 0}
#: Ranks of a dependency's source: a lock's entries override others.
LOCK, REQUIREMENTS, OTHER = 2, 1, 0


# Fixed value: a requirement as the public grammar of dependency specifiers has it: a name, its extras in brackets, the rest.
REQUIREMENT = r"^\s*([A-Za-z0-9](?:[A-Za-z0-9._-]*[A-Za-z0-9])?)\s*(?:\[[^\]]*\])?\s*(.*)$"


def requirement(text: Column) -> tuple[Column, Column]:
    """The normalised name and the constraint of a requirement; what follows a semicolon says where it holds."""
    plain = F.btrim(F.regexp_replace(text, r";[\s\S]*\z", ""))
    return normalise_name(F.regexp_extract(plain, REQUIREMENT, 1)), F.btrim(F.regexp_extract(plain, REQUIREMENT, 2))


def requirement_lines(files: DataFrame) -> DataFrame:
    """(source, seq, name, constraint): requirement lines of files (path, text), without comments, markers, options and blanks."""
    lines = files.select(F.col("path").alias("source"), F.posexplode(F.split("text", "\r?\n")).alias("seq", "line"))
    line = F.btrim(F.regexp_replace("line", r"(^|\s)#.*\z", ""))
    lines = lines.select("source", "seq", line.alias("line")).where("line <> '' and not startswith(line, '-')")
    name, constraint = requirement(F.col("line"))
    return lines.select("source", "seq", name.alias("name"), constraint.alias("constraint")).where("name is not null")


def merge(declared: DataFrame) -> DataFrame:
    """(name, version, pin, source, constraint), one for each name of declared (name, constraint, source, rank, seq).

    The last lock entry wins; without one the highest pin, of equals the first. seq is the
    order in which entries are read, by rank of their files.
    """
    rows = declared.withColumn("c", parse_constraint(F.col("constraint"))).withColumn("lock", F.col("rank") == LOCK)
    key = F.struct((~F.col("lock")).alias("later"), F.when(F.col("lock"), F.lit(0)).otherwise(-mapped(F.col("c.pin"), PIN_RANK, 0)).alias("pin"), F.when(F.col("lock"), -F.col("seq")).otherwise(F.col("seq")).alias("seq"))
    best = rows.groupBy("name").agg(F.min_by(F.struct("c.version", "c.pin", "source", "constraint"), key).alias("d"))
    return best.select("name", "d.version", "d.pin", "d.source", "d.constraint")
