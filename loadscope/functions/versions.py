"""Versions, constraints and three-valued thresholds as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Components compared; missing ones are 0.
WIDTH = 8


def parse_version(raw: Column) -> Column:
    """The leading numbers of a version, a `v` before them aside; null without any."""
    found = F.regexp_extract(F.btrim(raw), "^[vV]?([0-9]+(?:\\.[0-9]+)*)", 1)
    return F.when(found != "", F.transform(F.split(found, "\\."), lambda x: x.cast("bigint")))


def padded(version: Column) -> Column:
    return F.slice(F.concat(version, F.array_repeat(F.lit(0).cast("bigint"), WIDTH)), 1, WIDTH)


def compare(a: Column, b: Column) -> Column:
    """-1, 0 or 1; null if either is."""
    x, y = padded(a), padded(b)
    return F.when(x < y, -1).when(x > y, 1).when(x == y, 0)


def at_least(version: Column, target: Column) -> Column:
    return padded(version) >= padded(target)


def parse_constraint(raw: Column) -> Column:
    """(version, pin): exact, range (with its lowest version) or unpinned."""
    text = F.btrim(raw)
    exact = F.regexp_extract(text, "^==+\\s*([^,\\s]+)", 1)
    floor = F.regexp_extract(text, "^(?:~=|\\^|~)\\s*([^,\\s]+)", 1)
    least = F.regexp_extract(text, "(?:^|,)\\s*>=\\s*([^,\\s]+)", 1)
    bare = F.regexp_extract(text, "^([vV]?[0-9][^,\\s]*)\\z", 1)
    made = lambda v, pin: F.struct(v.alias("version"), F.lit(pin).alias("pin"))
    none = made(F.lit(None).cast("string"), "unpinned")
    return (
        F.when(text.isin("", "*") | text.isNull(), none)
        .when(exact != "", made(F.regexp_replace(exact, "\\.\\*\\z", ""), "exact"))
        .when(floor != "", made(floor, "range"))
        .when(least != "", made(least, "range"))
        .when(bare != "", made(bare, "exact"))
        .otherwise(none)
    )


def normalise_name(raw: Column) -> Column:
    """A distribution's name: lower case, hyphens, without extras; null if it isn't one."""
    name = F.regexp_replace(F.replace(F.lower(F.btrim(raw)), F.lit("_"), F.lit("-")), "\\[.*\\z", "")
    return F.when(name.rlike("^[a-z0-9][a-z0-9.-]*\\z"), name)


def threshold(version: Column, pin: Column, target: Column) -> Column:
    """True or false where the pin decides whether the version reaches the target, else null.

    An exact pin decides both ways; a range only that its lowest version is enough.
    """
    reached = at_least(parse_version(version), target)
    return F.when(pin == "exact", reached).when((pin == "range") & reached, True)
