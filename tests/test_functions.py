from __future__ import annotations

import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loadscope.functions import text as X
from loadscope.functions import versions as V


def values(spark, column, rows):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, v string")
    return [r[0] for r in df.orderBy("i").select(column(F.col("v"))).collect()]


def test_clip_and_sanitise(spark):
    assert values(spark, lambda c: X.clip(c, 6), ["  a \n b ", "abcdefgh", "", None, "x\u00a0y"]) == ["a b", "abcde…", "", None, "x y"]
    assert values(spark, X.sanitise, ["a\x1bb\u202e\ufeff", "tab\tok"]) == ["a\ufffdb\ufffd\ufffd", "tab\tok"]


@pytest.mark.parametrize(
    ("raw", "want"),
    [("a/./b//c", "a/b/c"), ("a\\b", "a/b"), ("/a", None), ("C:\\a", None), ("a/../b", None), ("", None), (".", None), ("a" * 1025, None), ("a" * 1024, "a" * 1024)],
)
def test_normalise_path(spark, raw, want):
    assert values(spark, X.normalise_path, [raw]) == [want]


def test_path_parts(spark):
    paths = ["a/b.TAR.gz", "x", ".env", "d/.hid.py", "d/e/"]
    assert values(spark, X.extname, paths) == [".gz", "", "", ".py", ""]
    assert values(spark, X.stem, paths) == ["b.TAR", "x", ".env", ".hid", ""]
    assert values(spark, X.dirname, paths) == ["a", "", "", "d", "d/e"]


@pytest.mark.parametrize(
    ("glob", "path", "want"),
    [
        ("**/x.py", "x.py", True), ("**/x.py", "a/b/x.py", True), ("*.py", "a/x.py", False), ("a/**", "a/b/c", True), ("a?c", "a/c", False), ("a.b", "axb", False), ("t*/**/z", "tt/a/z", True), ("*.py", "x.py\n", False),
    ],
)
def test_globs(spark, glob, path, want):
    assert values(spark, lambda c: X.matches_any(c, [glob]), [path]) == [want]


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab/*?.x", max_size=8), st.text(alphabet="ab/.x", max_size=8))
def test_glob_regex_is_a_full_match(glob, path):
    pattern = X.glob_regex(glob).replace("\\z", "\\Z")
    assert (re.match(pattern, path) is not None) == (re.fullmatch(pattern[1:-2], path) is not None)


def test_csv_cell(spark):
    assert values(spark, X.csv_cell, ["=1", 'a"b', None, "-x", "\ty"]) == ['"\'=1"', '"a""b"', '""', '"\'-x"', '"\'\ty"']


def test_versions(spark):
    assert values(spark, V.parse_version, ["v2.6.1rc", "3", "x", "2.", None]) == [[2, 6, 1], [3], None, [2], None]
    two = lambda c: V.compare(V.parse_version(c), V.parse_version(F.lit("2.6")))
    assert values(spark, two, ["2.6.0", "2.10", "2.5.9", "none"]) == [0, 1, -1, None]


@pytest.mark.parametrize(
    ("raw", "want"),
    [("", (None, "unpinned")), ("*", (None, "unpinned")), ("==2.*", ("2", "exact")), ("~=1.4", ("1.4", "range")), ("^0.3", ("0.3", "range")), (">=2,<3", ("2", "range")), ("<3, >=2", ("2", "range")), ("1.2", ("1.2", "exact")), ("<2.6", (None, "unpinned"))],
)
def test_constraints(spark, raw, want):
    assert tuple(values(spark, V.parse_constraint, [raw])[0]) == want


def test_threshold(spark):
    rows = spark.createDataFrame([("2.7", "exact"), ("2.5", "exact"), ("2.5", "range"), ("2.7", "range"), (None, "unpinned"), (None, None)], "v string, p string")
    got = [r[0] for r in rows.select(V.threshold(F.col("v"), F.col("p"), F.array(F.lit(2).cast("bigint"), F.lit(6).cast("bigint")))).collect()]
    assert got == [True, False, None, True, None, None]
