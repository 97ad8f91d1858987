from __future__ import annotations

import re

import duckdb
import pytest

from loadscope.llm import decontam

ITEM = "Tom has 12 apples and buys 30 kg of Pears from Anna before the market closes at noon today"


def found(spark, texts, items=(ITEM,)):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    return sorted((r["doc_id"], r["item_id"], r["same"]) for r in decontam.leaks(docs, bench).collect())


@pytest.mark.parametrize(
    ("text", "want"),
    [
        (f"well, {ITEM} indeed", [(0, 0, True)]),
        ("so " + ITEM.replace("12", "99").replace("kg", "pounds").replace("Pears", "Plums").replace("Anna", "Bob"), [(0, 0, False)]),
        (ITEM.upper(), []),
        (ITEM[:40], []),
        (" ".join(reversed(ITEM.split())), []),
        ("", []),
        (None, []),
    ],
)
def test_passages(spark, text, want):
    assert found(spark, [text]) == want


def test_slots_have_to_be_consistent(spark):
    item = "first 5 boxes then another 5 boxes then again 7 boxes were carried slowly up the long hill"
    good, bad = re.sub("5", "8", item), item.replace("another 5", "another 8")
    merged = item.replace("5", "7")
    assert found(spark, [good, bad, merged], [item]) == [(0, 0, False)]


def test_short_items_repeats_and_edges(spark, odd, empty):
    assert found(spark, ["x alpha beta gamma delta y", "alpha beta gamma"], ["alpha beta gamma delta", "alpha 1 2", ""]) == [(0, 0, True)]
    bench = spark.createDataFrame([(0, ITEM, 1), (0, ITEM, 1), (None, ITEM, 1), (1, None, 1)], "item_id long, text string, hash int")
    assert decontam.leaks(odd, bench).count() == 0 and decontam.leaks(empty, bench).count() == 0 and decontam.leaks(odd, bench.limit(0)).count() == 0
    assert decontam.clean(odd, bench).count() == 8


def test_sql(spark, sf):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"create view {t} as select * from read_parquet('{sf}/{t}.parquet')")
    want = con.execute(decontam.leaks_sql())
    names = [d[0] for d in want.description]
    got = decontam.leaks(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet"))
    assert sorted(map(tuple, got.select(*names).collect())) == sorted(want.fetchall())


@pytest.mark.parametrize("n", range(3, 14))
def test_capitalised_items_within_a_sentence(spark, n):
    """An item's first word has an ordinary word before it in a document; items of digits and names have few words of their own."""
    items = [" ".join(ITEM.split()[:n]), " ".join(["Rome", "7", "Oslo", "8", "kg", "9", "Bonn", "4", "Lima", "5", "Kyiv", "6", "km"][:n])]
    assert found(spark, [f"they say {items[0]} again", f"they say {items[1]} again", f"they say {items[0].lower()} again"[:12]], items) == [(0, 0, True), (1, 1, True)]
