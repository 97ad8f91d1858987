"""Artifacts and evidence, whose texts are made in the query, are in no broadcast, however small Spark takes them to be."""

from __future__ import annotations

import re

import pytest

from loadscope import queries
from loadscope.operators import explore, numbering

GROWING = [
    "bom_digests",
    "bom_rows",
    "bom_visible",
    "boundary",
    "boundary_cells",
    "evidence_bind",
    "evidence_counts",
    "evidence_gaps",
    "evidence_scanners",
    "facet_counts",
    "facet_filter",
    "finding_rank",
    "finding_subjects",
    "findings",
    "indicators",
    "insertion_order",
    "reference_resolve",
    "search",
    "search_proof",
    "sort_records",
    "stripe",
    "summary",
]


def broadcast(plan: str) -> list[str]:
    """The scans of part and orders below a broadcast that a hash table is built of."""
    depth = lambda line: len(line) - len(line.lstrip(" :+-"))
    found, inside = [], None
    for line in plan.split("\n"):
        if inside is not None and depth(line) <= inside:
            inside = None
        if inside is None and "BroadcastExchange HashedRelation" in line:
            inside = depth(line)
        if inside is not None:
            found += re.findall(r"FileScan parquet \[[po]_\w+", line)
    return found


@pytest.mark.parametrize("name", GROWING)
def test_growing_tables_are_not_broadcast(spark, sf, monkeypatch, name):
    made = []

    def kept(f):
        return lambda rows, *more: made.append(rows) or f(rows, *more)

    for module, part in ((numbering, "dealt"), (queries, "stored"), (explore, "stored")):
        monkeypatch.setattr(module, part, kept(getattr(module, part)))
    made.append(queries.queries()[name](spark, sf))
    plans = [rows._jdf.queryExecution().executedPlan().toString() for rows in made]
    assert any("FileScan parquet [p_" in p for p in plans)
    assert [x for p in plans for x in broadcast(p)] == []
