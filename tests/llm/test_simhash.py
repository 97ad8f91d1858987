from __future__ import annotations

from itertools import combinations

import numpy as np
import pytest
import xxhash

from loadscope.llm import simhash
from loadscope.llm.common import components
from loadscope.llm.queries import op2_simhash


def brute_fingerprint(text):
    w = text.encode().lower().split()
    if not w:
        return 0
    shingles = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [b" ".join(w)]
    h = [xxhash.xxh64_intdigest(s, seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def reach(ids, linked):
    head = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for a, b in linked:
            m = min(head[a], head[b])
            if head[a] != m or head[b] != m:
                head[a] = head[b] = m
                changed = True
    return head


def test_query_equals_brute_force(spark, sf, rows):
    fps = {d["doc_id"]: brute_fingerprint(d["text"]) for d in rows}
    head = reach(fps, [(a, b) for a, b in combinations(sorted(fps), 2) if (fps[a] ^ fps[b]).bit_count() <= 2])
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in op2_simhash(spark, sf).collect()}
    assert got == {i: (f"{fps[i]:016x}", head[i]) for i in fps}


@pytest.mark.parametrize(("max_bits", "longest"), [(2, 48), (2, 1), (4, 48), (4, 1)])
def test_links_reach_all_pairs(spark, monkeypatch, max_bits, longest):
    """Through short postings and through one-bit neighbours alike."""
    monkeypatch.setattr(simhash, "LONGEST_POSTING", longest)
    rnd = np.random.default_rng(1)
    values = [int(x) for x in rnd.integers(-(1 << 63), 1 << 63, 12, dtype=np.int64)]
    for v in list(values):
        for _ in range(4):
            v ^= sum(int(np.uint64(1 << int(b)).view(np.int64)) for b in rnd.choice(64, rnd.integers(1, 4), replace=False))
            values.append(int(v))
    values = sorted(set(values))
    want = reach(values, [(a, b) for a, b in combinations(values, 2) if ((a ^ b) & (1 << 64) - 1).bit_count() <= max_bits])
    found = simhash.links(spark.createDataFrame([(v,) for v in values], "fp long"), max_bits)
    assert all(((r["u"] ^ r["v"]) & (1 << 64) - 1).bit_count() <= max_bits for r in found.collect())
    got = {r["node"]: r["component"] for r in components(found).collect()}
    assert {v: got.get(v, v) for v in values} == want


def test_keys_cover_every_choice_of_bytes():
    for d in (2, 4):
        keys = simhash.key_positions(d)
        assert all(any(set(k) <= set(c) for k in keys) for c in combinations(range(8), 8 - d))


def test_components_of_chains_hubs_and_rings(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 100 + i) for i in range(1, 60)] + [(200, 201), (201, 202), (202, 200), (7, 7), (None, 3)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 160)} | {i: 200 for i in range(200, 203)}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_edges(spark, odd, empty):
    got = [(r["doc_id"], r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(odd).collect()]
    assert len(got) == 8
    by = {g[0]: g for g in got}
    assert by[2][1] == by[3][1] == by[5][1] == "0" * 16 and by[2][2] == by[3][2] == by[5][2] == 2
    assert sum(g[0] == 1 for g in got) == 2 and by[1][2] == 1
    assert simhash.near_duplicates(empty).count() == 0
