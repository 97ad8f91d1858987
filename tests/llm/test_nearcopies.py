from __future__ import annotations

from itertools import combinations

import pytest

import corpus_pipeline as C
from loadscope.llm import nearcopies
from tests.llm.test_simhash import reach

DOC = "doc_id long, text string, lang string, source string, n_chars long"


def brute_set(text):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def brute_alike(a, b):
    return a == b or bool(a and b) and len(a & b) >= 0.8 * len(a | b)


def survivors(rows):
    sets = [brute_set(t) for _, t in rows]
    head = reach(range(len(rows)), [(i, j) for i, j in combinations(range(len(rows)), 2) if brute_alike(sets[i], sets[j])])
    groups = {}
    for i, (k, _) in enumerate(rows):
        groups.setdefault(head[i], []).append((k is None, k or 0))
    return sorted(min(g) for g in groups.values())


def kept(spark, rows):
    docs = spark.createDataFrame([(k, t, "l", "s", len(t or "")) for k, t in rows], DOC)
    return sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in C.distinct(spark, docs, None).collect())


def text(seed, n=120):
    return [f"w{(seed * 7919 + i * i * 31 + i) % 99991}" for i in range(n)]


def edited(words, *at):
    return " ".join(f"x{i}" if i in at else w for i, w in enumerate(words))


def test_planted_near_copies_go(spark):
    """One changed word in 120 leaves a Jaccard similarity of 0.92, two of 0.84, six below 0.8."""
    rows = []
    for k in range(12):
        w = text(k)
        rows += [(10 * k, " ".join(w)), (10 * k + 1, edited(w, 50)), (10 * k + 2, edited(w, 20, 90)), (10 * k + 3, edited(w, 10, 30, 50, 70, 90, 110))]
    assert kept(spark, rows) == survivors(rows) == sorted([(False, 10 * k) for k in range(12)] + [(False, 10 * k + 3) for k in range(12)])


def test_rows_without_or_with_repeated_ids(spark):
    rows = [(None, " ".join(text(1))), (None, " ".join(text(2))), (7, " ".join(text(3))), (7, " ".join(text(4))), (None, " ".join(text(3))), (8, None), (9, " \n")]
    assert kept(spark, rows) == survivors(rows) == [(False, 7), (False, 7), (False, 8), (True, 0), (True, 0)]


@pytest.mark.parametrize("longest", [48, 2])
def test_large_groups(spark, monkeypatch, longest):
    monkeypatch.setattr(nearcopies, "LONGEST_BAND", longest)
    rows = [(k, edited(text(k % 2, 200), k, (k * 37) % 200)) for k in range(150)] + [(1000 + k, edited(text(5, 60), *range(k))) for k in range(12)]
    assert kept(spark, rows) == survivors(rows)


@pytest.mark.parametrize("longest", [48, 4])
def test_no_pair_of_a_template_is_lost(spark, monkeypatch, longest):
    """Texts of one template that aren't near (0.78), with planted pairs that are (0.83 and more), and chains of near copies among them."""
    monkeypatch.setattr(nearcopies, "LONGEST_BAND", longest)
    base, rows = text(11, 450), []
    for k in range(160):
        own = [f"u{k}x{i}" for i in range(64)]
        rows.append((2 * k, " ".join(base + own)))
        if k % 2:
            rows.append((2 * k + 1, " ".join(base + own[:20] + [f"v{k}x{i}" for i in range(44)])))
    rows += [(5000 + k, edited(text(12, 300), *range(0, k * 3, 3))) for k in range(60)]
    want = survivors(rows)
    assert len([k for _, k in want if k < 5000]) == 160 and kept(spark, rows) == want


def test_prefixes_share_a_shingle():
    for n in range(1, 60):
        for m in range(n, 80):
            least = next((o for o in range(n + 1) if 5 * o >= 4 * (n + m - o)), None)
            if least is not None:
                first, every = nearcopies.prefix_lengths(n)[0], nearcopies.prefix_lengths(m)[1]
                assert first >= n - least + 1 and every >= m - least + 1 and 5 * n >= 4 * m


def test_sketches_never_differ_more_than_sets():
    rnd = __import__("numpy").random.default_rng(4)
    for n in (1, 40, 3000):
        a = rnd.integers(0, 1 << 63, n).astype("uint64")
        b = a.copy()
        b[: n // 5 + 1] = rnd.integers(0, 1 << 63, n // 5 + 1).astype("uint64")
        bits = sum(int(x).bit_count() for x in (nearcopies.sketch(a) ^ nearcopies.sketch(b)).view("uint64"))
        assert bits <= len({*a.tolist()} ^ {*b.tolist()}) and (n != 40 or bits >= 10)


def test_table_equals_brute_force(spark, sf, rows):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    want = survivors([(d["doc_id"], d["text"]) for d in rows])
    assert sorted((False, r["doc_id"]) for r in C.distinct(spark, docs, sf).collect()) == want


def test_edges(spark, odd, empty):
    assert C.distinct(spark, empty, None).count() == 0
    got = nearcopies.keep_one(odd)
    assert got.columns == odd.columns and sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in got.collect()) == [(False, 1), (False, 2), (False, 4), (False, 6), (True, 0)]


def test_simhash_links_come_first(spark):
    """Without any band: fingerprints of two differing bits link, one of three doesn't, and none below the similarity."""
    w = text(3, 300)
    texts = {"a": " ".join(w), "b": edited(w, 7), "c": edited(w, 70), "d": edited(w, 250), "e": " ".join(text(4, 300)), "f": ""}
    fps = {"a": 0b111, "b": 0b100, "c": 0b100, "d": 0b111 << 20, "e": 0b110, "f": 0b1110}
    marked = spark.createDataFrame([(k, [], fps[k], t) for k, t in texts.items()], "set string, bands array<long>, fp long, text string")
    assert {(r["u"], r["v"]) for r in nearcopies.links(marked).collect()} == {("a", "b"), ("b", "c")}
    own = nearcopies.shingles(texts["a"])
    assert nearcopies.simhash.fingerprint_of(own) == sum(1 << b for b in range(63) if 2 * sum(int(x) >> b & 1 for x in own) > len(own)) - (2 * sum(int(x) >> 63 for x in own) > len(own)) * (1 << 63)
