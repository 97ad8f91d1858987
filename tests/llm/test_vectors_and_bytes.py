from __future__ import annotations

import hashlib
import tracemalloc
from collections import Counter

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from loadscope.llm import embed, license, suffix
from loadscope.llm.queries import op6_license, op7_embedding, op10_suffix


def test_embeddings_equal_their_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from read_parquet('{sf}/embeddings.parquet')")
    want = con.execute(embed.ORACLE)
    names = [d[0] for d in want.description]
    assert sorted(map(tuple, op7_embedding(spark, sf).select(*names).collect())) == sorted(want.fetchall())


@pytest.mark.parametrize("block", [1024, 16])
def test_recall_of_links(spark, monkeypatch, block):
    """Groups about the threshold, in many cells and in blocks: no false link, and 0.9 of the true ones at least."""
    monkeypatch.setattr(embed, "BLOCK", block)
    monkeypatch.setattr(embed, "CELL", 32)
    rnd = np.random.default_rng(2)
    base = rnd.normal(size=(60, 16))
    rows = np.concatenate([b + rnd.normal(scale=0.2, size=(12, 16)) for b in base]).astype(np.float32)
    x = embed.unit(rows.astype(np.float64))
    truth = (x @ x.T >= embed.COSINE) & ~np.eye(len(x), dtype=bool)
    got = {r["vec_id"]: r for r in embed.near_duplicates(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rows)], "vec_id long, embedding array<float>")).collect()}
    n = np.array([got[i]["n_links"] for i in range(len(rows))])
    assert (n <= truth.sum(axis=1)).all() and n.sum() >= 0.9 * truth.sum()


def test_vector_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [2.0, 0.1]), (4, None), (5, [0.0, 0.0]), (6, [nan, 1.0]), (7, [inf, 1.0]), (8, [None, 1.0]), (9, []), (10, [1.0, 0.0, 0.0]), (11, [1e-300, 0.0]), (12, [-1.0, -0.0]), (None, [0.0, 1.0])]
    df = spark.createDataFrame([(*r, 0) for r in rows], "vec_id long, embedding array<double>, cell int")
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in embed.near_duplicates(df).collect()}
    linked = {1: (3, 1, True), 2: (3, 1, False), 3: (3, 1, False), 11: (3, 1, False)}
    assert got == linked | {i: (0, i, True) for i in (4, 5, 6, 7, 8, 9, 10, 12)} | {None: (0, None, False)}
    assert embed.near_duplicates(df.limit(0)).count() == 0


def brute_repeats(raws):
    seen = Counter(r[i : i + 200] for r in raws for i in range(len(r) - 199))
    out = []
    for r in raws:
        cover = np.zeros(len(r) + 1, np.int8)
        for i in range(len(r) - 199):
            if seen[r[i : i + 200]] > 1:
                cover[i : i + 200] = 1
        kept = bytes(np.frombuffer(r, np.uint8)[cover[: len(r)] == 0]) if r else b""
        out.append((len(r), int(cover[: len(r)].sum()), int((np.diff(np.concatenate([[0], cover])) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


def test_suffix_query_equals_brute_force(spark, sf, rows):
    want = dict(zip([d["doc_id"] for d in rows], brute_repeats([d["text"].encode() for d in rows]), strict=True))
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in op10_suffix(spark, sf).collect()}
    assert got == want


@pytest.mark.parametrize("block", [4000, 1])
def test_suffix_of_hard_texts(spark, monkeypatch, block):
    """Runs, periods, one passage in different surroundings, copies: through suffix arrays and through strings' own hashes."""
    monkeypatch.setattr(suffix, "BLOCK", block)
    rnd = np.random.default_rng(3)
    noise = lambda n: "".join(rnd.choice(list("abcdefgh é"), n))
    passage, line = noise(260), noise(90)
    texts = [passage, noise(50) + passage + noise(70), passage[:230] + noise(300), "x" * 700, "ab" * 300, noise(400), (t := noise(350)), t, line + noise(200), line + noise(210), t[:180] + noise(90), line * 5, "", "short", passage[30:] + line * 3]
    docs = spark.createDataFrame([(i, x, 0) for i, x in enumerate(texts)], "doc_id long, text string, n int")
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], hashlib.sha256(r["kept"]).hexdigest()) for r in suffix.deduplicate(docs).collect()}
    assert [got[i] for i in range(len(texts))] == brute_repeats([x.encode() for x in texts])


def test_suffix_edges(spark, odd, empty):
    got = sorted((r["doc_id"] or 0, r["n_bytes"], r["n_removed"]) for r in suffix.deduplicate(odd).collect())
    assert len(got) == 8 and [g for g in got if g[0] == 4][0][2] == 300_000 and suffix.deduplicate(empty).count() == 0


def test_suffix_arrays_and_prefixes():
    rnd = np.random.default_rng(1)
    for _ in range(150):
        t = np.append(rnd.integers(1, rnd.integers(2, 6), rnd.integers(1, 150)), 0)
        if rnd.random() < 0.3:
            t = np.concatenate([t[:-1], t])
        order = suffix.suffix_array(t)
        assert order.tolist() == sorted(range(len(t)), key=lambda i: t[i:].tolist())
        shared = suffix.common_prefixes(t, order)
        for a, b in zip(order[:-1], order[1:], strict=True):
            n = 0
            while max(a, b) + n < len(t) and t[a + n] == t[b + n]:
                n += 1
            assert shared[b] == n


def test_contexts_hold_each_string_once(monkeypatch):
    raw = bytes(np.random.default_rng(5).integers(97, 101, 3000).astype(np.uint8))
    for chunk in (1 << 22, 500):
        monkeypatch.setattr(suffix, "CHUNK", chunk)
        _, start, size = suffix.contexts(raw)
        assert [x for s, n in zip(start, size, strict=True) for x in range(s, s + n)] == list(range(len(raw) - 199))


def test_licences(spark):
    deep = "/".join("abcdefghij" * 5)
    files = [
        ("a/LICENSE", "Released under the MIT License."), ("a/b/x.py", "code"), ("a/b/c/LICENSE.txt", "Licensed under the Apache License, Version 2.0."), ("a/b/c/d/y.py", "code"), ("z.py", None),
        ("q/own.py", "# x\n# This work is licensed under the GNU General Public License, version 3.\ncode"), ("a/none.py", "no licence is spoken of here, but warranty"), ("a/LICENSE", "Released under the MIT License."), (None, "x"), (None, "Released under the MIT License."),
        (f"a/{deep}/z.py", ""), ("i/COPYING", "Copyright (c) 2020 A. Person\n\n" + license.TEXTS["ISC"].replace(". ", ".\n")), ("i/x.py", "word " * 60_000),
    ]
    rows = license.scan(spark.createDataFrame([(*f, 1) for f in files], "path string, text string, licence int")).collect()
    assert len(rows) == len(files) and sorted((r["licence"] or "", r["origin"]) for r in rows if r["path"] is None) == [("", "none"), ("MIT", "own")]
    got = {r["path"]: (r["licence"], r["origin"], r["inherited_from"]) for r in rows if r["path"]}
    assert got == {
        "a/LICENSE": ("MIT", "own", None), "a/b/x.py": ("MIT", "inherited", "a/LICENSE"), "a/b/c/LICENSE.txt": ("Apache-2.0", "own", None), "a/b/c/d/y.py": ("Apache-2.0", "inherited", "a/b/c/LICENSE.txt"),
        "z.py": (None, "none", None), "q/own.py": ("GPL-3.0", "own", None), "a/none.py": ("MIT", "inherited", "a/LICENSE"), f"a/{deep}/z.py": ("MIT", "inherited", "a/LICENSE"),
        "i/COPYING": ("ISC", "own", None), "i/x.py": ("ISC", "inherited", "i/COPYING"),
    }
    assert license.scan(spark.createDataFrame([], "path string, text string")).count() == 0


def test_licences_work_out_each_path_and_text_once(spark):
    rows = [("a/LICENSE", "Released under the MIT License."), ("a/b/x.py", "code"), ("a/b/c/COPYING", "code"), ("z.py", ""), (None, "x")]
    paths, texts = spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0)

    def counted(seen):
        return F.udf(lambda x: seen.add(1) or x, "string")

    files = spark.createDataFrame(rows, "p string, t string").select(counted(paths)("p").alias("path"), counted(texts)("t").alias("text"))
    found = license.scan(files).collect()
    assert {r["path"]: r["inherited_from"] for r in found} == {"a/LICENSE": None, "a/b/x.py": "a/LICENSE", "a/b/c/COPYING": "a/LICENSE", "z.py": None, None: None}
    assert (paths.value, texts.value) == (len(rows), len(rows))


@pytest.mark.parametrize("name", sorted(license.TEXTS))
def test_whole_licence_texts_are_told_apart(name):
    matcher = license.Matcher(license.TEMPLATES, license.TEXTS)
    assert matcher.own("Copyright 2021 Someone\n\n" + license.TEXTS[name], True)[1] == name


def test_passages_equal_brute_force(rows):
    """Every line and every line with its neighbours against every sentence, as dense vectors."""
    import math
    import re

    matcher = license.Matcher(license.TEMPLATES, {})
    units = [(n, s) for n, t in license.TEMPLATES.items() for s in t.replace("SPDX-", ". SPDX-").split(". ") if s.strip(" .")]
    words = lambda t: re.findall(r"[^\W_]+(?:[.-][^\W_]+)*", t.lower())
    df = Counter(w for _, s in units for w in set(words(s)))
    vector = lambda ws: {w: c * (math.log((1 + len(units)) / (1 + df.get(w, 0))) + 1) for w, c in Counter(ws).items()}
    dot = lambda a, b: sum(x * b.get(w, 0.0) for w, x in a.items())
    known = [(n, v := vector(words(s)), math.sqrt(dot(v, v))) for n, s in units]
    odd = ["", "\n\n", "the License", "Released under\nthe MIT License.", "x\r\nLicensed under the Apache\rLicense, Version 2.0."]
    for text in odd + [d["text"] for d in rows][:60]:
        lines = [words(x) for x in re.split(r"\r\n|\r|\n", text)]
        passages = [p for i in range(len(lines)) if lines[i] for p in (lines[i], sum(lines[max(0, i - 1) : i + 2], []))]
        found = [(-round(min(dot(p, v) / math.sqrt(dot(p, p)) / norm, 1.0), 9), n) for p in map(vector, passages) if p for n, v, norm in known if dot(p, v) >= 0.5 * norm * math.sqrt(dot(p, p))]
        want, got = min(found, default=None), matcher.own(text, False)
        assert (got is None) == (want is None) and (got is None or abs(got[0] - want[0]) < 1e-8)


def test_licence_query(spark, sf, rows):
    known = {"Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0", "General Public License, version 3.": "GPL-3.0", "under the Apache License, Version 2.0.": "Apache-2.0", "under the MIT License.": "MIT"}
    got = {r["doc_id"]: r for r in op6_license(spark, sf).collect()}
    assert len(got) == len(rows)
    for d in rows:
        want = {v for k, v in known.items() if k in d["text"]}
        if len(want) == 1:
            assert got[d["doc_id"]]["licence"] == want.pop() and got[d["doc_id"]]["origin"] == "own"


def test_shards_are_bounded_and_hold_whole_hashes(monkeypatch):
    """A large group isn't put on top of a shard that is nearly full, and none is split."""
    monkeypatch.setattr(suffix, "SHARD", 3000)
    rows = pd.DataFrame({"anchor": np.repeat(np.arange(40), (np.arange(40) * 7) % 13 + 2), "n": 1, "start": 0})
    rows = rows.assign(key=np.arange(len(rows)), bytes=[bytes([97 + k % 26]) * (200 + k % 90) for k in range(len(rows))])
    seen: list[list[bytes]] = []
    monkeypatch.setattr(suffix, "repeated_starts", lambda contexts: seen.append(contexts) or [np.ones(1, bool)] * len(contexts))
    for step in (7, 100, 10_000):
        seen.clear()
        out = pd.concat(suffix._sorted_shards(rows.iloc[i : i + step] for i in range(0, len(rows), step)))
        assert out["key"].tolist() == rows["key"].tolist() and len(seen) > 5
        at = 0
        for contexts in seen:
            own = rows.iloc[at : at + len(contexts)]
            at += len(contexts)
            assert sum(map(len, contexts)) <= 3000 or own["anchor"].nunique() == 1
            assert not set(own["anchor"]) & set(rows.iloc[at:]["anchor"])


def test_memory_of_a_suffix_array():
    """Fewer than 60 bytes for each byte of a shard, at the peak."""
    rnd = np.random.default_rng(1)
    noise = lambda n: bytes(rnd.integers(97, 123, n).astype(np.uint8))
    line = noise(160)
    contexts = [noise(90) + line + noise(90) for _ in range(600)]
    tracemalloc.start()
    try:
        suffix.repeated_starts(contexts)
        assert tracemalloc.get_traced_memory()[1] < 60 * sum(map(len, contexts))
    finally:
        tracemalloc.stop()
