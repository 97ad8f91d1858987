"""Each stage against brute force on its own input."""

from __future__ import annotations

import corpus_pipeline as C
from loadscope.llm import decontam, pii, quality
from loadscope.llm.queries import QUALITY_CUT, quality_model
from tests.llm.test_simhash import reach


def test_stages(spark, sf, rows):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model, seen = quality_model(spark, sf, docs), __import__("numpy").zeros(quality.BUCKETS, bool)
    first = C.good(spark, docs, sf)
    assert first.columns == docs.columns
    kept = {d["doc_id"]: d["text"] for d in rows if model.score(__import__("numpy").array([model.margin(quality.indicators(d["text"], seen))]))[0] >= QUALITY_CUT}
    assert {r["doc_id"] for r in first.collect()} == set(kept)

    words = {i: t.encode().lower().split() for i, t in kept.items()}
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set() for i, w in words.items()}
    ids = sorted(sets)
    alike = lambda a, b: len(a & b) >= 0.8 * len(a | b)
    head = reach(sets, [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if alike(sets[a], sets[b])])
    second = C.distinct(spark, first, sf)
    assert second.columns == docs.columns and sorted(r["doc_id"] for r in second.collect()) == sorted(set(head.values()))

    third = C.uncontaminated(spark, second, sf)
    leaked = {r["doc_id"] for r in decontam.leaks(second, spark.read.parquet(f"{sf}/benchmark.parquet")).collect()}
    assert {r["doc_id"] for r in third.collect()} == set(head.values()) - leaked

    fourth = C.private(spark, third, sf)
    rows4 = fourth.collect()
    assert fourth.columns == docs.columns and all(r["n_chars"] == len(r["text"]) for r in rows4) and not any(pii.base_spans(r["text"]) for r in rows4)
    assert C.tokens(spark, fourth, sf).count() == len(rows4)
    assert C.run(spark, sf).count() == len(rows4) and [n for n, _ in C.STAGES] == ["quality", "simhash", "decontamination", "pii", "bpe"]
