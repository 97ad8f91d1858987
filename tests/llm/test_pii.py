from __future__ import annotations

import hashlib
import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loadscope.llm import pii
from loadscope.llm.queries import op1_pii


def brute(text):
    digits = lambda m: re.sub(r"[^0-9]", "", m[0])
    out = [(0, *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(1, *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [(2, *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 16 <= len(digits(m)) <= 19 and pii.luhn(digits(m))]
    return out + [(3, *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 8 <= len(digits(m)) <= 15]


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="ab@.0123 -+()%_\n²٣é", max_size=60))
def test_base_spans_equal_the_patterns(text):
    base = pii.base_spans(text)
    assert base == brute(text)
    taken = sorted((s, e) for _, s, e in base)
    for _, s, e in pii.field_spans(text, base, pii.fit()):
        assert 0 <= s < e <= len(text) and all(e <= a or s >= b for a, b in taken)


def named(text):
    base = pii.base_spans(text)
    return [(pii.KINDS[k], text[s:e]) for k, s, e in sorted(pii.field_spans(text, base, pii.fit()))]


def test_the_field_adds_spans():
    assert named("call (555) 123-4567 or mail joe[at]mail.example.com today") == [("email", "joe[at]mail.example.com"), ("phone", "(555) 123-4567")]
    # the patterns swallow both and fail; the field tells them apart
    assert named("x +1 (988) 555-2485 4041894974608795 y") == [("card", "4041894974608795"), ("phone", "+1 (988) 555-2485")]
    assert named("version 4.0, 2024-01-02 12:33:44, 300.1.1.1 and password=e3b0c44298fc") == []


def test_best_segmentation_equals_brute_force():
    """Over all ways to choose spans that don't overlap."""
    rnd, w = random.Random(5), pii.fit()
    for _ in range(60):
        text = "".join(rnd.choice(["12", "555", "-", " ", ".", "1234", "(", ")", "+", "a@b.co"]) for _ in range(6)).strip()
        for tokens in pii.runs(text):
            options = [(i, j, sum(w.get((k, f), 0.0) for f in pii.features(text, tokens[i][0], tokens[j - 1][1]))) for i, j, k in pii.candidates(text, tokens)]

            def best(at, tokens=tokens, options=options):
                return 0.0 if at >= len(tokens) else max([best(at + 1)] + [s + best(j) for i, j, s in options if i == at and s > 0])

            found = pii.field_spans(text, [], w)
            ends = {t[0]: i for i, t in enumerate(tokens)}, {t[1]: i + 1 for i, t in enumerate(tokens)}
            got = sum(sum(w.get((k, f), 0.0) for f in pii.features(text, s, e)) for k, s, e in found if s in ends[0] and e in ends[1])
            assert abs(got - best(0)) < 1e-9


def test_query(spark, sf, rows):
    got = {r["doc_id"]: r for r in op1_pii(spark, sf).collect()}
    assert len(got) == len(rows)
    for d in rows:
        base, r = brute(d["text"]), got[d["doc_id"]]
        assert [r[f"n_{k}"] for k in pii.KINDS] == [sum(x[0] == i for x in base) for i in range(4)]
        assert r["base_sha256"] == hashlib.sha256(pii.joined(base).encode()).hexdigest()
        assert set(pii.joined(base).split(",")) <= set(r["spans"].split(","))


def test_edges(spark, odd, empty):
    got = pii.find(odd).collect()
    assert len(got) == 8 and sum(r["pii"]["n_card"] for r in got) == 1
    assert pii.find(empty).count() == 0
    clean = {r["key"]: r["text"] for r in pii.redact(odd).collect()}
    assert clean[4].endswith("end <card>") and clean[1] is None and clean[2] == ""


@pytest.mark.parametrize("text", [lambda n: "1" * n, lambda n: "1." * n, lambda n: "+1 " * n, lambda n: "a@" * n, lambda n: "1 " * n, lambda n: "a@b." * n, lambda n: "(1-" * n])
def test_hostile_texts_take_linear_time(text):
    import time

    def taken(n):
        best = []
        for _ in range(3):
            began = time.perf_counter()
            pii.field_spans(text(n), pii.base_spans(text(n)), pii.fit())
            best.append(time.perf_counter() - began)
        return min(best)

    assert taken(10_000) < 10 * taken(2_500) + 0.1  # squares would take 16 times as long
