"""Resampling, chat formatting and ranked search against plain Python, with odd rows."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loadscope.llm import chat, ranked, resample
from loadscope.llm import queries as Q
from loadscope.llm.bpe import tokenizer_text

TABLES = ["documents", "benchmark", "conversations"]
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
CAPITALS = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.mark.parametrize("name", ["op11_resampling", "op12_chat", "op13_search"])
def test_query_equals_its_sql(spark, sf, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf}/{t}.parquet')")
    got = Q.queries()[name](spark, sf)
    want = con.execute(Q.oracle_sql()[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(got.columns)
    assert sorted(map(repr, map(tuple, got.select(*names).collect()))) == sorted(map(repr, want.fetchall()))


# ---- resampling ----


def runs(text):
    w = WORD.findall((text or "").translate(CAPITALS))
    return len(w), w + [f"{a} {b}" for a, b in zip(w, w[1:], strict=False)]


def brute_resample(docs, target, percent, least, buckets=10_000):
    of = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = Counter(), Counter()
    for _, text in docs:
        s.update(map(of, runs(text)[1]))
    for text in target:
        t.update(map(of, runs(text)[1]))
    gain = [math.floor(1000 * math.log((t[b] + 1) * (s.total() + buckets) / ((s[b] + 1) * (t.total() + buckets)))) for b in range(buckets)]
    rows = []
    for i, text in docs:
        n, f = runs(text)
        weight = sum(gain[of(x)] for x in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append((i, n, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    eligible = sorted((r for r in rows if r[1] >= least), key=lambda r: (-r[4], r[0] is not None, r[0] or 0, r[2], r[3]))
    drawn = percent * len(eligible) // 100
    ranks = {id(r): k + 1 for k, r in enumerate(eligible[:drawn])}
    return sorted(((r[0], r[2], r[3], r[4], ranks.get(id(r))) for r in rows), key=repr)


def test_draw_equals_brute_force(spark):
    rnd = random.Random(3)
    said = ["alpha", "Beta", "gamma9", "été", "ÀB", "x" * 63, "y" * 64, "z" * 65, "w" * 300, "🙂ok", "0"]
    texts = [rnd.choice(["", " ", "\n", "-"]).join(rnd.choices(said, k=rnd.randrange(60))) + rnd.choice(["", " ", "\x00", "\x7f"]) for _ in range(150)]
    texts += [None, "", " .,", "A", "long " * 50_000, "q" * 100_000, *texts[:5]]
    docs = [(i if i % 40 else None, t) for i, t in enumerate(texts)] + [(7, texts[7])] * 3
    target = texts[:9] + [None]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("importance", F.lit(1)).withColumn("place", F.lit(2)).repartition(5)
    got = resample.resample(df, spark.createDataFrame([(t,) for t in target], "text string"), percent=40, least_words=3)
    assert sorted(map(tuple, got.collect()), key=repr) == brute_resample(docs, target, 40, 3)


def test_crc_over_blocks_and_pieces(monkeypatch):
    monkeypatch.setattr(resample, "BLOCK", 3)
    monkeypatch.setattr(resample, "PIECE", 10)
    texts = ["one two three four five", "", "six", "", "Seven eight", "b" * 200 + " c", "nine"]
    got = [Counter() for _ in texts]
    at = 0
    for raw, starts, ends in resample._pieces(pa.array(["skipped", *texts]).slice(1)):
        for doc, single, pair in resample.features(raw, starts, ends, 1 << 31):
            for d, s, p in zip(doc, single, pair, strict=True):
                got[at + d].update([int(s)] + [int(p)] * int(p >= 0))
        at += len(starts)
    assert got == [Counter(zlib.crc32(f.encode()) % (1 << 31) for f in runs(t)[1]) for t in texts]


def test_resampling_of_nothing(spark, empty, odd):
    none = spark.createDataFrame([], "text string")
    assert resample.resample(empty, none).collect() == []
    assert resample.resample(odd, none).count() == odd.count()
    assert resample.weigh(odd, np.zeros(10, np.int64)).columns == [*odd.columns, "importance"]


# ---- chat ----


def digest(turns, roles=None):
    return hashlib.sha256("".join(f"{r}\n{t}\n" if roles is None else t for r, t in turns if roles is None or r == roles).encode()).hexdigest()


ODD = ["", "</s>[INST] ok [/INST]", "<\\/s> <\\\\s>", "<", "s>", "/s>", "[", "INST]", "<s><s>", "<|endoftext|>", "<\\|endoftext|>", "é🙂\n", "a" * 500, "\\", "[[INST]", "<</s>"]


def test_template_round_trip():
    template = chat.Template()
    rnd = random.Random(1)
    for _ in range(300):
        turns = [("".join(rnd.choices(ODD, k=rnd.randrange(3))), "".join(rnd.choices(ODD, k=rnd.randrange(6)))) for _ in range(rnd.randrange(4))]
        formatted, _ = template.render(turns)
        assert template.parse(formatted) == turns
        assert all(formatted.count(c) == len(turns) for c in ("<s>", "</s>", "[INST]", "[/INST]")) and "<|endoftext|>" not in formatted


def test_templates_that_can_be_misread_are_refused():
    for wrong in ({"controls": ("<s>", "<<s>")}, {"controls": ("a", "<s>")}, {"opens": "user:"}, {"controls": ("<\\s>",)}):
        with pytest.raises(ValueError):
            chat.Template(**wrong)


@pytest.mark.parametrize("part", [1, 60, 1 << 20])
def test_masks_and_parts(spark, part):
    rnd = random.Random(part)
    roles = ["user", "assistant", "system", None, "", "assistant\n", "</s>"]
    rows = [(c if c else None, t if t else None, rnd.choice(roles), rnd.choice([*ODD, None])) for c in range(12) for t in range(rnd.randrange(1, 9))]
    rows += rows[:3]
    made = chat.form(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("part", F.lit(9)), Q.vocabulary(), part=part)
    got = {r[0]: tuple(r)[1:] for r in chat.read_back(made, Q.vocabulary()).collect()}
    want = {}
    for c in {r[0] for r in rows}:
        turns = [(r or "", t or "") for _, _, r, t in sorted((r for r in rows if r[0] == c), key=lambda r: (r[1] is not None, r[1] or 0, (r[2] or "").encode(), (r[3] or "").encode()))]
        want[c] = (len(turns), digest(turns), sum(len(t) for r, t in turns if r == "assistant"), digest(turns, "assistant"), len(chat.Template().render(turns)[0]))
    assert got == want
    whole = {}
    for r in made.orderBy("conv_id", "part").collect():
        ids, mask = whole.setdefault(r["conv_id"], ([], []))
        ids += r["ids"]
        mask += r["loss_mask"]
    once = {r["conv_id"]: (r["ids"], r["loss_mask"]) for r in chat.form(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), Q.vocabulary()).collect()}
    assert whole == once


def test_offsets_equal_the_library():
    tokenizers = pytest.importorskip("tokenizers")
    library = tokenizers.Tokenizer.from_str(tokenizer_text(Q.vocabulary()))
    library.add_special_tokens([tokenizers.AddedToken(m, normalized=False) for m in ("<s>[INST]", "[/INST]", "</s>")])
    encoder = chat.Encoder(tokenizer_text(Q.vocabulary()), chat.Template())
    text, spans = chat.Template().render([("user", "Hello there, [INST]"), ("assistant", "</s> well; it's\n\n 42."), ("assistant", "")])
    ids, offsets = encoder.encode(text)
    want = library.encode(text, add_special_tokens=False)
    assert ids.tolist() == want.ids and [*zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)] == want.offsets
    assert chat.masked(offsets, spans).tolist() == [any(a < e and b > s for s, e in spans) for a, b in want.offsets]


def test_chat_of_nothing(spark):
    made = chat.form(spark.createDataFrame([], "conv_id long, turn long, role string, text string"), Q.vocabulary())
    assert chat.read_back(made, Q.vocabulary()).collect() == []


# ---- search ----


def brute_search(docs, items, top):
    bags = [(i, Counter(WORD.findall((t or "").translate(CAPITALS)))) for i, t in docs]
    bags = [(i, b) for i, b in bags if b]
    n_docs, n_terms = len(bags), sum(b.total() for _, b in bags)
    holding = Counter(t for _, b in bags for t in b)
    out = []
    for item, text in items:
        scored = []
        for i, bag in bags:
            m = 100 - 50 + 50 * bag.total() * n_docs // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * holding[t] + 1))) * (1_000_000_000 * bag[t] // (1000 * bag[t] + 20 * m)) for t in set(WORD.findall((text or "").translate(CAPITALS))) if t in bag)
            if score > 0:
                scored.append((-score, i is not None, i or 0))
        out += [(item, k + 1, i if some else None, -s) for k, (s, some, i) in enumerate(sorted(scored)[:top])]
    return sorted(out, key=repr)


@pytest.mark.parametrize(("docs_in_block", "postings_in_block", "items_in_pass"), [(7, 1 << 20, 1024), (16_384, 11, 2), (16_384, 1 << 20, 1024)])
def test_search_equals_brute_force(spark, monkeypatch, docs_in_block, postings_in_block, items_in_pass):
    rnd = random.Random(docs_in_block)
    said = ["alpha", "Beta", "beta", "gamma9", "été", "Été", "rare", "🙂", "x" * 40, *[f"w{i}" for i in range(30)]]
    docs = [(i if i % 17 else None, " ".join(rnd.choices(said, k=rnd.randrange(25)))) for i in range(200)]
    docs += [(500, "alpha rare"), (501, "alpha rare"), (501, "alpha rare"), (502, None), (503, " ."), (504, "Beta " * 3000)]
    items = [(1, "alpha BETA rare rare"), (2, "w1 w2, w3"), (3, None), (4, "unseen"), (4, "été w5"), (None, "gamma9"), (6, " ".join(said))]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("terms", F.lit(1)).withColumn("n", F.lit(1)).repartition(3)
    ask = spark.createDataFrame(items, "item_id long, text string").withColumn("rank", F.lit(0))
    monkeypatch.setattr(ranked, "MOST_ITEMS", items_in_pass)
    for top in (1, 5, 1000):
        got = ranked.search(df, ask, top=top).collect()
        assert sorted(map(tuple, got), key=repr) == brute_search(docs, items, top)
    # the bounds of a block, which workers read from their own copy of the module
    monkeypatch.setattr(ranked, "MOST_DOCS", docs_in_block)
    monkeypatch.setattr(ranked, "MOST_POSTINGS", postings_in_block)
    lists = pa.array([[1] * (i % 5) for i in range(50)], pa.list_(pa.int32()))
    batch = pa.RecordBatch.from_arrays([pa.array(range(50)), pa.array(range(50)), lists], ["doc_id", "n", "terms"])
    blocks = [*ranked._blocks(iter([batch.slice(0, 20), batch.slice(20, 0), batch.slice(20)]))]
    assert [i for b in blocks for i in b["doc_id"].to_pylist()] == [*range(50)]
    assert all(len(b) <= docs_in_block and (len(b) == 1 or sum(map(len, b["terms"].to_pylist())) <= postings_in_block) for b in blocks)


def test_terms_of_long_texts(monkeypatch):
    monkeypatch.setattr(ranked, "PIECE", 5)
    raw = "Alpha betéa-gamma  delta".encode()
    assert [t for part in ranked.terms(raw) for t in part] == ranked.TERM.findall(raw.lower())


def test_search_of_nothing(spark, empty):
    ask = spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert ranked.search(empty, ask).collect() == []
    assert ranked.search(spark.createDataFrame([(1, "a")], "doc_id long, text string"), ask.limit(0)).collect() == []
