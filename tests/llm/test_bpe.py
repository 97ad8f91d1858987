from __future__ import annotations

import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from loadscope.llm import bpe
from loadscope.llm.queries import op3_bpe, vocabulary


@pytest.fixture(scope="module")
def both():
    return bpe.Tokenizer.parsed(bpe.tokenizer_text(vocabulary())), Tokenizer.from_file(vocabulary())


def check(both, text):
    own, theirs = both
    ids = theirs.encode(text, add_special_tokens=False).ids
    assert own.encode(text) == ids
    decoded = theirs.decode(ids, skip_special_tokens=False)
    assert own.decode(ids) == decoded
    assert own.digests(text) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest())


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=80))
def test_any_text(both, text):
    check(both, text)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="aabeht 's\n\t0.,<|>endoftxé漢\x1c\x85 ²", max_size=80))
def test_likely_text(both, text):
    check(both, text)


@pytest.mark.parametrize("text", ["", " ", "<|endoftext|>", "a<|endoftext|><|endoftext|>b", "a" * 3000, " " * 500 + "x", "=" * 333, "\r\n\r\n", "it's we'll I'D", "🙂" * 50])
def test_chosen_texts(both, text):
    check(both, text)


def test_small_automaton_equals_merging():
    """Against merging pair by pair, for every short word over three bytes."""
    merges = [(97, 97), (97, 98), (256, 97), (98, 99), (257, 99), (256, 256)]
    automaton = bpe.Automaton(merges)
    labels = [bytes([b]) for b in range(256)]
    for a, b in merges:
        labels.append(labels[a] + labels[b])

    def merged(word):
        out = list(word)
        for k, pair in enumerate(merges):
            i = 0
            while i < len(out) - 1:
                if (out[i], out[i + 1]) == pair:
                    out[i : i + 2] = [256 + k]
                i += 1
        return out

    words = [b""]
    for _ in range(7):
        words = [w + bytes([c]) for w in words for c in b"abc"]
        assert all(automaton.encode(w) == merged(w) and automaton.decode(automaton.encode(w)) == w for w in words)


def test_query(spark, sf, rows, both):
    got = {r["doc_id"]: tuple(r)[1:] for r in op3_bpe(spark, sf).collect()}
    for d in rows:
        ids = both[1].encode(d["text"], add_special_tokens=False).ids
        want = hashlib.sha256(both[1].decode(ids, skip_special_tokens=False).encode()).hexdigest()
        assert got[d["doc_id"]] == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), want)


def test_edges(spark, odd, empty):
    coded = bpe.decode(bpe.encode(odd, vocabulary(), out="key"), vocabulary(), ids="key", out="n")
    assert all(r["n"] == (r["text"] or "") for r in coded.collect())
    assert bpe.encode(empty, vocabulary()).count() == 0 and coded.count() == 8


def test_few_arcs_are_looked_up(both, rows):
    """The longest tokens are tried first, so that few others are: three tries for two tokens at most."""
    automaton = bpe.Automaton([])
    automaton.__dict__ |= both[0].automaton.__dict__ | {"_known": (tried := type("Tried", (dict,), {"n": 0, "get": lambda self, key: setattr(self, "n", self.n + 1) or dict.get(self, key)})())}
    made = sum(len(automaton.encode(w.encode())) for d in rows[:100] for w in both[0].split_words(d["text"]))
    assert made <= tried.n <= 1.5 * made
