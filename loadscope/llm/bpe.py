"""Byte-pair encoding by a tokenization automaton.

The merges are compiled one after the other into a deterministic automaton over tokens
that accepts just those token sequences the merges would make. All arcs that read one
token lead to one state, so a state is what may follow a token. The gadget of a merge
(a, b) splits the state q behind a: a copy of q without the arc b takes q's place behind
a, and wherever a can be read the new token can be read as well, leading to where b led.
A state is kept as the version before it and the one arc that its copy lost; the arcs
that it gains later follow from the arc a of the merge that made them.

A word is encoded with two tables: a trie of the tokens' bytes and the automaton. Each
prefix of a word has one path at most, so a search that takes the longest token first tries
each place of a word once.
"""

from __future__ import annotations

import hashlib
import json
import re
from bisect import bisect_right
from collections.abc import Callable
from functools import lru_cache
from pathlib import Path

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loadscope.llm.common import each_value, text_of

#: The pre-tokenizer's split, a fixed value of the vocabulary's format.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
EMPTY = hashlib.sha256(b"").hexdigest()
#: The same split for texts of the characters that PLAIN allows, on which `re` has the same classes and is faster.
PLAIN_SPLIT = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
PLAIN = re.compile(r"[\t\n\x0b\x0c\r -~À-ÖØ-öø-ɏ]*")
#: Bytes of words and their codes that a worker keeps at most, in each of two generations. Results don't depend on it.
KEPT_BYTES = 24 << 20
#: What a kept word costs beside its own and its codes' characters.
KEPT_WORD = 240
#: Arcs looked up that a worker keeps at most (some 100 bytes each).
KEPT_ARCS = 200_000
#: Longer words are encoded each time.
LONGEST_KEPT = 64


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in a byte-level vocabulary."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Automaton:
    """Compiled from a list of merges. Tokens are numbered: bytes 0 to 255, then merges in their order.

    States behind one token are versions of each other: each gadget adds one, a copy of
    the version before without one arc. `chain` has a state's token, `versions` a token's
    states with the steps they were born at, `lost` the version at which an arc was lost; most tokens have none of these.
    """

    def __init__(self, merges: list[tuple[int, int]]):
        self.left = [-1] * 256
        self.labels = [bytes([b]) for b in range(256)]
        self.chain, self.version, self.born = [-1], [0], [-1]  # state 0 reads everything
        self.base, self.target = [0] * 256, [0] * 256
        self.versions: dict[int, tuple[list[int], list[int]]] = {}
        self.lost: dict[int, dict[int, int]] = {}
        self._known: dict[int, bool] = {}
        for step, (a, b) in enumerate(merges):
            self.labels.append(self.labels[a] + self.labels[b])
            meets = self.reads(self.target[a], b)  # else an earlier merge takes b from a: the pair never meets
            self.left.append(a if meets else -2)
            self.base.append(self.target[b] if meets else 0)
            self.target.append(self.base[-1])
            if meets:
                states, born = self.versions.setdefault(a, ([], []))
                self.chain.append(a)
                self.born.append(step)
                states.append(len(self.chain) - 1)
                born.append(step)
                self.version.append(len(states))
                self.lost.setdefault(a, {})[b] = len(states)
                self.target[a] = states[-1]
        #: The trie: a node has its children by their bytes, and at -1 the longest token on its way. Of a child without children only the token is kept, at -2 less its byte.
        self.trie: dict[int, dict | int] = {-1: -1}
        live = [t for t in range(len(self.labels)) if self.left[t] != -2]
        for t in live:
            node = self.trie
            *way, last = self.labels[t]
            for byte in way:
                if (after := node.get(byte)) is None:
                    after = node[byte] = {-1: node.pop(-2 - byte, -1)}
                node = after
            if last in node:
                node[last][-1] = t
            else:
                node[-2 - last] = t
        todo = [self.trie]
        while todo:
            node = todo.pop()
            for byte, after in node.items():
                if byte >= 0:
                    after[-1] = node[-1] if after[-1] < 0 else after[-1]
                    todo.append(after)
        #: A token's longest beginning that is a token, else -1.
        self.shorter = [-1] * len(self.labels)
        for t in live:
            node = self.trie
            for byte in self.labels[t][:-1]:
                node = node[byte]
            self.shorter[t] = node[-1]
        self.sizes = [*map(len, self.labels)]
        self.longest = max(self.sizes)

    def reads(self, state: int, token: int) -> bool:
        """Whether the state has an arc for the token."""
        s, t = state, token
        while True:
            if t >= 256 and t - 256 >= self.born[s]:  # the arc came with the merge, where the arc of its left part was
                if (t := self.left[t]) < 0:
                    return False
            elif s == 0:
                return True
            else:
                a, v = self.chain[s], self.version[s]
                if 0 < self.lost[a].get(t, 0) <= v:
                    return False
                states, born = self.versions[a]
                older = bisect_right(born, t - 256, 0, v) if t >= 256 else 0
                s = states[older - 1] if older else self.base[a]

    def encode(self, word: bytes) -> list[int]:
        """The tokens of one pre-split word: depth first, from each place the longest token first.

        A place that led to no end isn't tried again, whatever token leads there, since it has one path.
        """
        n = len(word)
        out: list[int] = []
        dead: set[int] = set()
        trie, shorter, sizes, target, known, longest = self.trie, self.shorter, self.sizes, self.target, self._known, self.longest
        i = s = 0
        while i < n:
            node, t = trie, None
            for byte in word[i : i + longest]:
                if (after := node.get(byte)) is None:
                    t = node.get(-2 - byte)
                    break
                node = after
            if t is None:
                t = node[-1]
            while True:
                if t < 0:  # back by one token
                    dead.add(i)
                    t = out.pop()
                    i -= sizes[t]
                    s = target[out[-1]] if out else 0
                    t = shorter[t]
                    continue
                j = i + sizes[t]
                if j not in dead:
                    key = s << 20 | t
                    if (reads := known.get(key)) is None:
                        if len(known) > KEPT_ARCS:
                            known.clear()
                        reads = known[key] = self.reads(s, t)
                    if reads:
                        break
                t = shorter[t]
            out.append(t)
            i, s = j, target[t]
        return out

    def decode(self, tokens: list[int]) -> bytes:
        return b"".join(map(self.labels.__getitem__, tokens))


class Tokenizer:
    """A byte-level BPE vocabulary file: its split, its added tokens and its automaton."""

    def __init__(self, spec: dict):
        letters = byte_letters()
        vocab = spec["model"]["vocab"]
        names = {name: bytes(letters[c] for c in name) for name in vocab}
        own = {bytes_: vocab[name] for name, bytes_ in names.items()}
        number = {bytes([b]): b for b in range(256)}
        merges = []
        for pair in spec["model"]["merges"]:
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            merges.append((number[names[a]], number[names[b]]))
            number.setdefault(names[a + b], 255 + len(merges))
        if len(number) != 256 + len(merges):
            raise ValueError("two merges make the same token")
        self.automaton = Automaton(merges)
        self.decimals = [str(own[label]) for label in self.automaton.labels]
        self.labels = {i: label for label, i in own.items()} | {own[label]: label for label in self.automaton.labels}
        self.added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.labels |= {i: text.encode() for text, i in self.added.items()}
        self.by_decimal = dict(zip(self.decimals, self.automaton.labels, strict=True)) | {str(i): label for i, label in self.labels.items()}
        self.split = regex.compile(SPLIT)
        self.special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self.words = Words(self)

    @staticmethod
    @lru_cache(2)
    def parsed(text: str) -> Tokenizer:
        return Tokenizer(json.loads(text))

    def split_words(self, text: str) -> list[str]:
        return PLAIN_SPLIT.findall(text) if PLAIN.fullmatch(text) else self.split.findall(text)

    def pieces(self, text: str) -> list[str]:
        """Of each word in turn, its ids' decimals with commas."""
        if not self.special or not self.special.search(text):
            return [*map(self.words.__getitem__, self.split_words(text))]
        out = []
        for k, part in enumerate(self.special.split(text)):
            out += [str(self.added[part])] if k % 2 else map(self.words.__getitem__, self.split_words(part))
        return out

    def encode(self, text: str) -> list[int]:
        return [int(i) for ids in self.pieces(text) for i in ids.split(",")]

    def decode(self, ids: list[int]) -> str:
        """The arcs' labels of these ids, joined; bytes that aren't UTF-8 become U+FFFD; unknown ids are left out."""
        return b"".join(self.labels.get(i, b"") for i in ids).decode("utf-8", "replace")

    def digests(self, text: str) -> tuple[int, str, str]:
        if not (found := self.pieces(text)):
            return 0, EMPTY, EMPTY
        joined = ",".join(found)
        ids = joined.split(",")
        whole = b"".join(map(self.by_decimal.__getitem__, ids))
        try:
            whole.decode()
        except UnicodeDecodeError:
            whole = whole.decode("utf-8", "replace").encode()
        return len(ids), hashlib.sha256(joined.encode()).hexdigest(), hashlib.sha256(whole).hexdigest()


class Words(dict):
    """Codes of pre-split words, worked out when first asked for.

    A full generation becomes the old one, from which words that are asked for again come
    back; the rest goes with the next.
    """

    def __init__(self, tokenizer: Tokenizer):
        self.tokenizer, self.old, self.held = tokenizer, {}, 0

    def __missing__(self, word: str) -> str:
        if (out := self.old.get(word)) is None:
            tokens = self.tokenizer.automaton.encode(word.encode("utf-8", "replace"))
            out = ",".join([self.tokenizer.decimals[t] for t in tokens])
        if len(word) <= LONGEST_KEPT:
            if self.held >= KEPT_BYTES:
                self.old = dict(self)
                self.clear()
                self.held = 0
            self[word] = out
            self.held += KEPT_WORD + len(word) * 2 + len(out)
        return out


def tokenizer_text(path: str) -> str:
    """The vocabulary file, read on the driver (a few MB, whatever the data)."""
    return Path(path).read_text(encoding="utf-8")


def _over(docs: DataFrame, column: Column, path: str, kind: str, arrow: pa.DataType, of: Callable) -> Column:
    spec = docs.sparkSession.sparkContext.broadcast(tokenizer_text(path))

    def begin() -> Callable:
        tokenizer = Tokenizer.parsed(spec.value)
        return lambda x: of(tokenizer, x)

    return each_value(column, kind, arrow, begin)


def encode(docs: DataFrame, path: str, text: str = "text", out: str = "ids") -> DataFrame:
    """docs with the array of token ids of each whole text as column `out`; a null or empty text has none.

    Rows are independent: repeated ones get equal results. A column `out` that is there already
    is replaced; others stay; an empty table gives an empty one.
    """
    return docs.withColumn(out, _over(docs, text_of(text), path, "array<int>", pa.list_(pa.int32()), Tokenizer.encode))


def decode(docs: DataFrame, path: str, ids: str = "ids", out: str = "text") -> DataFrame:
    """docs with the text of each array of ids as column `out`; null decodes as no ids, a null id as nothing.

    Rows are independent: repeated ones get equal results; a column `out` that is there already
    is replaced; an empty table gives an empty one.
    """
    column = F.coalesce(F.col(ids).cast("array<int>"), F.array().cast("array<int>"))
    return docs.withColumn(out, _over(docs, column, path, "string", pa.string(), Tokenizer.decode))


def digest(docs: DataFrame, path: str, text: str = "text", out: str = "bpe") -> DataFrame:
    """docs with a struct `out` of n_tokens, ids_sha256 and decoded_sha256 of each whole text, encoded and decoded.

    A null or empty text has no tokens and the digests of nothing. Rows are independent:
    repeated ones get equal results; a column `out` that is there already is replaced; an
    empty table gives an empty one.
    """
    kind = "n_tokens long, ids_sha256 string, decoded_sha256 string"
    arrow = pa.struct([("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])
    return docs.withColumn(out, _over(docs, text_of(text), path, kind, arrow, Tokenizer.digests))
