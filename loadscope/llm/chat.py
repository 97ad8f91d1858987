"""Chat formatting: conversations as one text and its tokens, with a loss mask over what the assistant said.

A conversation is rendered whole by a template whose markers are tokens of their own;
what looks like a marker inside a text is escaped, and can be brought back. The rendered text
is encoded once, with the byte offsets of its tokens. The spans of the assistant's turns
and the tokens are both in order, so each span's first and last token are found by binary search.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loadscope.llm.bpe import Tokenizer, tokenizer_text

#: Bytes from which a conversation is cut before its next turn, so that a worker's memory doesn't grow with it.
PART = 1 << 20
#: Rendered bytes that are handed on at once.
HANDED = 2 << 20
#: Whose turns are learnt.
LEARNT = "assistant"
KIND = "conv_id long, part int, formatted string, ids array<int>, loss_mask array<boolean>"
#: The SQL of what op12_chat returns: the same template, escapes and digests.
ORACLE = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(role || chr(10) || text, '<(\\*)(/?s>)', '<\\\1\2', 'g'), '\[(\\*)(/?INST\])', '[\\\1\2', 'g'), '<(\\*)(\|endoftext\|>)', '<\\\1\2', 'g') AS x FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
sum(length(x) - 1 + length('<s>[INST]') + length('[/INST]') + length('</s>'))::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""


@dataclass(frozen=True)
class Template:
    """opens + role + says + text + ends, turn after turn.

    controls are the strings that may not stand in a role or a text as they are: those that
    markers are made of, and the vocabulary's own. Each has two characters or more, no
    backslash, and its first character nowhere else in any of them, so that no two overlap.
    """

    opens: str = "<s>[INST]"
    says: str = "[/INST]"
    ends: str = "</s>"
    controls: tuple[str, ...] = ("<s>", "</s>", "[INST]", "[/INST]", "<|endoftext|>")

    def __post_init__(self):
        firsts = {c[:1] for c in self.controls}
        if any(len(c) < 2 or "\\" in c or firsts & set(c[1:]) for c in self.controls):
            raise ValueError("controls may overlap")
        if not all(m and re.fullmatch("(?:" + "|".join(map(re.escape, self.controls)) + ")+", m) for m in (self.opens, self.says, self.ends)):
            raise ValueError("markers have to be made of controls")

    def _pattern(self, slashes: str) -> re.Pattern:
        return re.compile("|".join(f"{re.escape(c[0])}(?={slashes}{re.escape(c[1:])})" for c in self.controls))

    def escape(self, text: str) -> str:
        r"""A control string, with or without backslashes behind its first character, gets one more there."""
        return self._pattern(r"\\*").sub(lambda m: m[0] + "\\", text)

    def unescape(self, text: str) -> str:
        """Takes off one backslash where escape put one."""
        pattern = "|".join(f"({re.escape(c[0])})\\\\(?=\\\\*{re.escape(c[1:])})" for c in self.controls)
        return re.sub(pattern, lambda m: m[m.lastindex], text)

    def render(self, turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
        """The text of turns (role, text), and the byte spans of the texts that are learnt."""
        out, spans, at = [], [], 0
        for role, text in turns:
            head, said = self.opens + self.escape(role) + self.says, self.escape(text)
            start = at + len(head.encode())
            end = start + len(said.encode())
            if role == LEARNT:
                spans.append((start, end))
            out += [head, said, self.ends]
            at = end + len(self.ends.encode())
        return "".join(out), spans

    def parse(self, formatted: str) -> list[tuple[str, str]]:
        """The turns (role, text) that a text was rendered from."""
        turns = []
        for turn in formatted.split(self.ends)[:-1]:
            role, _, text = turn.removeprefix(self.opens).partition(self.says)
            turns.append((self.unescape(role), self.unescape(text)))
        return turns


class Encoder:
    """A vocabulary whose special tokens are its own and a template's markers, numbered after all others."""

    def __init__(self, spec: str, template: Template):
        plain = json.loads(spec)
        own = plain.get("added_tokens", [])
        if missing := {t["content"] for t in own} - set(template.controls):
            raise ValueError(f"the vocabulary's {sorted(missing)} aren't among the template's controls")
        first = 1 + max([*plain["model"]["vocab"].values(), *(t["id"] for t in own)])
        markers = [*dict.fromkeys([template.opens, template.says, template.ends])]
        self.tokenizer = Tokenizer(plain | {"added_tokens": own + [{"content": m, "id": first + i} for i, m in enumerate(markers)]})
        self.width = np.zeros(first + len(markers), np.int64)
        for i, label in self.tokenizer.labels.items():
            self.width[i] = len(label)

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """(ids, byte offsets: where each token starts, and where the last ends)."""
        pieces = self.tokenizer.pieces(text)
        ids = np.array(",".join(pieces).split(","), dtype=np.int32) if pieces else np.empty(0, np.int32)
        return ids, np.concatenate([[0], np.cumsum(self.width[ids])])

    def said(self, ids: np.ndarray, mask: np.ndarray) -> list[str]:
        """The texts of the runs of masked tokens."""
        edges = np.flatnonzero(np.diff(np.concatenate([[0], mask.astype(np.int8), [0]])))
        labels = self.tokenizer.labels
        return [b"".join([labels[i] for i in ids[a:b].tolist()]).decode() for a, b in zip(edges[::2], edges[1::2], strict=True)]


def masked(offsets: np.ndarray, spans: list[tuple[int, int]]) -> np.ndarray:
    """Whether each token shares a byte with a span: of both sorted sides, by binary search."""
    marks = np.zeros(len(offsets), np.int64)
    if spans:
        start, end = np.array(spans, np.int64).T
        some = end > start
        np.add.at(marks, np.searchsorted(offsets[1:], start[some], "right"), 1)
        np.add.at(marks, np.searchsorted(offsets[:-1], end[some], "left"), -1)
    return np.cumsum(marks[:-1]) > 0


def form(conversations: DataFrame, path: str, template: Template = Template(), conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", part: int = PART) -> DataFrame:
    """(conv_id, part, formatted, ids, loss_mask): each conversation as a text, its tokens, and whether each token is learnt.

    Turns stand in the order of turn, of equals by role and text; a null turn comes first, a null
    role or text is empty, and turns without a conversation's id are one conversation.
    Repeated rows are repeated turns; other columns are left out; an empty table gives an empty one. A
    conversation is one row, part 0, unless its text reaches `part` bytes: it is then cut before the next
    turn, where a marker is a token of its own, so ids and masks of its parts joined are
    those of the whole. Rows of a conversation stand together, in the order of their parts.
    """
    spec = conversations.sparkSession.sparkContext.broadcast(tokenizer_text(path))
    rows = conversations.select(F.col(conv_id).cast("long").alias("conv_id"), F.col(turn).cast("long").alias("turn"), F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    # turns come as one ordered stream, so no conversation is ever gathered
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = Encoder(spec.value, template)

        def made(key, number: int, turns: list[tuple[str, str]]) -> tuple:
            formatted, spans = template.render(turns)
            ids, offsets = encoder.encode(formatted)
            return key, number, formatted, ids, masked(offsets, spans)

        def handed(out: list[tuple]) -> pd.DataFrame:
            frame = pd.DataFrame(out, columns=["conv_id", "part", "formatted", "ids", "loss_mask"])
            return frame.astype({"conv_id": "Int64"})

        key, number, turns, size, out, ready = None, 0, [], 0, [], 0
        for batch in batches:
            ids = [None if pd.isna(i) else int(i) for i in batch["conv_id"]]
            for now, who, said in zip(ids, batch["role"], batch["text"], strict=True):
                if turns and (now != key or size >= part):
                    out.append(made(key, number, turns))
                    ready += size
                    number = number + 1 if now == key else 0
                    turns, size = [], 0
                    if ready >= HANDED:
                        yield handed(out)
                        out, ready = [], 0
                key = now
                turns.append((who, said))
                size += len(said.encode())
        if turns:
            out.append(made(key, number, turns))
        yield handed(out)

    return rows.select("conv_id", "role", "text").mapInPandas(run, KIND)


def read_back(formed: DataFrame, path: str, template: Template = Template()) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars) of what form made, directly after it.

    Turns are parsed from the formatted text; what is learnt is decoded from the ids under the mask, run by
    run, and unescaped. Digests go on from part to part; a conversation without learnt text has the
    digest of nothing.
    """
    spec = formed.sparkSession.sparkContext.broadcast(tokenizer_text(path))
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = Encoder(spec.value, template)
        now = None
        for batch in batches:
            out = []
            for key, part, formatted, ids, mask in zip(*[batch[c] for c in ("conv_id", "part", "formatted", "ids", "loss_mask")], strict=True):
                if part == 0:
                    if now:
                        out.append((now[0], now[1], now[2].hexdigest(), now[3], now[4].hexdigest(), now[5]))
                    now = [None if pd.isna(key) else int(key), 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                turns = template.parse(formatted)
                now[1] += len(turns)
                for role, text in turns:
                    now[2].update(f"{role}\n{text}\n".encode())
                for said in map(template.unescape, encoder.said(np.asarray(ids), np.asarray(mask, bool))):
                    now[3] += len(said)
                    now[4].update(said.encode())
                now[5] += len(formatted)
            yield pd.DataFrame(out, columns=names).astype({"conv_id": "Int64"})
        if now:
            yield pd.DataFrame([(now[0], now[1], now[2].hexdigest(), now[3], now[4].hexdigest(), now[5])], columns=names).astype({"conv_id": "Int64"})

    return formed.mapInPandas(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
