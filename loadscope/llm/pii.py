"""Personal data: fixed patterns, and a semi-Markov conditional random field over whole spans.

The field scores segments of a run of tokens: a segment is one token of plain text or a
candidate span with a kind. Features look at the whole span (its digits, separators,
checksum, parts, and what stands on either side), not at single tokens. Dynamic
programming over segments of at most LONGEST tokens picks boundaries and kinds together.
Spans of the patterns are given: they are never taken away, and no other span may overlap
one. The weights are fitted here, by conditional likelihood, on a fixed number of
generated runs; nothing is learnt from the data.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loadscope.llm.common import each_value, text_of

KINDS = ("email", "ip", "card", "phone")
#: Tokens in a span at most.
LONGEST = 24
#: Generated runs that the weights are fitted on, and passes over them.
RUNS, PASSES = 400, 25

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: A match starts where a run of digits does: from within one there is none that isn't from its start.
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
CARD_SIGNS, PHONE_SIGNS = frozenset("0123456789 -"), frozenset("0123456789 +().-/")
#: A run that the field looks at holds a digit or an at sign, or the word for one between brackets.
SIGN = re.compile(r"[0-9@]|[\[(]at[\])]")
TOKEN = re.compile(r"[A-Za-z]+|[0-9]+|\S")

Span = tuple[int, int, int]  # kind, start, end


def luhn(digits: str) -> bool:
    back = [ord(c) - 48 for c in reversed(digits)]
    return (sum(back[::2]) + sum(sum(divmod(2 * d, 10)) for d in back[1::2])) % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_spans(text: str) -> list[Span]:
    """The patterns' spans, by kind and then start: leftmost, not overlapping within a kind; what fails its check goes, without another try."""
    out: list[Span] = []
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at)):
            end = m.end()
            out.append((0, start, end))
            at = text.find("@", end)
        else:
            at = text.find("@", at + 1)
    out += [(1, *m.span()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
    out += [(2, *m.span()) for m in CARD.finditer(text) if len(m[0]) >= 16 and 16 <= len(d := _digits(m[0])) <= 19 and luhn(d)]
    if "+" in text:
        out += [(3, *m.span()) for m in PHONE.finditer(text) if 8 <= len(_digits(m[0])) <= 15]
    return out


def features(text: str, start: int, end: int) -> list[str]:
    """Of a candidate span as a whole."""
    span = text[start:end]
    digits = _digits(span)
    n, others = len(digits), {c for c in span if not c.isalnum()}
    parts = span.split(".")
    groups = re.findall(r"[0-9]+", span)
    left, right = text[start - 1 : start], text[end : end + 1]
    at = re.search(r"@|[\[(]at[\])]", span)
    return [
        "bias",
        f"digits:{n if n < 8 else '8-9' if n < 10 else '10-11' if n < 12 else '12-15' if n < 16 else '16-19' if n < 20 else '20+'}",
        f"letters:{any(c.isalpha() for c in span)}",
        f"groups:{min(len(groups), 6)}",
        f"lengths:{'-'.join(map(str, map(len, groups))) if len(groups) in (3, 4) and n <= 16 else ''}",
        f"luhn:{n >= 13 and luhn(digits)}",
        f"quad:{len(parts) == 4 and all(p.isascii() and p.isdigit() and len(p) < 4 and int(p) < 256 for p in parts)}",
        f"at:{bool(at)}",
        f"host:{bool(at and re.fullmatch(r'[A-Za-z0-9-]+(?:(?:[.]| ?[(]dot[)] ?)[A-Za-z0-9-]+)+', span[at.end() :]) and re.fullmatch(r'[A-Za-z0-9._%+-]+', span[: at.start()]))}",
        f"plus:{span[:1] == '+'}",
        f"bracket:{'(' in others and ')' in others}",
        f"separators:{''.join(sorted(others & set(' -./')))}",
        f"odd:{bool(others - set(' -.()+@[]_%'))}",
        f"left:{'' if not left else 'a' if left.isalnum() else 's' if left.isspace() else 'o'}",
        f"right:{'' if not right else 'a' if right.isalnum() else 's' if right.isspace() else 'o'}",
    ]


def candidates(text: str, tokens: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """(first token, token after the last, kind) of spans worth scoring: linear in the tokens, LONGEST at most from each."""
    out = []
    for i, (s, _) in enumerate(tokens):
        if not (text[s].isascii() and (text[s].isalnum() or text[s] in "+(")):
            continue
        seen = ""
        for j in range(i + 1, min(len(tokens), i + LONGEST) + 1):
            a, b = tokens[j - 1]
            if j - 1 > i and a - tokens[j - 2][1] > 1:
                break
            seen += text[a:b] if text[a].isdigit() else ""
            last = text[b - 1]
            if not (last.isascii() and last.isalnum()):
                continue
            span = text[s:b]
            if text[s].isalnum() and ("@" in span or "at]" in span or "at)" in span):
                out.append((i, j, 0))
            if not any(c.isalpha() for c in span):
                if span.count(".") == 3 and text[s].isdigit():
                    out.append((i, j, 1))
                if 13 <= len(seen) <= 19 and text[s].isdigit() and not set(span) - CARD_SIGNS:
                    out.append((i, j, 2))
                if 7 <= len(seen) <= 15 and not set(span) - PHONE_SIGNS:
                    out.append((i, j, 3))
    return out


def runs(text: str) -> Iterator[list[tuple[int, int]]]:
    """Tokens of each stretch of white-space-separated words around signs of personal data; words beside each other make one."""
    at, stretch, n = 0, None, len(text)
    while (m := SIGN.search(text, at)) or stretch:
        if m:
            s, e = m.start(), m.end()
            while s > at and not text[s - 1].isspace():
                s -= 1
            while e < n and not text[e].isspace():
                e += 1
            at = e
            if stretch and s - stretch[1] <= 1:
                stretch = (stretch[0], e)
                continue
        if stretch:
            yield [(k.start(), k.end()) for k in TOKEN.finditer(text, *stretch)]
        stretch = (s, e) if m else None


Weights = dict[tuple[int, str], float]


def _forward(n: int, by_end: dict[int, list[tuple[int, float, int]]]) -> list[float]:
    alpha = [0.0] + [-math.inf] * n
    for j in range(1, n + 1):
        terms = [alpha[j - 1]] + [alpha[i] + w for i, w, _ in by_end.get(j, ())]
        top = max(terms)
        alpha[j] = top + math.log(sum(math.exp(t - top) for t in terms))
    return alpha


def _generated(rnd: random.Random) -> tuple[str, list[Span]]:
    """A run of text with its true spans: formats of personal data, and numbers that are none."""
    d = lambda n: "".join(rnd.choice("0123456789") for _ in range(n))
    w = lambda: "".join(rnd.choice("abcdefghiklmnoprstuvw") for _ in range(rnd.randint(2, 8)))

    def card(sep: str) -> str:
        head = str(rnd.choice((4, 5))) + d(14)
        number = next(head + str(c) for c in range(10) if luhn(head + str(c)))
        return sep.join(number[k : k + 4] for k in range(0, 16, 4))

    area, mid, end = d(3), d(3), d(4)
    host = f"{w()}{rnd.choice(('', d(1)))}.{rnd.choice(('example.com', 'org', 'net', 'co.uk'))}"
    kind, span = rnd.choice(
        [(0, f"{w()}.{d(2)}@{host}"), (0, f"{w()}@{host}"), (0, f"{w()}[at]{host}"), (0, f"{w()}(at){host}")]
        + [(1, ".".join(str(rnd.randint(0, 255)) for _ in range(4)))] * 3
        + [(2, card(s)) for s in ("", "", " ", "-")]
        + [(3, f"+1 ({area}) {mid}-{end}")] * 2
        + [(3, f"({area}) {mid}-{end}"), (3, f"{area}-{mid}-{end}"), (3, f"1-{area}-{mid}-{end}"), (3, f"+{d(2)} {d(2)} {d(4)} {d(4)}")]
        + [(-1, x) for x in (f"{d(1)}.{d(1)}", d(4), f"{d(1)}.{d(1)}.{d(2)}", f"password={d(3)}{w()}{d(5)}{w()}{d(3)}", f"{d(4)}-{d(2)}-{d(2)}", d(7), d(10), d(16), d(20), f"{d(1)},{d(3)},{d(3)},{d(3)}", f"@{w()}", f"{d(2)}:{d(2)}:{d(2)}", f"{d(3)} {d(3)} {d(4)}", f"{d(4)} {d(4)} {d(4)}", ".".join(d(3) + "9" for _ in range(4)), f"{d(1)} {d(2)} {d(1)} {d(3)} {d(2)}", ".".join(str(rnd.randint(200, 999)) for _ in range(4)), f"{rnd.randint(256, 999)}.{d(1)}.{d(1)}.{d(1)}", f"{d(2)}.{d(2)}.{d(4)}", f"{d(4)}-{d(2)}-{d(2)} {d(2)}:{d(2)}:{d(2)}", f"AKIA{d(2)}{w().upper()}{d(1)}", ".".join(str(rnd.randint(0, 99)) for _ in range(5)))]
    )
    before = rnd.choice(("", "", f"{d(2)} ", f"x{d(1)} "))
    after = rnd.choice(("", "", ".", ",", f" {d(1)}"))
    return before + span + after, [(kind, len(before), len(before) + len(span))] if kind >= 0 else []


@lru_cache(1)
def fit(n_runs: int = RUNS, passes: int = PASSES, seed: int = 7) -> Weights:
    """Weights of the features by kind: AdaGrad on the conditional log-likelihood of n_runs generated runs."""
    rnd = random.Random(seed)
    data = []
    while len(data) < n_runs:
        text, true = _generated(rnd)
        tokens = [m.span() for m in TOKEN.finditer(text)]
        options = candidates(text, tokens)
        gold = {(k, s, e) for k, s, e in true}
        found = [(i, j, [(k, f) for f in features(text, tokens[i][0], tokens[j - 1][1])], (k, tokens[i][0], tokens[j - 1][1]) in gold) for i, j, k in options]
        if len(gold) == sum(x[3] for x in found):
            data.append((len(tokens), found))
    w: Weights = {}
    squares: Weights = {}
    for _ in range(passes):
        for n, found in data:
            scores = [sum(w.get(f, 0.0) for f in fs) for _, _, fs, _ in found]
            by_end: dict[int, list[tuple[int, float, int]]] = {}
            by_start: dict[int, list[tuple[int, float, int]]] = {}
            for at, (i, j, _, _) in enumerate(found):
                by_end.setdefault(j, []).append((i, scores[at], at))
                by_start.setdefault(n - i, []).append((n - j, scores[at], at))
            alpha, beta = _forward(n, by_end), _forward(n, by_start)
            for at, (i, j, fs, true) in enumerate(found):
                g = true - math.exp(min(0.0, alpha[i] + scores[at] + beta[n - j] - alpha[n]))
                if abs(g) > 1e-4:
                    for f in fs:
                        step = g - 0.002 * w.get(f, 0.0)
                        squares[f] = squares.get(f, 1e-6) + step * step
                        w[f] = w.get(f, 0.0) + 0.4 * step / math.sqrt(squares[f])
    return w


def field_spans(text: str, base: list[Span], w: Weights) -> list[Span]:
    """Spans that the field adds to the given ones: the best segmentation of each run in which no segment overlaps one of those."""
    out: list[Span] = []
    taken = np.array(sorted((s, e) for _, s, e in base), np.int64).reshape(-1, 2)
    for tokens in runs(text):
        if not tokens:
            continue
        n = len(tokens)
        if len(taken):
            a, b = np.searchsorted(taken[:, 1], tokens[0][0], "right"), np.searchsorted(taken[:, 0], tokens[-1][1], "left")
            here = [(int(s), int(e)) for s, e in taken[a:b]]
        else:
            here = []
        if len(here) == 1 and here[0][0] <= tokens[0][0] and here[0][1] >= tokens[-1][1] - 1:
            continue
        by_end: dict[int, list[tuple[int, float, int]]] = {}
        pointer = 0
        for i, j, k in candidates(text, tokens):
            s, e = tokens[i][0], tokens[j - 1][1]
            while pointer < len(here) and here[pointer][1] <= s:
                pointer += 1
            if any(x < e and y > s for x, y in here[max(0, pointer - 1) : pointer + 4]):
                continue
            score = sum(w.get((k, f), 0.0) for f in features(text, s, e))
            if score > 0:
                by_end.setdefault(j, []).append((i, score, k))
        if not by_end:
            continue
        best, back = [0.0] * (n + 1), [(-1, -1)] * (n + 1)
        for j in range(1, n + 1):
            best[j] = best[j - 1]
            for i, score, k in by_end.get(j, ()):
                if best[i] + score > best[j]:
                    best[j], back[j] = best[i] + score, (i, k)
        j = n
        while j:
            i, k = back[j]
            if i >= 0:
                out.append((k, tokens[i][0], tokens[j - 1][1]))
                j = i
            else:
                j -= 1
    return out


def joined(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in spans)


def find(docs: DataFrame, text: str = "text", out: str = "pii") -> DataFrame:
    """docs with a struct `out`: n_email, n_ip, n_card and n_phone of the patterns' spans, their base_sha256, and all spans.

    Offsets are code points, ends exclusive. A null or empty text has no spans. Rows are
    independent: repeated ones get equal results; an empty table gives an empty one; a
    column `out` that is there already is replaced, others stay.
    """
    weights = docs.sparkSession.sparkContext.broadcast(fit())
    kind = ", ".join(f"n_{k} long" for k in KINDS) + ", base_sha256 string, spans string"

    def row(text: str, w: Weights) -> tuple:
        base = base_spans(text)
        counts = [sum(k == i for k, _, _ in base) for i in range(len(KINDS))]
        return *counts, hashlib.sha256(joined(base).encode()).hexdigest(), joined(sorted(base + field_spans(text, base, w)))

    @F.pandas_udf(kind)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([row(t, weights.value) for t in batch], columns=[*(f"n_{k}" for k in KINDS), "base_sha256", "spans"])

    return docs.withColumn(out, run(text_of(text)))


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with every span of personal data in `text` replaced by its kind in angle brackets; spans that overlap become one.

    Null stays null, the empty text empty. Rows are independent: repeated ones get equal
    results; an empty table gives an empty one; other columns stay.
    """
    weights = docs.sparkSession.sparkContext.broadcast(fit())

    def clean(t: str | None, w: Weights) -> str | None:
        if t is None:
            return None
        base = base_spans(t)
        parts, at = [], 0
        for s, e, k in sorted((s, e, k) for k, s, e in base + field_spans(t, base, w)):
            if s >= at:
                parts += [t[at:s], f"<{KINDS[k]}>"]
            at = max(at, e)
        return "".join([*parts, t[at:]])

    return docs.withColumn(text, each_value(F.col(text).cast("string"), "string", pa.string(), lambda: lambda t: clean(t, weights.value)))
