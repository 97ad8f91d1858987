"""Python and JavaScript source as rows: calls, imports, scopes and bindings, from a linear scan over masked text.

Masking keeps every character's place: comments become spaces, what stands in strings a
filler. A call is a dotted name before a bracket. What names mean, which scope a call is in
and what a variable is bound to is worked out by joins over these rows (operators.loads).
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FILL = "\x01"
NAME = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_."
BRACKET = re.compile(r"[()\[\]{}]")
PY_TOKEN = re.compile(r"#[^\n]*|(?:[rRbBuUfF]{0,2})(\"\"\"|'''|\"|')")
JS_TOKEN = re.compile(r"//[^\n]*|/\*.*?(?:\*/|\Z)|([\"'`])", re.S)
PY_IMPORT = re.compile(r"^[ \t]*(?:from[ \t]+([\w.]+)[ \t]+import[ \t]+\(?([^\n)]*)|import[ \t]+([^\n]+))", re.M)
JS_IMPORT = re.compile(r"import\s+(?:\*\s+as\s+(\w+)|\{([^}]*)\}|(\w+))\s+from\s+(['\"])([^'\"]+)\4|(?:const|let|var)\s+(?:\{([^}]*)\}|(\w+))\s*=\s*require\(\s*(['\"])([^'\"]+)\8\s*\)")
BINDING = re.compile(r"^[ \t]*(?:const |let |var )?([A-Za-z_]\w*)[ \t]*=(?!=)[ \t]*([^\n]+)|\bwith[ \t]+(open\([^\n]*\))[ \t]+as[ \t]+(\w+)", re.M)
SCOPE = re.compile(r"^([ \t]*)(?:async[ \t]+)?(?:def|class|function)[ \t]+([A-Za-z_]\w*)", re.M)
ROW = "file string, kind string, at int, line int, indent int, name string, value string, opened int, closed int"


def mask(text: str, python: bool) -> str:
    """The text with comments and what stands in strings blanked out, place by place."""
    out, at, n = [], 0, len(text)
    token = PY_TOKEN if python else JS_TOKEN
    while m := token.search(text, at):
        out.append(text[at : m.start()])
        if not (quote := m[1]):
            out.append(re.sub(r"[^\n]", " ", m[0]))
            at = m.end()
            continue
        k, lines = m.end(), len(quote) == 3 or quote == "`"
        while k < n and not text.startswith(quote, k) and (lines or text[k] != "\n"):
            k += 2 if text[k] == "\\" else 1
        k = min(k, n)
        closed = text.startswith(quote, k)
        out.append(m[0] + re.sub(r"[^\n]", FILL, text[m.end() : k]) + quote * closed)
        at = k + len(quote) * closed
    return "".join([*out, text[at:]])


CLOSER = {"(": ")", "[": "]", "{": "}"}


def brackets(masked: str) -> tuple[list[tuple[int, int]], dict[int, int]]:
    """Round brackets that open, each with the end of what stands before it; and where each closes.

    A closer of another kind than the innermost open bracket leaves that bracket and all
    around it without an end.
    """
    opened, closes, stack, last = [], {}, [], 0
    for m in BRACKET.finditer(masked):
        at = m.start()
        if m[0] in CLOSER:
            if m[0] == "(":
                opened.append((last, at))
            stack.append(at)
        elif stack:
            if CLOSER[masked[stack[-1]]] == m[0]:
                closes[stack.pop()] = at
            else:
                stack.clear()
        last = at + 1
    return opened, closes


def called(masked: str, opened: list[tuple[int, int]]) -> Iterator[tuple[int, str, int]]:
    """(place, name, bracket) of dotted names before brackets. Each bracket looks back to the one before it only, so this is linear."""
    for since, at in opened:
        before = masked[since:at].rstrip(" \t")
        name = before[len(before.rstrip(NAME)) :].lstrip("0123456789.")
        if name:
            yield since + len(before) - len(name), name, at


def imported(text: str, masked: str, python: bool) -> Iterator[tuple[int, str, str | None, str]]:
    """(place, module, local name or none, what it stands for) of each imported name."""
    if python:
        for m in PY_IMPORT.finditer(masked):
            for part in (m[2] or m[3] or "").split(","):
                words = part.split()
                if words and re.fullmatch(r"[\w.]+", words[0]):
                    name = words[2] if len(words) == 3 and words[1] == "as" else None
                    yield m.start(), m[1] or words[0], name or words[0] if m[1] else name, f"{m[1]}.{words[0]}" if m[1] else words[0]
        return
    for m in JS_IMPORT.finditer(text):
        whole = m[5] or m[9]
        module = whole.split("/")[-1]
        for part in (m[2] or m[6] or "").split(","):
            words = re.split(r"\s+as\s+|\s*:\s*", part.strip())
            if words[0]:
                yield m.start(), whole, words[-1], words[0]
        if star := m[1] or m[3] or m[7]:
            yield m.start(), whole, star, {"onnxruntime-node": "onnxruntime", "onnxruntime-web": "onnxruntime", "tfjs": "tf", "tfjs-node": "tf"}.get(module, module)


def rows(file: str, text: str) -> Iterator[tuple]:
    """The rows of one file. A JavaScript function holds what follows it, so there scopes have no indentation and calls have one."""
    python = file.endswith((".py", ".pyi", ".ipynb"))
    masked = mask(text, python)
    starts = [0, *(m.end() for m in re.finditer("\n", text))]
    line = lambda at: bisect_right(starts, at)
    width = lambda head: len(head.replace("\t", "    "))
    for at, module, name, full in imported(text, masked, python):
        yield file, "import", at, line(at), None, module, None, None, None
        if name:
            yield file, "alias", at, line(at), None, name, full, None, None
    for m in SCOPE.finditer(masked):
        yield file, "scope", m.start(), line(m.start()), width(m[1]) if python else 0, m[2], None, None, None
    for m in BINDING.finditer(masked):
        name, (s, e) = (m[1], m.span(2)) if m[1] else (m[4], m.span(3))
        value = text[s:e].split("#")[0] if python else text[s:e]
        yield file, "binding", m.start(), line(m.start()), None, name, value.strip().rstrip(";"), None, None
    opened, closes = brackets(masked)
    for at, name, bracket in called(masked, opened):
        if bracket in closes:
            n = line(at)
            indent = width(re.compile(r"[ \t]*").match(text, starts[n - 1])[0]) if python else 1
            yield file, "call", at, n, indent, name, None, bracket, closes[bracket]


def read(files: DataFrame) -> DataFrame:
    """The rows of source files (path, text); the language is told from the extension. Files without a path or a text have none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [c.split()[0] for c in ROW.split(", ")]
        for batch in batches:
            for path, text in zip(batch["path"], batch["text"], strict=True):
                found = pd.DataFrame(rows(path, text), columns=columns)
                yield found.astype({c: "Int32" for c in ("at", "line", "indent", "opened", "closed")})

    return files.where("path is not null and text is not null").select("path", "text").mapInPandas(run, ROW)


def imports(found: DataFrame) -> DataFrame:
    """(file, names): the sorted distinct modules that each file imports, of the rows of read."""
    return found.where("kind = 'import'").groupBy("file").agg(F.array_sort(F.collect_set("name")).alias("names"))
