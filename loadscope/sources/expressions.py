"""Arguments of calls and the paths that expressions certainly are: small helpers over one call's text."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loadscope.sources.scanner import mask

# How deep paths are folded, and how long a snippet is.
DEEPEST, SNIPPET = 6, 160
FORMATTED = re.compile(r"[fF][rR]?(\"\"\"|'''|\"|')(.*)\1\Z", re.S)
QUOTED = re.compile(r"[rRbBuU]{0,2}(\"\"\"|'''|\"|'|`)(.*)\1\Z", re.S)
OPENED = ("open", "read_bytes", "read_text", "resolve", "absolute", "as_posix")
JOINED = ("Path", "PurePath", "str", "fspath", "join")
#: A word of an expression that may be a variable's name.
WORD = r"[A-Za-z_]\w*"


def split_top(text: str, masked: str, separators: str = ",") -> list[str]:
    """The parts between separators that stand in no bracket."""
    parts, depth, at = [], 0, 0
    for m in re.finditer(rf"[()\[\]{{}}{re.escape(separators)}]", masked):
        if m[0] in separators:
            if not depth:
                parts.append(text[at : m.start()])
                at = m.end()
        else:
            depth += 1 if m[0] in "([{" else -1
    return [p.strip() for p in [*parts, text[at:]] if p.strip()]


# What the constants of both languages are as literals.
CONSTANTS = {"True": "true", "true": "true", "False": "false", "false": "false", "None": "none", "null": "none", "undefined": "none"}


def folded(value: str) -> str:
    """A constant or plain string as its value, anything else as it is written."""
    if (m := QUOTED.fullmatch(value)) and m[1] not in m[2] and "\\" not in m[2]:
        return m[2]
    return CONSTANTS.get(value, value)


def parts(text: str, masked: str, python: bool) -> tuple[dict[str, str], list[str]]:
    """(named, plain) arguments as they are written."""
    named, plain = {}, []
    for part in split_top(text, masked):
        if python and (k := re.match(r"([A-Za-z_]\w*)\s*[=:](?!=)\s*(.*)\Z", part, re.S)):
            named[k[1]] = k[2].strip()
        elif not python and part.startswith("{"):
            named |= {a.strip("\"' "): b.strip() for a, _, b in (x.partition(":") for x in split_top(part[1:-1], mask(part[1:-1], False))) if b}
        else:
            plain.append(part)
    return named, plain


def arguments(calls: DataFrame, sources: DataFrame) -> DataFrame:
    """calls (file, at, opened, closed) with their snippet, named arguments, the same folded as args, and plain ones. A file's calls meet its text once."""
    kind = "file string, at int, snippet string, named map<string,string>, args map<string,string>, plain array<string>"

    def run(batches):
        for batch in batches:
            for file, text, spans in zip(batch["file"], batch["text"], batch["spans"], strict=True):
                python = file.endswith((".py", ".pyi", ".ipynb"))
                masked, out = mask(text, python), []
                for s in spans:
                    inside = slice(s["opened"] + 1, s["closed"])
                    named, plain = parts(text[inside], masked[inside], python)
                    out.append((file, s["at"], " ".join(text[s["at"] : s["closed"] + 1].split())[:SNIPPET], named, {k: folded(v) for k, v in named.items()}, plain))
                yield pd.DataFrame(out, columns=["file", "at", "snippet", "named", "args", "plain"])

    spans = calls.groupBy("file").agg(F.collect_list(F.struct("at", "opened", "closed")).alias("spans"))
    found = sources.select(F.col("path").alias("file"), "text").join(spans, "file").select("file", "text", "spans").mapInPandas(run, kind)
    return calls.join(found, ["file", "at"])


class Folder:
    """Expressions of one call as paths: variables are what bound says, other names what known says."""

    def __init__(self, bound: dict[str, str], known: dict[str, str], python: bool):
        self.bound, self.known, self.python = bound, known, python

    def formatted(self, body: str, again) -> str | None:
        """An f-string's text if all that it puts in is certain."""
        pieces = re.split(r"(\{\{|\}\}|\{[^{}]*\})", body)
        out = [again(p[1:-1].split(":")[0].split("!")[0]) if p.startswith("{") and p != "{{" else p[0] if p in ("{{", "}}") else p for p in pieces]
        return None if None in out or any(c in p for p, o in zip(pieces, out, strict=True) for c in "{}" if p is o) else "".join(out)

    def path(self, expr: str, depth: int = 0) -> str | None:
        """A path that an expression certainly is, or null."""
        expr = expr.strip()
        if depth > DEEPEST or not expr:
            return None
        again = lambda e: self.path(e, depth + 1)
        if (m := QUOTED.fullmatch(expr)) and m[1] not in m[2]:
            return m[2] if "\\" not in m[2] or expr[0] in "rR" else re.sub(r"\\(.)", lambda x: {"n": "\n", "t": "\t", "r": "\r", "0": "\0"}.get(x[1], x[1]), m[2])
        if self.python and (m := FORMATTED.fullmatch(expr)) and m[1] not in m[2]:
            return self.formatted(m[2], again)
        if re.fullmatch(WORD, expr):
            found = self.bound.get(expr)
            return again(found) if found and found != expr else None
        masked = mask(expr, self.python)
        for operator, glue in (("+", ""), ("/", "/")):
            if len(terms := split_top(expr, masked, operator)) > 1:
                out = [again(p) for p in terms]
                return None if None in out else glue.join(f.strip("/") if glue and i else f for i, f in enumerate(out))
        if m := re.fullmatch(rf"(?:([\w.]+)|(.+?)\.({'|'.join(OPENED)}))\((.*)\)", expr, re.S):
            name = m[1] or ""
            if m[2] or name.rpartition(".")[2] in OPENED and "." in name:
                return again(m[2] or name.rpartition(".")[0])
            inside = split_top(m[4], mask(m[4], self.python))
            if self.known.get(name, name).rpartition(".")[2] in JOINED and inside:
                out = [again(p) for p in inside]
                return None if None in out else "/".join(out)
            if name == "open" and inside:
                return again(inside[0])
        return None


def _folded(expr: pd.Series, python: pd.Series, bound: pd.Series, known: pd.Series) -> pd.Series:
    return pd.Series([Folder(json.loads(b), json.loads(k), p).path(e) if e is not None else None for e, p, b, k in zip(expr, python, bound, known, strict=True)], dtype=object)


def literal(expr: Column, python: Column, bound: Column, known: Column) -> Column:
    """The path that an expression is, given maps of what its variables are bound to and what its names stand for."""
    nothing = lambda c: F.coalesce(F.to_json(c), F.lit("{}"))
    return F.pandas_udf(_folded, "string")(expr, python, nothing(bound), nothing(known))
