"""Text and path functions as Column expressions, and the glob compiler of the driver side."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed value: white space as the analysed languages' own regular expressions see it.
SPACE = "[\\t\\n\\x0B\\f\\r \\u00A0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000\\uFEFF]"
# Fixed value: characters that could make a terminal or a reader misread a name.
CONTROL = "[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F-\\u009F\\u200B-\\u200F\\u202A-\\u202E\\u2066-\\u2069\\uFEFF]"
LONGEST_PATH = 1024


def clip(text: Column, most: int) -> Column:
    """White space runs as one space, trimmed; longer than `most`, cut and marked with an ellipsis."""
    flat = F.btrim(F.regexp_replace(text, SPACE + "+", " "), F.lit(" "))
    return F.when(F.length(flat) > most, F.concat(F.substring(flat, 1, most - 1), F.lit("…"))).otherwise(flat)


def sanitise(text: Column) -> Column:
    return F.regexp_replace(text, CONTROL, "�")


def normalise_path(raw: Column) -> Column:
    """A relative POSIX path, or null if it is empty, too long, absolute or leaves its root."""
    slashed = F.replace(sanitise(raw), F.lit("\\"), F.lit("/"))
    refused = (F.length(raw) == 0) | (F.length(raw) > LONGEST_PATH) | F.contains(raw, F.lit("\0")) | slashed.rlike("^(/|[A-Za-z]:)")
    parts = F.filter(F.split(slashed, "/"), lambda p: ~p.isin("", "."))
    return F.when(~refused & ~F.array_contains(parts, "..") & (F.size(parts) > 0), F.array_join(parts, "/"))


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def dirname(path: Column) -> Column:
    return F.when(F.contains(path, F.lit("/")), F.regexp_replace(path, "/[^/]*\\z", "")).otherwise("")


def extname(path: Column) -> Column:
    """The extension in lower case, with its dot; empty without one or if the name begins with its only dot."""
    return F.lower(F.regexp_extract(basename(path), "^[\\s\\S]+(\\.[^.]*)\\z", 1))


def suffixes(path: Column) -> Column:
    """What a path ends with, from each of its segments on: the whole path first, its name last."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, k, F.size(parts)), "/"))


def stem(path: Column) -> Column:
    name = basename(path)
    return F.substring(name, F.lit(1), F.length(name) - F.length(extname(path)))


def join_path(folder: Column, name: Column) -> Column:
    return F.when(folder == "", name).otherwise(F.concat_ws("/", folder, name))


def glob_regex(glob: str) -> str:
    """The regular expression of a glob: `**/` any segments, `**` anything, `*` and `?` within a segment."""
    meaning = {"**/": "(?:[^/]+/)*", "**": ".*", "*": "[^/]*", "?": "[^/]"}
    pieces = re.split(r"(\*\*/|\*\*|\*|\?)", glob)
    return "^" + "".join(meaning[p] if p in meaning else re.sub(r"([.+^${}()|\[\]\\])", r"\\\1", p) for p in pieces) + "\\z"


def matches_any(path: Column, globs: list[str]) -> Column:
    return path.rlike("|".join(f"(?:{glob_regex(g)})" for g in globs)) if globs else F.lit(False)


def csv_cell(value: Column) -> Column:
    """A quoted cell that no spreadsheet takes for a formula."""
    text = F.coalesce(value.cast("string"), F.lit(""))
    safe = F.when(text.rlike("^[=+\\-@\\t\\r]"), F.concat(F.lit("'"), text)).otherwise(text)
    return F.concat(F.lit('"'), F.replace(safe, F.lit('"'), F.lit('""')), F.lit('"'))


def left_truncated(text: Column, width: int) -> Column:
    return F.when(F.length(text) <= width, text).otherwise(F.concat(F.lit("…"), F.right(text, F.lit(width - 1))))


def padded(text: Column, width: Column) -> Column:
    """Right-padded, never cut."""
    return F.rpad(text, F.greatest(width, F.length(text)), F.lit(" "))


def line_of(text: Column, position: Column) -> Column:
    """The 1-based line of a 1-based position: as-of lookup over line starts."""
    head = F.substring(text, F.lit(1), position - 1)
    return 1 + F.length(head) - F.length(F.replace(head, F.lit("\n"), F.lit("")))


#: A run of name characters is looked at once: the name is what follows its leading digits and dots.
CALL = r"(?<![A-Za-z0-9_.])[0-9.]*+([A-Za-z_][A-Za-z0-9_.]*+)[ \t]*+\("


def call_names(text: Column) -> Column:
    """Dotted names before an opening parenthesis, in order."""
    return F.regexp_extract_all(text, F.lit(CALL), F.lit(1))


def call_lines(rows: DataFrame, text: str) -> DataFrame:
    """rows without the text, for each call in it: line (from 1) and name. A call never spans lines, so no position is looked up."""
    lines = rows.select(*[c for c in rows.columns if c != text], F.posexplode(F.split(text, "\n")).alias("at", "words"))
    kept = [c for c in lines.columns if c not in ("at", "words")]
    return lines.select(*kept, (F.col("at") + 1).alias("line"), F.explode(call_names(F.col("words"))).alias("name"))


def short_id(text: Column) -> Column:
    return F.left(F.sha2(text, 256), F.lit(12))


def digest(content: Column, size: Column, cap: int, edge: int) -> Column:
    """(value, coverage): SHA-256 of all bytes, or above the cap of both edges and the size between bars."""
    whole = F.struct(F.sha2(content, 256).alias("value"), F.lit("full").alias("coverage"))
    ends = F.concat(F.substring(content, 1, edge), F.encode(F.concat(F.lit("|"), size.cast("string"), F.lit("|")), "UTF-8"), F.substring(content, -edge, edge))
    return F.when(size <= cap, whole).otherwise(F.struct(F.sha2(ends, 256).alias("value"), F.lit("head-tail").alias("coverage")))


def bounded_text(content: Column, most: int) -> Column:
    """The first bytes as text; bytes that aren't UTF-8 become U+FFFD."""
    return F.make_valid_utf8(F.substring(content, 1, most).cast("string"))


def elided(path: Column, most: int) -> Column:
    """A path of at most so many characters: its middle gives way to an ellipsis, its last segment longest."""
    name = basename(path)
    room = F.greatest(F.lit(most) - F.length(name) - 2, F.lit(0))
    short = F.when(F.length(name) + 2 > most, left_truncated(name, most)).otherwise(F.concat(F.left(path, room), F.lit("…/"), name))
    return F.when(F.length(path) <= most, path).otherwise(short)


def human_bytes(size: Column) -> Column:
    """A size in the largest unit of 1024 that it reaches: one decimal place above bytes, two of GiB, of two equally near values the larger."""
    at = lambda unit, n, places: F.concat(F.format_string(f"%.{places}f", F.round(size / n, places)), F.lit(f" {unit}"))
    return F.when(size < 1024, F.concat(size.cast("string"), F.lit(" B"))).when(size < 1 << 20, at("KiB", 1 << 10, 1)).when(size < 1 << 30, at("MiB", 1 << 20, 1)).otherwise(at("GiB", 1 << 30, 2))
