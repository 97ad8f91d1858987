"""Benchmark passages in documents, also with other numbers, names or units put in.

Two readings of a text are compared. In the typed one a number, a unit or a capitalised word
(or a run of numbers or of capitalised words without punctuation between) becomes its typed
placeholder, and any other word itself in lower case; a token depends on nothing outside its
own run. In the plain one each word stands as it is. Windows of tokens are hashed and joined
to the benchmark's, the windows themselves compared, and matches gathered by document, item
and alignment. A typed alignment counts if its slots are consistent: each value of the item's
slots stands for one value in the document and the other way round. All of it is DataFrame
functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loadscope.llm.common import text_of

WINDOW = 8
#: Tokens of an alignment that make a leak, or all of a shorter item.
LEAK = 13
#: Words of their own, not placeholders, that a typed window needs.
LITERALS = 4
#: Different windows of the benchmark up to which their hashes (8 bytes each) are broadcast; more are joined by a shuffle.
BROADCAST_HASHES = 2_000_000

# Measures that count as units.
UNITS = (
    "mm cm m km ft yd mi g kg mg lb lbs oz t l ml gal s sec secs min mins h hr hrs ms kb mb gb tb hz khz mhz ghz w kw v c f k pct percent "
    "seconds minute minutes hour hours day days week weeks month months year years meter meters metre metres inch inches foot feet mile miles "
    "gram grams kilogram kilograms pound pounds ounce ounces liter liters litre litres dollar dollars cent cents euro euros degree degrees"
).split()
SPACE = r" \t\n\x0B\f\r"
EDGES = r".,;:!?()\[\]{}<>\"'`*#|~_=\-"
CURRENCY = "$€£¥+"
REST = f"(?:[^{SPACE}]*[^{SPACE}{EDGES}])?"
#: A word from its first to its last character that is no edge.
WORD = f"[^{SPACE}{EDGES}]{REST}"
NUMBER, NAME = rf"[{CURRENCY}]*[0-9]{REST}", rf"\p{{Lu}}{REST}"
PLACEHOLDERS = ("<number>", "<unit>", "<name>")


def _typed_pattern(possessive: str) -> str:
    """Runs of numbers, runs of capitalised words, other words. Possessive loops don't recurse in Java; in RE2, which has none, they match the same."""
    run = lambda w: f"{w}(?:[{SPACE}]+{w})*{possessive}"
    return f"{run(NUMBER)}|{run(NAME)}|{WORD}"


def _kind(token: Column) -> Column:
    """A typed token as it is compared. Most tokens begin with a small letter and are done after one comparison more."""
    first, low = F.substring(token, 1, 1), F.lower(token)
    number = first.between("0", "9") | first.isin(*CURRENCY) & F.substring(F.ltrim(token, F.lit(CURRENCY)), 1, 1).between("0", "9")
    word = F.when(low.isin(UNITS), PLACEHOLDERS[1]).otherwise(low)
    return F.when(token.between("a", "{"), word).when(number, PLACEHOLDERS[0]).when(low.isin(UNITS), PLACEHOLDERS[1]).when(first != F.lower(first), PLACEHOLDERS[2]).otherwise(low)


def _key(id_: str, text: Column) -> Column:
    """Of an id, null or not, and a text together."""
    return F.sha2(F.concat_ws("\n", F.coalesce(F.concat(F.lit("="), F.col(id_).cast("string")), F.lit("")), text), 256)


def _rows(df: DataFrame, name: str, id_: str, text: str) -> DataFrame:
    """(name, key, text): the id, null or not, and a key of id and text together."""
    rows = df.select(F.col(id_).alias(name), text_of(text).alias("text"))
    return rows.select(name, "text", _key(name, F.col("text")).alias("key"))


def _held(df: DataFrame, columns: list[str], **new: Column) -> DataFrame:
    """df with new columns worked out once a row, behind a generator of one row.

    Without it the optimizer puts a column's expression into the lambda functions that read
    the column, and it is worked out again for each element.
    """
    made = df.select(*columns, F.explode(F.array(F.struct(*[c.alias(n) for n, c in new.items()]))).alias("held"))
    return made.select(*columns, "held.*")


def _tokens(rows: DataFrame, columns: list[str], typed: bool) -> DataFrame:
    """rows with the array `tokens` of one reading in place of the text."""
    return _held(rows, columns, tokens=F.regexp_extract_all("text", F.lit(_typed_pattern("+") if typed else WORD), F.lit(0)))


def _grams(read: DataFrame, columns: list[str], sizes: list[int], typed: bool) -> DataFrame:
    """(columns, at, size, hash): each window of each size of read's tokens, from 0.

    Positions are taken out of the array of hashes within generated code, and the array is left
    behind there: rows that go on are small, and a text takes time in proportion to its length.
    """
    hashed = _held(read, columns, hashes=F.transform("tokens", lambda t: F.xxhash64(_kind(t) if typed else t)))
    window = lambda n: F.when(F.col("at") + n <= F.size("hashes"), F.xxhash64(F.lit(n), *[F.get("hashes", F.col("at") + k) for k in range(n)]))
    each = hashed.select(*columns, "hashes", F.posexplode("hashes").alias("at", "_")).select(*columns, "at", *[window(n).alias(f"w{n}") for n in sizes])
    if len(sizes) == 1:
        return each.where(f"w{sizes[0]} is not null").select(*columns, "at", F.lit(sizes[0]).alias("size"), F.col(f"w{sizes[0]}").alias("hash"))
    lists = F.array(*[F.struct(F.lit(n).alias("size"), F.col(f"w{n}").alias("hash")) for n in sizes])
    return each.select(*columns, "at", F.explode(lists).alias("w")).select(*columns, "at", "w.*").where("hash is not null")


def _cut(read: DataFrame, columns: list[str], typed: bool) -> DataFrame:
    """A row for each place: at, size, hash, its tokens `own` as they are compared and `low` in lower case."""
    own = lambda p: F.slice("tokens", p["at"] + 1, p["size"])
    one = lambda p: F.struct(p["at"].alias("at"), p["size"].alias("size"), p["hash"].alias("hash"), (F.transform(own(p), _kind) if typed else own(p)).alias("own"), F.transform(own(p), F.lower).alias("low"))
    return read.select(*columns, F.explode(F.transform("places", one)).alias("w")).select(*columns, "w.*")


def _matches(docs: DataFrame, items: DataFrame, typed: bool) -> DataFrame:
    """(doc_id, doc_key, item_id, item_key, shift, at, size, least, own, low, item_low): windows of a reading that documents share with items.

    Hashes alone are joined first; the documents with a match are read again for the tokens.
    """
    known = _tokens(items, ["item_id", "key"], typed).withColumn("n", F.size("tokens"))
    short = [r[0] for r in known.select("n").where(F.col("n").between(1, WINDOW - 1)).distinct().collect()]  # fewer than WINDOW rows
    sizes = [WINDOW, *sorted(short)]
    placed = _grams(known, ["key"], sizes, typed).groupBy("key").agg(F.collect_set(F.struct("at", "size", "hash")).alias("places"))
    windows = _cut(known.join(placed, "key"), ["item_id", "key", "n"], typed).where((F.col("size") == WINDOW) | (F.col("n") == F.col("size")))
    windows = windows.select("item_id", F.col("key").alias("item_key"), "hash", F.col("at").alias("item_at"), F.least("n", F.lit(LEAK)).alias("least"), F.col("own").alias("item_own"), F.col("low").alias("item_low"))
    if typed:
        windows = windows.where(F.size(F.filter("item_own", lambda t: ~t.isin(*PLACEHOLDERS))) >= F.least(F.lit(LITERALS), F.size("item_own")))
    wanted = windows.select("hash").distinct()
    if wanted.limit(BROADCAST_HASHES + 1).count() <= BROADCAST_HASHES:
        wanted = F.broadcast(wanted)
    places = _grams(_tokens(docs, ["key"], typed), ["key"], sizes, typed).join(wanted, "hash", "left_semi").groupBy("key").agg(F.collect_set(F.struct("at", "size", "hash")).alias("places"))
    read = _tokens(docs.join(places, "key"), ["doc_id", "key", "places"], typed)
    both = _cut(read, ["doc_id", "key"], typed).join(windows, "hash").where(F.col("own") == F.col("item_own"))
    return both.select("doc_id", F.col("key").alias("doc_key"), "item_id", "item_key", (F.col("at") - F.col("item_at")).alias("shift"), F.col("item_at").alias("at"), "size", "least", "own", "low", "item_low")


def _lined(matches: DataFrame, *more: Column) -> DataFrame:
    """Alignments with `n`, the item's tokens that they cover; those that cover too few go. An alignment has no more windows than its item."""
    lined = matches.groupBy("doc_id", "doc_key", "item_id", "item_key", "shift").agg(F.collect_set(F.struct("at", "size")).alias("ats"), F.max("least").alias("least"), *more)
    covered = F.array_distinct(F.flatten(F.transform("ats", lambda w: F.sequence(w["at"], w["at"] + w["size"] - 1))))
    return lined.withColumn("n", F.size(covered).cast("long")).where(F.col("n") >= F.col("least"))


def leaks(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row for each document and item of which it holds a passage: doc_id, item_id, n_tokens, n_words, same.

    n_tokens is the length of the best consistent typed alignment and n_words that of the best
    word-by-word one (0 without), same whether some alignment has the item's own slot values.
    An item of fewer tokens than a window is looked for as a whole; one with fewer than
    LITERALS words of its own only word by word. Null texts are empty; ids may be null and
    are returned so; rows that repeat an id give one row, with the best of their texts; other
    columns are ignored; empty tables give an empty result.
    """
    return _leaks(docs, benchmark, doc_id, text, item_id, item_text).groupBy("doc_id", "item_id").agg(F.max("n_tokens").alias("n_tokens"), F.max("n_words").alias("n_words"), F.max("same").alias("same"))


def _leaks(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    items = _rows(benchmark, "item_id", item_id, item_text).distinct()
    rows = _rows(docs, "doc_id", doc_id, text)
    slots = F.filter(F.arrays_zip(F.col("own").alias("kind"), F.col("low").alias("theirs"), F.col("item_low").alias("own")), lambda s: s["kind"].isin(*PLACEHOLDERS))
    lined = _lined(_matches(rows, items, True).withColumn("slots", slots), F.array_distinct(F.flatten(F.collect_set("slots"))).alias("slots"))
    distinct = lambda *fields: F.size(F.array_distinct(F.transform("slots", lambda s: F.struct(s["kind"], *[s[f] for f in fields]))))
    lined = lined.where((distinct("own", "theirs") == distinct("own")) & (distinct("own", "theirs") == distinct("theirs")))
    none = F.lit(0).cast("long")
    typed = lined.select("doc_id", "doc_key", "item_id", F.col("n").alias("n_tokens"), none.alias("n_words"), (~F.exists("slots", lambda s: s["own"] != s["theirs"])).alias("same"))
    plain = _lined(_matches(rows, items, False)).select("doc_id", "doc_key", "item_id", none.alias("n_tokens"), F.col("n").alias("n_words"), F.lit(True).alias("same"))
    return typed.unionByName(plain)


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without those that hold a benchmark passage.

    Each row is judged by its own text: rows with a null or repeated id stay or go by
    themselves, repeated rows together. Empty tables give empty results or leave docs as
    they are; other columns stay.
    """
    leaked = _leaks(docs, benchmark).select(F.col("doc_key").alias("_key")).distinct()
    return docs.withColumn("_key", _key("doc_id", text_of("text"))).join(leaked, "_key", "left_anti").select(*docs.columns)


def leaks_sql() -> str:
    """DuckDB SQL for leaks() over the tables documents and benchmark, its windows compared as lists."""
    q = lambda s: "'" + s.replace("'", "''") + "'"
    units = ", ".join(f"'{u}'" for u in UNITS)
    kind = f"""CASE WHEN substr(t, 1, 1) BETWEEN '0' AND '9' OR contains('{CURRENCY}', substr(t, 1, 1)) AND substr(ltrim(t, '{CURRENCY}'), 1, 1) BETWEEN '0' AND '9' THEN '<number>'
        WHEN lower(t) IN ({units}) THEN '<unit>' WHEN substr(t, 1, 1) <> lower(substr(t, 1, 1)) THEN '<name>' ELSE lower(t) END"""

    def read(table: str, key: str, typed: bool) -> str:
        own = f"list_transform(tokens, lambda t: {kind})" if typed else "tokens"
        return f"""SELECT {key}, text, {own} AS own, list_transform(tokens, lambda t: lower(t)) AS low
            FROM (SELECT {key}, text, regexp_extract_all(text, {q(_typed_pattern("") if typed else WORD)}) AS tokens FROM (SELECT DISTINCT {key}, coalesce(text, '') AS text FROM {table}))"""

    def reading(p: str, typed: bool) -> str:
        literals = f"WHERE len(list_filter(own, lambda x: x NOT IN ('<number>', '<unit>', '<name>'))) >= least({LITERALS}, size)" if typed else ""
        return f"""
    {p}i AS ({read("benchmark", "item_id", typed)}),
    {p}d AS ({read("documents", "doc_id", typed)}),
    {p}s AS (SELECT {WINDOW} AS size UNION SELECT len(own) FROM {p}i WHERE len(own) BETWEEN 1 AND {WINDOW - 1}),
    {p}w AS (SELECT * FROM (SELECT item_id, text, low, len(own) AS n, size, pos, own[pos:pos + size - 1] AS own
           FROM (SELECT *, unnest(range(1, len(own) - size + 2)) AS pos FROM {p}i, {p}s WHERE size = {WINDOW} OR len(own) = size)) {literals}),
    {p}g AS (SELECT doc_id, text, low, size, place, own[place:place + size - 1] AS own FROM (SELECT *, unnest(range(1, len(own) - size + 2)) AS place FROM {p}d, {p}s)),
    {p}h AS (SELECT g.doc_id, g.text AS doc, w.item_id, w.text AS item, place - pos AS shift, pos, w.size, least(n, {LEAK}) AS least, w.low AS own_low, g.low AS their_low, w.own
             FROM {p}g g JOIN {p}w w ON g.own = w.own AND g.size = w.size),
    {p}p AS (SELECT DISTINCT doc_id, doc, item_id, item, shift, least, pos + k AS p, own[k + 1] AS kind, own_low[pos + k] AS a, their_low[pos + k + shift] AS b
             FROM (SELECT *, unnest(range(0, size)) AS k FROM {p}h)),
    {p}l AS (SELECT doc_id, doc, item_id, item, shift, count(DISTINCT p) AS n FROM {p}p GROUP BY ALL HAVING count(DISTINCT p) >= max(least))"""

    join = "d.doc_id IS NOT DISTINCT FROM l.doc_id AND d.doc = l.doc AND d.item_id IS NOT DISTINCT FROM l.item_id AND d.item = l.item AND d.shift = l.shift"
    return f"""
    WITH {reading("t", True)}, {reading("v", False)},
    slots AS (SELECT doc_id, doc, item_id, item, shift, count(DISTINCT (kind, a, b)) AS n, count(DISTINCT (kind, a)) AS na, count(DISTINCT (kind, b)) AS nb, bool_and(a = b) AS same
              FROM tp WHERE kind IN ('<number>', '<unit>', '<name>') GROUP BY ALL),
    found AS (
      SELECT l.doc_id, l.item_id, l.n AS n_tokens, 0 AS n_words, coalesce(same, true) AS same FROM (SELECT doc_id, doc, item_id, item, shift, max(n) AS n FROM tl GROUP BY ALL) l
      LEFT JOIN slots d ON {join} WHERE coalesce(d.n = na AND d.n = nb, true)
      UNION ALL SELECT doc_id, item_id, 0, n, true FROM vl)
    SELECT doc_id, item_id, max(n_tokens)::BIGINT AS n_tokens, max(n_words)::BIGINT AS n_words, bool_or(same) AS same FROM found GROUP BY doc_id, item_id"""
