"""Load sites out of the rows of source files: aliases, loader rules, scopes and bindings are joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loadscope.operators import context as C
from loadscope.operators.artifacts import match_loader
from loadscope.operators.columns import mapped
from loadscope.operators.imports import canonical
from loadscope.operators.rules import first_rule
from loadscope.operators.shared import stored
from loadscope.plans import dims
from loadscope.sources import expressions

# Fixed value: how far a call's closing bracket may be.
FARTHEST = 20_000
SITE = ["file", "line", "pos", "enclosing", "loader", "canonical", "snippet", "args", "target", "literal"]


def python(file):
    return file.rlike(r"\.(py|pyi|ipynb)\z")


def loads(found: DataFrame, sources: DataFrame, rules: DataFrame | None = None) -> DataFrame:
    """Calls of loaders, of the rows that scanner.read found in sources (path, text).

    (file, line, pos, enclosing, loader, canonical, snippet, args, target, literal): literal is
    the path that the target argument certainly is. rules (priority, ecosystem, pattern, loader, positions, keywords) take the
    place of the built-in loader rules.
    """
    aliases = found.where("kind = 'alias'").select("file", F.col("name").alias("alias"), F.col("value").alias("full"), "at")
    calls = found.where("kind = 'call'").where(F.col("closed") - F.col("opened") <= FARTHEST).select("file", "at", "line", "indent", "name", "opened", "closed")
    named = canonical(calls, aliases)
    ecosystem = F.when(python(F.col("file")), "py").otherwise("js")
    if rules is None:
        positions = mapped(F.col("loader"), {i: ",".join(map(str, p)) for i, _, p, _, _ in dims.LOADERS}, "")
        keywords = mapped(F.col("loader"), {i: ",".join(k) for i, _, _, k, _ in dims.LOADERS}, "")
        ruled = named.withColumn("loader", match_loader(F.col("canonical"), ecosystem)).where("loader is not null")
        ruled = ruled.withColumns({"positions": F.split(F.nullif(positions, F.lit("")), ",").cast("array<int>"), "keywords": F.split(F.nullif(keywords, F.lit("")), ",")})
    else:
        ruled = first_rule(named.withColumn("ecosystem", ecosystem), rules, "canonical", ["loader", "positions", "keywords"], ["ecosystem"]).where("loader is not null")
    ruled = stored(ruled.select("file", "at", "line", "indent", "canonical", "opened", "closed", "loader", "positions", "keywords"))
    scopes = found.where("kind = 'scope'").select("file", "at", "indent", "name")
    enclosing = C.enclosing_scope(ruled.select("file", F.col("at").alias("site"), "at", "indent"), scopes).withColumnRenamed("site", "at")
    written = expressions.arguments(ruled, sources)
    first = lambda values: F.get(F.filter(values, lambda v: v.isNotNull()), F.lit(0))
    target = F.coalesce(first(F.transform("keywords", lambda k: F.col("named")[k])), first(F.transform("positions", lambda p: F.get("plain", p))))
    written = stored(written.withColumn("target", target).join(enclosing, ["file", "at"], "left"))
    bindings = found.where("kind = 'binding'").select("file", "name", F.col("line").alias("at"), F.col("value").alias("expr"))
    bound = bound_names(written.where("target is not null").select("file", "line", F.col("target").alias("expr")), bindings)
    joining = F.col("full").rlike(r"(^|\.)(" + "|".join(expressions.JOINED) + r")\z")
    known = aliases.where(joining).groupBy("file", "alias").agg(F.max_by("full", "at").alias("full")).groupBy("file").agg(F.map_from_entries(F.collect_list(F.struct("alias", "full"))).alias("known"))
    rows = written.join(bound, ["file", "line"], "left").join(known, "file", "left")
    return rows.withColumn("literal", expressions.literal(F.col("target"), python(F.col("file")), F.col("bound"), F.col("known"))).withColumnRenamed("at", "pos").select(*SITE)


def bound_names(exprs: DataFrame, bindings: DataFrame) -> DataFrame:
    """(file, line, bound): for each line with expressions, a map of the variables that they come down to, each with what it is bound to there.

    exprs has file, line and expr; bindings file, name, at and expr. Names of an expression are
    looked up, then those of what they are bound to, as deep as paths are folded.
    """
    words = lambda: F.explode(F.array_distinct(F.regexp_extract_all("expr", F.lit(expressions.WORD), F.lit(0)))).alias("name")
    known = bindings.select("file", "name").distinct()
    wanted = exprs.select("file", "line", words()).distinct().join(known, ["file", "name"], "left_semi")
    every = None
    for _ in range(expressions.DEEPEST):
        wanted = stored(wanted)
        if wanted.isEmpty():
            break
        asks = wanted.select(F.col("file").alias("scope"), "name", F.col("line").alias("at"), F.lit(0).alias("call"))
        now = stored(C.nearest_binding(asks, bindings.withColumnRenamed("file", "scope")).select(F.col("scope").alias("file"), F.col("at").alias("line"), "name", F.col("bound").alias("expr")))
        every = now if every is None else every.unionByName(now)
        wanted = now.select("file", "line", words()).distinct().join(known, ["file", "name"], "left_semi").join(every.select("file", "line", "name"), ["file", "line", "name"], "left_anti")
    if every is None:
        return exprs.limit(0).select("file", "line", F.create_map().cast("map<string,string>").alias("bound"))
    return every.groupBy("file", "line").agg(F.map_from_entries(F.collect_list(F.struct("name", "expr"))).alias("bound"))
