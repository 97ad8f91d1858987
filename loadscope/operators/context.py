"""Where loading happens: environments of files, their privileges, and frameworks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loadscope.functions.text import matches_any
from loadscope.operators import asof
from loadscope.operators.columns import first_match, rank
from loadscope.plans import dims

#: Longer lines, and lines beyond this many, carry no privilege signals.
LONGEST_LINE, MOST_LINES = 4000, 60_000


def environment(file: Column, frameworks: Column | None = None, declared: list[tuple[str, list[str]]] = ()) -> Column:
    """(environment, basis): the first declared environment whose globs match, else the first path rule, else a service by its framework."""
    found = lambda env, basis: F.struct(F.lit(env).alias("environment"), F.lit(basis).alias("basis"))
    cases = [(matches_any(file, globs), found(env, "declared")) for env, globs in declared if globs]
    cases += [(matches_any(file, globs), found(env, "path")) for env, globs in dims.PATH_RULES]
    if frameworks is not None:
        services = F.array(*[F.lit(name) for name, _ in dims.FRAMEWORKS if name not in dims.NO_SERVICES])
        cases.append((F.arrays_overlap(frameworks, services), found("service", "framework")))
    return first_match(*cases).otherwise(found("unresolved", "unresolved"))


def frameworks(text: Column) -> Column:
    """Those whose marker the text has, in the rules' order."""
    return F.filter(F.array(*[F.when(text.rlike(p), F.lit(name)) for name, p in dims.FRAMEWORKS]), lambda x: x.isNotNull())


def signals(texts: DataFrame, rules: list[tuple[str, str, str]] | None = None) -> DataFrame:
    """(file, kind, label, line, evidence): the first line of each file that matches a rule.

    texts has path and text. The rules of a line are tried in one pass; nothing is joined.
    """
    rules = rules or dims.PRIVILEGES
    lines = texts.select(F.col("path").alias("file"), F.posexplode(F.split("text", "\r?\n")).alias("at", "words")).where((F.col("at") < MOST_LINES) & (F.length("words") <= LONGEST_LINE))
    hit = [F.when(F.col("words").rlike(p), F.struct(F.lit(i).alias("rule"), F.lit(kind).alias("kind"), F.lit(label).alias("label"))) for i, (kind, label, p) in enumerate(rules)]
    hits = lines.select("file", (F.col("at") + 1).alias("line"), F.btrim("words").alias("evidence"), F.explode(F.filter(F.array(*hit), lambda x: x.isNotNull())).alias("hit"))
    first = hits.groupBy("file", "hit.kind", "hit.label").agg(F.min(F.struct("line", "evidence")).alias("at"))
    return first.select("file", "kind", "label", "at.line", "at.evidence")


def contexts_of(sites: DataFrame, contexts: DataFrame) -> DataFrame:
    """(artifact_id, environment, privileged): one row for each environment of an artifact, a privileged context before others."""
    pairs = sites.where("artifact_id is not null").select("artifact_id", "file").distinct().join(contexts.select("file", "environment", "privileged"), "file")
    return pairs.groupBy("artifact_id", "environment").agg(F.bool_or("privileged").alias("privileged"))


def by_reach(environments: Column) -> Column:
    return rank(environments, dims.REACH)


def nearest_binding(calls: DataFrame, bindings: DataFrame) -> DataFrame:
    """calls (scope, name, at) with the expression bound last at or before `at`, or else first after it. bindings has scope, name, at, expr."""
    found = asof.nearest(calls.select("scope", "name", "at", "call"), bindings.select("scope", "name", "at", "expr"), ["scope", "name"], "at", "expr")
    return found.select("call", "scope", "name", "at", F.col("expr").alias("bound"))


def enclosing_scope(sites: DataFrame, scopes: DataFrame) -> DataFrame:
    """sites (file, site, at, indent) with the name of the deepest scope (file, at, indent, name) that begins at or before them and is less indented; of equals the last."""
    return asof.deepest(sites, scopes)
