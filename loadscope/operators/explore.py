"""Filters, facets, search and order over records."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loadscope.operators.columns import mapped, rank
from loadscope.operators.records import finding_cells, stripe
from loadscope.operators.shared import stored
from loadscope.operators.summary import environments
from loadscope.plans import dims


@dataclass(frozen=True)
class Filters:
    """Values of a facet are alternatives; facets all have to hold; so do the query's words."""

    behaviour: tuple[str, ...] = ()
    environment: tuple[str, ...] = ()
    format: tuple[str, ...] = ()
    migration: tuple[str, ...] = ()
    evidence: tuple[str, ...] = ()
    privileged: bool = False
    query: str = ""

    @property
    def active(self) -> int:
        """How many values are set."""
        values = [getattr(self, f) for f in self.__dataclass_fields__]
        return sum(len(v) if isinstance(v, tuple) else bool(v) for v in values)

    def toggled(self, facet: str, value: str) -> Filters:
        now = getattr(self, facet)
        return replace(self, **{facet: tuple(x for x in now if x != value) if value in now else (*now, value)})


PRESETS = {
    "executes": Filters(behaviour=("code",)),
    "production": Filters(environment=("production", "staging", "service")),
    "unknown": Filters(behaviour=("unknown",)),
    "privileged": Filters(privileged=True),
    "migrations": Filters(migration=("available",)),
    "clear": Filters(),
}


#: Stands between the fields that a search looks at, so that no word matches across two.
BETWEEN = " \u0001 "


def haystack(records: DataFrame) -> Column:
    """All of a record that a search looks at, in lower case; its load sites and evidence are looked at by themselves."""
    label = mapped(F.col("format"), dims.LABELS, "")
    named = lambda column, names: F.array_join(F.transform(column, lambda x: mapped(x, names, "")), BETWEEN)
    joined = lambda column: F.array_join(column, BETWEEN)
    version = F.col("version") if "version" in records.columns else F.lit(None).cast("string")
    return F.lower(F.concat_ws(
        BETWEEN, F.col("artifact_id").cast("string"), "locator", F.substring_index("locator", "/", -1), version, "format", label, "behaviour", "verdict.reason", "alternative.kind", F.left("digest", F.lit(16)),
        joined("environments"), named("environments", {e: x[0] for e, x in dims.ENVIRONMENTS.items()}), joined("privileges"), named("privileges", dims.PRIVILEGE_LABELS), joined("bindings"),
        joined(F.transform(finding_cells(records), lambda f: f["kind"])),
    ))


def search(records: DataFrame, sites: DataFrame, query: str, evidence: DataFrame | None = None) -> DataFrame:
    """Records that have every word of the query, each in themselves, in one of their load sites (file, line, enclosing, loader) or in a record of evidence (scanner, result).

    Sites and evidence are aggregated to one flag for each word and artifact before they are joined.
    """
    terms = query.lower().split()
    if not terms:
        return records
    rows, flags = records, [[] for _ in terms]
    for name, parts, columns in (("site", sites, ("file", "line", "enclosing", "loader")), ("proof", evidence, ("scanner", "result"))):
        if parts is None:
            continue
        text = F.lower(F.concat_ws(BETWEEN, *[F.col(c).cast("string") for c in columns if c in parts.columns]))
        inside = parts.where("artifact_id is not null").groupBy("artifact_id").agg(*[F.bool_or(F.contains(text, F.lit(t))).alias(f"_{name}{i}") for i, t in enumerate(terms)])
        rows = rows.join(inside, "artifact_id", "left")
        for i in range(len(terms)):
            flags[i].append(F.coalesce(f"_{name}{i}", F.lit(False)))
    for t, found in zip(terms, flags, strict=True):
        rows = rows.where(reduce(lambda a, b: a | b, found, F.contains(haystack(records), F.lit(t))))
    return rows.select(*records.columns)


def conditions(filters: Filters, records: DataFrame) -> dict[str, Column]:
    one = lambda column, values: F.col(column).isin(list(values)) if values else F.lit(True)
    out = {
        "behaviour": one("behaviour", filters.behaviour),
        "environment": F.arrays_overlap(environments(), F.array(*[F.lit(e) for e in filters.environment])) if filters.environment else F.lit(True),
        "format": one("format", filters.format),
        "migration": one("migration", filters.migration),
        "evidence": one("evidence_state", filters.evidence),
        "privileged": F.col("privileged") if filters.privileged else F.lit(True),
    }
    query = F.lit(True)
    for term in filters.query.lower().split():
        query = query & F.contains(haystack(records), F.lit(term))
    return out | {"query": query}


def apply_filters(records: DataFrame, filters: Filters, sites: DataFrame | None = None, evidence: DataFrame | None = None) -> DataFrame:
    """Records that pass all filters. With sites the query's words are also looked for in load sites and evidence, as search does."""
    held = conditions(filters, records)
    if sites is not None:
        held.pop("query")
        records = search(records, sites, filters.query, evidence)
    for condition in held.values():
        records = records.where(condition)
    return records


def facet_counts(records: DataFrame, filters: Filters) -> DataFrame:
    """(facet, value, artifacts): each facet counted under all the other facets' filters, in one pass over the records."""
    held = conditions(filters, records)
    passed = F.array(*[held[k] for k in held])
    failed = F.size(F.filter(passed, lambda x: ~x))
    values = {
        "behaviour": F.array("behaviour"), "environment": environments(), "format": F.array("format"), "migration": F.array("migration"), "evidence": F.array("evidence_state"),
        "privileged": F.when(F.col("privileged"), F.array(F.lit("true"))).otherwise(F.array().cast("array<string>")),
    }
    # a record counts for a facet if no filter fails it, or only that facet's own
    own = lambda k: (failed == 0) | (failed == 1) & ~held[k]
    cell = lambda k: lambda x: F.struct(F.lit(k).alias("facet"), x.alias("value"))
    cells = [F.when(own(k), F.transform(v, cell(k))) for k, v in values.items()]
    rows = records.select(F.explode(F.flatten(F.filter(F.array(*cells), lambda x: x.isNotNull()))).alias("c"))
    return rows.groupBy("c.facet", "c.value").agg(F.count("*").alias("artifacts"))


def order_keys(key: str) -> tuple[Column, Column]:
    """What an order of records compares, and the id that breaks ties."""
    keys = {
        "display": mapped(F.col("behaviour"), dims.DISPLAY, 9) * 10 - F.when(F.col("privileged"), 5).otherwise(0),
        "exposure": mapped(F.col("behaviour"), dims.EXPOSURE, -1) * 2 + F.when(F.col("privileged"), 1).otherwise(0),
        "artifact": F.col("locator"),
        "format": mapped(F.col("format"), dims.LABELS, ""),
        "context": F.when(F.size("environments") == 0, "zzz").otherwise(F.array_join(F.array_sort("environments"), ",")),
        "evidence": F.col("evidence_state"),
    }
    return keys[key], F.col("artifact_id")


def order_by(key: str, descending: bool = False) -> list[Column]:
    """Order keys of records; ties are always by id upwards."""
    of, tie = order_keys(key)
    return [of.desc() if descending else of.asc(), tie.asc()]


def migrations(records: DataFrame) -> DataFrame:
    """Records with an alternative, in the fixed order of its kinds."""
    return records.where((F.col("alternative.kind") != "none-identified") & (F.col("behaviour") != "data")).withColumn("rank", rank(F.col("alternative.kind"), dims.ALTERNATIVES))


def load_paths(sites: DataFrame, contexts: DataFrame) -> DataFrame:
    """(file, sites, artifacts, environment, privileged): loading files."""
    return sites.groupBy("file").agg(F.count("*").alias("sites"), F.count_distinct("artifact_id").alias("artifacts")).join(contexts.select("file", "environment", "privileged"), "file", "left")


def lookup(records: DataFrame, term: str) -> DataFrame:
    """The record that a term means: by id, by locator, by the locator's end, by its last segment; the first that has one, of equals the smallest id."""
    wanted = F.lit(term)
    at = F.when(F.col("artifact_id").cast("string") == wanted, 0).when(F.col("locator") == wanted, 1).when(F.endswith("locator", wanted), 2).when(F.substring_index("locator", "/", -1) == wanted, 3)
    return records.withColumn("_at", at).where("_at is not null").orderBy("_at", "artifact_id").limit(1).drop("_at")


def top(records: DataFrame, key: str, n: int) -> DataFrame:
    """The first n records of an order."""
    return records.orderBy(*order_by(key)).limit(n)


def boundary(records: DataFrame) -> DataFrame:
    """(artifact_id, terminal): the gravest disposition of a record's findings, record without any."""
    worst = F.array_min(F.transform(finding_cells(records), lambda f: rank(f["disposition"], dims.DISPOSITIONS)))
    return records.select("artifact_id", F.coalesce(F.get(F.array(*[F.lit(d) for d in dims.DISPOSITIONS]), worst), F.lit("record")).alias("terminal"))


def boundary_rows(records: DataFrame, n: int = 9) -> DataFrame:
    """(artifact_id, terminal, at, stage, state): the six cells and the terminal of the first n records of the shown order."""
    first = stored(top(records, "display", n))
    return boundary(first).join(stripe(first), "artifact_id")


def path_rows(sites: DataFrame, records: DataFrame) -> DataFrame:
    """(file, enclosing, loader, artifact_id, locator, behaviour): each load from its file to what loading does."""
    enclosing = F.col("enclosing") if "enclosing" in sites.columns else F.lit(None).cast("string")
    return sites.select("file", enclosing.alias("enclosing"), "loader", "artifact_id", "verdict.behaviour").join(records.select("artifact_id", "locator"), "artifact_id", "left")


def path_order() -> list[Column]:
    """Order of loading files: those of privileged contexts first, then by path."""
    return [F.coalesce("privileged", F.lit(False)).desc(), F.col("file").asc()]


def subjects(findings: DataFrame, records: DataFrame) -> DataFrame:
    """Findings with what they are about: locator, format and behaviour of the record."""
    return findings.join(records.select("artifact_id", "locator", "format", "behaviour"), "artifact_id", "left")


def visible(bill: DataFrame, records: DataFrame, filters: Filters) -> DataFrame:
    """Rows of a bill whose record passes the filters."""
    return bill.join(apply_filters(records, filters).select("artifact_id"), "artifact_id", "left_semi")


def compared(records: DataFrame) -> DataFrame:
    """(artifact_id, format, label, intrinsic, target, target_label, target_intrinsic): each migration's format beside the one it leads to."""
    rows = records.where("alternative.target is not null").select("artifact_id", "format", F.col("alternative.target").alias("target"))
    of = lambda c, values: mapped(F.col(c), values, "")
    return rows.select("artifact_id", "format", of("format", dims.LABELS).alias("label"), of("format", dims.INTRINSIC).alias("intrinsic"), "target", of("target", dims.LABELS).alias("target_label"), of("target", dims.INTRINSIC).alias("target_intrinsic"))


def commands(items: DataFrame, query: str, most: int = 60) -> DataFrame:
    """The first commands (group, label, hint, place) that have every word of the query."""
    text = F.lower(F.concat_ws(" ", "group", "label", "hint"))
    for term in query.lower().split():
        items = items.where(F.contains(text, F.lit(term)))
    return items.orderBy("place").limit(most)


def toggled_sort(key: str, descending: bool, wanted: str) -> tuple[str, bool]:
    """The order after one is asked for: the same one turns round, another begins upwards."""
    return (key, not descending) if key == wanted else (wanted, False)
