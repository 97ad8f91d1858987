"""Dependency manifests besides requirement lists: TOML and JSON projects, locks, conda environments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loadscope.functions.versions import normalise_name
from loadscope.operators.deps import LOCK, OTHER, REQUIREMENTS, requirement, requirement_lines
from loadscope.operators.numbering import numbered

# Manifests by their file's name, the first that fits.
KINDS = [
    ("requirements", r"(^|/)(requirements|constraints)[^/]*\.(txt|in)\z"),
    ("pyproject", r"(^|/)pyproject\.toml\z"),
    ("toml-lock", r"(^|/)(poetry|uv|pdm)\.lock\z"),
    ("json-lock", r"(^|/)Pipfile\.lock\z"),
    ("package-json", r"(^|/)package\.json\z"),
    ("conda", r"(^|/)environment\.ya?ml\z"),
]
#: Larger manifests aren't read.
MOST_BYTES = 4 << 20


def kind(path: Column) -> Column:
    out = None
    for name, pattern in KINDS:
        out = F.when(path.rlike(pattern), name) if out is None else out.when(path.rlike(pattern), name)
    return out


def _lines(files: DataFrame) -> DataFrame:
    return files.select(F.col("path").alias("source"), F.posexplode(F.split("text", "\r?\n")).alias("seq", "line"))


def _latest(value: Column) -> Column:
    """The last value that isn't null, up to this line."""
    return F.last(value, ignorenulls=True).over(Window.partitionBy("source").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow))


def toml_lock(files: DataFrame) -> DataFrame:
    """Packages of TOML locks: a name, then its version."""
    at = lambda key: F.regexp_extract("line", rf'^\s*{key}\s*=\s*"([^"]+)"', 1)
    opened = F.when(F.col("line").rlike(r"^\s*\[\["), F.lit(""))
    rows = _lines(files).withColumn("name", _latest(F.coalesce(F.nullif(at("name"), F.lit("")), opened))).withColumn("version", at("version"))
    return rows.where("version <> '' and name <> ''").select("source", "seq", normalise_name(F.col("name")).alias("name"), F.concat(F.lit("=="), F.col("version")).alias("constraint"))


def pyproject(files: DataFrame) -> DataFrame:
    """Dependencies of [project], also over several lines, and of poetry's tables."""
    rows = _lines(files).withColumn("table", _latest(F.nullif(F.regexp_extract("line", r"^\s*\[+([^\]]+)\]", 1), F.lit(""))))
    opens = F.when(F.col("line").rlike(r"^\s*dependencies\s*=\s*\["), 1).when(F.col("line").rlike(r"^\s*([A-Za-z-]+\s*=|\[)"), 0)
    rows = rows.withColumn("inside", _latest(opens))
    items = rows.where("table = 'project' and inside = 1").select("source", "seq", F.explode(F.regexp_extract_all("line", F.lit("[\"']([^\"']+)[\"']"), F.lit(1))).alias("text"))
    name, constraint = requirement(F.col("text"))
    project = items.select("source", "seq", name.alias("name"), constraint.alias("constraint"))
    pair = lambda k: F.regexp_extract("line", r'^\s*"?([A-Za-z0-9._-]+)"?\s*=\s*(?:\{[^}]*version\s*=\s*)?"([^"]*)"', k)
    poetry = rows.where(r"table rlike '^tool\\.poetry\\.(group\\.[^.]+\\.)?(dev-)?dependencies$'").where(pair(1) != "").where(pair(1) != "python")
    return project.unionByName(poetry.select("source", "seq", normalise_name(pair(1)).alias("name"), pair(2).alias("constraint")))


def _from_maps(files: DataFrame, schema: str, sections: list[str], constraint) -> DataFrame:
    parsed = files.select(F.col("path").alias("source"), F.from_json("text", schema).alias("d"))
    maps = F.filter(F.array(*[F.map_entries(F.col("d").getItem(s)) for s in sections]), lambda m: m.isNotNull())
    rows = parsed.select("source", F.posexplode(F.flatten(maps)).alias("seq", "e"))
    return rows.select("source", "seq", normalise_name(F.substring_index("e.key", "/", -1)).alias("name"), constraint(F.col("e.value")).alias("constraint"))


def package_json(files: DataFrame) -> DataFrame:
    sections = ["dependencies", "devDependencies", "peerDependencies"]
    return _from_maps(files, "struct<" + ",".join(f"{s}:map<string,string>" for s in sections) + ">", sections, lambda v: v)


def json_lock(files: DataFrame) -> DataFrame:
    sections = ["default", "develop", "dependencies", "packages"]
    kind_ = "struct<" + ",".join(f"{s}:map<string,struct<version:string>>" for s in sections) + ">"
    return _from_maps(files, kind_, sections, lambda v: F.concat(F.lit("=="), F.regexp_replace(v["version"], "^=+", "")))


def conda(files: DataFrame) -> DataFrame:
    """Items of the dependencies list; one equals sign pins."""
    rows = _lines(files).withColumn("key", _latest(F.nullif(F.regexp_extract("line", r"^([A-Za-z]+):", 1), F.lit(""))))
    part = lambda k: F.regexp_extract("line", r"^\s*-\s*([A-Za-z0-9][A-Za-z0-9._-]*)\s*([^#\s]*)", k)
    rows = rows.where("key = 'dependencies'").where(part(1) != "").where(~F.col("line").rlike(r":\s*\z"))
    return rows.select("source", "seq", normalise_name(part(1)).alias("name"), F.regexp_replace(part(2), r"^=(?!=)", "==").alias("constraint"))


def declared(files: DataFrame) -> DataFrame:
    """(name, constraint, source, rank, seq) of all manifests among files (path, text), in the order they are read: by rank, then path, then line."""
    known = files.where(F.octet_length("text") <= MOST_BYTES).withColumn("kind", kind(F.col("path"))).where("kind is not null")
    readers = [("requirements", requirement_lines, REQUIREMENTS), ("pyproject", pyproject, OTHER), ("toml-lock", toml_lock, LOCK), ("json-lock", json_lock, LOCK), ("package-json", package_json, OTHER), ("conda", conda, OTHER)]
    every = None
    for name, read, rank in readers:
        rows = read(known.where(F.col("kind") == name)).withColumn("rank", F.lit(rank))
        every = rows if every is None else every.unionByName(rows)
    read = every.where("name is not null").withColumnRenamed("seq", "line")
    return numbered(read, ["rank", "source", "line", "name", "constraint"], "seq").select("name", "constraint", "source", "rank", "seq")


def project_name(files: DataFrame, otherwise: str | None) -> DataFrame:
    """One row, name: that of the root's pyproject, else of its package.json, else the given one."""
    root = files.where(F.col("path").isin("pyproject.toml", "package.json"))
    table = F.regexp_extract("text", r"(?m)^\[project\][^\[]*?^name\s*=\s*[\"']([^\"']+)[\"']", 1)
    name = F.when(F.col("path") == "pyproject.toml", F.nullif(table, F.lit(""))).otherwise(F.get_json_object("text", "$.name"))
    return root.withColumn("name", name).agg(F.coalesce(F.min_by("name", F.when(F.col("name").isNotNull(), F.when(F.col("path") == "pyproject.toml", 0).otherwise(1))), F.lit(otherwise)).alias("name"))
