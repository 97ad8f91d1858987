"""JSON documents that tools leave: MCP manifests, hooks, evidence reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Records of a report that are read.
MOST_RECORDS = 5000
RESULTS = ("pass", "flagged", "error", "skipped")


# Keys that a document's objects never have, at any level, and how deep documents are read.
RESERVED = ("__proto__", "constructor", "prototype")
DEEPEST = 32


def fields(value: Column) -> Column:
    """The entries (key, value) of a variant that is an object, without reserved keys; null for others."""
    known = F.map_filter(F.try_variant_get(value, "$", "map<string,variant>"), lambda k, _: ~k.isin(*RESERVED))
    return F.map_entries(known)


def nodes(rows: DataFrame, deepest: int = DEEPEST) -> DataFrame:
    """rows (..., value: variant) with depth: each value itself at depth 0, then what its objects and lists hold, level by level.

    A round opens one level; what has been opened passes through, so each value is opened once.
    Reserved keys aren't entered, nor anything below the deepest level. A null value gives itself.
    """
    own = [c for c in rows.columns if c != "value"]
    out = rows.select(*own, F.lit(0).alias("depth"), F.lit(False).alias("opened"), "value")
    made = lambda depth, opened, value: F.struct(depth.alias("depth"), F.lit(opened).alias("opened"), value.alias("value"))
    for _ in range(deepest):
        this = F.array(made(F.col("depth"), True, F.col("value")))
        held = F.coalesce(F.transform(fields(F.col("value")), lambda e: e["value"]), F.try_variant_get("value", "$", "array<variant>"))
        below = F.transform(held, lambda v: made(F.col("depth") + 1, False, v))
        out = out.select(*own, F.explode(F.when(F.col("opened") | below.isNull(), this).otherwise(F.concat(this, below))).alias("n")).select(*own, "n.*")
    return out.drop("opened")


def string_at(value: Column, path: str) -> Column:
    """A string at a path of a variant; null if something else is there."""
    return F.when(F.schema_of_variant(F.try_variant_get(value, path, "variant")) == "STRING", F.try_variant_get(value, path, "string"))


def line_of(text: Column, key: Column) -> Column:
    """The line on which a key first stands in quotes, 1 if nowhere."""
    at = F.position(F.concat(F.lit('"'), key, F.lit('"')), text)
    return F.when(at > 0, F.size(F.split(F.substring(text, F.lit(1), at), "\n"))).otherwise(1)


def json_text(column: Column, path: str) -> Column:
    """A string at a path, or null if the document isn't JSON or has none there.

    The parser stops at the end of the first value; what stands after that shows once the
    document is put into an array and into an object.
    """
    within = lambda a, b: F.try_parse_json(F.concat(F.lit(a), column, F.lit(b))).isNotNull()
    return F.when(within("[", "]") & within('{"x":', "}"), F.try_variant_get(F.try_parse_json(column), path, "string"))


def _result(column: Column) -> Column:
    return F.when(column.isin(*RESULTS), column).otherwise("error")


def mcp_servers(files: DataFrame) -> DataFrame:
    """(path, line, name, behaviour, origin, command, args, url, transport, variables): servers of MCP manifests (path, text); one with a command runs code here.

    Entries that aren't objects are none; line is where the entry's name first stands in the text.
    """
    root = files.select("path", "text", F.try_parse_json("text").alias("d"))
    block = F.coalesce(*[F.try_variant_get("d", f"$.{k}", "variant") for k in ("mcpServers", "servers")])
    rows = root.select("path", "text", F.explode(fields(block)).alias("e")).select("path", "text", F.col("e.key").alias("name"), F.col("e.value").alias("s")).where(fields(F.col("s")).isNotNull())
    s = F.col("s")
    given = F.coalesce(F.try_variant_get(s, "$.args", "array<variant>"), F.array().cast("array<variant>"))
    args = F.transform(F.filter(given, lambda v: F.schema_of_variant(v) == "STRING"), lambda v: F.try_variant_get(v, "$", "string"))
    command = string_at(s, "$.command")
    local = command.isNotNull()
    return rows.select(
        "path", line_of(F.col("text"), F.col("name")).alias("line"), "name", F.when(local, "code").otherwise("directive").alias("behaviour"), F.when(local, "in-tree").otherwise("remote-reference").alias("origin"), command.alias("command"), args.alias("args"),
        F.coalesce(string_at(s, "$.url"), string_at(s, "$.endpoint")).alias("url"), F.coalesce(string_at(s, "$.type"), string_at(s, "$.transport")).alias("transport"), F.transform(fields(F.try_variant_get(s, "$.env", "variant")), lambda e: e["key"]).alias("variables"),
    )


def native_evidence(files: DataFrame) -> DataFrame:
    """(source, scanner, subject, subject_digest, result, detail) of native reports (path, text)."""
    kind = "struct<records:array<struct<scanner:string,version:string,subject:string,sha256:string,result:string,detail:string>>>"
    rows = files.select(F.col("path").alias("source"), F.explode(F.slice(F.from_json("text", kind)["records"], 1, MOST_RECORDS)).alias("r"))
    return rows.where("r.subject is not null").select("source", F.coalesce("r.scanner", F.lit("generic")).alias("scanner"), "r.subject", F.col("r.sha256").alias("subject_digest"), _result(F.col("r.result")).alias("result"), "r.detail")


def modelscan_evidence(files: DataFrame) -> DataFrame:
    """The same of ModelScan reports: scanned files pass unless an issue names them, skipped ones are skipped, other issues' files are flagged."""
    kind = "struct<summary:struct<scanned:struct<scanned_files:array<string>>,skipped:struct<skipped_files:array<string>>>,issues:array<struct<source:string,description:string>>>"
    d = files.select(F.col("path").alias("source"), F.from_json("text", kind).alias("d"))
    issues = d.select("source", F.explode("d.issues").alias("i")).groupBy("source", F.col("i.source").alias("subject")).agg(F.min("i.description").alias("detail"))
    named = lambda c: F.coalesce(F.get_json_object(c, "$.source"), c)
    scanned = d.select("source", F.explode("d.summary.scanned.scanned_files").alias("subject"))
    skipped = d.select("source", F.explode("d.summary.skipped.skipped_files").alias("s")).select("source", named(F.col("s")).alias("subject"), F.lit("skipped").alias("result"), F.lit(None).cast("string").alias("detail"))
    listed = scanned.join(issues, ["source", "subject"], "left").select("source", "subject", F.when(F.col("detail").isNotNull(), "flagged").otherwise("pass").alias("result"), "detail")
    unlisted = issues.join(scanned, ["source", "subject"], "left_anti").select("source", "subject", F.lit("flagged").alias("result"), "detail")
    every = listed.unionByName(skipped).unionByName(unlisted)
    return every.select("source", F.lit("modelscan").alias("scanner"), "subject", F.lit(None).cast("string").alias("subject_digest"), "result", "detail")


def picklescan_evidence(files: DataFrame) -> DataFrame:
    """The same of picklescan reports: flagged if called dangerous or if any global is named."""
    entry = "struct<file:string,path:string,globals:array<string>,safety:string,dangerous:boolean,sha256:string>"
    d = files.select(F.col("path").alias("source"), F.from_json("text", f"struct<results:array<{entry}>,scans:array<{entry}>>").alias("d"))
    rows = d.select("source", F.explode(F.slice(F.coalesce("d.results", "d.scans"), 1, MOST_RECORDS)).alias("r"))
    flagged = F.coalesce(F.col("r.safety") == "dangerous", F.lit(False)) | F.coalesce("r.dangerous", F.lit(False)) | (F.coalesce(F.size("r.globals"), F.lit(0)) > 0)
    return rows.select("source", F.lit("picklescan").alias("scanner"), F.coalesce("r.file", "r.path").alias("subject"), F.col("r.sha256").alias("subject_digest"), F.when(flagged, "flagged").otherwise("pass").alias("result"), F.lit(None).cast("string").alias("detail")).where("subject is not null")


def evidence(files: DataFrame) -> DataFrame:
    """Records of all reports, each read by its document's shape."""
    has = lambda key: F.get_json_object("text", f"$.{key}").isNotNull()
    native, modelscan = has("records"), has("summary") | has("issues")
    return native_evidence(files.where(native)).unionByName(modelscan_evidence(files.where(~native & modelscan))).unionByName(picklescan_evidence(files.where(~native & ~modelscan)))
