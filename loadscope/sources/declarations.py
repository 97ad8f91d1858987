"""Skills, agents, prompts and hooks: files that declare what an agent loads."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loadscope.functions.text import clip, sanitise, stem
from loadscope.sources.documents import RESERVED, fields, line_of, mcp_servers, nodes, string_at

#: Lines of frontmatter, placeholders and scripts that are kept.
MOST_FRONT, MOST_PLACEHOLDERS, MOST_SCRIPTS = 400, 12, 12
#: Levels below an event in which hook commands are looked for.
DEEPEST_HOOK = 6
# Declarations by path, the first that fits.
KINDS = [
    ("mcp", r"(^|/)\.?mcp\.json\z|(^|/)claude_desktop_config\.json\z"),
    ("settings", r"(^|/)settings(\.local)?\.json\z"),
    ("skill", r"(^|/)SKILL\.md\z"),
    ("agent", r"(^|/)agents/[^/]+\.md\z"),
    ("prompt", r"(^|/)prompts/.*\.(md|txt|jinja|j2|prompt)\z"),
]


def kind_of(files: DataFrame) -> DataFrame:
    out = None
    for name, pattern in KINDS:
        c = F.col("path").rlike(pattern)
        out = F.when(c, name) if out is None else out.when(c, name)
    return files.withColumn("kind", out).where("kind is not null")


FRONT = r"\A---[ \t]*\r?\n([\s\S]*?)(?:\r?\n)?---[ \t]*(?:\r?\n|\z)"


def frontmatter(files: DataFrame) -> DataFrame:
    """files (path, text, ...) with `fields`, a map of single values, `lists`, a map of lists, and `body`, what follows the block.

    The block stands between dashes, 400 lines at most. A key is lower-cased; `key: value` is a field, `key: [a, "b, c"]` a
    list, and a key without a value opens a list of the `- item` lines that follow it, however
    many lines stand between. A key twice: the last counts. Reserved keys are none. Files
    without a block have no keys, and all of their text is body.
    """
    lines = F.slice(F.split(F.regexp_extract("text", FRONT, 1), "\r?\n"), 1, MOST_FRONT)
    rows = files.where(F.col("text").rlike(FRONT)).select("path", F.posexplode(lines).alias("n", "line"))
    part = lambda k: F.regexp_extract("line", r"^([A-Za-z_][\w.-]*)\s*:\s*(.*)$", k)
    item = F.regexp_extract("line", r"^\s*-\s+(.*)$", 1)
    unquoted = lambda c: F.regexp_replace(F.btrim(c), r"^(['\"])(.*)\1\z", "$2")
    key = F.lower(part(1))
    is_pair = (key != "") & ~key.isin(*RESERVED)
    rows = rows.withColumn("pair", F.when(is_pair, F.struct(F.col("n").alias("at"), key.alias("key"), F.btrim(part(2)).alias("value"))))
    # the last key carried forward over the lines of a file, which are few
    rows = rows.withColumn("last", F.last("pair", ignorenulls=True).over(Window.partitionBy("path").orderBy("n").rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    value = F.col("last.value")
    inline = F.regexp_extract(value, r"^\[(.*)\]\z", 1)
    pieces = F.filter(F.transform(F.regexp_extract_all(inline, F.lit(r"\s*(\"[^\"]*\"|'[^']*'|[^,]+)"), F.lit(1)), unquoted), lambda x: x != "")
    listed = value.rlike(r"^\[.*\]\z")
    runs = rows.where("last is not null").groupBy("path", "last.key", "last.at").agg(
        F.max(F.when(F.col("pair").isNotNull() & (value != "") & ~listed, clip(sanitise(unquoted(value)), 400))).alias("field"),
        F.max(F.when(F.col("pair").isNotNull() & listed, pieces)).alias("inline"),
        F.array_sort(F.collect_list(F.when(F.col("pair").isNull() & (value == "") & F.col("line").rlike(r"^\s*-\s+"), F.struct("n", unquoted(item).alias("item"))))).alias("block"),
        F.max(value == "").alias("opens"),
    )
    items = F.when(F.col("opens"), F.transform("block", lambda x: x["item"])).otherwise(F.col("inline"))
    is_list = F.col("field").isNull()
    latest = runs.groupBy("path", "key", is_list.alias("many")).agg(F.max_by(F.struct("field", items.alias("items")), "at").alias("v"))
    entry = lambda many, name: F.map_from_entries(F.collect_list(F.when(F.col("many") == many, F.struct("key", F.col(f"v.{name}").alias(name)))))
    made = latest.groupBy("path").agg(entry(False, "field").alias("fields"), entry(True, "items").alias("lists"))
    nothing = F.create_map()
    return files.join(made, "path", "left").withColumns({
        "fields": F.coalesce("fields", nothing.cast("map<string,string>")), "lists": F.coalesce("lists", nothing.cast("map<string,array<string>>")), "body": F.regexp_replace("text", FRONT, ""),
    })


def hooks(files: DataFrame) -> DataFrame:
    """(path, line, event, command) of the hooks of settings files (path, text): commands under any key, six levels below their event."""
    root = files.select("path", "text", F.explode(fields(F.try_variant_get(F.try_parse_json("text"), "$.hooks", "variant"))).alias("e"))
    rows = root.select("path", line_of(F.col("text"), F.col("e.key")).alias("line"), F.col("e.key").alias("event"), F.col("e.value").alias("value"))
    return nodes(rows, DEEPEST_HOOK).select("path", "line", "event", F.when(fields(F.col("value")).isNotNull(), string_at(F.col("value"), "$.command")).alias("command")).where("command is not null")


def granted(key: str):
    """The tools of a key, as a list or as words between commas."""
    words = F.filter(F.split(F.coalesce(F.col("fields")[key], F.lit("")), r"\s*,\s*"), lambda t: t != "")
    return F.concat(F.coalesce(F.col("lists")[key], F.array().cast("array<string>")), words)


def declarations(files: DataFrame) -> DataFrame:
    """(artifact_id, path, line, format, behaviour, name, origin, facts, note) of declaration files (path, text); note says where a grant reaches every tool."""
    known = kind_of(files)
    none = F.array().cast("array<string>")
    texts = frontmatter(known.where(F.col("kind").isin("skill", "agent", "prompt")))
    name = F.coalesce(F.nullif(F.col("fields")["name"], F.lit("")), F.when(F.col("kind") == "skill", F.element_at(F.split("path", "/"), -2)).otherwise(stem(F.col("path"))))
    scripts = F.slice(F.array_sort(F.array_distinct(F.regexp_extract_all("body", F.lit(r"([A-Za-z0-9_./-]+\.(?:py|sh|js|ts|rb))\b"), F.lit(1)))), 1, MOST_SCRIPTS)
    placeholders = F.slice(F.array_distinct(F.regexp_extract_all("body", F.lit(r"\{\{?\s*([A-Za-z_][A-Za-z0-9_.]*)\s*\}?\}"), F.lit(1))), 1, MOST_PLACEHOLDERS)
    tools = F.array_distinct(F.concat(granted("allowed-tools"), granted("tools")))
    facts = F.when(F.col("kind") == "skill", F.concat(tools, scripts)).when(F.col("kind") == "agent", tools).otherwise(placeholders)
    form = F.when(F.col("kind") == "skill", "agent-skill").when(F.col("kind") == "agent", "agent-definition").otherwise("prompt-template")
    note = F.when(F.col("kind").isin("skill", "agent") & F.array_contains(tools, "*"), "the tool grant is *: every tool of the host")
    written = texts.select(F.concat_ws(":", "kind", name).alias("artifact_id"), "path", F.lit(1).alias("line"), form.alias("format"), F.lit("directive").alias("behaviour"), clip(name, 120).alias("name"), F.lit("in-tree").alias("origin"), facts.alias("facts"), note.alias("note"))
    said = F.array_compact(F.array(F.nullif(F.concat_ws(" ", "command", F.when(F.col("command").isNotNull(), F.col("args"))), F.lit("")), F.col("url"), F.when(F.size("variables") > 0, F.concat(F.lit("passes "), F.array_join("variables", ", ")))))
    servers = mcp_servers(known.where("kind = 'mcp'")).select(F.concat(F.lit("mcp:"), F.col("name")).alias("artifact_id"), "path", "line", F.lit("mcp-server-manifest").alias("format"), "behaviour", "name", "origin", said.alias("facts"), F.lit(None).cast("string").alias("note"))
    run = hooks(known.where("kind = 'settings'"))
    run = run.select(F.concat_ws(":", F.lit("hook"), "event", F.left("command", F.lit(40))).alias("artifact_id"), "path", "line", F.lit("agent-definition").alias("format"), F.lit("code").alias("behaviour"), F.col("event").alias("name"), F.lit("in-tree").alias("origin"), F.array("command").alias("facts"), F.lit(None).cast("string").alias("note"))
    return written.unionByName(servers).unionByName(run).withColumn("facts", F.coalesce("facts", none))
