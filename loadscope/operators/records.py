"""The wide record of each artifact, and what follows from it: alternative, findings and stripe."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loadscope.functions.text import dirname, join_path, stem
from loadscope.operators import behaviour as B
from loadscope.operators.columns import first_match, firsts, mapped, rank, unsent
from loadscope.operators.evidence import BINDINGS, state
from loadscope.plans import dims


def build(artifacts: DataFrame, sites: DataFrame, contexts: DataFrame, evidence: DataFrame, order: list[str]) -> DataFrame:
    """One row for each artifact, with its headline verdict, environments, evidence and alternative.

    sites have verdicts; order breaks ties between them. Environments and privileges stand in
    the order of the first site with each, bindings in that of the evidence (seq). Sites meet their file's context and
    are then aggregated once, evidence likewise, so all joins to artifacts are one to one.
    """
    kinds = F.col("privileges") if "privileges" in contexts.columns else F.array().cast("array<string>")
    known = contexts.select("file", "environment", F.col("privileged").alias("reaches"), kinds.alias("kinds"))
    loaded = sites.where("artifact_id is not null").join(known, "file", "left").groupBy("artifact_id").agg(
        *B.headline_of(order), F.bool_or("reaches").alias("privileged"),
        firsts(dims.REACH, lambda e: F.col("environment") == e, F.struct(*order)).alias("environments"),
        firsts(list(dims.PRIVILEGE_LABELS), lambda p: F.array_contains("kinds", p), F.struct(*order)).alias("privileges"),
    )
    loaded = loaded.withColumnRenamed("verdict", "headline")
    proof = evidence.groupBy("artifact_id").agg(
        firsts(BINDINGS, lambda b: F.col("binding") == b, F.col("seq")).alias("bindings"), F.bool_or((F.col("binding") == "current") & (F.col("result") == "flagged")).alias("current_flagged"), F.count("*").alias("evidence"),
        *[F.count_if(F.col("binding") == b).alias(f"evidence_{b}") for b in BINDINGS],
    )
    rows = artifacts.join(unsent(loaded), "artifact_id", "left").join(unsent(proof), "artifact_id", "left")
    rows = rows.withColumn("verdict", F.coalesce("headline", B.dormant_verdict())).drop("headline")
    nothing = F.array().cast("array<string>")
    rows = rows.select(
        *artifacts.columns, "verdict", F.col("verdict.behaviour").alias("behaviour"), F.coalesce("sites", F.lit(0)).cast("long").alias("sites"), "first_loader", "guardable",
        F.coalesce("inconsistent", F.lit(False)).alias("inconsistent"), F.coalesce("environments", nothing).alias("environments"), F.coalesce("privileged", F.lit(False)).alias("privileged"), F.coalesce("privileges", nothing).alias("privileges"),
        F.coalesce("bindings", nothing).alias("bindings"), F.coalesce("current_flagged", F.lit(False)).alias("current_flagged"), F.coalesce("evidence", F.lit(0)).cast("long").alias("evidence"),
        *[F.coalesce(f"evidence_{b}", F.lit(0)).cast("long").alias(f"evidence_{b}") for b in BINDINGS],
    )
    rows = rows.withColumn("alternative", alternative(rows)).withColumn("evidence_state", state(F.col("bindings")))
    return rows.withColumn("migration", F.when(F.col("alternative.kind") != "none-identified", "available").otherwise("none"))


def alternative(records: DataFrame) -> Column:
    """(kind, target): the first way to lose the execution surface. A column siblings (array of locator and format) is optional."""
    made = lambda kind, target=None: F.struct(F.lit(kind).alias("kind"), (F.lit(None).cast("string") if target is None else target).alias("target"))
    sibling = F.get(F.filter("siblings", lambda s: s["format"].isin(dims.DATA_FORMATS)), F.lit(0))["format"] if "siblings" in records.columns else F.lit(None).cast("string")
    guarded = F.col("verdict.guard").isNotNull() & (F.col("behaviour") != "code")
    target = mapped(F.col("format"), {f: next(t for t in ts if t in dims.DATA_FORMATS) for f, ts in dims.CONVERTIBLE.items()})
    return first_match(
        (F.col("behaviour") == "data", made("none-identified")),
        (sibling.isNotNull(), made("sibling-present", sibling)),
        (F.col("guardable").isNotNull() & ~guarded, made("loader-guard-available")),
        (target.isNotNull(), made("conversion-available", target)),
    ).otherwise(made("none-identified"))


def change(records: DataFrame) -> Column:
    """What an alternative asks for, in words; null where there is none.

    A guard is named with the loader, a conversion with the path it would be written to; of a
    declaration it is said that its format isn't what bounds it.
    """
    folder, base = dirname(F.col("locator")), stem(F.col("locator"))
    target, kind = F.col("alternative.target"), F.col("alternative.kind")
    written = F.concat(join_path(folder, base), F.lit("."), target)
    return first_match(
        (kind == "sibling-present", F.concat(F.lit("load the "), target, F.lit(" file beside it"))),
        (kind == "loader-guard-available", F.concat(F.lit("pass "), mapped(F.col("guardable"), dims.GUARDS), F.lit(" to "), F.col("guardable"))),
        (kind == "conversion-available", F.concat(F.lit("load "), F.col("locator"), F.lit(" once where nothing is at stake and write "), written)),
        (F.col("format") == "mcp-server-manifest", F.lit("pin the server and narrow what it may reach")),
        (F.col("behaviour") == "directive", F.lit("narrow what it is granted")),
    )


def finding_cells(records: DataFrame) -> Column:
    """An array of the (kind, disposition) of a record's findings."""
    b, reason, kind = F.col("behaviour"), F.col("verdict.reason"), F.col("alternative.kind")
    code = b == "code"
    matters = F.arrays_overlap("environments", F.array(*[F.lit(e) for e in dims.MATTERING]))
    notable = F.col("notable") if "notable" in records.columns else F.lit(False)
    rules = [
        ("privileged-execution-surface", "act", code & F.col("privileged")),
        ("execution-surface", "act", code & ~F.col("privileged") & matters),
        ("execution-surface", "review", code & ~F.col("privileged") & ~matters),
        ("pickle-notable-callable", "review", code & notable),
        ("unpinned-loader-default", "act", reason == "loader-default-unpinned"),
        ("remote-code-trust", "review", code & F.col("first_loader").isin(dims.REMOTE_CODE_LOADERS)),
        ("spawns-process-on-load", "review", code & (F.col("format") == "mcp-server-manifest")),
        ("directive-surface", "record", b == "directive"),
        ("inconsistent-guard", "act", F.col("inconsistent")),
        ("shadowed-safe-format", "act", kind == "sibling-present"),
        ("format-migration-available", "act", code & (kind == "loader-guard-available")),
        ("format-migration-available", "review", code & (kind == "conversion-available")),
        ("evidence-stale", "review", F.array_contains("bindings", "stale")),
        ("evidence-absent", "record", (F.col("evidence") == 0) & (code | F.coalesce(reason == "loader-default-unpinned", F.lit(False))) & (F.col("origin") == "in-tree")),
        ("unresolved-artifact", "review", reason.isin("path-not-static", "artifact-unresolved", "remote-contents-unresolvable", "format-undetermined")),
        ("unresolved-context", "review", F.array_contains("environments", "unresolved") & (b != "data")),
        ("extension-mismatch", "review", F.col("mismatch")),
    ]
    return F.filter(F.array(*[F.when(c, F.struct(F.lit(k).alias("kind"), F.lit(d).alias("disposition"))) for k, d, c in rules]), lambda f: f.isNotNull())


def findings(records: DataFrame) -> DataFrame:
    """(id, artifact_id, kind, disposition): every finding of every record."""
    rows = records.select("artifact_id", F.explode(finding_cells(records)).alias("f"))
    return rows.select(F.concat_ws(":", "f.kind", F.col("artifact_id").cast("string")).alias("id"), "artifact_id", "f.kind", "f.disposition")


def finding_rank() -> list[Column]:
    """Order keys of findings: disposition, family, id."""
    families = {k: dims.FAMILIES.index(f) for k, f in dims.FINDINGS.items()}
    return [rank(F.col("disposition"), dims.DISPOSITIONS), mapped(F.col("kind"), families, len(dims.FAMILIES)), F.col("id")]


def stripe(records: DataFrame) -> DataFrame:
    """(artifact_id, at, stage, state): six cells of each record."""
    b, fmt = F.col("behaviour"), F.col("format")
    none = F.size("environments") == 0
    lost = F.size(F.filter("environments", lambda e: e != "unresolved")) == 0
    said = lambda *cases: first_match(*[(c, F.lit(s)) for c, s in cases]).otherwise("resolved")
    current = F.array_contains("bindings", "current")
    cells = [
        said((fmt == "unknown", "unresolved"), (F.col("mismatch"), "flagged"), (F.col("basis") == "extension", "unresolved")),
        said((F.col("sites") == 0, "unresolved")),
        said((b.isin("code", "directive"), "flagged"), (b == "unknown", "unresolved")),
        said((none | lost, "unresolved"), (F.col("privileged"), "flagged")),
        said((F.array_contains("bindings", "stale") | F.col("current_flagged"), "flagged"), (~current, "unresolved")),
        said((F.col("alternative.kind") != "none-identified", "flagged"), (b != "data", "unresolved")),
    ]
    return records.select("artifact_id", F.posexplode(F.array(*[F.struct(F.lit(s).alias("stage"), c.alias("state")) for s, c in zip(dims.STAGES, cells, strict=True)])).alias("at", "c")).select("artifact_id", "at", "c.stage", "c.state")
