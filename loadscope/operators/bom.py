"""The bill of materials: a flat row for each record, its digest, and how it is written."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loadscope.functions.text import csv_cell, padded
from loadscope.operators.columns import mapped
from loadscope.operators.records import finding_cells
from loadscope.plans import dims

DEEPEST = 256


def rows(records: DataFrame) -> DataFrame:
    """The flat projection of records; lists are sorted and distinct."""
    sorted_ = lambda c: F.array_join(F.array_sort(F.array_distinct(c)), ",")
    return records.select(
        "artifact_id", "locator", "origin", "format", mapped(F.col("format"), dims.LABELS, "").alias("label"), "basis", "digest", "behaviour", F.col("verdict.guard").alias("guard"),
        F.col("verdict.reason").alias("reason"), "sites", sorted_("environments").alias("environments"), "privileged", sorted_("bindings").alias("evidence"), F.col("alternative.kind").alias("alternative"),
        sorted_("privileges").alias("privileges"), sorted_(F.transform(finding_cells(records), lambda f: f["kind"])).alias("findings"),
    )


def canonical_json(value: Any, depth: int = 0) -> str:
    """Keys sorted, no white space, nothing that JSON lacks; too deep raises."""
    if depth > DEEPEST:
        raise ValueError(f"deeper than {DEEPEST} levels")
    if isinstance(value, dict):
        return "{" + ",".join(f"{json.dumps(str(k), ensure_ascii=False)}:{canonical_json(value[k], depth + 1)}" for k in sorted(value, key=str)) + "}"
    if isinstance(value, list | tuple):
        return "[" + ",".join(canonical_json(x, depth + 1) for x in value) + "]"
    if isinstance(value, float) and (value != value or value in (float("inf"), float("-inf"))):
        return "null"
    if isinstance(value, float) and value.is_integer() and abs(value) < 2**53:
        value = int(value)
    return json.dumps(value, ensure_ascii=False)


def row_digests(bom: DataFrame) -> DataFrame:
    """(artifact_id, digest) of each row's canonical JSON."""

    @F.pandas_udf("string")
    def digest(rows: pd.DataFrame) -> pd.Series:
        plain = rows.astype(object).where(rows.notna(), None).to_dict("records")
        return pd.Series([hashlib.sha256(canonical_json({k: v.item() if hasattr(v, "item") else v for k, v in r.items()}).encode()).hexdigest() for r in plain], dtype=object)

    return bom.select("artifact_id", digest(F.struct(*bom.columns)).alias("row_digest"))


#: Leading hex digits by which row digests are first gathered; each further fold takes one digit away.
FOLDED = 5


def digest(bom: DataFrame) -> str:
    """One digest of a whole bill: a tree over its rows' digests in order, with a leaf for each FOLDED leading digits and sixteen branches above.

    A leaf holds about a millionth of the rows, and neither rows nor leaves reach the driver.
    """
    parts = row_digests(bom).select(F.left("row_digest", F.lit(FOLDED)).alias("part"), F.col("row_digest").alias("d"))
    for n in range(FOLDED, -1, -1):
        parts = parts.groupBy("part").agg(F.sha2(F.array_join(F.array_sort(F.collect_list("d")), ""), 256).alias("d")).select(F.left("part", F.lit(max(0, n - 1))).alias("part"), F.concat("part", "d").alias("d"))
    row = parts.first()
    return row["d"] if row else hashlib.sha256(b"").hexdigest()


def document(bom: DataFrame, summary: dict[str, Any], project: str) -> Iterator[str]:
    """The lines of a JSON document of a bill: project, summary, digest and entries in order of id, each as it arrives."""
    head = {"schema": "loadscope/bill/1", "project": project, "summary": summary, "digest": digest(bom)}
    yield canonical_json(head)[:-1] + ',"entries":['
    first = True
    for row in bom.orderBy("artifact_id").toLocalIterator():
        yield ("" if first else ",") + canonical_json(row.asDict(recursive=True))
        first = False
    yield "]}"


def cyclonedx_document(bom: DataFrame, project: str) -> Iterator[str]:
    """The lines of a CycloneDX 1.6 document of a bill."""
    yield '{"bomFormat":"CycloneDX","specVersion":"1.6","version":1,"metadata":{"component":{"type":"application","name":' + json.dumps(project) + '}},"components":['
    first = True
    for row in cyclonedx(bom).orderBy("artifact_id").toLocalIterator():
        yield ("" if first else ",") + row["component"]
        first = False
    yield "]}"


def csv_lines(bom: DataFrame) -> Column:
    return F.concat_ws(",", *[csv_cell(F.col(c)) for c in bom.columns])


#: Forms whose every line stands by itself.
SPREAD = {"lines": lambda bom: F.to_json(F.struct(*bom.columns)), "csv": csv_lines}


def spread(bom: DataFrame, form: str) -> DataFrame:
    """A bill's lines as rows (value) in order of id over many partitions, to be written by tasks."""
    return bom.repartitionByRange("artifact_id").sortWithinPartitions("artifact_id").select(SPREAD[form](bom).alias("value"))


def text_lines(bom: DataFrame) -> DataFrame:
    """(artifact_id, line): aligned by the longest locator."""
    width = bom.agg(F.max(F.length("locator")).alias("width"))
    line = F.concat_ws("  ", padded(F.col("behaviour"), F.lit(9)), padded(F.col("locator"), F.col("width")), F.col("label"))
    return bom.crossJoin(F.broadcast(width)).select("artifact_id", line.alias("line"))


def cyclonedx(bom: DataFrame) -> DataFrame:
    """(artifact_id, component): a CycloneDX 1.6 component of each row, as JSON."""
    model = ~F.col("format").isin("mcp-server-manifest", "agent-skill", "agent-definition", "prompt-template")
    property_ = lambda name, c: F.struct(F.lit(f"load:{name}").alias("name"), F.col(c).cast("string").alias("value"))
    hashes = F.when(F.col("digest").isNotNull(), F.array(F.struct(F.lit("SHA-256").alias("alg"), F.col("digest").alias("content"))))
    component = F.struct(
        F.when(model, "machine-learning-model").otherwise("data").alias("type"), F.col("artifact_id").cast("string").alias("bom-ref"), F.col("locator").alias("name"), hashes.alias("hashes"),
        F.array(property_("behaviour", "behaviour"), property_("format", "format"), property_("environments", "environments"), property_("alternative", "alternative")).alias("properties"),
    )
    return bom.select("artifact_id", F.to_json(component).alias("component"))
