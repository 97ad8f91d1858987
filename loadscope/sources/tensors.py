"""The header of a safetensors file as relations: its tensors, its metadata, and what is wrong with it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loadscope.functions.text import clip, sanitise
from loadscope.sources.documents import fields, string_at

# Bytes of a header at most, and characters of a name and of a value of its metadata.
MOST_HEADER, MOST_NAME, MOST_VALUE = 16 << 20, 200, 256
STATES = ("none", "oversize", "truncated", "broken", "whole")


def _length(head: Column) -> Column:
    """The first eight bytes as a little-endian number; null if it has more than 63 bits or there are fewer bytes."""
    pairs = F.regexp_extract_all(F.hex(F.substring(head, 1, 8)), F.lit("(..)"), F.lit(1))
    digits = F.array_join(F.reverse(pairs), "")
    return F.when((F.size(pairs) == 8) & (digits < "8"), F.conv(digits, 16, 10).cast("long"))


def headers(files: DataFrame) -> DataFrame:
    """files (path, size, head, ...) with header_bytes, state and header (a variant).

    head is a file's first bytes, as many as were read. state is none (no such header, or one longer than its file), oversize (a
    header over MOST_HEADER), truncated (longer than what was read), broken (not a JSON object) or whole; only the last
    has a header.
    """
    n = _length(F.col("head"))
    likely = (n > 1) & (F.octet_length("head") >= 9) & (n + 8 <= F.col("size")) & (F.hex(F.substring("head", 9, 1)) == "7B")
    rows = files.withColumn("header_bytes", F.when(likely, n))
    # only what the header's length allows is decoded
    text = F.when(F.col("header_bytes") <= F.least(F.lit(MOST_HEADER).cast("long"), F.octet_length("head") - 8), F.expr("substring(head, 9, int(header_bytes))").cast("string"))
    rows = rows.withColumn("header", F.try_parse_json(text))
    state = F.when(F.col("header_bytes").isNull(), "none").when(F.col("header_bytes") > MOST_HEADER, "oversize").when(F.col("header_bytes") > F.octet_length("head") - 8, "truncated").when(fields(F.col("header")).isNull(), "broken").otherwise("whole")
    return rows.withColumn("state", state).withColumn("header", F.when(F.col("state") == "whole", F.col("header")))


def tensors(found: DataFrame) -> DataFrame:
    """(path, name, dtype, shape, begin, end, problem), one for each tensor of headers.

    problem is shape (dtype, shape or offsets missing), outside (not within the file's data) or overlapping (it begins
    before one that stands before it ends); null if there is none. Tensors are sorted within one
    file, whose header is bounded.
    """
    entry = found.select("path", (F.col("size") - 8 - F.col("header_bytes")).alias("room"), F.explode(fields(F.col("header"))).alias("e")).where(F.col("e.key") != "__metadata__")
    v = F.col("e.value")
    listed = lambda p: F.try_variant_get(v, p, "array<bigint>")
    rows = entry.select("path", "room", clip(sanitise(F.col("e.key")), MOST_NAME).alias("name"), string_at(v, "$.dtype").alias("dtype"), listed("$.shape").alias("shape"), F.get(listed("$.data_offsets"), F.lit(0)).alias("begin"), F.get(listed("$.data_offsets"), F.lit(1)).alias("end"))
    before = Window.partitionBy("path").orderBy("begin", "end", "name").rowsBetween(Window.unboundedPreceding, -1)
    lacks = F.col("dtype").isNull() | F.col("shape").isNull() | F.col("begin").isNull() | F.col("end").isNull()
    outside = (F.col("begin") < 0) | (F.col("end") < F.col("begin")) | (F.col("end") > F.col("room"))
    covered = F.max(F.when(~lacks & ~outside, F.col("end"))).over(before)
    problem = F.when(lacks, "shape").when(outside, "outside").when(F.col("begin") < covered, "overlapping")
    return rows.withColumn("problem", problem).drop("room")


def metadata(found: DataFrame) -> DataFrame:
    """(path, name, value): the strings of headers' metadata, clipped and without control characters."""
    own = fields(F.try_variant_get("header", "$.__metadata__", "variant"))
    rows = found.select("path", F.explode(own).alias("e")).where(F.schema_of_variant("e.value") == "STRING")
    return rows.select("path", clip(sanitise(F.col("e.key")), MOST_NAME).alias("name"), clip(sanitise(F.try_variant_get("e.value", "$", "string")), MOST_VALUE).alias("value"))


def dtypes(rows: DataFrame) -> DataFrame:
    """(path, dtype, tensors, problems): how many of a file's tensors have each dtype."""
    return rows.groupBy("path", "dtype").agg(F.count("*").alias("tensors"), F.count("problem").alias("problems"))
