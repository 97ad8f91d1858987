"""What the operators share: reading tables, cutting lineage, connected components."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loadscope.operators.shared import shared_dir

#: Values whose results are handed on together.
PIECE = 256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, partition_by: list[str] | None = None) -> DataFrame:
    """df written as Parquet to the shared folder and read again: lineage is cut and lost executors cost nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path, partitionBy=partition_by)
    return spark.read.schema(df.schema).parquet(path)


def each_value(column: Column, kind: str, arrow: pa.DataType, begin: Callable[[], Callable]) -> Column:
    """What begin() makes of each value of a column, as Spark's type `kind`, Arrow's `arrow`; begin is called once a task.

    Values leave Arrow's batch one at a time and results go on PIECE at a time, so a worker never
    holds a whole batch as Python's objects, and it returns a batch's memory when its task ends.
    """

    @F.arrow_udf(kind)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        of = begin()
        for batch in batches:
            for at in range(0, len(batch), PIECE):
                yield pa.array([of(x.as_py()) for x in batch.slice(at, PIECE)], arrow)
        batch = None  # its memory can go
        pa.default_memory_pool().release_unused()

    return run(column)


def text_of(name: str) -> Column:
    """A text column with null as the empty text."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def held_out(name: str, buckets: int, fold: int) -> Column:
    """True where crc32 of the id's decimal text falls into the fold; a null id is held out."""
    return F.coalesce(F.crc32(F.col(name).cast("string").cast("binary")) % buckets == fold, F.lit(True))


def labelled(docs: DataFrame, labels: DataFrame, label: str, doc_id: str, text: str, max_rows: int, max_bytes: int) -> DataFrame:
    """(key, y, text), stored: a sample of labelled rows, max_rows and max_bytes of text at most, whatever the tables' sizes.

    Rows are taken in the order of their id's hash; one that would exceed the bound of bytes is left out, whatever its place. A null
    id or label is none, and so is an id with two different labels; of rows that repeat an id
    the smallest text counts. Only ids and sizes reach the driver.
    """
    chosen = labels.select(F.col(doc_id).cast("long").alias("key"), F.col(label).cast("int").alias("y")).where("key is not null and y is not null")
    chosen = chosen.groupBy("key").agg(F.min("y").alias("y"), F.max("y").alias("other")).where("y = other").select("key", "y").orderBy(F.xxhash64("key"), "key").limit(max_rows)
    found = docs.select(F.col(doc_id).cast("long").alias("key"), text_of(text).alias("text")).join(F.broadcast(chosen), "key").groupBy("key", "y").agg(F.min("text").alias("text"))
    found = stored(found)
    sizes = found.select("key", F.octet_length("text").cast("long").alias("size"), F.xxhash64("key").alias("h")).orderBy("h", "key").collect()
    total, kept = 0, []
    for row in sizes:
        if total + row["size"] <= max_bytes:
            total += row["size"]
            kept.append((row["key"],))
    return found.join(F.broadcast(docs.sparkSession.createDataFrame(kept, "key long")), "key", "left_semi")


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable from each node of edges (u, v).

    Large-star and small-star steps in turn: each step points a node's larger (then
    smaller) neighbours at its smallest one, so hubs are only ever aggregated with a
    partial minimum and joined, never gathered. Each round is written to the shared folder. Nodes without an edge between two
    different nodes get no row; nulls are dropped; repeated edges count once.
    """
    kind = edges.schema[0].dataType
    u, v = edges.columns[:2]
    now = stored(edges.select(F.greatest(u, v).alias("a"), F.least(u, v).alias("b")).where("a <> b and a is not null and b is not null").distinct())
    sign = lambda d: d.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.xxhash64("b", "a").cast("decimal(38,0)"))).first()
    before = sign(now)
    while before[0]:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a")
        small = small.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b")))
        now = stored(small.distinct())
        if (after := sign(now)) == before:
            break
        before = after
    out = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return out.unionByName(out.select(F.col("component").alias("node"), "component").distinct()).withColumn("node", F.col("node").cast(kind))
