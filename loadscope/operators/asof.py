"""What came last before, or comes first after, in an order: over ranges, so that no key is one task's.

Rows are dealt out by ranges of a key and an order. Within a range a window or one sweep
looks back; what earlier ranges leave to a range is put before it as rows of its own. That
is worked out from one row a range and level, never from the rows of a key.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from loadscope.operators.shared import shared_dir


def dealt(rows: DataFrame, order: list[str]) -> DataFrame:
    """rows dealt out by ranges of the order, with the number of their range as `_range`; kept in the shared folder."""
    shared_dir(rows.sparkSession)
    return rows.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()).checkpoint()


def carried(spread: DataFrame, key: list[str], order: list[str], of: Column, level: list[str] = (), back: bool = False) -> DataFrame:
    """(_range, *key, *level, *order): for each range and the key it begins with, the last of that key's rows in ranges before it, one of each level.

    Only rows that `of` is true for are carried. With back it is the first in ranges after it, for
    the key a range ends with. Both ends of every range are broadcast: as many rows as there
    are ranges.
    """
    whole = F.struct(*key)
    ends = spread.groupBy("_range").agg(F.min(whole).alias("_lo"), F.max(whole).alias("_hi"))
    leaves, enters = ("_lo", "_hi") if back else ("_hi", "_lo")
    found = spread.where(of).join(F.broadcast(ends.select("_range", leaves)), "_range").where(whole.eqNullSafe(F.col(leaves)))
    pick = F.min if back else F.max
    left = found.groupBy("_range", *key, *level).agg(pick(F.struct(*order)).alias("_row"))
    levels = left.select(*[F.col(c).alias(f"_{c}") for c in key], *level).distinct()
    asks = ends.select("_range", f"{enters}.*").join(levels, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in key])
    rows = left.select("_range", *key, *level, "_row", F.lit(True).alias("_own")).unionByName(asks.select("_range", *key, *level, F.lit(None).alias("_row"), F.lit(False).alias("_own")))
    span = F.col("_range").desc() if back else F.col("_range")
    so_far = F.last("_row", ignorenulls=True).over(Window.partitionBy(*key, *level).orderBy(span, "_own").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return rows.withColumn("_row", so_far).where("not _own and _row is not null").select("_range", *key, *level, "_row.*")


def nearest(asks: DataFrame, known: DataFrame, key: list[str], at: str, value: str) -> DataFrame:
    """asks with `value` of the row of known last at or before `at` within the key, or else of the first after it.

    Rows of known with one key and place are taken in the order of their value. asks keeps its columns and repeated rows; a null key
    is a key of its own; a key that known lacks gives null.
    """
    order = [at, "_side", value]
    own = [c for c in asks.columns if c not in (*key, at)]
    kind = known.schema[value].dataType
    ask = asks.select(*key, at, F.lit(1).alias("_side"), F.lit(None).cast(kind).alias(value), F.struct(*own, F.lit(0).alias("_")).alias("_ask"))
    give = known.where(F.col(value).isNotNull()).select(*key, F.col(at).cast(asks.schema[at].dataType).alias(at), F.lit(0).alias("_side"), value)
    spread = dealt(ask.unionByName(give, allowMissingColumns=True), [*key, *order])
    is_known = F.col("_side") == 0
    rows = spread.withColumn("_edge", F.lit(0))
    for back, edge in ((False, -1), (True, 1)):
        rows = rows.unionByName(carried(spread, key, order, is_known, back=back).withColumn("_edge", F.lit(edge)), allowMissingColumns=True)
    line = Window.partitionBy("_range", *key).orderBy("_edge", *order)
    before = F.last(value, ignorenulls=True).over(line.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    after = F.first(value, ignorenulls=True).over(line.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    return rows.withColumn("_found", F.coalesce(before, after)).where("_side = 1").select(*key, at, *[F.col(f"_ask.{c}").alias(c) for c in own], F.col("_found").alias(value))


def deepest(sites: DataFrame, scopes: DataFrame) -> DataFrame:
    """(file, site, enclosing): of each site (file, site, at, indent) the name of the most indented of its file's scopes (file, at, indent, name) that begin at or before it and are less indented, of equals the last.

    One sweep over the rows in order keeps the last scope of each indentation. A site before
    all scopes gets null; repeated sites are repeated; rows without an indentation are
    neither in a scope nor one.
    """
    kind, name = sites.schema["site"].dataType, scopes.schema["name"].dataType
    ask = sites.select("file", F.col("at").cast("long").alias("at"), F.lit(1).alias("_side"), F.col("indent").cast("long").alias("indent"), "site")
    give = scopes.where("indent is not null").select("file", F.col("at").cast("long").alias("at"), F.lit(0).alias("_side"), F.col("indent").cast("long").alias("indent"), "name")
    order = ["at", "_side", "name"]
    spread = dealt(ask.unionByName(give, allowMissingColumns=True), ["file", *order])
    before = carried(spread, ["file"], order, F.col("_side") == 0, level=["indent"])
    rows = spread.withColumn("_edge", F.lit(0)).unionByName(before.withColumn("_edge", F.lit(-1)), allowMissingColumns=True)
    rows = rows.repartition("_range").sortWithinPartitions("_range", "file", "_edge", *order)
    file_kind, site_kind, name_kind = (to_arrow_type(k) for k in (sites.schema["file"].dataType, kind, name))

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, depths, names = None, [], []
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("_range", "file", "_side", "indent", "site", "name")]
            out = []
            for span, file, side, indent, site, name in zip(*columns, strict=True):
                if (span, file) != now:
                    now, depths, names = (span, file), [], []
                k = bisect_left(depths, indent) if indent is not None else 0
                if side:
                    out.append((file, site, names[k - 1] if k else None))
                elif k < len(depths) and depths[k] == indent:
                    names[k] = name
                else:
                    depths.insert(k, indent)
                    names.insert(k, name)
            files, found, enclosing = zip(*out, strict=True) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(files, file_kind), pa.array(found, site_kind), pa.array(enclosing, name_kind)], ["file", "site", "enclosing"])

    out = rows.select("_range", "file", "_side", "indent", "site", "name")
    return out.mapInArrow(sweep, f"file {sites.schema['file'].dataType.simpleString()}, site {kind.simpleString()}, enclosing {name.simpleString()}")
