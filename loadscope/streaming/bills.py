"""Changes between bills as they arrive, each compared with the last bill of its project.

Two states, both bounded by the last bill: which artifacts a project's bill lists, so that those
a new one lacks are known, and each artifact's last row, kept by project and artifact, so that
a large project is spread over tasks. Both are in the state store, none in a task's memory.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from loadscope.operators.columns import first_match
from loadscope.operators.diff import FIELDS, cells

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
KINDS = {"sites": "long", "privileged": "boolean"}
ROW = ", ".join(f"{f} {KINDS.get(f, 'string')}" for f in FIELDS)


class Listing(StatefulProcessor):
    """For each project which artifacts a new bill lists, and which it lacks that the one before it listed."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.listed = handle.getMapState("listed", "artifact_id string", "last long, now array<long>")
        self.number = handle.getValueState("number", "bill long")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        last = self.number.get()[0] if self.number.exists() else None
        bills: set[int] = set()
        for row in rows:
            # a bill that isn't newer than the last was seen before
            if last is not None and row["bill"] <= last:
                continue
            bills.add(row["bill"])
            at = (row["artifact_id"],)
            before, now = self.listed.getValue(at) if self.listed.containsKey(at) else (None, [])
            self.listed.updateValue(at, (before, sorted({*(now or []), row["bill"]})))
            yield Row(project=key[0], bill=row["bill"], artifact_id=row["artifact_id"], part="listed")
        if not bills:
            return
        order = [last, *sorted(bills)]
        gone = []
        for (artifact,), (before, now) in self.listed.iterator():
            held = {before, *(now or [])} - {None}
            for earlier, later in zip(order, order[1:], strict=False):
                if earlier in held and later not in held:
                    yield Row(project=key[0], bill=later, artifact_id=artifact, part="gone")
            if order[-1] in held:
                self.listed.updateValue((artifact,), (order[-1], []))
            else:
                gone.append(artifact)
        for artifact in gone:
            self.listed.removeKey((artifact,))
        self.number.update((order[-1],))

    def close(self) -> None:
        pass


class Steps(StatefulProcessor):
    """For each artifact of a project its row before and after each bill that lists or lacks it. A row counts if its project's listing has it."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("held", ROW)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        before = tuple(self.held.get()) if self.held.exists() else None
        given, listed = {}, {}
        for r in rows:
            if r["part"] == "row":  # of repeated ones the last in their order
                row = tuple(r[f] for f in FIELDS)
                given[r["bill"]] = max(given.get(r["bill"], row), row, key=str)
            else:
                listed[r["bill"]] = r["part"]
        for bill in sorted(listed):
            after = given[bill] if listed[bill] == "listed" else None
            if before != after:
                yield Row(project=key[0], bill=bill, artifact_id=key[1], b=before, a=after)
            before = after
        if before is None:
            self.held.clear()
        else:
            self.held.update(before)

    def close(self) -> None:
        pass


def changes(bills: DataFrame) -> DataFrame:
    """(project, bill, artifact_id, status, fields) of a stream of whole bills (project, bill, artifact_id and the compared fields).

    Bills of a project are numbered upwards; one that isn't newer than the last seen is left
    out, so that a repeated delivery changes nothing. A project's first bill is all added. fields has
    (field, before, after, direction) of what differs in an artifact that both bills list. Rows without a
    project, number or artifact are none.
    """
    bills.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    rows = bills.where("project is not null and bill is not null and artifact_id is not null")
    rows = rows.select("project", F.col("bill").cast("long").alias("bill"), F.col("artifact_id").cast("string").alias("artifact_id"), *[F.col(f).cast(KINDS.get(f, "string")).alias(f) for f in FIELDS])
    listing = rows.select("project", "bill", "artifact_id").groupBy("project").transformWithState(Listing(), "project string, bill long, artifact_id string, part string", "Append", "None")
    both = rows.withColumn("part", F.lit("row")).unionByName(listing, allowMissingColumns=True)
    held = "struct<" + ROW.replace(", ", ",").replace(" ", ":") + ">"
    steps = both.groupBy("project", "artifact_id").transformWithState(Steps(), f"project string, bill long, artifact_id string, b {held}, a {held}", "Append", "None")
    status = first_match((F.col("b").isNull(), F.lit("added")), (F.col("a").isNull(), F.lit("removed"))).otherwise("changed")
    return steps.select("project", "bill", "artifact_id", status.alias("status"), F.when(status == "changed", cells()).alias("fields"))


def follow(bills: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Starts a query that writes the changes of a stream of bills as Parquet; a restart goes on where it was and repeats nothing."""
    return changes(bills).writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint).outputMode("append").start()
