"""Bills of two projects as a stream, against the batch comparison of each with the one before."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from loadscope.operators import diff
from loadscope.streaming import bills

PLAIN = dict(behaviour="code", guard=None, format="pickle", digest="d", sites=1, environments="", privileged=False, evidence="", alternative="none-identified")
SCHEMA = f"project string, bill long, artifact_id string, {bills.ROW}"


def row(project, bill, artifact, **other):
    values = PLAIN | other
    return (project, bill, artifact, *[values[f] for f in diff.FIELDS])


BATCHES = [
    [row("p", 1, "a"), row("p", 1, "b"), row("q", 7, "a", sites=3)],
    [row("p", 2, "a", behaviour="data"), row("p", 2, "c"), row("q", 8, "a", sites=4), row("q", 8, "z"), row("q", 9, "z", guard="g"), (None, 1, "x", *[None] * len(diff.FIELDS))],
    [row("p", 2, "zombie"), row("p", 3, "b"), row("p", 3, "c", privileged=True), row("q", 10, "a"), row("q", 10, "z", guard="g")],
]


@pytest.mark.parametrize("restart", [False, True])
def test_stream_equals_batch(spark, tmp_path, restart):
    source = tmp_path / "in"
    stream = None
    for i, batch in enumerate(BATCHES):
        spark.createDataFrame(batch, SCHEMA).coalesce(1).write.mode("append").parquet(str(source))
        if stream is None or restart:
            if stream is not None:
                stream.stop()
            stream = bills.follow(spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(source)), str(tmp_path / "out"), str(tmp_path / "check"))
        stream.processAllAvailable()
        assert i == 0 or stream.isActive
    stream.stop()
    got = sorted((r["project"], r["bill"], r["artifact_id"], r["status"], sorted(map(tuple, r["fields"] or []))) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    every = [r for batch in BATCHES for r in batch if r[0] and r[2] != "zombie"]
    want = []
    for project, numbers in (("p", [1, 2, 3]), ("q", [7, 8, 9, 10])):
        before = spark.createDataFrame([], SCHEMA)
        for n in numbers:
            after = spark.createDataFrame([r for r in every if r[:2] == (project, n)], SCHEMA)
            found = diff.status(before, after).where("status <> 'unchanged'").withColumn("fields", F.when(F.col("status") == "changed", diff.cells()))
            want += [(project, n, r["artifact_id"], r["status"], sorted(map(tuple, r["fields"] or []))) for r in found.collect()]
            before = after
    assert got == sorted(want)
