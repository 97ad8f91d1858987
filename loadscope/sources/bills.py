"""Bills of materials as files, read for a comparison: every field that is compared has to be there."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loadscope.operators.diff import FIELDS
from loadscope.plans.dims import EXPOSURE
from loadscope.sources.errors import AnalysisError

SCHEMA = "artifact_id string, locator string, behaviour string, guard string, format string, digest string, sites long, environments string, privileged boolean, evidence string, alternative string, _broken string"
NEEDED = ("artifact_id", "behaviour", "format", "sites", "environments", "privileged", "evidence", "alternative")


#: How the line before the entries of a bill ends, which is written with one entry a line.
OPENS = '"entries":['


def read(spark: SparkSession, path: str) -> DataFrame:
    """The entries of a bill: JSON lines, a folder of them, or a JSON document, as written or reformatted.

    An entry that isn't JSON, lacks a compared field or names an unknown behaviour raises with its entry and field.
    Lines are read by tasks, so a bill of any size can be compared; only a reformatted document is read by one.
    """
    text = spark.read.text(path).where(F.btrim("value") != "")
    head = text.first()
    start = head["value"].strip() if head else ""
    if start.startswith("{") and not start.endswith("}") and not start.endswith(OPENS) or start == "{":
        whole = spark.read.option("multiLine", True).schema(f"entries array<struct<{SCHEMA.replace(' string', ':string').replace(' long', ':long').replace(' boolean', ':boolean')}>>, _broken string").option("columnNameOfCorruptRecord", "_broken").json(path)
        rows = whole.select(F.explode_outer("entries").alias("e"), F.col("_broken").alias("_whole")).select("e.*", "_whole").withColumn("_broken", F.col("_whole")).drop("_whole")
    else:
        lines = text.where(~F.endswith("value", F.lit(OPENS)) & (F.btrim("value") != "]}")).select(F.regexp_replace("value", "^,", "").alias("value"))
        rows = lines.select(F.from_json("value", SCHEMA, {"columnNameOfCorruptRecord": "_broken"}).alias("e")).select("e.*")
    missing = F.array_join(F.filter(F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in NEEDED], F.when(~F.col("behaviour").isin(list(EXPOSURE)), F.lit("behaviour"))), lambda x: x.isNotNull()), ", ")
    bad = rows.withColumn("_missing", missing).where("_broken is not null or _missing <> ''").select("artifact_id", "_missing", "_broken").limit(1).collect()
    if bad:
        r = bad[0]
        raise AnalysisError("bad-bill", f"{path}: entry {r['artifact_id'] or '?'} can't be compared", f"not JSON: {r['_broken']}" if r["_broken"] else f"no valid {r['_missing']}", "Write the bill again with this version.")
    return rows.select("artifact_id", "locator", *FIELDS)
