"""Scanner evidence bound to artifacts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loadscope.functions.text import basename, suffixes
from loadscope.operators.columns import first_match, unsent

#: What a record's digest says of a file: it is that of the whole file, of another one, or nothing certain.
BINDINGS = ("current", "stale", "unbound")


def bind(records: DataFrame, artifacts: DataFrame) -> DataFrame:
    """records (seq, subject, subject_digest, ...) with artifact_id and binding; those about no artifact go.

    A subject is an artifact's locator; else the one locator that it ends with or that ends
    with it, after a slash; else the one of the same last segment. Locators are counted by each
    of their suffixes before they are joined, so a subject meets one row of each kind and no
    name is a hot key. A digest (16 to 64 hex digits) binds as a prefix of the whole file's.
    """
    known = artifacts.select("artifact_id", "locator", "digest", "coverage")
    tagged = lambda tag, kind, key: F.struct(F.lit(tag).alias("tag"), F.lit(kind).alias("kind"), key.alias("key"))
    each = lambda tag, kind, keys: F.transform(keys, lambda k: tagged(tag, kind, k))
    proper = lambda path: F.slice(suffixes(path), 2, 1 << 16)
    ours = F.concat(F.array(tagged("", "whole", F.col("locator")), tagged("", "name", basename(F.col("locator")))), each("", "ending", proper(F.col("locator"))))
    keyed = known.select("artifact_id", F.explode(ours).alias("k")).groupBy("k.kind", "k.key").agg(F.count("*").alias("n"), F.min("artifact_id").alias("id"))
    clean = F.replace("subject", F.lit("\\"), F.lit("/"))
    theirs = F.concat(F.array(tagged("exact", "whole", clean), tagged("either", "ending", clean), tagged("name", "name", basename(clean))), each("either", "whole", proper(clean)))
    met = records.select("subject").distinct().select("subject", F.explode(theirs).alias("k")).select("subject", "k.*").join(unsent(keyed), ["kind", "key"])
    one = lambda tag: (F.sum(F.when(F.col("tag") == tag, F.col("n"))), F.min(F.when(F.col("tag") == tag, F.col("id"))))
    (_, exact), (either, ending), (named, name) = one("exact"), one("either"), one("name")
    target = met.groupBy("subject").agg(first_match((exact.isNotNull(), exact), (either == 1, ending), (named == 1, name)).alias("artifact_id")).where("artifact_id is not null")
    bound = records.join(unsent(target), "subject").join(unsent(known.select("artifact_id", "digest", "coverage")), "artifact_id")
    return bound.withColumn("binding", binding(F.col("subject_digest"), F.col("digest"), F.col("coverage"))).select(*records.columns, "artifact_id", "binding")


def binding(of_record: Column, of_file: Column, coverage: Column) -> Column:
    usable = of_record.rlike("^[0-9A-Fa-f]{16,64}\\z") & of_file.isNotNull() & (coverage == "full")
    return F.when(~F.coalesce(usable, F.lit(False)), "unbound").when(F.startswith(of_file, F.lower(of_record)), "current").otherwise("stale")


def state(bindings: Column) -> Column:
    """Of an array of bindings: absent, stale, bound or unbound."""
    has = lambda x: F.array_contains(bindings, x)
    return F.when(F.coalesce(F.size(bindings), F.lit(0)) <= 0, "absent").when(has("stale"), "stale").when(has("current"), "bound").otherwise("unbound")


def gaps(records: DataFrame) -> DataFrame:
    """Artifacts of the tree without evidence that execute or might."""
    return records.where((F.col("evidence_state") == "absent") & (F.col("origin") == "in-tree") & F.col("behaviour").isin("code", "unknown"))


def counts(evidence: DataFrame, records: DataFrame) -> DataFrame:
    """(binding, records): evidence by its binding, and as absent the artifacts that lack it."""
    bound = evidence.groupBy("binding").agg(F.count("*").alias("records"))
    return bound.unionByName(gaps(records).agg(F.count("*").alias("records")).select(F.lit("absent").alias("binding"), "records"))


def scanners(evidence: DataFrame) -> DataFrame:
    """(scanner, records, artifacts): those that said something about an artifact; shown by name."""
    return evidence.groupBy("scanner").agg(F.count("*").alias("records"), F.count_distinct("artifact_id").alias("artifacts"))
