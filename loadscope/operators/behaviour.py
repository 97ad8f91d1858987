"""What loading does: a verdict for each call site, for an artifact as a whole, and for one that nothing loads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loadscope.functions.versions import threshold
from loadscope.operators.columns import first_match, mapped
from loadscope.plans import dims

VERDICT = "struct<behaviour:string,reason:string,guard:string,if_removed:string>"


def verdict(behaviour: str | Column, reason: str | None = None, guard: str | None = None, if_removed: str | None = None) -> Column:
    b = F.lit(behaviour) if isinstance(behaviour, str) else behaviour
    made = F.struct(b.alias("behaviour"), F.lit(reason).alias("reason"), F.lit(guard).alias("guard"), F.lit(if_removed).alias("if_removed"))
    return made.cast(VERDICT)


def decided(name: str, target: list[int]) -> Column:
    """Whether the dependency's pin puts it at or above the target; columns <name>_version and <name>_pin."""
    return threshold(F.col(f"{name}_version"), F.col(f"{name}_pin"), F.array(*[F.lit(x).cast("bigint") for x in target]))


def by_default(reached: Column, guard: str) -> Column:
    """A loader whose newer versions are safe by default."""
    return first_match((reached.isNull(), verdict("unknown", "loader-default-unpinned")), (reached, verdict("guarded", None, guard, "code"))).otherwise(verdict("code"))


def site_verdict() -> Column:
    """The decision table over columns loader, args (map of keyword to literal), literal, origin, basis, format and the pins of torch, keras and tensorflow."""
    loader, intrinsic = F.col("loader"), mapped(F.col("format"), dims.INTRINSIC, "unknown")
    arg = lambda name: F.lower(F.col("args").getItem(name))
    here = F.col("origin") == "in-tree"
    data_only = loader.isin(dims.DATA_ONLY_LOADERS) & here
    torch, keras, tensorflow = decided("torch", dims.TORCH_SAFE), decided("keras", dims.KERAS_SAFE), decided("tensorflow", dims.TENSORFLOW_SAFE)
    undetermined = verdict("unknown", "format-undetermined")
    torch_load = first_match(
        (arg("pickle_module").isNotNull(), verdict("code")),
        (arg("weights_only") == "false", verdict("code")),
        (arg("weights_only") == "true", verdict("guarded", None, "weights_only=True", "code")),
    ).otherwise(by_default(torch, "weights_only default"))
    numpy_load = first_match((arg("allow_pickle") == "true", verdict("code")), (arg("allow_pickle") == "false", verdict("data", None, "allow_pickle=False", "code"))).otherwise(verdict("data"))
    keras_load = first_match((arg("safe_mode") == "false", verdict("code")), (arg("safe_mode") == "true", verdict("guarded", None, "safe_mode=True", "code"))).otherwise(
        by_default(F.coalesce(keras, tensorflow), "safe_mode default")
    )
    hub = first_match(
        (arg("trust_remote_code") == "true", verdict("code")),
        (arg("use_safetensors") == "true", verdict("data", None, "use_safetensors=True", "unknown")),
        (here & (intrinsic == "data"), verdict("data")),
        (here, by_default(torch, "weights_only default")),
        (F.col("literal").isNotNull(), verdict("unknown", "remote-contents-unresolvable")),
    ).otherwise(verdict("unknown", "path-not-static"))
    datasets = first_match((arg("trust_remote_code") == "true", verdict("code"))).otherwise(verdict("data", None, "trust_remote_code default", "code"))
    return first_match(
        (data_only & F.col("basis").isin("extension", "none"), undetermined),
        (data_only & (intrinsic == "code"), undetermined),
        (loader.isin(dims.PICKLE_LOADERS), verdict("code")),
        (loader == "torch.load", torch_load),
        (loader.isin("torch.jit.load", "torch.hub.load", "tensorflow.saved_model.load", "ultralytics.YOLO"), verdict("code")),
        (loader == "numpy.load", numpy_load),
        (loader == "keras.load_model", keras_load),
        (loader.isin(dims.HUB_LOADERS), hub),
        (loader == "datasets.load_dataset", datasets),
        (loader.isin(*dims.DATA_ONLY_LOADERS, "js.transformers.from_pretrained", "js.tfjs"), verdict("data")),
    ).otherwise(verdict("unknown", "loader-unrecognised"))


def orphan_verdict(target: Column) -> Column:
    """Of a site that no artifact answers to."""
    return F.when(target.isNull(), verdict("unknown", "artifact-unresolved")).otherwise(verdict("unknown", "path-not-static"))


def pins_row(deps: DataFrame, names: tuple[str, ...] = ("torch", "keras", "tensorflow")) -> DataFrame:
    """One row with the version and pin of each dependency that a threshold reads; nulls where it isn't declared."""
    of = lambda name, c: F.max(F.when(F.col("name") == name, F.col(c)))
    return deps.agg(*[of(n, c).alias(f"{n}_{c}") for n in names for c in ("version", "pin")])


def resolve(sites: DataFrame, artifacts: DataFrame, deps: DataFrame) -> DataFrame:
    """sites with `verdict`: those bound to an artifact by the table, the others as orphans.

    Artifacts join on artifact_id; the pins are one row, so they are broadcast.
    """
    known = artifacts.select("artifact_id", "format", "basis", "origin")
    rows = sites.join(known, "artifact_id", "left").crossJoin(F.broadcast(pins_row(deps)))
    found = F.when(F.col("origin").isNull(), orphan_verdict(F.col("target"))).otherwise(site_verdict())
    return rows.withColumn("verdict", found).select(*sites.columns, "verdict")


def headline_of(order: list[str]) -> list[Column]:
    """Aggregates over an artifact's sites: verdict (of the most exposed site, of equals the first in order), first_loader, guardable, sites, inconsistent.

    All keep a partial result of fixed size, so an artifact with any number of sites is not
    a hot key.
    """
    exposure = mapped(F.col("verdict.behaviour"), dims.EXPOSURE, -1)
    place = F.struct(*order)
    guard = F.col("loader").isin(list(dims.GUARDS))
    return [
        F.min_by("verdict", F.struct(-exposure, *order)).alias("verdict"), F.min_by("loader", place).alias("first_loader"), F.min_by(F.when(guard, F.col("loader")), F.when(guard, place)).alias("guardable"),
        F.count("*").alias("sites"), (F.min(exposure) != F.max(exposure)).alias("inconsistent"),
    ]


def headline(sites: DataFrame, order: list[str]) -> DataFrame:
    """(artifact_id, verdict, first_loader, guardable, sites, inconsistent) of artifacts that are loaded."""
    return sites.where("artifact_id is not null").groupBy("artifact_id").agg(*headline_of(order))


def dormant_verdict() -> Column:
    """Of an artifact that nothing loads; columns format and basis."""
    intrinsic = mapped(F.col("format"), dims.INTRINSIC, "unknown")
    return first_match(
        (F.col("basis").isin("extension", "none") | (F.col("format") == "unknown"), verdict("unknown", "format-undetermined")),
        (intrinsic == "code", verdict("unknown", "artifact-unresolved")),
    ).otherwise(verdict(intrinsic))
