"""Artifacts: references of calls to paths, files nothing refers to, siblings, formats by bytes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loadscope.functions.text import dirname, extname, matches_any, sanitise, stem, suffixes
from loadscope.operators.columns import first_match, mapped, unsent
from loadscope.plans import dims


def in_scope(entries: DataFrame, ignored: list[str]) -> DataFrame:
    """Entries (path, size, link) that no ignore glob matches and that aren't links."""
    return entries.where(~matches_any(F.col("path"), ignored) & ~F.col("link"))


def notices(entries: DataFrame, ignored: list[str], source_cap: int, notebook_cap: int) -> DataFrame:
    """(path, code): links that are skipped and sources too large to read, of entries in scope."""
    extension = extname(F.col("path"))
    cap = F.when(extension == ".ipynb", notebook_cap).otherwise(source_cap)
    code = first_match((F.col("link"), F.lit("link-skipped")), (F.col("size") > cap, F.lit("file-too-large")))
    return entries.where(~matches_any(F.col("path"), ignored)).select("path", code.alias("code")).where("code is not null")


def resolve_references(literals: DataFrame, paths: DataFrame) -> DataFrame:
    """(literal, target): what each distinct literal refers to among paths, or null.

    In order: a path itself; the one path that ends with it after a slash; a repository
    `hf:org/name`, which has no extension; `missing:` for something that looks like a model file. Paths are counted by
    each of their suffixes first, so a literal meets one row however many namesakes there are.
    """
    cleaned = F.regexp_replace(F.replace(sanitise(F.col("literal")), F.lit("\\"), F.lit("/")), "^\\./", "")
    wanted = literals.select("literal").distinct().withColumn("path", cleaned)
    exact = wanted.join(unsent(paths.select("path", F.lit(True).alias("exact")).distinct()), "path", "left")
    endings = paths.select("path").distinct().select(F.explode(suffixes(F.col("path"))).alias("ending"), F.col("path").alias("found"))
    endings = endings.groupBy("ending").agg(F.min("found").alias("found"), F.count("*").alias("n")).where("n = 1")
    ending = wanted.join(unsent(endings), wanted["path"] == endings["ending"]).select("literal", "found")
    rows = exact.join(unsent(ending), "literal", "left")
    extension = extname(F.col("path"))
    hub = F.col("path").rlike("^[A-Za-z0-9][A-Za-z0-9_.-]*/[A-Za-z0-9_.-]+\\z") & (extension == "")
    missing = F.col("path").rlike("[/.]") & extension.isin(list(dims.BY_EXTENSION))
    target = first_match((F.col("exact"), F.col("path")), (F.col("found").isNotNull(), F.col("found")), (hub, F.concat(F.lit("hf:"), F.col("path"))), (missing, F.concat(F.lit("missing:"), F.col("path"))))
    return rows.select("literal", target.alias("target"))


def unreferenced(artifacts: DataFrame, sites: DataFrame) -> DataFrame:
    return artifacts.join(sites.select("artifact_id"), "artifact_id", "left_anti")


def siblings(paths: DataFrame) -> DataFrame:
    """(path, siblings): others of the same directory and stem, sorted, each with the format of its extension; one row for each path that has any.

    Files of a stem are gathered once and each takes the others from the list, so no pair is formed.
    """
    named = paths.select("path", dirname(F.col("path")).alias("folder"), stem(F.col("path")).alias("stem"), mapped(extname(F.col("path")), dims.INFERRED, "unknown").alias("format"))
    known = named.where("format <> 'unknown'").groupBy("folder", "stem").agg(F.array_sort(F.collect_set(F.struct(F.col("path").alias("locator"), "format"))).alias("all"))
    found = named.join(known, ["folder", "stem"]).select("path", F.filter("all", lambda s: s["locator"] != F.col("path")).alias("siblings"))
    return found.where(F.size("siblings") > 0)


def classify(path: Column, head: Column) -> Column:
    """(format, basis, mismatch) from the first bytes (as binary) of a file that isn't an archive; its extension where they say nothing."""
    hexed = F.hex(F.substring(head, 1, 16))
    extension = extname(path)
    guess = mapped(extension, dims.BY_EXTENSION, "unknown")
    pickled = hexed.rlike("^800[1-5]")
    joblib = guess == "joblib"
    magic = first_match(
        (F.startswith(hexed, F.lit("47475546")), F.lit("gguf")),
        (F.startswith(hexed, F.lit("894844460D0A1A0A")), F.lit("keras-h5")),
        (F.substring(hexed, 9, 8) == "54464C33", F.lit("tflite")),
        (F.startswith(hexed, F.lit("934E554D5059")), F.lit("numpy-npy")),
        (pickled & extension.isin(".pt", ".pth", ".ckpt"), F.lit("pytorch-legacy")),
        (pickled & joblib, F.lit("joblib")),
        (pickled, F.lit("pickle")),
        (joblib & (F.startswith(hexed, F.lit("78")) | F.startswith(hexed, F.lit("04224D18"))), F.lit("joblib")),
        (F.startswith(hexed, F.lit("08")) & (extension == ".onnx"), F.lit("onnx")),
        (hexed.rlike("^(8[0-9A-F]|D[EF])") & (extension == ".msgpack"), F.lit("flax-msgpack")),
    )
    named = F.when(hexed != "", magic)
    basis = F.when(named.isNotNull(), "magic").when(guess != "unknown", "extension").otherwise("none")
    found = F.coalesce(named, guess)
    return F.struct(found.alias("format"), basis.alias("basis"), F.coalesce((basis == "magic") & (guess != "unknown") & ~compatible(guess, found), F.lit(False)).alias("mismatch"))


def compatible(guess: Column, actual: Column) -> Column:
    """An extension and a format that agree: the same, of one family, or a pickle under a joblib name and the other way round."""
    family = guess.isin(dims.PYTORCH_FAMILY) & actual.isin(*dims.PYTORCH_FAMILY, "pickle")
    either = guess.isin("pickle", "joblib") & actual.isin("pickle", "joblib")
    archive = (guess == "numpy-npz") & (actual == "numpy-npy")
    return (guess == actual) | family | either | archive


def match_loader(name: Column, ecosystem: Column) -> Column:
    """The first loader rule of the ecosystem that a canonical name matches, or null."""
    return first_match(*[((ecosystem == eco) & name.rlike(pattern), F.lit(loader)) for loader, eco, _, _, pattern in dims.LOADERS])
