"""Relations of the analyser derived from the star schema: loads of artifacts by files, dependencies, evidence and two bills."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loadscope.operators import behaviour as B
from loadscope.operators import context as C
from loadscope.operators import deps as D
from loadscope.operators import evidence as E
from loadscope.operators import records as R
from loadscope.operators.columns import unsent
from loadscope.plans import dims

#: Order of sites; together these are unique.
ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice"]
DECLARED = [("production", ["africa/**"]), ("staging", ["america/*1/**"])]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Loaders that suit each format, three to choose from; declarations have none of their own.
SUITING = {
    "pickle": ["pickle.load", "dill.load", "pandas.read_pickle"],
    "pytorch-zip": ["torch.load", "torch.load", "transformers.from_pretrained"],
    "pytorch-legacy": ["torch.load", "torch.hub.load", "torch.load"],
    "torchscript": ["torch.jit.load", "torch.load", "torch.jit.load"],
    "joblib": ["joblib.load", "cloudpickle.load", "joblib.load"],
    "numpy-npy": ["numpy.load", "numpy.load", "pickle.load"],
    "numpy-npz": ["numpy.load", "numpy.load", "numpy.load"],
    "safetensors": ["safetensors.load_file", "transformers.from_pretrained", "sentence_transformers"],
    "onnx": ["onnxruntime.InferenceSession", "js.onnxruntime", "onnxruntime.InferenceSession"],
    "gguf": ["llama_cpp.Llama", "js.node-llama-cpp", "llama_cpp.Llama"],
    "tflite": ["js.tfjs", "js.tfjs", "onnxruntime.InferenceSession"],
    "keras-h5": ["keras.load_model", "keras.load_model", "keras.load_model"],
    "keras-v3": ["keras.load_model", "tensorflow.saved_model.load", "keras.load_model"],
    "tf-savedmodel": ["tensorflow.saved_model.load", "keras.load_model", "js.tfjs"],
    "flax-msgpack": ["transformers.from_pretrained", "marshal.load", "transformers.from_pretrained"],
    "mcp-server-manifest": ["pickle.load", "ultralytics.YOLO", "pickle.load"],
    "remote-repository": ["transformers.from_pretrained", "datasets.load_dataset", "transformers.pipeline"],
    "unknown": ["torch.load", "ultralytics.YOLO", "js.transformers.from_pretrained"],
}
#: One loader for each format and choice, in their order; null where a format isn't loaded.
CHOICES = [loader for f in dims.FORMAT_IDS for loader in SUITING.get(f, [None] * 3)]


def artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One for each part; every tenth and the one before share a name, some have a safe sibling or a notable callable."""
    k = F.col("p_partkey")
    fmt = F.element_at(F.array(*[F.lit(f) for f in dims.FORMAT_IDS]), (k % 21 + 1).cast("int"))
    ext = F.element_at(F.array(*[F.lit((f[4] or [".dat"])[0]) for f in dims.FORMATS]), (k % 21 + 1).cast("int"))
    name = F.when(k % 10 == 9, F.concat(F.lit("shared"), F.floor(k / 420).cast("string"), F.lit(".bin"))).otherwise(F.concat(F.lit("m"), k.cast("string"), ext))
    locator = F.concat(F.lit("models/"), F.lower("p_type"), F.lit("/"), F.lower(F.replace("p_brand", F.lit("#"), F.lit("-"))), F.lit("/"), k.cast("string"), F.lit("/"), name)
    none = F.array().cast("array<struct<locator:string,format:string>>")
    rows = table(spark, sf_dir, "part").select(
        k.alias("artifact_id"), locator.alias("locator"), fmt.alias("format"), F.when(k % 5 == 0, "extension").otherwise("magic").alias("basis"),
        F.when(fmt == "remote-repository", "remote-reference").otherwise("in-tree").alias("origin"), (k % 17 == 3).alias("mismatch"), (k % 9 == 1).alias("notable"),
        F.when(k % 13 == 2, F.array(F.struct(F.lit("beside").alias("locator"), F.lit("safetensors").alias("format")))).otherwise(none).alias("siblings"),
    )
    return rows.withColumn("digest", F.sha2("locator", 256)).withColumn("coverage", F.when(F.col("artifact_id") % 11 == 0, "head-tail").otherwise("full"))


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(suppkey, file): loading files. Joined by key to nation and region, both small."""
    joined = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    kind = F.when(F.col("s_suppkey") % 7 == 1, "test_").when(F.col("s_suppkey") % 7 == 2, "run_").otherwise("")
    ext = F.when(F.col("s_suppkey") % 9 == 4, ".ipynb").otherwise(".py")
    return joined.select(F.col("s_suppkey").alias("suppkey"), F.lower(F.concat_ws("/", F.replace("r_name", F.lit(" "), F.lit("-")), "n_name", F.concat(kind, F.replace("s_name", F.lit("#"), F.lit("-")), ext))).alias("file"), "s_nationkey", "s_acctbal")


def contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file, environment, basis, privileged, privileges)"""
    frameworks = F.when(F.col("suppkey") % 4 == 0, F.array(F.lit("flask"))).when(F.col("suppkey") % 4 == 1, F.array(F.lit("mlflow"))).otherwise(F.array().cast("array<string>"))
    found = C.environment(F.col("file"), frameworks, DECLARED)
    kinds = F.array_compact(F.array(F.when(F.col("suppkey") % 6 == 1, "network-egress"), F.when(F.col("s_acctbal") < 0, "secret-material")))
    return files(spark, sf_dir).select("file", found.alias("e"), (F.col("s_acctbal") < 0).alias("privileged"), kinds.alias("privileges")).select("file", "e.environment", "e.basis", "privileged", "privileges")


def declared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(name, constraint, source, rank, seq): dependency entries of the nations' files, three kinds of source."""
    k = F.col("n_nationkey")
    name = F.element_at(F.array(*[F.lit(x) for x in ("torch", "keras", "tensorflow", "numpy", "onnx")]), (k % 5 + 1).cast("int"))
    minor = (k % 4 + 4).cast("string")
    text = F.element_at(F.array(F.concat(F.lit("==2."), minor), F.concat(F.lit(">=2."), minor), F.lit("*"), F.concat(F.lit("~=3."), minor), F.lit("<9"), F.concat(F.lit("v2."), minor), F.concat(F.lit("^1."), minor), F.lit("==2.*")), (k % 8 + 1).cast("int"))
    rank = F.when(k % 7 == 6, D.LOCK).when(k % 3 == 0, D.REQUIREMENTS).otherwise(D.OTHER)
    return table(spark, sf_dir, "nation").select(name.alias("name"), text.alias("constraint"), F.concat(F.lit("file"), k.cast("string")).alias("source"), rank.alias("rank"), (rank * 1000 + k).alias("seq"))


def dependencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.merge(declared(spark, sf_dir))


def sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Load sites without verdicts: the ORDER columns, artifact_id, file, loader, args, target, literal.

    A part's lines with one line number are its sites, about four; all others load what isn't
    known. An artifact's sites mostly have one loader and one set of arguments.
    """
    n, k = F.col("l_linenumber"), F.col("l_partkey")
    odd = F.when(F.col("l_orderkey") % 40 == 3, 1).otherwise(0)
    loader = F.element_at(F.array(*[F.lit(x) for x in CHOICES]), (k % 21 * 3 + (F.floor(k / 21) + odd) % 3 + 1).cast("int"))
    own = loader.isNotNull() & (n == k % 7 + 1) & (k % 12 != 7)
    fallback = F.element_at(F.array(*[F.lit(x[0]) for x in dims.LOADERS]), ((n * 5 + k % 3) % 24 + 1).cast("int"))
    said = (F.floor(k / 63) + odd) % 4
    flag = F.when(said == 0, "False").when(said == 1, "True")
    args = F.create_map(
        F.lit("weights_only"), flag, F.lit("allow_pickle"), flag, F.lit("safe_mode"), flag, F.lit("trust_remote_code"), F.when(k % 10 == 3, "True"),
        F.lit("use_safetensors"), F.when(k % 10 == 4, "True"), F.lit("pickle_module"), F.when(k % 19 == 7, "dill"),
    )
    rows = table(spark, sf_dir, "lineitem").select(
        *ORDER, F.when(own, k).alias("artifact_id"), F.when(own, loader).otherwise(fallback).alias("loader"), args.alias("args"),
        F.when(F.col("l_orderkey") % 2 == 0, k.cast("string")).alias("literal"), F.when(F.col("l_orderkey") % 100 == 7, None).otherwise(F.lit("path")).alias("target"),
    )
    return rows.join(files(spark, sf_dir).select("suppkey", "file"), F.col("l_suppkey") == F.col("suppkey")).drop("suppkey")


def resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.resolve(sites(spark, sf_dir), artifacts(spark, sf_dir), dependencies(spark, sf_dir))


def scanned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence records (seq, subject, subject_digest, result), one for each order, about artifacts' locators, whole or by their tail; about every sixth artifact there is none."""
    count = table(spark, sf_dir, "part").agg(F.count("*").alias("parts"))
    k = F.col("o_orderkey") % F.col("parts")
    rows = table(spark, sf_dir, "orders").crossJoin(F.broadcast(count)).withColumn("k", F.when(k % 6 == 5, k - 1).otherwise(k)).join(unsent(artifacts(spark, sf_dir).select(F.col("artifact_id").alias("k"), "locator", F.col("digest").alias("d"))), "k")
    o = F.col("o_orderkey") % 7
    subject = F.when(o == 0, F.concat(F.lit("repo/"), F.col("locator"))).when(o == 1, F.substring_index("locator", "/", -2)).when(o == 2, F.concat(F.lit("x/"), F.substring_index("locator", "/", -1))).when(o == 3, F.substring_index("locator", "/", -1)).otherwise(F.col("locator"))
    d = F.when(F.col("o_orderkey") % 97 == 5, F.sha2(F.col("d"), 256)).when(F.col("o_orderstatus") != "P", F.left(F.upper("d"), F.lit(20)))
    return rows.select(F.col("o_orderkey").alias("seq"), subject.alias("subject"), d.alias("subject_digest"), F.when(F.col("o_orderpriority").startswith("1"), "flagged").when(F.col("o_orderpriority").startswith("2"), "error").otherwise("pass").alias("result"), F.concat(F.lit("scanner"), (F.col("o_orderkey") % 5).cast("string")).alias("scanner"))


def evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.bind(scanned(spark, sf_dir), artifacts(spark, sf_dir))


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only sites that have an artifact count in records, so their merge join with the artifacts has no hot key."""
    known = artifacts(spark, sf_dir)
    loaded = B.resolve(sites(spark, sf_dir).where("artifact_id is not null"), unsent(known), dependencies(spark, sf_dir))
    return R.build(known, loaded, contexts(spark, sf_dir), evidence(spark, sf_dir), ORDER)


def bills(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Two bills over customers: before, and after with some rows gone, some new and some altered."""
    k = F.col("artifact_id")
    base = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("artifact_id"),
        F.element_at(F.array(*[F.lit(b) for b in dims.DISPLAY]), (F.col("c_custkey") % 5 + 1).cast("int")).alias("behaviour"),
        F.when(F.col("c_custkey") % 3 == 0, "weights_only=True").alias("guard"),
        F.lower("c_mktsegment").alias("format"),
        F.sha2("c_name", 256).alias("digest"),
        (F.col("c_nationkey") % 4).cast("long").alias("sites"),
        F.when(F.col("c_nationkey") % 3 == 0, "sandbox").when(F.col("c_nationkey") % 3 == 1, "notebook,production").otherwise("").alias("environments"),
        (F.col("c_acctbal") < 0).alias("privileged"),
        F.when(F.col("c_custkey") % 2 == 0, "current").otherwise("").alias("evidence"),
        F.when(F.col("c_custkey") % 7 == 0, "sibling-present").otherwise("none-identified").alias("alternative"),
    )
    before = base.where(k % 10 != 3)
    after = base.where(k % 10 != 4).select(
        "artifact_id",
        F.when(k % 11 == 2, "code").when(k % 11 == 3, "data").otherwise(F.col("behaviour")).alias("behaviour"),
        F.when(k % 13 == 5, None).otherwise(F.col("guard")).alias("guard"),
        F.when(k % 17 == 1, "onnx").otherwise(F.col("format")).alias("format"),
        F.when(k % 19 == 4, F.sha2("digest", 256)).otherwise(F.col("digest")).alias("digest"),
        F.when(k % 23 == 6, F.col("sites") + 1).otherwise(F.col("sites")).alias("sites"),
        F.when(k % 29 == 8, "staging").otherwise(F.col("environments")).alias("environments"),
        F.when(k % 31 == 9, ~F.col("privileged")).otherwise(F.col("privileged")).alias("privileged"),
        F.when(k % 37 == 10, "stale").otherwise(F.col("evidence")).alias("evidence"),
        F.when(k % 41 == 11, "conversion-available").otherwise(F.col("alternative")).alias("alternative"),
    )
    return before, after
