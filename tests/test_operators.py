from __future__ import annotations

import itertools

import duckdb
import pytest
from pyspark.sql import functions as F

from loadscope import queries as Q
from loadscope.operators import artifacts as A
from loadscope.operators import behaviour as B
from loadscope.operators import bom
from loadscope.operators import context as C
from loadscope.operators import diff as DF
from loadscope.operators import evidence as E
from loadscope.operators import explore, graph
from loadscope.plans import derived as P
from loadscope.plans import dims

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from read_parquet('{sf}/{t}.parquet')")
    return c


def plain(rows):
    return sorted(str(tuple(round(float(x), 6) if isinstance(x, int | float) and not isinstance(x, bool) else x for x in r)) for r in rows)


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_query_equals_its_sql(spark, sf, con, name):
    got = Q.queries()[name](spark, sf)
    want = con.execute(Q.oracle_sql()[name])
    columns = sorted(got.columns)
    assert sorted(d[0] for d in want.description) == columns
    names = [d[0] for d in want.description]
    rows = [tuple(r[names.index(c)] for c in columns) for r in want.fetchall()]
    assert plain(tuple(r) for r in got.select(*[f"`{c}`" for c in columns]).collect()) == plain(rows)


def sites(spark, rows):
    """rows: loader, args, literal, origin, basis, format, torch, keras, tensorflow as (version, pin)."""
    kind = "loader string, args map<string,string>, literal string, origin string, basis string, format string, " + ", ".join(f"{n}_version string, {n}_pin string" for n in ("torch", "keras", "tensorflow"))
    flat = [(*r[:6], *itertools.chain(*r[6:])) for r in rows]
    return [tuple(r["v"])[:3] for r in spark.createDataFrame(flat, kind).select(B.site_verdict().alias("v")).collect()]


NO, OLD, NEW = (None, None), ("2.5", "exact"), ("2.6", "exact")


@pytest.mark.parametrize(
    ("row", "want"),
    [
        (("pickle.load", {}, None, "in-tree", "magic", "safetensors", NO, NO, NO), ("code", None, None)),
        (("safetensors.load_file", {}, None, "in-tree", "extension", "safetensors", NO, NO, NO), ("unknown", "format-undetermined", None)),
        (("safetensors.load_file", {}, None, "in-tree", "magic", "pytorch-zip", NO, NO, NO), ("unknown", "format-undetermined", None)),
        (("safetensors.load_file", {}, None, "in-tree", "magic", "safetensors", NO, NO, NO), ("data", None, None)),
        (("torch.load", {}, None, "in-tree", "magic", "pytorch-zip", NO, NO, NO), ("unknown", "loader-default-unpinned", None)),
        (("torch.load", {}, None, "in-tree", "magic", "pytorch-zip", OLD, NO, NO), ("code", None, None)),
        (("torch.load", {}, None, "in-tree", "magic", "pytorch-zip", NEW, NO, NO), ("guarded", None, "weights_only default")),
        (("torch.load", {"weights_only": "True"}, None, "in-tree", "magic", "pytorch-zip", OLD, NO, NO), ("guarded", None, "weights_only=True")),
        (("torch.load", {"weights_only": "True", "pickle_module": "dill"}, None, "in-tree", "magic", "pytorch-zip", NEW, NO, NO), ("code", None, None)),
        (("numpy.load", {"allow_pickle": "True"}, None, "in-tree", "magic", "numpy-npy", NO, NO, NO), ("code", None, None)),
        (("numpy.load", {"allow_pickle": "False"}, None, "in-tree", "magic", "numpy-npy", NO, NO, NO), ("data", None, "allow_pickle=False")),
        (("keras.load_model", {}, None, "in-tree", "magic", "keras-v3", NO, ("3.1", "range"), NO), ("guarded", None, "safe_mode default")),
        (("keras.load_model", {}, None, "in-tree", "magic", "keras-v3", NO, NO, ("2.15", "exact")), ("code", None, None)),
        (("transformers.pipeline", {}, "org/x", "remote-reference", "none", "remote-repository", NEW, NO, NO), ("unknown", "remote-contents-unresolvable", None)),
        (("transformers.pipeline", {}, None, "remote-reference", "none", "remote-repository", NEW, NO, NO), ("unknown", "path-not-static", None)),
        (("transformers.from_pretrained", {"use_safetensors": "True"}, None, "remote-reference", "none", "remote-repository", NO, NO, NO), ("data", None, "use_safetensors=True")),
        (("datasets.load_dataset", {}, None, "remote-reference", "none", "remote-repository", NO, NO, NO), ("data", None, "trust_remote_code default")),
        (("torch.hub.load", {}, None, "remote-reference", "none", "remote-repository", NO, NO, NO), ("code", None, None)),
        (("else", {}, None, "in-tree", "magic", "gguf", NO, NO, NO), ("unknown", "loader-unrecognised", None)),
    ],
)
def test_decision_table(spark, row, want):
    assert sites(spark, [row]) == [want]


def test_every_loader_has_a_verdict(spark):
    rows = [(x[0], {}, None, "in-tree", "magic", "gguf", NO, NO, NO) for x in dims.LOADERS]
    assert "loader-unrecognised" not in [v[1] for v in sites(spark, rows)]


def test_references(spark):
    paths = spark.createDataFrame([("a/m.pt",), ("b/m.pt",), ("c/n.pkl",)], "path string")
    wanted = {"a/m.pt": "a/m.pt", "./c/n.pkl": "c/n.pkl", "n.pkl": "c/n.pkl", "m.pt": "missing:m.pt", "org/x": "hf:org/x", "x/y.onnx": "missing:x/y.onnx", "x/y.txt": None, "config/index.yaml": None, "org/_x-1": "hf:org/_x-1", "org/x.v2": None, "word": None, "a\\m.pt": "a/m.pt"}
    rows = A.resolve_references(spark.createDataFrame([(k,) for k in wanted], "literal string"), paths).collect()
    assert {r["literal"]: r["target"] for r in rows} == wanted


def test_evidence_binding(spark):
    arts = spark.createDataFrame([(1, "a/m.pt", "ab" * 32, "full"), (2, "b/m.pt", "cd" * 32, "full"), (3, "c/n.pkl", "ef" * 32, "head-tail")], "artifact_id long, locator string, digest string, coverage string")
    rows = [(1, "a/m.pt", "AB" * 10), (2, "repo/b/m.pt", "ab" * 10), (3, "m.pt", None), (4, "n.pkl", "ef" * 32), (5, "x/n.pkl", None), (6, "a/m.pt", "ab"), (7, "none", None)]
    got = {r["seq"]: (r["artifact_id"], r["binding"]) for r in E.bind(spark.createDataFrame(rows, "seq int, subject string, subject_digest string"), arts).collect()}
    assert got == {1: (1, "current"), 2: (2, "stale"), 4: (3, "unbound"), 5: (3, "unbound"), 6: (1, "unbound")}


def test_context_cascade(spark):
    rows = [("tests/x.py", []), ("a/Dockerfile", []), (".github/workflows/x.yml", []), ("a/b.ipynb", []), ("src/x.py", ["flask"]), ("src/y.py", ["mlflow"]), ("prod/test_x.py", []), ("demo/z.py", ["flask"])]
    df = spark.createDataFrame(rows, "f string, w array<string>")
    got = [tuple(r["e"]) for r in df.select(C.environment(F.col("f"), F.col("w"), [("production", ["prod/**"])]).alias("e")).collect()]
    assert got == [("test", "path"), ("build", "path"), ("ci", "path"), ("notebook", "path"), ("service", "framework"), ("unresolved", "unresolved"), ("production", "declared"), ("sandbox", "path")]


def test_signals(spark):
    text = "x\nkey = os.getenv('API_TOKEN')\nsubprocess.run(['x'])\nsubprocess.run(['y'])\nrequests.get(u)\n" + "z" * 5000 + " hvac.Client"
    rows = C.signals(spark.createDataFrame([("a.py", text), ("b.py", None)], "path string, text string")).collect()
    assert sorted((r["kind"], r["line"]) for r in rows) == [("network-egress", 5), ("process-execution", 3), ("secret-material", 2)]


def test_nearest_binding_falls_forward(spark):
    calls = spark.createDataFrame([("s", "x", 1, 1), ("s", "x", 5, 2), ("s", "y", 5, 3)], "scope string, name string, at int, call long")
    bound = spark.createDataFrame([("s", "x", 3, "first"), ("s", "x", 5, "second")], "scope string, name string, at int, expr string")
    assert {r["call"]: r["bound"] for r in C.nearest_binding(calls, bound).collect()} == {1: "first", 2: "second", 3: None}


def test_many_sites_of_one_artifact(spark):
    rows = spark.range(40_000).select(F.lit(1).cast("long").alias("artifact_id"), F.lit("torch.load").alias("loader"), F.col("id").alias("l"), B.verdict("data").alias("verdict"))
    rows = rows.withColumn("verdict", F.when(F.col("l") == 77, B.verdict("code")).otherwise(F.col("verdict")))
    assert [(r["verdict"]["behaviour"], r["sites"], r["inconsistent"]) for r in B.headline(rows, ["l"]).collect()] == [("code", 40_000, True)]


def test_canonical_json():
    assert bom.canonical_json({"b": [1.0, None, float("nan")], "a": {"é": "\x1b"}}) == '{"a":{"é":"\\u001b"},"b":[1,null,null]}'
    deep: list = []
    for _ in range(300):
        deep = [deep]
    with pytest.raises(ValueError, match="deeper"):
        bom.canonical_json(deep)


def test_digest_does_not_depend_on_partitions(spark, sf):
    records = P.records(spark, sf)
    one = bom.digest(bom.rows(records))
    assert one == bom.digest(bom.rows(records).repartition(7)) and len(one) == 64


def test_text_and_diff_lines(spark, sf):
    records = P.records(spark, sf)
    lines = [r["line"] for r in bom.text_lines(bom.rows(records)).collect()]
    assert len(lines) == records.count()
    before, after = P.bills(spark, sf)
    signs = {r["line"][0] for r in DF.text_lines(before, after).collect()}
    assert signs == {"+", "-", "~"}
    assert DF.changes(before, before).count() == 0


def test_filters():
    f = explore.Filters().toggled("behaviour", "code").toggled("format", "onnx")
    assert f.active == 2 and f.toggled("behaviour", "code").active == 1 and explore.PRESETS["clear"].active == 0


def test_component_with_a_cycle(spark):
    links = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("d", "e")], "from string, to string")
    assert sorted(map(tuple, graph.component(links, "a").collect())) == [("a", 0), ("b", 1), ("c", 1)]
    assert [tuple(r) for r in graph.component(links, "z").collect()] == [("z", 0)]


def test_no_loader_of_artifacts_is_imported():
    import re
    from pathlib import Path

    for p in (Path(__file__).resolve().parent.parent / "loadscope").rglob("*.py"):
        assert not re.search(r"^\s*(import|from)\s+(pickle|torch|marshal|yaml|zipfile|dill|joblib)\b", p.read_text(), re.M), p
