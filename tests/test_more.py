from __future__ import annotations

import json

import pytest

from loadscope.operators import explore
from loadscope.operators.diff import FIELDS
from loadscope.operators.numbering import numbered
from loadscope.plans import derived as P
from loadscope.sources import bills, manifests
from loadscope.sources.errors import AnalysisError


def test_numbers_go_on_over_ranges(spark):
    rows = spark.range(0, 1000).selectExpr("(id * 7919) % 1000 as k").repartition(6)
    got = numbered(rows, ["k"], "n").collect()
    assert sorted((r["k"], r["n"]) for r in got) == [(i, i + 1) for i in range(1000)]
    assert numbered(rows.limit(0), ["k"], "n", "x-").count() == 0


def test_lookup(spark, sf):
    records = P.artifacts(spark, sf)
    row = records.orderBy("artifact_id").first()
    assert explore.lookup(records, row["locator"]).first()["artifact_id"] == row["artifact_id"]
    assert explore.lookup(records, row["locator"].split("/")[-1]).first()["artifact_id"] == row["artifact_id"]
    assert explore.lookup(records, "7").first()["artifact_id"] == 7 and explore.lookup(records, "no such thing").count() == 0


def test_project_name(spark):
    name = lambda *files: manifests.project_name(spark.createDataFrame([*files], "path string, text string"), "folder").first()["name"]
    assert name(("package.json", '{"name": "web"}'), ("pyproject.toml", '[project]\nversion = "1"\nname = "core"\n')) == "core"
    assert name(("package.json", '{"name": "web"}'), ("pyproject.toml", "[tool.x]\nname = 'no'\n")) == "web"
    assert name(("src/package.json", '{"name": "web"}')) == "folder"


def test_bills_are_checked(spark, tmp_path):
    good = dict.fromkeys(FIELDS, "x") | {"artifact_id": "a", "behaviour": "code", "sites": 1, "privileged": True}
    path = tmp_path / "a.json"
    path.write_text(json.dumps(good) + "\n")
    assert bills.read(spark, str(path)).count() == 1
    for bad in (good | {"sites": None}, good | {"behaviour": "odd"}, {k: v for k, v in good.items() if k != "artifact_id"}):
        path.write_text(json.dumps(good) + "\n" + json.dumps(bad) + "\n")
        with pytest.raises(AnalysisError):
            bills.read(spark, str(path))
    path.write_text("{broken\n")
    with pytest.raises(AnalysisError, match="not JSON"):
        bills.read(spark, str(path))


def test_both_forms_of_a_bill_are_read(spark, tmp_path):
    from loadscope.operators import bom

    rows = spark.createDataFrame([dict.fromkeys(FIELDS, "x") | {"artifact_id": a, "locator": a, "behaviour": "code", "sites": 1, "privileged": True} for a in ("a", "b,c", "d]}")], bills.SCHEMA.replace(", _broken string", ""))
    want = sorted(map(tuple, rows.select("artifact_id", "locator", *FIELDS).collect()))
    (tmp_path / "doc.json").write_text("\n".join(bom.document(rows, {"artifacts": 3}, "p")) + "\n")
    (tmp_path / "pretty.json").write_text(json.dumps(json.loads((tmp_path / "doc.json").read_text()), indent=2))
    bom.spread(rows, "lines").write.text(str(tmp_path / "lines"))
    for name in ("doc.json", "pretty.json", "lines"):
        assert sorted(map(tuple, bills.read(spark, str(tmp_path / name)).collect())) == want, name
    (tmp_path / "empty.json").write_text("\n".join(bom.document(rows.limit(0), {}, "p")) + "\n")
    assert bills.read(spark, str(tmp_path / "empty.json")).count() == 0


def test_one_key_over_many_ranges(spark):
    """All rows of one key: what ranges leave to later ones is carried on, forwards and back."""
    from loadscope.operators import asof

    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        known = spark.range(500, 50_000, 7_000).selectExpr("'k' as k", "id as at", "concat('v', id) as v")
        asks = spark.range(0, 60_000, 11).selectExpr("'k' as k", "id as at", "id as n")
        spread = asof.dealt(asks, ["k", "at"])
        assert spread.select("_range").distinct().count() > 1
        points = [r["at"] for r in known.collect()]
        got = {r["n"]: r["v"] for r in asof.nearest(asks, known, ["k"], "at", "v").collect()}
        assert got == {n: f"v{max([p for p in points if p <= n], default=min(points))}" for n in range(0, 60_000, 11)}
        scopes = spark.createDataFrame([("f", i * 13, i % 9, f"s{i}") for i in range(3000)], "file string, at long, indent int, name string")
        sites = spark.createDataFrame([("f", i, i * 17 + 5, (i * 5) % 11 if i % 50 else None) for i in range(2500)], "file string, site long, at long, indent int")
        last, want = {}, {}
        events = sorted([(i * 13, 0, i % 9, f"s{i}") for i in range(3000)] + [(i * 17 + 5, 1, (i * 5) % 11 if i % 50 else None, i) for i in range(2500)], key=lambda e: e[:2])
        for _, side, indent, what in events:
            if side:
                below = [d for d in last if indent is not None and d < indent]
                want[what] = last[max(below)] if below else None
            else:
                last[indent] = what
        assert {r["site"]: r["enclosing"] for r in asof.deepest(sites, scopes).collect()} == want
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_rules_in_blocks_equal_rules_at_once(spark, monkeypatch):
    from loadscope.operators import rules
    from loadscope.operators.artifacts import match_loader
    from loadscope.plans import dims
    from pyspark.sql import functions as F

    names = ["pickle.loads", "torch.load", "transformers.AutoModel.from_pretrained", "load_model", "none", "safetensors.torch.load_file", None]
    rows = spark.createDataFrame([(n, "py") for n in names] + [("tf.loadGraphModel", "js")], "canonical string, ecosystem string")
    given = spark.createDataFrame([(i, eco, p, loader) for i, (loader, eco, _, _, p) in enumerate(dims.LOADERS)], "priority int, ecosystem string, pattern string, loader string")
    want = sorted(map(repr, rows.select("canonical", "ecosystem", match_loader(F.col("canonical"), F.col("ecosystem")).alias("loader")).collect()))
    for n in (512, 5):
        monkeypatch.setattr(rules, "AT_ONCE", n)
        assert sorted(map(repr, rules.first_rule(rows, given, "canonical", ["loader"], ["ecosystem"]).collect())) == want


def test_headers_of_tensors(spark):
    import struct

    from loadscope.sources import tensors

    def made(doc, extra=0, cut=None):
        text = doc if isinstance(doc, bytes) else json.dumps(doc).encode()
        raw = struct.pack("<Q", len(text)) + text + bytes(extra)
        return len(raw), bytearray(raw[:cut])

    cases = {
        "whole": made({"__metadata__": {"format": "pt", "n": 3, "\x07": "x" * 300}, "w": {"dtype": "F32", "shape": [2, 2], "data_offsets": [0, 16]}, "v": {"dtype": "F16", "shape": [1], "data_offsets": [16, 18]}}, 18),
        "bad": made({"a": {"dtype": "F32", "shape": [2], "data_offsets": [0, 8]}, "b": {"dtype": "F32", "shape": [2], "data_offsets": [4, 12]}, "c": {"dtype": "F32", "shape": [2], "data_offsets": [100, 108]}, "d": {}, "e": 3, "prototype": {}}, 12),
        "truncated": made({"a": {"dtype": "F32", "shape": [2], "data_offsets": [0, 8]}}, 8, 20), "broken": made(b"{nope}", 1), "none": (5, bytearray(b"abcde")), "null": (5, None),
        "oversize": (1 << 40, bytearray(struct.pack("<Q", 17 << 20) + b"{}")), "beyond": (10, bytearray(struct.pack("<Q", 1 << 60) + b"{}")), "negative": (10, bytearray(b"\xff" * 8 + b"{}")),
    }
    found = tensors.headers(spark.createDataFrame([(k, s, h) for k, (s, h) in cases.items()], "path string, size long, head binary"))
    assert {r["path"]: r["state"] for r in found.collect()} == {"whole": "whole", "bad": "whole", "truncated": "truncated", "broken": "broken", "none": "none", "null": "none", "oversize": "oversize", "beyond": "none", "negative": "none"}
    rows = {(r["path"], r["name"]): r["problem"] for r in tensors.tensors(found).collect()}
    assert rows == {("whole", "w"): None, ("whole", "v"): None, ("bad", "a"): None, ("bad", "b"): "overlapping", ("bad", "c"): "outside", ("bad", "d"): "shape", ("bad", "e"): "shape"}
    assert sorted(map(tuple, tensors.metadata(found).collect())) == [("whole", "format", "pt"), ("whole", "�", "x" * 255 + "…")]
    assert sorted(map(tuple, tensors.dtypes(tensors.tensors(found)).where("path = 'whole'").collect())) == [("whole", "F16", 1, 0), ("whole", "F32", 1, 0)]
