"""The command line over a small project, and what the analysis says beside records."""

from __future__ import annotations

import json
import pickle

import pytest

from loadscope import cli
from loadscope.functions import text as X
from loadscope.operators import behaviour as B
from loadscope.operators import explore
from loadscope.operators import records as R
from loadscope.plans.analyze import Report, counts, notices
from loadscope.sources import probes, walk
from loadscope.sources.config import Config
from loadscope.sources.errors import AnalysisError
from pyspark.sql import functions as F


@pytest.fixture
def project(tmp_path):
    files = {
        "requirements.txt": b"torch==2.6.0\n",
        "src/api.py": b'import pickle, torch\nNAME = "a"\ndef load():\n    return pickle.load(open(f"weights/{NAME}.pkl", "rb"))\ntorch.load("gone/x.pt")\n',
        "weights/a.pkl": pickle.dumps({"a": 1}, 4),
        "agents/one.md": b"---\nname: same\n---\nfirst",
        "agents/two.md": b"---\nname: same\ntools: Read\n---\nsecond",
        "broken.ipynb": b"{",
        "security/evidence.json": json.dumps({"records": [{"scanner": "s", "subject": "weights/a.pkl", "result": "pass"}]}).encode(),
    }
    for name, raw in files.items():
        (tmp_path / "p" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "p" / name).write_bytes(raw)
    (tmp_path / "p" / "link.py").symlink_to("/etc/passwd")
    return tmp_path / "p"


def run(capsys, *args):
    code = cli.main([str(a) for a in args])
    return code, capsys.readouterr().out.splitlines()


@pytest.fixture
def found(spark):
    """A small analysis, given as it is."""
    arts = spark.createDataFrame(
        [("w/a.pkl", "w/a.pkl", "pickle", "magic", "in-tree", False, "ab" * 32, "full", False), ("w/b.onnx", "w/b.onnx", "onnx", "magic", "in-tree", False, None, "full", False)],
        "artifact_id string, locator string, format string, basis string, origin string, mismatch boolean, digest string, coverage string, notable boolean",
    )
    sites = spark.createDataFrame([("src/a.py", 4, 0, "pickle.load", "w/a.pkl"), ("test/b.py", 2, 0, "onnxruntime.InferenceSession", "w/b.onnx")], "file string, line int, pos int, loader string, artifact_id string")
    sites = sites.withColumn("verdict", F.when(F.col("line") == 4, B.verdict("code")).otherwise(B.verdict("data")))
    contexts = spark.createDataFrame([("src/a.py", "production", "declared", True, ["secret-material"]), ("test/b.py", "test", "path", False, [])], "file string, environment string, basis string, privileged boolean, privileges array<string>")
    evidence = spark.createDataFrame([(1, "w/a.pkl", "pass", "s", "w/a.pkl", "unbound")], "seq int, subject string, result string, scanner string, artifact_id string, binding string")
    notices = spark.createDataFrame([("link.py", "link-skipped")], "path string, code string")
    records = R.build(arts, sites, contexts, evidence, ["file", "line", "pos"])
    return Report(arts, sites, contexts, evidence, records, notices, spark.range(1).toDF("walked"))


def test_commands(found, capsys, tmp_path, monkeypatch):
    monkeypatch.setattr(cli, "report", lambda *_: found)
    code, lines = run(capsys, "scan", "p")
    assert code == 0 and any(x.startswith("code ") for x in lines) and "environments: Production 1, Test 1" not in lines and "environments: production 1, test 1" in lines and "link-skipped: link.py" in lines
    assert [x.split()[:2] for x in run(capsys, "loadpaths", "p")[1]] == [["!", "src/a.py"], ["test/b.py", "test"]]
    assert run(capsys, "evidence", "p")[1] == ["absent: 0", "unbound: 1", "s: 1 records on 1 artifacts"]
    code, lines = run(capsys, "explain", "p", "a.pkl")
    assert code == 0 and lines[0] == "w/a.pkl  pickle (magic)  code" and "  src/a.py:4 pickle.load" in lines and "  act: privileged-execution-surface" in lines
    assert run(capsys, "explain", "p", "no such") == (2, [])
    assert run(capsys, "plan", "p")[1][0] == "## conversion-available\n"[:-1]
    out = tmp_path / "bill.json"
    assert run(capsys, "bom", "p", "--out", out)[1] == []
    doc = json.loads(out.read_text())
    assert [e["artifact_id"] for e in doc["entries"]] == ["w/a.pkl", "w/b.onnx"] and doc["summary"]["artifacts"] == 2 and len(doc["digest"]) == 64 and doc["entries"][0]["privileges"] == "secret-material"
    assert run(capsys, "migrations", "p", "--quiet", "--fail-on", "execution") == (1, [])
    assert len(json.loads("".join(run(capsys, "bom", "p", "--format", "cyclonedx")[1]))["components"]) == 2
    old, new = tmp_path / "old", tmp_path / "new"
    run(capsys, "bom", "p", "--format", "lines", "--out", old)
    new.write_text("\n".join(old.read_text().splitlines()[1:]) + "\n")
    assert run(capsys, "diff", old, new)[0] == 2


def test_an_empty_folder_is_an_error(spark, tmp_path):
    assert cli.main(["scan", str(tmp_path)]) == 2


def test_a_tree_has_to_be_of_some_size(spark, project, monkeypatch):
    spark.dataSource.register(walk.TreeSource)
    entries = spark.read.format("tree").option("root", str(project)).load()
    assert walk.check(entries, str(project)) == 8
    monkeypatch.setattr(walk, "MOST_ENTRIES", 3)
    with pytest.raises(AnalysisError, match="more than 3"):
        walk.check(entries, str(project))


def test_notices_and_counts(spark):
    """Those of files whose content is given: nothing is scanned for them."""
    files = walk.memory(spark, {"a.py": "x = 1\n", "broken.ipynb": "{", "good.ipynb": '{"cells": []}'})
    extension = X.extname(F.col("path"))
    scope = files.withColumn("head", F.col("content"))
    assert [tuple(r) for r in notices(files, scope, extension, Config()).collect()] == [("broken.ipynb", "unparsed")]
    assert tuple(counts(files, scope).first()) == (3, 3, 3, 20)


def test_files_are_hashed_in_pieces(spark, project, tmp_path):
    import hashlib

    entries = spark.createDataFrame([("weights/a.pkl", 1, False), ("../outside", 1, False), ("gone", 1, False), ("l", 0, True)], "path string, size long, link boolean")
    (tmp_path / "outside").write_bytes(b"x")
    got = {r["path"]: (r["digest"], r["content"]) for r in walk.read_files(entries, str(project)).collect()}
    raw = (project / "weights/a.pkl").read_bytes()
    assert got == {"weights/a.pkl": (hashlib.sha256(raw).hexdigest(), bytearray(raw)), "../outside": (None, None), "gone": (None, None), "l": (None, None)}


def test_small_helpers(spark):
    rows = spark.createDataFrame([(0, ["a", "os.system", "b"]), (1536, []), (5 << 30, [])], "n long, names array<string>")
    assert [tuple(r) for r in rows.select(X.human_bytes(F.col("n")), probes.notable_first(F.col("names"))).collect()] == [("0 B", ["os.system", "a", "b"]), ("1.5 KiB", []), ("5.00 GiB", [])]
    assert explore.toggled_sort("artifact", False, "artifact") == ("artifact", True) and explore.toggled_sort("artifact", True, "format") == ("format", False)
    assert explore.Filters(behaviour=("code", "data"), privileged=True).active == 3
    items = spark.createDataFrame([("go", "Scan tree", "s", 1), ("go", "Open bill", "b", 2)], '"group" string, label string, hint string, place int'.replace('"', "`"))
    assert [r["label"] for r in explore.commands(items, "GO bill").collect()] == ["Open bill"]


def test_calls_of_long_lines_take_linear_time(spark):
    import time

    def taken(n):
        rows = spark.createDataFrame([("a" * n + " " + "b1.c(" * 3,)], "t string")
        best = []
        for _ in range(3):
            began = time.perf_counter()
            assert rows.select(X.call_names(F.col("t"))).first()[0] == ["b1.c"] + ["b1.c"] * 2
            best.append(time.perf_counter() - began)
        return min(best)

    assert taken(80_000) < 8 * taken(20_000) + 1.0
