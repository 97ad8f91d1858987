from __future__ import annotations

import json
import pickle

from loadscope.operators import summary as S
from loadscope.plans.analyze import analyze
from loadscope.sources import walk
from loadscope.sources.config import Config

API = '''from flask import Flask
import os, pickle, subprocess
from transformers import AutoModel
app = Flask(__name__)
secret = os.environ["API_TOKEN"]
def load():
    with open("weights/a.pkl", "rb") as h:
        return pickle.load(h)
AutoModel.from_pretrained("org/model")
'''


TENSORS = json.dumps({"__metadata__": {"format": "pt"}, "w": {"dtype": "F32", "shape": [1], "data_offsets": [0, 4]}, "v": {"dtype": "F32", "shape": [1], "data_offsets": [4, 8]}, "b": {"dtype": "I8", "shape": [1], "data_offsets": [7, 8]}}).encode()
HEADER = len(TENSORS).to_bytes(8, "little") + TENSORS + bytes(8)


def test_a_small_project(spark):
    digest = __import__("hashlib").sha256(pickle.dumps({"a": 1}, 4)).hexdigest()
    files = {
        "requirements.txt": "torch==2.6.0\n",
        "src/api.py": API,
        "tests/test_a.py": 'import torch\ntorch.load("weights/b.pt")\ntorch.load(name)\n',
        "weights/a.pkl": pickle.dumps({"a": 1}, 4),
        "weights/b.pt": pickle.dumps({"a": 1}, 2),
        "weights/b.safetensors": HEADER,
        "prompts/x.md": "Say {{word}}",
        "security/evidence.json": json.dumps({"records": [{"scanner": "s", "subject": "weights/a.pkl", "sha256": digest, "result": "pass"}]}),
        "ignored/z.py": 'import torch\ntorch.load("weights/a.pkl")\n',
    }
    report = analyze(walk.memory(spark, files), Config((("production", ("src/**",)),), ("ignored/**",)))
    got = {r["artifact_id"]: (r["format"], r["behaviour"], r["environments"], r["privileged"], r["alternative"]["kind"], r["evidence_state"]) for r in report.records.collect()}
    assert got == {
        "weights/a.pkl": ("pickle", "code", ["production"], True, "conversion-available", "bound"),
        "weights/b.pt": ("pytorch-legacy", "guarded", ["test"], False, "sibling-present", "absent"),
        "weights/b.safetensors": ("safetensors", "data", [], False, "none-identified", "absent"),
        "hf:org/model": ("remote-repository", "unknown", ["production"], True, "loader-guard-available", "absent"),
        "prompt:x": ("prompt-template", "directive", ["unresolved"], False, "none-identified", "absent"),
    }
    assert {r["artifact_id"]: r["dtypes"] for r in report.records.where("dtypes is not null").collect()} == {"weights/b.safetensors": ["2 F32", "1 I8"]}
    assert sorted((r["name"], r["problem"]) for r in report.tensors.collect()) == [("b", "overlapping"), ("v", None), ("w", None)] and report.metadata.collect() == [("weights/b.safetensors", "format", "pt")]
    assert report.sites.where("artifact_id is null").count() == 1 and report.project is None
    assert not report.records.where(S.gate(report.records, "privileged")).isEmpty()


def test_an_empty_tree(spark):
    files = spark.createDataFrame([], "path string, size long, link boolean, content binary")
    assert analyze(files).records.count() == 0


def test_each_file_is_read_once(spark, tmp_path):
    """Bytes are read by a function that leaves a mark for each file; relations of the report are read afterwards, several times."""
    from pyspark.sql import functions as F

    names = {"src/a.py": "import torch\nX = 'w.pt'\ntorch.load(X)\n", "w.pt": "x", "n.ipynb": json.dumps({"cells": [{"cell_type": "markdown", "source": "t"}, {"cell_type": "code", "source": "x = 1"}, {"cell_type": "code", "source": "import pickle\npickle.load('w.pt')"}]}), ".mcp.json": '{"mcpServers":\n{"a": {"command": "x"}}}', "e/evidence.json": '{"records": [{"subject": "w.pt", "scanner": "s", "result": "pass"}]}'}
    marks = str(tmp_path)

    def read(batches):
        import uuid

        for batch in batches:
            for path in batch["path"]:
                with open(f"{marks}/{path.replace('/', '_')}-{uuid.uuid4().hex}", "w"):
                    pass
            yield batch.assign(content=[names[p].encode() for p in batch["path"]])

    rows = spark.createDataFrame([(p, len(t), False) for p, t in names.items()], "path string, size long, link boolean")
    heard = []
    report = analyze(rows.mapInPandas(read, "path string, size long, link boolean, content binary"), progress=lambda stage, counted: heard.append((stage, counted)))
    for _ in range(2):
        sites = {(r["file"], r["line"]): (r["site"], r["cell"], r["artifact_id"]) for r in report.sites.collect()}
        assert report.records.count() == 2 and report.notices.count() == 0 and report.counts.first()["walked"] == 5
    assert sites == {(".mcp.json", 2): ("ls-1", None, "mcp:a"), ("n.ipynb", 4): ("ls-2", 2, "w.pt"), ("src/a.py", 3): ("ls-3", None, "w.pt")}
    assert report.evidence.first()["id"] == "ev-1"
    assert sorted(p.name.split("-")[0] for p in tmp_path.iterdir()) == sorted(n.replace("/", "_") for n in names)
    assert [s for s, c in heard if c is None] == ["walk", "dependencies", "load-sites", "artifacts", "behaviour", "context", "evidence", "evidence", "bom"]
    assert report.stages == {"walk": {"files": 5}, "dependencies": {"declared": 0, "pinned": 0}, "load-sites": {"calls": 2, "files": 2}, "artifacts": {"artifacts": 2, "in_tree": 2}, "behaviour": {"sites": 3, "code": 2, "unknown": 1}, "context": {"contexts": 3, "privileged": 0}, "evidence": {"read": 1, "bound": 1}, "bom": {"records": 2, "code": 2}}
