from __future__ import annotations

import json
import os
import pickle
import struct
import time
import zipfile
from io import BytesIO

import pytest

from loadscope.operators import deps as D
from loadscope.operators import loads as L
from loadscope.operators.shared import stored
from loadscope.sources import config, declarations, documents, manifests, notebook, probes, scanner, walk
from loadscope.sources.errors import AnalysisError

PY = '''import torch
from joblib import load as jl
ROOT = "models"  # pickle.load(x)
def serve(path):
    """torch.load('no')"""
    with open("a/b.pkl", "rb") as h:
        m = pickle.load(h)
    return torch.load(ROOT + "/x.pt", weights_only=False)
class K:
    def go(self):
        return jl(Path(ROOT) / "z.joblib")
torch.load(
'''


def calls(spark, *texts, ext="py"):
    """(line, enclosing, loader, args, literal) of the loads of each text, by place; all texts in one run."""
    files = spark.createDataFrame([(f"f{i}.{ext}", t) for i, t in enumerate(texts)], "path string, text string")
    rows = L.loads(stored(scanner.read(files)), files).collect()
    return [[(r["line"], r["enclosing"], r["loader"], r["args"], r["literal"]) for r in sorted(rows, key=lambda r: r["pos"]) if r["file"] == f"f{i}.{ext}"] for i in range(len(texts))]


FOLDED = [('f"models/{NAME}.pt"', "models/m.pt"), ('f"{ROOT}/{NAME:>3}"', "w/m"), ('f"a{{b}}"', "a{b}"), ('f"x{other()}"', None), ('f"x{NAME"', None), ('f"x{unknown}"', None), ('Path(f"{ROOT}") / NAME', "w/m"), ("unknown", None), ("f=ROOT", "w"), ('f="k.pt"', "k.pt"), ("DEEP", "w/m"), ("ROUND", None)]


def test_python_calls(spark):
    head = 'import torch\nfrom pathlib import Path as P\nROOT = "w"\nNAME = "m"\nHALF = ROOT\nDEEP = P(HALF, NAME)\nROUND = TURN\nTURN = ROUND\n'
    scopes = "import torch\ndef a():\n    class B:\n        def c(self):\n            torch.load(1)\n        torch.load(2)\n    torch.load(3)\ntorch.load(4)\ndef d():\n    torch.load(5)\n"
    texts = [PY, head + "".join(f"torch.load({e})\n" for e, _ in FOLDED), "import torch\ntorch.load(x]\n", "import torch\ntorch.load(x)\ntorch.load([y)\n", scopes, "import torch.nn as n, torch as t\nn.load(1)\nt.load(2)\nfrom torch import load as n\nn(3)\n"]
    plain, folded, none, one, scoped, aliased = calls(spark, *texts)
    assert plain == [
        (7, "serve", "pickle.load", {}, "a/b.pkl"),
        (8, "serve", "torch.load", {"weights_only": "false"}, "models/x.pt"),
        (11, "go", "joblib.load", {}, "models/z.joblib"),
    ]
    assert [c[4] for c in folded] == [want for _, want in FOLDED]
    assert none == [] and len(one) == 1
    assert [c[1] for c in scoped] == ["c", "B", "a", None, "d"]
    assert [c[0] for c in aliased] == [3, 5]  # of an alias given twice the last counts, so n.load is torch.load.load


def test_javascript_calls(spark):
    js = 'import { pipeline as p } from "@x/transformers"\nimport * as ort from "onnxruntime-node"\nconst f = "m.onnx"\n// p("no")\nort.InferenceSession.create(f)\np("task", "org/x")\n'
    inner = "function a() {\n  tf.loadGraphModel('x')\n}\ntf.loadGraphModel('y')\n"
    first, second = calls(spark, js, inner, ext="js")
    assert [(c[2], c[4]) for c in first] == [("js.onnxruntime", "m.onnx"), ("js.transformers.from_pretrained", "task")]
    assert [c[1] for c in second] == ["a", "a"]


@pytest.mark.parametrize("text", ["a" * 2_000_000, "torch.load(" * 50_000, "x = f(1) " * 200_000, '"' * 100_000, "(" * 300_000, "def f():\n" * 100_000, "x = 1\n" * 200_000])
def test_scan_is_linear(text):
    began = time.time()
    assert not any(r[5] == "torch.load" for r in scanner.rows("f.py", text) if r[1] == "call")
    assert time.time() - began < 20


def test_many_scopes_and_bindings_of_one_file(spark):
    n = 20_000
    text = "import torch\n" + "".join(f"def f{i}():\n    x = 'a{i}'\n    torch.load(x)\n" for i in range(n))
    (found,) = calls(spark, text)
    assert [(c[1], c[4]) for c in found] == [(f"f{i}", f"a{i}") for i in range(n)]


def test_rows_of_source(spark):
    files = spark.createDataFrame([("a.py", "import b.c as d, e\nfrom f import g\n# import no\n"), ("a.ts", "import {x} from 'y/z'\nconst q = require('r')\n"), ("b.py", ""), ("n.py", None), (None, PY)], "path string, text string")
    found = scanner.read(files)
    assert {r["file"]: r["names"] for r in scanner.imports(found).collect()} == {"a.py": ["b.c", "e", "f"], "a.ts": ["r", "y/z"]}
    assert {r["file"] for r in found.select("file").distinct().collect()} == {"a.py", "a.ts"}


def test_given_loader_rules(spark):
    rules = spark.createDataFrame([(1, "py", r"^mine\.load$", "mine", [1], ["where"]), (2, "py", r"load$", "other", [0], [])], "priority int, ecosystem string, pattern string, loader string, positions array<int>, keywords array<string>")
    files = spark.createDataFrame([("a.py", 'import mine as m\nm.load(1, "a")\nm.load(where="b")\nother.load("c")\n')], "path string, text string")
    got = sorted((r["line"], r["loader"], r["literal"]) for r in L.loads(scanner.read(files), files, rules).collect())
    assert got == [(2, "mine", "a"), (3, "mine", "b"), (4, "other", "c")]


class Evil:
    def __reduce__(self):
        return os.system, ("true",)


def test_pickle_walk():
    protocol, names, invokes, how, cut = probes.walk_pickle(pickle.dumps(Evil(), 4))
    assert (protocol, names, invokes, how, cut) == (4, [f"{os.system.__module__}.system"], True, ["REDUCE"], False)
    assert probes.walk_pickle(pickle.dumps({"a": [1, "x"]}, 4))[1:3] == ([], False)
    assert probes.walk_pickle(b"\x80\x04cos\n")[4]
    assert probes.walk_pickle(b"\x80\x04X\xff\xff\xff\xffab")[4]
    assert probes.walk_pickle(b"\x80\x04" + b"\x94" * 30_000)[4]


def archive(**members):
    raw = BytesIO()
    with zipfile.ZipFile(raw, "w") as z:
        for name, data in members.items():
            z.writestr(name.replace("__", "/").replace("_", "."), data)
    return raw.getvalue()


def test_probes_and_classes(spark):
    header = json.dumps({"w": {"dtype": "F32"}, "__metadata__": {}}).encode()
    files = {
        "a.pt": archive(archive__data_pkl=b"x"),
        "b.bin": archive(m__code__x_py=b"x", m__data_pkl=b"y"),
        "c.keras": archive(config_json=b"{}"),
        "d.safetensors": struct.pack("<Q", len(header)) + header,
        "e.safetensors": b"\x89HDF\r\n\x1a\n" + bytes(8),
        "f.pkl": pickle.dumps([1], 4),
        "g.onnx": b"",
        "h.pth": pickle.dumps([1], 2),
        "i.npz": b"PK\x03\x04" + bytes(8),
        "j.safetensors": struct.pack("<Q", 1 << 60) + b"{}",
    }
    rows = [(p, len(c), bytearray(c), bytearray(c)) for p, c in files.items()]
    probed = probes.probe(spark.createDataFrame(rows, "path string, size long, head binary, tail binary"))
    got = {r["path"]: tuple(r["found"]) for r in probes.classified(probed).collect()}
    assert got == {
        "a.pt": ("pytorch-zip", "container", False), "b.bin": ("torchscript", "container", False), "c.keras": ("keras-v3", "container", False), "d.safetensors": ("safetensors", "magic", False),
        "e.safetensors": ("keras-h5", "magic", True), "f.pkl": ("pickle", "magic", False), "g.onnx": ("onnx", "extension", False), "h.pth": ("pytorch-legacy", "magic", False),
        "i.npz": ("numpy-npz", "container", False), "j.safetensors": ("safetensors", "extension", False),
    }


def test_walk(spark, tmp_path):
    for p in ("a.txt", ".hidden", "src/x.py", "src/node_modules/no.js", "build/no", "src/deep/empty"):
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text("" if p.endswith("empty") else "12345")
    (tmp_path / "link").symlink_to(tmp_path / "a.txt")
    rows = walk.tree(spark, str(tmp_path))
    assert sorted(map(tuple, rows.collect())) == [(".hidden", 5, False), ("a.txt", 5, False), ("link", 0, True), ("src/deep/empty", 0, False), ("src/x.py", 5, False)]
    edges = {r["path"]: (bytes(r["head"]), bytes(r["tail"])) for r in walk.read_edges(rows, str(tmp_path), 3).collect()}
    assert edges["a.txt"] == (b"123", b"345") and edges["src/deep/empty"] == (b"", b"")
    picked = spark.createDataFrame([("top/a", 1, False), ("top/node_modules/b", 1, False), ("c", 1, False)], "path string, size long, link boolean")
    assert [r["path"] for r in walk.picked(picked).collect()] == ["a"]
    assert walk.memory(spark, {"b": "é", "a": b"x"}).select("path", "size").collect() == [("a", 1), ("b", 2)]


def listed(spark, root, **options):
    return walk.tree(spark, str(root), **options)


def test_filters_go_into_the_walk(spark, tmp_path, monkeypatch):
    for i in range(200):
        (tmp_path / f"d{i % 20}/e{i}").mkdir(parents=True, exist_ok=True)
        (tmp_path / f"d{i % 20}/e{i}/f.py").write_text("x" * i)
    for p in ("gen/deep/no.py", "src/gen/yes.py", "src/node_modules/a/no.js", "dist/no", "d1/venv/no"):
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text("12345")
    (tmp_path / "src/link").symlink_to(tmp_path / "dist")
    plain = {tuple(r) for r in listed(spark, tmp_path).collect()}
    assert len(plain) == 203 and listed(spark, tmp_path).rdd.getNumPartitions() > walk.PARTITIONS
    for condition, holds in [
        ("path like 'd1%'", lambda p, s, l: p.startswith("d1")), ("not startswith(path, 'gen/') and not startswith(path, 'd')", lambda p, s, l: not p.startswith(("gen/", "d"))), ("size <= 7 and not link", lambda p, s, l: s <= 7 and not l),
        ("link", lambda p, s, l: l), ("startswith(path, 'src/gen/y') and size > 1", lambda p, s, l: p.startswith("src/gen/y") and s > 1), ("startswith(path, 'd1') and startswith(path, 'd11/')", lambda p, s, l: p.startswith("d11/")),
    ]:
        assert {tuple(r) for r in listed(spark, tmp_path).where(condition).collect()} == {r for r in plain if holds(*r)}, condition
    found = walk.without(listed(spark, tmp_path), ["gen/**", "*.md", "src/*/**"])
    assert {r["path"] for r in found.collect()} == {p for p, _, _ in plain if not p.startswith("gen/")}
    assert "Filter " not in found._jdf.queryExecution().executedPlan().toString()
    # an ignored folder isn't opened at all
    reader, opened = walk.TreeReader(str(tmp_path), False), []
    assert [*reader.pushFilters([walk.Not(walk.StringStartsWith(("path",), "gen/")), walk.EqualTo(("path",), "x")])] == [walk.EqualTo(("path",), "x")]
    scandir = walk.os.scandir
    monkeypatch.setattr(walk.os, "scandir", lambda p: opened.append(str(p)) or scandir(p))
    assert sum(1 for part in reader.partitions() for _ in reader.read(part)) == 202 and not any("/gen/" in f"{p}/" and "/src/" not in p for p in opened)
    monkeypatch.undo()
    skipped = sorted(r["path"] for r in listed(spark, tmp_path, list="skipped").collect())
    assert skipped == ["d1/venv", "dist", "src/node_modules"]
    assert [r["path"] for r in listed(spark, tmp_path, list="skipped").where("startswith(path, 'src/')").collect()] == ["src/node_modules"]


def test_dropped_and_picked_folders(spark):
    rows = spark.createDataFrame([("/top/a", 1, False), ("top/node_modules/x/b", 1, False), ("top/node_modules/c", 1, False), ("c", 1, False), ("", 1, False), ("l", 0, True), ("/".join("d" * 30), 1, False)], "path string, size long, link boolean")
    assert sorted(r["path"] for r in walk.dropped(rows).collect()) == ["c", "top/a"]
    assert sorted(map(tuple, walk.picked_skipped(rows.where("path like 'top/%'")).collect())) == [("node_modules", 2)]
    assert walk.decoded(spark.createDataFrame([("a", "aMOp"), ("b", None)], "path string, content string")).select("path", "content").collect() == [("a", bytearray("hé".encode())), ("b", None)]


def test_config():
    text = "environments:\n  production:\n    - 'src/**'\n  test:\n    - t/*\nignore:\n  - gen/**  # why\n"
    want = config.Config((("production", ("src/**",)), ("test", ("t/*",))), ("gen/**",), "c")
    assert config.parse_yaml(text, "c") == want
    assert config.parse_json(json.dumps({"environments": {"production": ["src/**"], "test": ["t/*"]}, "ignore": ["gen/**"]}), "c") == want
    for bad in ("\tx:", "nonsense:\n", "environments:\n  moon:\n    - a\n", "- a\n", "ignore:\n  - /abs\n", "ignore:\n  - a/../b\n", "environments: x\n"):
        with pytest.raises(AnalysisError):
            config.parse_yaml(bad, "c")
    for bad in ("{", "[]", '{"x": 1}', '{"ignore": "a"}', '{"environments": {"moon": []}}'):
        with pytest.raises(AnalysisError):
            config.parse_json(bad, "c")


def test_manifests(spark):
    files = {
        "requirements.txt": "torch==2.6.0  # pinned\n-r other\n\nNumpy[extra]>=1.2; python_version<'4'\n",
        "pyproject.toml": '[project]\nname = "x"\ndependencies = [\n  "keras~=3.1",\n  "torch",\n]\n[tool.poetry.dependencies]\npython = "^3"\nonnx = "^1.2"\n',
        "poetry.lock": '[[package]]\nname = "torch"\nversion = "2.5.1"\n[[package]]\nname = "keras"\nversion = "3.0"\n',
        "web/package.json": '{"dependencies": {"@a/tf": "^4.1"}}',
        "Pipfile.lock": '{"default": {"dill": {"version": "==0.3"}}}',
        "environment.yml": "name: x\ndependencies:\n  - scipy=1.9\n  - pip:\n    - joblib==1.3\n",
        "README.md": "torch==1.0",
    }
    rows = manifests.declared(spark.createDataFrame(list(files.items()), "path string, text string"))
    merged = {r["name"]: (r["version"], r["pin"]) for r in D.merge(rows).collect()}
    assert merged == {
        "torch": ("2.5.1", "exact"), "numpy": ("1.2", "range"), "keras": ("3.0", "exact"), "onnx": ("1.2", "range"), "tf": ("4.1", "range"), "dill": ("0.3", "exact"), "scipy": ("1.9", "exact"), "joblib": ("1.3", "exact"),
    }


def test_notebooks(spark):
    book = json.dumps({"cells": [{"cell_type": "code", "source": ["a = 1\n", "!pip x"]}, {"cell_type": "markdown", "source": "no"}, {"cell_type": "code", "source": "b = 2"}]})
    rows = notebook.read(spark.createDataFrame([("n", book), ("bad", "{"), ("null", None)], "path string, text string"))
    assert notebook.joined(rows).collect() == [("n", "a = 1\n\n\nb = 2\n")]
    cells = notebook.cells(rows)
    assert [(r["cell"], r["first_line"], r["n_lines"]) for r in cells.orderBy("at").collect()] == [(1, 1, 2), (2, 4, 1)]
    lines = spark.createDataFrame([("n", 2), ("n", 3), ("n", 4)], "notebook string, line int")
    assert sorted((r["line"], r["cell"]) for r in notebook.cell_of_line(cells, lines).collect()) == [(2, 1), (3, None), (4, 2)]


def test_declarations(spark):
    files = {
        "skills/triage/SKILL.md": "---\nname: triage\nallowed-tools: Bash, Read\n---\nRun scripts/go.py and scripts/go.py\n",
        "agents/sum.md": "---\ntools: Read\n---\nx",
        "prompts/c.md": "Say {{ticket}} {name}",
        ".mcp.json": '{"mcpServers": {"a": {"command": "npx"}, "b": {"url": "https://x"}}}',
        ".x/settings.json": '{"hooks": {"Post": [{"matcher": "*", "hooks": [{"type": "command", "command": "rm x"}]}]}}',
        "src/no.md": "x",
    }
    got = {r["artifact_id"]: (r["format"], r["behaviour"], r["facts"]) for r in declarations.declarations(spark.createDataFrame(list(files.items()), "path string, text string")).collect()}
    assert got == {
        "skill:triage": ("agent-skill", "directive", ["Bash", "Read", "scripts/go.py"]), "agent:sum": ("agent-definition", "directive", ["Read"]), "prompt:c": ("prompt-template", "directive", ["ticket", "name"]),
        "mcp:a": ("mcp-server-manifest", "code", ["npx"]), "mcp:b": ("mcp-server-manifest", "directive", ["https://x"]), "hook:Post:rm x": ("agent-definition", "code", ["rm x"]),
    }


def test_declarations_in_other_spellings(spark):
    spark.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    deep = "x"
    for i in range(40):
        deep = {"command": f"c{i}", "k": deep} if i % 2 else [deep]
    files = {
        "agents/a.md": '---\ntools: [Read, "a, b"]\nmodel: x\n---\nx', "agents/b.md": "---\nTools:\n- Read\n  # no item\n  - 'a, b'\n---\nx", "agents/c.md": "---\ntools: [old]\ntools:\n  - Read\n  - \"a, b\"\n---", "agents/d.md": "---\ntools: '*'\nprototype: y\n---\nx", "agents/e.md": "no block", "agents/f.md": "---\n---\n", "agents/g.md": "---\ntools: [x]\nnever closed",
        ".mcp.json": '{"x": 1,\n"mcpServers": {"a": {"command": "npx", "args": ["-y", 1, "q"], "env": {"K": "v", "__proto__": "z"}},\n "b": {"endpoint": "https://x"}, "constructor": {"command": "no"}, "z": 3}}',
        "a/settings.json": '{"hooks": {"A": {"command": "one", "command": "two"}, "__proto__": [{"command": "no"}], "B": 7, "C": {"command": 3, "x": {"y": [[{"z": {"command": "six"}}]], "deep": [[[{"z": {"command": "seven"}}]]]}}}}',
        "b/settings.json": json.dumps({"hooks": {"D": deep}}), "c/settings.json": "{", "d/settings.json": '{"hooks": []}',
    }
    found = declarations.declarations(spark.createDataFrame(list(files.items()), "path string, text string")).collect()
    agents = {r["path"][7]: (r["facts"], r["note"]) for r in found if r["path"].startswith("agents/")}
    star = "the tool grant is *: every tool of the host"
    assert agents == {**dict.fromkeys("abc", (["Read", "a, b"], None)), "d": (["*"], star), **dict.fromkeys("efg", ([], None))}
    assert sorted((r["name"], r["line"], r["facts"]) for r in found if r["path"] == ".mcp.json") == [("a", 2, ["npx -y q", "passes K"]), ("b", 3, ["https://x"])]

    def brute(value, depth=0):
        if depth > 6 or not isinstance(value, dict | list):
            return []
        if isinstance(value, list):
            return [c for v in value for c in brute(v, depth + 1)]
        own = [value["command"]] if isinstance(value.get("command"), str) else []
        return own + [c for k, v in value.items() if k not in documents.RESERVED for c in brute(v, depth + 1)]

    want = sorted((e, c) for p in "abd" for e, v in dict(json.loads(files[f"{p}/settings.json"])["hooks"] or {}).items() if e not in documents.RESERVED for c in brute(v))
    assert sorted((r["name"], r["facts"][0]) for r in found if r["path"].endswith("settings.json")) == want and ("A", "two") in want and ("C", "six") in want


def test_nodes_of_documents(spark):
    docs = ['{"a": [1, {"b": null}], "__proto__": {"c": 1}, "d": {"constructor": [2]}}', "[]", "3", "{"]
    rows = spark.createDataFrame([(i, d) for i, d in enumerate(docs)], "i int, t string").selectExpr("i", "try_parse_json(t) as value")
    depths = {}
    for r in documents.nodes(rows, 2).select("i", "depth").collect():
        depths.setdefault(r["i"], []).append(r["depth"])
    assert {k: sorted(v) for k, v in depths.items()} == {0: [0, 1, 1, 2, 2], 1: [0], 2: [0], 3: [0]}


def test_evidence_documents(spark):
    files = {
        "native.json": json.dumps({"records": [{"scanner": "s", "subject": "a.pkl", "sha256": "ab", "result": "odd"}, {"scanner": "s"}]}),
        "modelscan.json": json.dumps({"summary": {"scanned": {"scanned_files": ["x", "y"]}, "skipped": {"skipped_files": [{"source": "z"}]}}, "issues": [{"source": "x", "description": "bad"}, {"source": "w", "description": "worse"}]}),
        "picklescan.json": json.dumps({"results": [{"file": "p", "globals": ["os.system"]}, {"path": "q", "safety": "innocuous"}]}),
        "broken.json": "{",
    }
    got = sorted((r["scanner"], r["subject"], r["result"]) for r in documents.evidence(spark.createDataFrame(list(files.items()), "path string, text string")).collect())
    assert got == [("modelscan", "w", "flagged"), ("modelscan", "x", "flagged"), ("modelscan", "y", "pass"), ("modelscan", "z", "skipped"), ("picklescan", "p", "flagged"), ("picklescan", "q", "pass"), ("s", "a.pkl", "error")]
