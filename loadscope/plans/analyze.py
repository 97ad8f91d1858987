"""The whole analysis of a source tree: its files are read once, and each stage is a table that the next ones join."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from loadscope.functions import text as X
from loadscope.functions.text import basename, extname
from loadscope.operators import artifacts as A
from loadscope.operators import behaviour as B
from loadscope.operators import context as C
from loadscope.operators import deps as D
from loadscope.operators import evidence as E
from loadscope.operators import loads as L
from loadscope.operators import records as R
from loadscope.operators.columns import mapped
from loadscope.operators.numbering import numbered
from loadscope.operators.shared import stored
from loadscope.plans import dims
from loadscope.sources import declarations, documents, manifests, notebook, probes, scanner
from loadscope.sources import tensors as T
from loadscope.sources.config import Config
from loadscope.sources.walk import EDGE, MOST_HASHED

#: Bytes above which a source or a notebook isn't read.
MOST_SOURCE, MOST_NOTEBOOK = 2 << 20, 8 << 20
SOURCES = [".py", ".pyi", ".js", ".mjs", ".cjs", ".jsx", ".ts", ".tsx", ".mts"]
PRIVILEGED = ["cloud-credentials", "secret-material", "orchestration-api", "process-execution"]
EVIDENCE = r"(^|/)(evidence|modelscan|picklescan|fickling)[^/]*\.json\z|-evidence\.json\z|(modelscan|picklescan)-report\.json\z"


@dataclass(frozen=True)
class Report:
    """Relations of one analysis. All but notices and counts are tables in the shared folder; stages has what was counted while they were written."""

    artifacts: DataFrame
    sites: DataFrame
    contexts: DataFrame
    evidence: DataFrame
    records: DataFrame
    notices: DataFrame
    counts: DataFrame
    tensors: DataFrame | None = None
    metadata: DataFrame | None = None
    project: str | None = None
    stages: dict[str, dict[str, int]] = field(default_factory=dict)


#: Stages in their order.
STAGES = ("walk", "dependencies", "load-sites", "artifacts", "behaviour", "context", "evidence", "bom")
Progress = Callable[[str, dict[str, int] | None], None]


class Stages:
    """Relations are stored stage by stage, and counted by the very job that writes them."""

    def __init__(self, progress: Progress | None):
        self.progress, self.counts = progress, {}

    def store(self, stage: str, make: Callable[[], DataFrame], **counts: Column) -> DataFrame:
        """The relation as a table, with the counts of its stage; progress hears of the stage before (None) and after."""
        if self.progress:
            self.progress(stage, None)
        seen = Observation(f"{stage}-{uuid.uuid4().hex}")
        out = stored(make().observe(seen, *[F.coalesce(c, F.lit(0)).cast("long").alias(n) for n, c in counts.items()]))
        self.counts.setdefault(stage, {}).update({n: seen.get.get(n, 0) for n in counts})
        if self.progress:
            self.progress(stage, self.counts[stage])
        return out


def analyze(files: DataFrame, config: Config = Config(), loaders: DataFrame | None = None, progress: Progress | None = None) -> Report:
    """files: path, size, link, content (bytes); optionally head, tail, digest and coverage, which are made of the content where they are missing.

    files is read once: what the analysis needs of it is kept in the shared folder. An empty
    tree gives empty relations; nulls in content are files that can't be read, or where there
    is a head, files too large to be read as text. loaders takes the place of the built-in
    loader rules (see operators.loads); progress is called with each stage, without and then with its counts.
    """
    # of a key twice in a JSON object the last counts
    files.sparkSession.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    stages = Stages(progress)
    if "head" not in files.columns:
        made = X.digest(F.col("content"), F.col("size"), MOST_HASHED, EDGE)
        files = files.withColumns({"head": F.substring("content", 1, EDGE), "tail": F.substring("content", -EDGE, EDGE), "digest": made["value"], "coverage": made["coverage"]})
    in_scope = ~X.matches_any(F.col("path"), list(config.ignore)) & ~F.col("link")
    held = stages.store("walk", lambda: files.where("path is not null"), files=F.count_if(in_scope))
    scope = A.in_scope(held, list(config.ignore))
    extension = extname(F.col("path"))
    cap = F.when(extension == ".ipynb", MOST_NOTEBOOK).when(extension.isin(SOURCES), MOST_SOURCE).otherwise(F.lit(1 << 62))
    texts = scope.where(F.col("size") <= cap).select("path", F.make_valid_utf8(F.col("content").cast("string")).alias("text"))

    deps = stages.store("dependencies", lambda: D.merge(manifests.declared(texts)), declared=F.count("*"), pinned=F.count_if(F.col("pin") == "exact"))

    project = manifests.project_name(texts, None).first()["name"]

    cells = notebook.read(texts.where(extension == ".ipynb"))
    sources = texts.where(extension.isin(SOURCES)).unionByName(notebook.joined(cells).select(F.col("notebook").alias("path"), F.col("source").alias("text")))
    calls = stages.store("load-sites", lambda: L.loads(stored(scanner.read(sources)), sources, loaders), calls=F.count("*"), files=F.approx_count_distinct("file"))

    heads = scope.where(extension.isin(list(dims.BY_EXTENSION))).select("path", "size", "head", "tail", "digest", "coverage")
    headers = stored(T.headers(scope.where(extension.isin(list(dims.BY_EXTENSION))).select("path", "size", F.coalesce("content", "head").alias("head"))).drop("head").where("state <> 'none'"))
    targets = stored(A.resolve_references(calls.where("literal is not null").select("literal"), heads.select("path")))
    declared = stored(declarations.declarations(texts))
    arts = stages.store("artifacts", lambda: known(heads, headers).unionByName(remote(targets), allowMissingColumns=True).unionByName(stated(declared), allowMissingColumns=True), artifacts=F.count("*"), in_tree=F.count_if(F.col("origin") == "in-tree"))

    place = ["file", "line", "pos", "loader", "artifact_id"]
    bound = calls.join(targets.withColumnRenamed("target", "artifact_id"), "literal", "left").select("file", "line", "pos", "enclosing", "loader", "args", "literal", "artifact_id", "target")
    lines = declared.select(F.col("path").alias("file"), F.col("line"), F.lit(0).alias("pos"), F.lit(None).cast("string").alias("enclosing"), F.concat(F.lit("declared:"), F.col("format")).alias("loader"), F.create_map().cast("map<string,string>").alias("args"), F.lit(None).cast("string").alias("literal"), "artifact_id", F.lit(None).cast("string").alias("target"), B.verdict(F.col("behaviour")).alias("verdict"))
    in_cells = notebook.cell_of_line(notebook.cells(cells), bound.where(extname(F.col("file")) == ".ipynb").select(F.col("file").alias("notebook"), "line").distinct())
    in_cells = in_cells.select(F.col("notebook").alias("file"), "line", F.col("cell").cast("int").alias("cell"))
    sites = stages.store("behaviour", lambda: numbered(B.resolve(bound, arts, deps).unionByName(lines).join(in_cells, ["file", "line"], "left"), place, "site", "ls-"), sites=F.count("*"), code=F.count_if(F.col("verdict.behaviour") == "code"), unknown=F.count_if(F.col("verdict.behaviour") == "unknown"))

    contexts = stages.store("context", lambda: context(sites, sources, config), contexts=F.count("*"), privileged=F.count_if("privileged"))

    reports = documents.evidence(texts.where(F.col("path").rlike(EVIDENCE) | (basename(F.col("path")) == "evidence.json")))
    reports = stages.store("evidence", lambda: numbered(reports, ["source", "subject", "scanner", "result", "subject_digest", "detail"], "seq").withColumn("id", F.concat(F.lit("ev-"), F.col("seq").cast("string"))), read=F.count("*"))
    proof = stages.store("evidence", lambda: E.bind(reports, arts), bound=F.count("*"))
    records = stages.store("bom", lambda: R.build(arts, sites, contexts, proof, ["file", "line", "pos"]), records=F.count("*"), code=F.count_if(F.col("behaviour") == "code"))
    return Report(arts, sites, contexts, proof, records, notices(held, scope, extension, config), counts(held, scope), T.tensors(headers), T.metadata(headers), project, stages.counts)


def known(heads: DataFrame, headers: DataFrame) -> DataFrame:
    """Artifacts that are files of the tree (path, size, head, tail, digest, coverage); dtypes says how many tensors of each type their headers list."""
    probed = probes.classified(probes.probe(heads))
    counted = F.concat_ws(" ", F.col("tensors").cast("string"), F.coalesce("dtype", F.lit("untyped")))
    listed = T.dtypes(T.tensors(headers)).groupBy("path").agg(F.array_sort(F.collect_list(F.struct("dtype", counted.alias("text")))).alias("d")).select("path", F.transform("d", lambda x: x["text"]).alias("dtypes"))
    probed = probed.drop("tensors").join(listed, "path", "left")
    return probed.join(A.siblings(heads.select("path")), "path", "left").select(
        F.col("path").alias("artifact_id"), F.col("path").alias("locator"), "found.*", F.lit("in-tree").alias("origin"), "digest", F.coalesce("coverage", F.lit("full")).alias("coverage"), F.lit(None).cast("string").alias("version"),
        F.coalesce(F.size(probes.notable(F.col("pickle.globals"))) > 0, F.lit(False)).alias("notable"), "siblings", "dtypes",
    )


def no_siblings() -> Column:
    return F.array().cast("array<struct<locator:string,format:string>>")


def remote(targets: DataFrame) -> DataFrame:
    """Artifacts that calls name and the tree lacks: repositories, and files that aren't there."""
    found = targets.where("target like 'hf:%' or target like 'missing:%'").select("target").distinct()
    here = F.regexp_replace("target", "^[a-z]+:", "")
    hub = F.startswith("target", F.lit("hf:"))
    guess = mapped(extname(here), dims.INFERRED, "unknown")
    return found.select(
        F.col("target").alias("artifact_id"), here.alias("locator"), F.when(hub, "remote-repository").otherwise(guess).alias("format"), F.when(hub, "none").otherwise("extension").alias("basis"), F.lit(False).alias("mismatch"),
        F.when(hub, "remote-reference").otherwise("unresolved").alias("origin"), F.lit(None).cast("string").alias("digest"), F.lit("full").alias("coverage"), F.nullif(F.regexp_extract(here, r"@([\w.-]+)\z", 1), F.lit("")).alias("version"), F.lit(False).alias("notable"), no_siblings().alias("siblings"),
    )


def stated(declared: DataFrame) -> DataFrame:
    """Artifacts that declarations name; of declarations with one id the last by path counts."""
    rows = declared.select(
        "artifact_id", F.col("name").alias("locator"), "format", F.lit("declared").alias("basis"), F.lit(False).alias("mismatch"), "origin", F.lit(None).cast("string").alias("digest"), F.lit("full").alias("coverage"), F.lit(None).cast("string").alias("version"), F.lit(False).alias("notable"), no_siblings().alias("siblings"), "path",
    )
    return rows.groupBy("artifact_id").agg(F.max_by(F.struct(*[c for c in rows.columns if c not in ("artifact_id", "path")]), "path").alias("d")).select("artifact_id", "d.*")


def context(sites: DataFrame, sources: DataFrame, config: Config) -> DataFrame:
    """(file, environment, basis, privileged, privileges) of the files that load."""
    signals = C.signals(sources).groupBy("file").agg(F.bool_or(F.col("kind").isin(PRIVILEGED)).alias("privileged"), F.array_sort(F.collect_set("kind")).alias("privileges"))
    marks = sources.select(F.col("path").alias("file"), C.frameworks(F.col("text")).alias("frameworks"))
    used = sites.select("file").distinct().join(marks, "file", "left").join(signals, "file", "left")
    nothing = F.array().cast("array<string>")
    environment = C.environment(F.col("file"), F.coalesce("frameworks", nothing), [(e, list(g)) for e, g in config.environments])
    return used.select("file", environment.alias("e"), F.coalesce("privileged", F.lit(False)).alias("privileged"), F.coalesce("privileges", nothing).alias("privileges")).select("file", "e.environment", "e.basis", "privileged", "privileges")


def notices(files: DataFrame, scope: DataFrame, extension: Column, config: Config) -> DataFrame:
    """(path, code) of what isn't looked into: links, sources above their cap, files that can't be read, notebooks that can't be parsed."""
    skipped = A.notices(files.where("path is not null"), list(config.ignore), MOST_SOURCE, MOST_NOTEBOOK)
    unread = scope.where("content is null and head is null").select("path", F.lit("unreadable").alias("code"))
    book = F.from_json(F.make_valid_utf8(F.col("content").cast("string")), "struct<cells:array<struct<cell_type:string>>>")
    unparsed = scope.where((extension == ".ipynb") & F.col("content").isNotNull()).where(book["cells"].isNull()).select("path", F.lit("unparsed").alias("code"))
    return skipped.where(extension.isin([*SOURCES, ".ipynb"]) | (F.col("code") == "link-skipped")).unionByName(unread).unionByName(unparsed)


def counts(files: DataFrame, scope: DataFrame) -> DataFrame:
    """One row: entries walked, in scope and read as text, and bytes read."""
    walked = files.agg(F.count("*").alias("walked"))
    read = scope.agg(F.count("*").alias("in_scope"), F.count("content").alias("read"), F.coalesce(F.sum(F.octet_length("content")), F.lit(0)).alias("bytes"))
    return walked.crossJoin(read)
