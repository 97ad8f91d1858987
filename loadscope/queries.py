"""Registered queries of the analyser's operators over relations derived from the test tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loadscope.functions import text as X
from loadscope.functions import versions as V
from loadscope.operators import artifacts as A
from loadscope.operators import behaviour as B
from loadscope.operators import bom, explore, graph
from loadscope.operators import context as C
from loadscope.operators import deps as D
from loadscope.operators import diff as DF
from loadscope.operators import evidence as E
from loadscope.operators import records as R
from loadscope.operators import summary as S
from loadscope.operators.columns import unsent
from loadscope.operators.imports import canonical
from loadscope.operators.numbering import numbered, numbered_within
from loadscope.operators.rules import first_rule
from loadscope.operators.shared import stored
from loadscope.plans import derived as P
from loadscope.plans import dims

Query = Callable[[SparkSession, str], DataFrame]
FOUND: dict[str, Query] = {}
SQL: dict[str, str] = {}


def _list(values: list[str | None]) -> str:
    return "[" + ", ".join("NULL" if v is None else f"'{v}'" for v in values) + "]"


def _in(values) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


def _case(column: str, values: dict, default: str = "NULL") -> str:
    quoted = lambda v: f"'{v}'" if isinstance(v, str) else str(v)
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN {quoted(v)}" for k, v in values.items()) + f" ELSE {default} END"


def _v(b: str, r: str | None = None, g: str | None = None, x: str | None = None) -> str:
    q = lambda s: f"'{s}'" if s else "NULL::VARCHAR"
    return f"{{'b': {q(b)}, 'r': {q(r)}, 'g': {q(g)}, 'x': {q(x)}}}"


def _default(reached: str, guard: str) -> str:
    return f"CASE WHEN {reached} IS NULL THEN {_v('unknown', 'loader-default-unpinned')} WHEN {reached} THEN {_v('guarded', None, guard, 'code')} ELSE {_v('code')} END"


EXPOSURE = _case("verdict.b", dims.EXPOSURE, "-1")
MATTERS = _list(dims.MATTERING)
SITE_ORDER = ", ".join(P.ORDER)

#: The derived relations as common table expressions; each query's SQL can use any of them.
WITH = f"""
WITH RECURSIVE art AS (
  SELECT *, sha256(locator) AS digest FROM (SELECT p_partkey AS artifact_id,
    'models/' || lower(p_type) || '/' || lower(replace(p_brand, '#', '-')) || '/' || p_partkey || '/' || CASE WHEN p_partkey % 10 = 9 THEN 'shared' || (p_partkey // 420) || '.bin'
      ELSE 'm' || p_partkey || ({_list([(f[4] or [".dat"])[0] for f in dims.FORMATS])})[p_partkey % 21 + 1] END AS locator,
    ({_list(dims.FORMAT_IDS)})[p_partkey % 21 + 1] AS format, CASE WHEN p_partkey % 5 = 0 THEN 'extension' ELSE 'magic' END AS basis,
    CASE WHEN p_partkey % 21 = 19 THEN 'remote-reference' ELSE 'in-tree' END AS origin, p_partkey % 17 = 3 AS mismatch, p_partkey % 9 = 1 AS notable, p_partkey % 13 = 2 AS sibling,
    CASE WHEN p_partkey % 11 = 0 THEN 'head-tail' ELSE 'full' END AS coverage FROM part)),
fil AS (
  SELECT s_suppkey AS suppkey, s_acctbal, lower(replace(r_name, ' ', '-') || '/' || n_name || '/' || CASE s_suppkey % 7 WHEN 1 THEN 'test_' WHEN 2 THEN 'run_' ELSE '' END
    || replace(s_name, '#', '-') || CASE WHEN s_suppkey % 9 = 4 THEN '.ipynb' ELSE '.py' END) AS file
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
ctx AS (
  SELECT file, s_acctbal < 0 AS privileged, list_filter([CASE WHEN suppkey % 6 = 1 THEN 'network-egress' END, CASE WHEN s_acctbal < 0 THEN 'secret-material' END], lambda x: x IS NOT NULL) AS kinds, CASE WHEN file LIKE 'africa/%' THEN 'production' WHEN regexp_matches(file, '^america/[^/]*1/') THEN 'staging'
    WHEN file LIKE '%.ipynb' THEN 'notebook' WHEN regexp_matches(file, '(^|/)test_[^/]*[.]py$') THEN 'test' WHEN suppkey % 4 = 0 THEN 'service' ELSE 'unresolved' END AS environment,
    CASE WHEN file LIKE 'africa/%' OR regexp_matches(file, '^america/[^/]*1/') THEN 'declared' WHEN file LIKE '%.ipynb' OR regexp_matches(file, '(^|/)test_[^/]*[.]py$') THEN 'path'
    WHEN suppkey % 4 = 0 THEN 'framework' ELSE 'unresolved' END AS basis FROM fil),
decl AS (
  SELECT (['torch', 'keras', 'tensorflow', 'numpy', 'onnx'])[k % 5 + 1] AS name, ['==2.' || m, '>=2.' || m, '*', '~=3.' || m, '<9', 'v2.' || m, '^1.' || m, '==2.*'][k % 8 + 1] AS "constraint",
    'file' || k AS source, rank, rank * 1000 + k AS seq, [2, 1, 0, 1, 0, 2, 1, 2][k % 8 + 1] AS pinned, ['2.' || m, '2.' || m, NULL, '3.' || m, NULL, 'v2.' || m, '1.' || m, '2'][k % 8 + 1] AS version
  FROM (SELECT n_nationkey AS k, n_nationkey % 4 + 4 AS m, CASE WHEN n_nationkey % 7 = 6 THEN 2 WHEN n_nationkey % 3 = 0 THEN 1 ELSE 0 END AS rank FROM nation)),
dep AS (
  SELECT name, version, (['unpinned', 'range', 'exact'])[pinned + 1] AS pin, source, "constraint" FROM (
    SELECT *, row_number() OVER (PARTITION BY name ORDER BY rank = 2 DESC, CASE WHEN rank = 2 THEN 0 ELSE -pinned END, CASE WHEN rank = 2 THEN -seq ELSE seq END) AS n FROM decl) WHERE n = 1),
ver AS (SELECT name, pin, version, list_transform(string_split(ltrim(version, 'v'), '.'), lambda x: x::BIGINT) AS parts FROM dep),
hit AS (
  SELECT name, CASE WHEN pin = 'exact' THEN reached WHEN pin = 'range' AND reached THEN true END AS ok FROM (
    SELECT name, pin, CASE name WHEN 'torch' THEN parts[1] > 2 OR parts[1] = 2 AND coalesce(parts[2], 0) >= 6 WHEN 'keras' THEN parts[1] >= 3
      WHEN 'tensorflow' THEN parts[1] > 2 OR parts[1] = 2 AND coalesce(parts[2], 0) >= 16 END AS reached FROM ver)),
pins AS (SELECT bool_or(ok) FILTER (name = 'torch') AS torch, coalesce(bool_or(ok) FILTER (name = 'keras'), bool_or(ok) FILTER (name = 'tensorflow')) AS keras FROM hit),
sit AS (
  SELECT * EXCLUDE (own, suiting, fallback), CASE WHEN own THEN l_partkey END AS artifact_id, CASE WHEN own THEN suiting ELSE fallback END AS loader FROM (
    SELECT *, suiting IS NOT NULL AND l_linenumber = l_partkey % 7 + 1 AND l_partkey % 12 <> 7 AS own FROM (
      SELECT {SITE_ORDER}, ({_list(P.CHOICES)})[l_partkey % 21 * 3 + (l_partkey // 21 + CASE WHEN l_orderkey % 40 = 3 THEN 1 ELSE 0 END) % 3 + 1] AS suiting,
        ({_list([x[0] for x in dims.LOADERS])})[(l_linenumber * 5 + l_partkey % 3) % 24 + 1] AS fallback,
        CASE (l_partkey // 63 + CASE WHEN l_orderkey % 40 = 3 THEN 1 ELSE 0 END) % 4 WHEN 0 THEN 'false' WHEN 1 THEN 'true' END AS flag, l_partkey % 10 = 3 AS trust, l_partkey % 10 = 4 AS safe,
        l_partkey % 19 = 7 AS pm, l_orderkey % 2 = 0 AS literal, l_orderkey % 100 = 7 AS untargeted, file FROM lineitem JOIN fil ON l_suppkey = suppkey))),
res AS (
  SELECT s.*, CASE WHEN a.artifact_id IS NULL THEN CASE WHEN untargeted THEN {_v("unknown", "artifact-unresolved")} ELSE {_v("unknown", "path-not-static")} END
    WHEN loader IN {_in(dims.DATA_ONLY_LOADERS)} AND origin = 'in-tree' AND (basis = 'extension' OR intrinsic = 'code') THEN {_v("unknown", "format-undetermined")}
    WHEN loader IN {_in(dims.PICKLE_LOADERS)} THEN {_v("code")}
    WHEN loader = 'torch.load' THEN CASE WHEN pm OR flag = 'false' THEN {_v("code")} WHEN flag = 'true' THEN {_v("guarded", None, "weights_only=True", "code")} ELSE {_default("torch", "weights_only default")} END
    WHEN loader IN ('torch.jit.load', 'torch.hub.load', 'tensorflow.saved_model.load', 'ultralytics.YOLO') THEN {_v("code")}
    WHEN loader = 'numpy.load' THEN CASE flag WHEN 'true' THEN {_v("code")} WHEN 'false' THEN {_v("data", None, "allow_pickle=False", "code")} ELSE {_v("data")} END
    WHEN loader = 'keras.load_model' THEN CASE flag WHEN 'false' THEN {_v("code")} WHEN 'true' THEN {_v("guarded", None, "safe_mode=True", "code")} ELSE {_default("keras", "safe_mode default")} END
    WHEN loader IN {_in(dims.HUB_LOADERS)} THEN CASE WHEN trust THEN {_v("code")} WHEN safe THEN {_v("data", None, "use_safetensors=True", "unknown")}
      WHEN origin = 'in-tree' AND intrinsic = 'data' THEN {_v("data")} WHEN origin = 'in-tree' THEN {_default("torch", "weights_only default")}
      WHEN literal THEN {_v("unknown", "remote-contents-unresolvable")} ELSE {_v("unknown", "path-not-static")} END
    WHEN loader = 'datasets.load_dataset' THEN CASE WHEN trust THEN {_v("code")} ELSE {_v("data", None, "trust_remote_code default", "code")} END ELSE {_v("data")} END AS verdict
  FROM sit s LEFT JOIN (SELECT *, {_case("format", dims.INTRINSIC, "'unknown'")} AS intrinsic FROM art) a USING (artifact_id), pins),
head AS (
  SELECT artifact_id, arg_min(verdict, (-({EXPOSURE}), {SITE_ORDER})) AS verdict, arg_min(loader, ({SITE_ORDER})) AS first_loader, count(*) AS sites, count(DISTINCT verdict.b) > 1 AS inconsistent,
    count(*) FILTER (loader IN {_in(dims.GUARDS)}) > 0 AS guardable FROM res WHERE artifact_id IS NOT NULL GROUP BY artifact_id),
act AS (SELECT artifact_id, environment, bool_or(privileged) AS privileged, min(({SITE_ORDER})) AS since FROM res JOIN ctx USING (file) WHERE artifact_id IS NOT NULL GROUP BY artifact_id, environment),
priv AS (SELECT artifact_id, array_to_string(list_sort(list_distinct(flatten(list(kinds)))), ',') AS privileges FROM (SELECT DISTINCT artifact_id, file FROM res WHERE artifact_id IS NOT NULL) JOIN ctx USING (file) GROUP BY artifact_id),
envs AS (SELECT artifact_id, list(environment ORDER BY since) AS environments, bool_or(privileged) AS privileged FROM act GROUP BY artifact_id),
scn AS (
  SELECT o_orderkey AS seq, CASE o_orderkey % 7 WHEN 0 THEN 'repo/' || locator WHEN 1 THEN array_to_string(string_split(locator, '/')[-2:], '/') WHEN 2 THEN 'x/' || string_split(locator, '/')[-1] WHEN 3 THEN string_split(locator, '/')[-1] ELSE locator END AS subject,
    CASE WHEN o_orderkey % 97 = 5 THEN sha256(digest) WHEN o_orderstatus <> 'P' THEN upper(digest)[:20] END AS subject_digest, CASE left(o_orderpriority, 1) WHEN '1' THEN 'flagged' WHEN '2' THEN 'error' ELSE 'pass' END AS result, 'scanner' || (o_orderkey % 5) AS scanner
  FROM (SELECT *, o_orderkey % (SELECT count(*) FROM part) AS k FROM orders) JOIN art ON CASE WHEN k % 6 = 5 THEN k - 1 ELSE k END = artifact_id),
met AS (
  SELECT subject, artifact_id, locator = subject AS exact, ends_with(subject, '/' || locator) OR ends_with(locator, '/' || subject) AS tail
  FROM (SELECT DISTINCT subject FROM scn) JOIN art ON string_split(subject, '/')[-1] = string_split(locator, '/')[-1]),
meant AS (
  SELECT subject, coalesce(min(artifact_id) FILTER (exact), CASE WHEN count(*) FILTER (tail) = 1 THEN min(artifact_id) FILTER (tail) END, CASE WHEN count(*) = 1 THEN min(artifact_id) END) AS artifact_id FROM met GROUP BY subject),
ev AS (
  SELECT s.*, artifact_id, CASE WHEN subject_digest IS NULL OR coverage <> 'full' THEN 'unbound' WHEN starts_with(digest, lower(subject_digest)) THEN 'current' ELSE 'stale' END AS binding
  FROM scn s JOIN meant USING (subject) JOIN art USING (artifact_id)),
evs AS (SELECT artifact_id, list(binding ORDER BY seq) AS bindings, bool_or(binding = 'current' AND result = 'flagged') AS current_flagged, count(*) AS evidence FROM ev GROUP BY artifact_id),
rec0 AS (
  SELECT a.*, coalesce(h.verdict, CASE WHEN basis = 'extension' OR format = 'unknown' THEN {_v("unknown", "format-undetermined")} WHEN intrinsic = 'code' THEN {_v("unknown", "artifact-unresolved")}
      WHEN intrinsic = 'data' THEN {_v("data")} WHEN intrinsic = 'directive' THEN {_v("directive")} ELSE {_v("unknown")} END) AS verdict, first_loader, coalesce(sites, 0) AS sites, coalesce(inconsistent, false) AS inconsistent,
    coalesce(guardable, false) AS guardable, coalesce(environments, []) AS environments, coalesce(privileged, false) AS privileged, coalesce(bindings, []) AS bindings, coalesce(current_flagged, false) AS current_flagged, coalesce(evidence, 0) AS evidence
  FROM (SELECT *, {_case("format", dims.INTRINSIC, "'unknown'")} AS intrinsic FROM art) a LEFT JOIN head h USING (artifact_id) LEFT JOIN envs USING (artifact_id) LEFT JOIN evs USING (artifact_id)),
rec AS (
  SELECT *, verdict.b AS behaviour, CASE WHEN verdict.b = 'data' THEN 'none-identified' WHEN sibling THEN 'sibling-present' WHEN guardable AND NOT (verdict.g IS NOT NULL AND verdict.b <> 'code') THEN 'loader-guard-available'
      WHEN format IN {_in(dims.CONVERTIBLE)} THEN 'conversion-available' ELSE 'none-identified' END AS alternative,
    CASE WHEN len(bindings) = 0 THEN 'absent' WHEN list_contains(bindings, 'stale') THEN 'stale' WHEN list_contains(bindings, 'current') THEN 'bound' ELSE 'unbound' END AS evidence_state,
    CASE WHEN len(environments) = 0 THEN ['unresolved'] ELSE environments END AS shown FROM rec0),
fnd AS (
  SELECT artifact_id, unnest(list_filter([
    CASE WHEN code AND privileged THEN 'privileged-execution-surface/act' END, CASE WHEN code AND NOT privileged THEN CASE WHEN list_has_any(environments, {MATTERS}) THEN 'execution-surface/act' ELSE 'execution-surface/review' END END,
    CASE WHEN code AND notable THEN 'pickle-notable-callable/review' END, CASE WHEN alternative = 'sibling-present' THEN 'shadowed-safe-format/act' END,
    CASE WHEN verdict.r = 'loader-default-unpinned' THEN 'unpinned-loader-default/act' END, CASE WHEN code AND first_loader IN {_in(dims.REMOTE_CODE_LOADERS)} THEN 'remote-code-trust/review' END,
    CASE WHEN code AND format = 'mcp-server-manifest' THEN 'spawns-process-on-load/review' END, CASE WHEN behaviour = 'directive' THEN 'directive-surface/record' END, CASE WHEN inconsistent THEN 'inconsistent-guard/act' END,
    CASE WHEN code AND alternative = 'loader-guard-available' THEN 'format-migration-available/act' WHEN code AND alternative = 'conversion-available' THEN 'format-migration-available/review' END,
    CASE WHEN list_contains(bindings, 'stale') THEN 'evidence-stale/review' END, CASE WHEN evidence = 0 AND (code OR coalesce(verdict.r = 'loader-default-unpinned', false)) AND origin = 'in-tree' THEN 'evidence-absent/record' END,
    CASE WHEN verdict.r IN ('path-not-static', 'artifact-unresolved', 'remote-contents-unresolvable', 'format-undetermined') THEN 'unresolved-artifact/review' END,
    CASE WHEN list_contains(environments, 'unresolved') AND behaviour <> 'data' THEN 'unresolved-context/review' END, CASE WHEN mismatch THEN 'extension-mismatch/review' END
  ], lambda x: x IS NOT NULL)) AS f FROM (SELECT *, behaviour = 'code' AS code FROM rec)),
find AS (SELECT split_part(f, '/', 1) || ':' || artifact_id AS id, artifact_id, split_part(f, '/', 1) AS kind, split_part(f, '/', 2) AS disposition FROM fnd),
cus AS (
  SELECT c_custkey AS k, ({_list(list(dims.DISPLAY))})[c_custkey % 5 + 1] AS behaviour, CASE WHEN c_custkey % 3 = 0 THEN 'weights_only=True' END AS guard, lower(c_mktsegment) AS format, sha256(c_name) AS digest,
    (c_nationkey % 4)::BIGINT AS sites, CASE c_nationkey % 3 WHEN 0 THEN 'sandbox' WHEN 1 THEN 'notebook,production' ELSE '' END AS environments, c_acctbal < 0 AS privileged,
    CASE WHEN c_custkey % 2 = 0 THEN 'current' ELSE '' END AS evidence, CASE WHEN c_custkey % 7 = 0 THEN 'sibling-present' ELSE 'none-identified' END AS alternative FROM customer),
bb AS (SELECT k AS artifact_id, * EXCLUDE (k) FROM cus WHERE k % 10 <> 3),
ba AS (
  SELECT k AS artifact_id, CASE WHEN k % 11 = 2 THEN 'code' WHEN k % 11 = 3 THEN 'data' ELSE behaviour END AS behaviour, CASE WHEN k % 13 = 5 THEN NULL ELSE guard END AS guard, CASE WHEN k % 17 = 1 THEN 'onnx' ELSE format END AS format,
    CASE WHEN k % 19 = 4 THEN sha256(digest) ELSE digest END AS digest, CASE WHEN k % 23 = 6 THEN sites + 1 ELSE sites END AS sites, CASE WHEN k % 29 = 8 THEN 'staging' ELSE environments END AS environments,
    CASE WHEN k % 31 = 9 THEN NOT privileged ELSE privileged END AS privileged, CASE WHEN k % 37 = 10 THEN 'stale' ELSE evidence END AS evidence, CASE WHEN k % 41 = 11 THEN 'conversion-available' ELSE alternative END AS alternative
  FROM cus WHERE k % 10 <> 4),
chg AS (
  SELECT artifact_id, unnest(list_filter([
    CASE WHEN a.behaviour <> b.behaviour THEN {{'f': 'behaviour', 'b': b.behaviour, 'a': a.behaviour, 'd': CASE WHEN {_case("a.behaviour", dims.EXPOSURE)} > {_case("b.behaviour", dims.EXPOSURE)} THEN 'opened' ELSE 'closed' END}} END,
    CASE WHEN a.guard IS DISTINCT FROM b.guard THEN {{'f': 'guard', 'b': coalesce(b.guard, 'none'), 'a': coalesce(a.guard, 'none'), 'd': CASE WHEN a.guard IS NULL THEN 'opened' ELSE 'closed' END}} END,
    CASE WHEN a.format <> b.format THEN {{'f': 'format', 'b': b.format, 'a': a.format, 'd': 'lateral'}} END, CASE WHEN a.digest <> b.digest THEN {{'f': 'digest', 'b': b.digest, 'a': a.digest, 'd': 'lateral'}} END,
    CASE WHEN a.sites <> b.sites THEN {{'f': 'sites', 'b': b.sites::VARCHAR, 'a': a.sites::VARCHAR, 'd': CASE WHEN a.sites > b.sites THEN 'opened' ELSE 'lateral' END}} END,
    CASE WHEN a.environments <> b.environments THEN {{'f': 'environments', 'b': b.environments, 'a': a.environments,
      'd': CASE WHEN list_has_any(string_split(a.environments, ','), {MATTERS}) AND NOT list_has_any(string_split(b.environments, ','), {MATTERS}) THEN 'opened' ELSE 'lateral' END}} END,
    CASE WHEN a.privileged <> b.privileged THEN {{'f': 'privileged', 'b': b.privileged::VARCHAR, 'a': a.privileged::VARCHAR, 'd': CASE WHEN a.privileged THEN 'opened' ELSE 'closed' END}} END,
    CASE WHEN a.evidence <> b.evidence THEN {{'f': 'evidence', 'b': b.evidence, 'a': a.evidence, 'd': CASE WHEN a.evidence LIKE '%stale%' OR a.evidence = '' THEN 'opened' ELSE 'closed' END}} END,
    CASE WHEN a.alternative <> b.alternative THEN {{'f': 'alternative', 'b': b.alternative, 'a': a.alternative, 'd': 'lateral'}} END], lambda x: x IS NOT NULL)) AS c
  FROM bb b JOIN ba a USING (artifact_id))
"""


def query(sql: str | None):
    """Registers a query under its function's name, with the SQL that follows WITH."""

    def register(f: Query) -> Query:
        FOUND[f.__name__] = f
        if sql:
            SQL[f.__name__] = WITH + sql
        return f

    return register


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as files: path, text, size, link."""
    rows = P.table(spark, sf_dir, "documents")
    ext = F.element_at(F.array(*[F.lit(e) for e in (".py", ".ts", ".ipynb", ".md", ".pt", ".safetensors", ".pkl")]), (F.col("doc_id") % 7 + 1).cast("int"))
    return rows.select("doc_id", F.concat(F.col("source"), F.lit("/"), F.col("lang"), F.lit("/d"), F.floor(F.col("doc_id") / 3).cast("string"), ext).alias("path"), "text", F.octet_length("text").cast("long").alias("size"), (F.col("doc_id") % 13 == 5).alias("link"))


DOCS = "(SELECT doc_id, source || '/' || lang || '/d' || (doc_id // 3) || (['.py', '.ts', '.ipynb', '.md', '.pt', '.safetensors', '.pkl'])[doc_id % 7 + 1] AS path, text, strlen(text) AS size, doc_id % 13 = 5 AS link FROM documents)"
IGNORED = ["src1/**", "**/d?.py", "*/fr/*.md"]
IGNORED_SQL = "regexp_matches(path, '^src1/.*$|^(?:[^/]+/)*d[^/][.]py$|^[^/]*/fr/[^/]*[.]md$')"


# ---- files ----


@query(f"SELECT path, size FROM {DOCS} WHERE NOT link AND NOT {IGNORED_SQL}")
def walk_scope(spark, d):
    return A.in_scope(docs(spark, d), IGNORED).select("path", "size")


@query(f"SELECT path, CASE WHEN link THEN 'link-skipped' ELSE 'file-too-large' END AS code FROM {DOCS} WHERE NOT {IGNORED_SQL} AND (link OR size > CASE WHEN path LIKE '%.ipynb' THEN 8000 ELSE 2000 END)")
def walk_notices(spark, d):
    return A.notices(docs(spark, d), IGNORED, 2000, 8000)


RAW_PATH = "CASE page_id % 6 WHEN 0 THEN replace(url, '/', '\\') WHEN 1 THEN 'C:' || url WHEN 2 THEN './/' || url || '/./x' WHEN 3 THEN url || '/../y' WHEN 4 THEN '/' || url ELSE split_part(url, '/', 4) END"


@query(f"""
, raw AS (SELECT page_id, {RAW_PATH} AS raw FROM pages),
p AS (SELECT page_id, raw, list_filter(string_split(replace(raw, '\\', '/'), '/'), lambda x: x NOT IN ('', '.')) AS parts FROM raw)
SELECT page_id, CASE WHEN raw = '' OR length(raw) > 1024 OR regexp_matches(replace(raw, '\\', '/'), '^(/|[A-Za-z]:)') OR list_contains(parts, '..') OR len(parts) = 0 THEN NULL ELSE array_to_string(parts, '/') END AS path FROM p""")
def path_normalise(spark, d):
    raw = F.expr(RAW_PATH.replace("\\", "\\\\"))
    return P.table(spark, d, "pages").select("page_id", X.normalise_path(raw).alias("path"))


@query(f"SELECT regexp_extract(path, '([.][^.]*)$', 1) AS extension, count(*) AS files, sum(size)::BIGINT AS bytes FROM {DOCS} GROUP BY 1")
def ext_counts(spark, d):
    return docs(spark, d).groupBy(X.extname(F.col("path")).alias("extension")).agg(F.count("*").alias("files"), F.sum("size").alias("bytes"))


@query(f"SELECT doc_id, parse_dirname(path) AS folder, d AS name FROM (SELECT doc_id, path, regexp_extract(path, '([^/]*)[.][^./]*$', 1) AS d, regexp_replace(path, '/[^/]*$', '') AS f FROM {DOCS})".replace("parse_dirname(path)", "f"))
def path_parts(spark, d):
    return docs(spark, d).select("doc_id", X.dirname(F.col("path")).alias("folder"), X.stem(F.col("path")).alias("name"))


@query("SELECT doc_id, CASE WHEN length(t) > 80 THEN left(t, 79) || '…' ELSE t END AS text FROM (SELECT doc_id, trim(regexp_replace(text, '[ \\t\\n\\x0B\\f\\r\\x{A0}]+', ' ', 'g')) AS t FROM documents)")
def text_clip(spark, d):
    return P.table(spark, d, "documents").select("doc_id", X.clip(X.sanitise(F.col("text")), 80).alias("text"))


@query(f"SELECT doc_id, sha256(text) AS value, left(sha256(text), 12) AS short FROM {DOCS}")
def digest_full(spark, d):
    found = X.digest(F.col("text").cast("binary"), F.col("size"), 1 << 40, 64)
    return docs(spark, d).select("doc_id", found["value"].alias("value"), X.short_id(F.col("text").cast("binary")).alias("short"))


@query(f"SELECT doc_id, CASE WHEN size <= 1000 THEN sha256(text) ELSE sha256(b[:64] || encode('|' || size || '|') || b[-64:]) END AS value, CASE WHEN size <= 1000 THEN 'full' ELSE 'head-tail' END AS coverage FROM (SELECT *, encode(text) AS b FROM {DOCS})")
def digest_head_tail(spark, d):
    found = X.digest(F.col("text").cast("binary"), F.col("size"), 1000, 64)
    return docs(spark, d).select("doc_id", found["value"].alias("value"), found["coverage"].alias("coverage"))


# Keyed by the remainder of p_size: the first bytes of a file of some format.
HEADS = ["47475546", "894844460D0A1A0A", "1C00000054464C33", "934E554D5059", "80045D", "8002", "78DA", "08071207", "82A1", "00", "", "5B31"]
EXTENSIONS = [".gguf", ".h5", ".tflite", ".npy", ".pt", ".joblib", ".joblib", ".onnx", ".msgpack", ".bin", ".keras", ".txt", ".safetensors"]


@query(f"""
, c AS (SELECT p_partkey AS artifact_id, ({_list(HEADS)})[p_size % 12 + 1] AS h, ({_list(EXTENSIONS)})[p_partkey % 13 + 1] AS e FROM part),
m AS (SELECT *, {_case("e", dims.BY_EXTENSION, "'unknown'")} AS guess, CASE WHEN h LIKE '47475546%' THEN 'gguf' WHEN h LIKE '894844460D0A1A0A%' THEN 'keras-h5' WHEN substr(h, 9, 8) = '54464C33' THEN 'tflite'
  WHEN h LIKE '934E554D5059%' THEN 'numpy-npy' WHEN regexp_matches(h, '^800[1-5]') THEN CASE WHEN e IN ('.pt', '.pth', '.ckpt') THEN 'pytorch-legacy' WHEN e IN ('.joblib', '.jbl') THEN 'joblib' ELSE 'pickle' END
  WHEN h LIKE '78%' AND e = '.joblib' THEN 'joblib' WHEN h LIKE '08%' AND e = '.onnx' THEN 'onnx' WHEN regexp_matches(h, '^8[0-9A-F]') AND e = '.msgpack' THEN 'flax-msgpack' END AS magic FROM c)
SELECT artifact_id, coalesce(magic, guess) AS format, CASE WHEN magic IS NOT NULL THEN 'magic' WHEN guess <> 'unknown' THEN 'extension' ELSE 'none' END AS basis,
  coalesce(magic IS NOT NULL AND guess <> 'unknown' AND NOT (guess = magic OR guess IN {_in(dims.PYTORCH_FAMILY)} AND magic IN {_in([*dims.PYTORCH_FAMILY, "pickle"])} OR guess IN ('pickle', 'joblib') AND magic IN ('pickle', 'joblib')), false) AS mismatch FROM m""")
def classify_magic(spark, d):
    head = F.unhex(F.element_at(F.array(*[F.lit(h) for h in HEADS]), (F.col("p_size") % 12 + 1).cast("int")))
    path = F.concat(F.lit("m/x"), F.element_at(F.array(*[F.lit(e) for e in EXTENSIONS]), (F.col("p_partkey") % 13 + 1).cast("int")))
    return P.table(spark, d, "part").select(F.col("p_partkey").alias("artifact_id"), A.classify(path, head).alias("c")).select("artifact_id", "c.*")


# ---- versions and dependencies ----

VERSIONS = "(SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 'v' ELSE '' END || (p_size % 3 + 1) || CASE WHEN p_partkey % 3 > 0 THEN '.' || (p_partkey % 12) ELSE '' END || CASE WHEN p_partkey % 5 = 1 THEN '.0' WHEN p_partkey % 5 = 2 THEN 'rc1' ELSE '' END AS a, '2.' || (p_partkey % 7) AS b FROM part)"


@query(f"SELECT p_partkey, a, b, CASE WHEN x > y THEN 1 WHEN x < y THEN -1 ELSE 0 END AS compared, x >= y AS reached FROM (SELECT *, list_resize(list_transform(string_split(regexp_extract(a, '^v?([0-9]+([.][0-9]+)*)', 1), '.'), lambda p: p::BIGINT), 8, 0) AS x, list_resize(list_transform(string_split(b, '.'), lambda p: p::BIGINT), 8, 0) AS y FROM {VERSIONS})")
def version_compare(spark, d):
    k, s = F.col("p_partkey"), F.col("p_size")
    a = F.concat(F.when(s % 4 == 0, "v").otherwise(""), (s % 3 + 1).cast("string"), F.when(k % 3 > 0, F.concat(F.lit("."), (k % 12).cast("string"))).otherwise(""), F.when(k % 5 == 1, ".0").when(k % 5 == 2, "rc1").otherwise(""))
    b = F.concat(F.lit("2."), (k % 7).cast("string"))
    rows = P.table(spark, d, "part").select("p_partkey", a.alias("a"), b.alias("b"))
    x, y = V.parse_version(F.col("a")), V.parse_version(F.col("b"))
    return rows.select("p_partkey", "a", "b", V.compare(x, y).alias("compared"), V.at_least(x, y).alias("reached"))


@query("""
, r AS (SELECT p_partkey, (['Torch_Vision', 'numpy[extra]', ' Keras ', '-bad', 'a.b'])[p_partkey % 5 + 1] AS n, ['==2.6.*', '>=1.2,<3', '~=4.1', '*', '', '1.5', '>2', '^0.3', '<2,>=1.9'][p_size % 9 + 1] AS c FROM part)
SELECT p_partkey, (['torch-vision', 'numpy', 'keras', NULL, 'a.b'])[p_partkey % 5 + 1] AS name, CASE WHEN c LIKE '==%' THEN regexp_replace(substr(c, 3), '[.][*]$', '') WHEN regexp_matches(c, '^(~=|\\^)') THEN regexp_extract(c, '^(~=|\\^)(.*)$', 2)
  WHEN regexp_matches(c, '(^|,)>=') THEN regexp_extract(c, '(^|,)>=([^,]+)', 2) WHEN regexp_matches(c, '^[0-9]') THEN c END AS version,
  CASE WHEN c LIKE '==%' OR regexp_matches(c, '^[0-9]') THEN 'exact' WHEN regexp_matches(c, '^(~=|\\^)|(^|,)>=') THEN 'range' ELSE 'unpinned' END AS pin FROM r""")
def constraint_parse(spark, d):
    pick = lambda values, i: F.element_at(F.array(*[F.lit(v) for v in values]), (i + 1).cast("int"))
    name = pick(("Torch_Vision", "numpy[extra]", " Keras ", "-bad", "a.b"), F.col("p_partkey") % 5)
    c = V.parse_constraint(pick(("==2.6.*", ">=1.2,<3", "~=4.1", "*", "", "1.5", ">2", "^0.3", "<2,>=1.9"), F.col("p_size") % 9))
    return P.table(spark, d, "part").select("p_partkey", V.normalise_name(name).alias("name"), c["version"].alias("version"), c["pin"].alias("pin"))


@query('SELECT name, version, pin, source, "constraint" FROM dep')
def deps_merge(spark, d):
    return P.dependencies(spark, d)


@query("SELECT d.name, t.target, CASE WHEN pin = 'exact' THEN ok WHEN pin = 'range' AND ok THEN true END AS reached FROM (SELECT v.name, pin, t.target, list_resize(parts, 8, 0) >= list_resize([t.target::BIGINT, 6], 8, 0) AS ok FROM ver v, (SELECT unnest([1, 2, 3]) AS target) t) d JOIN (SELECT unnest([1, 2, 3]) AS target) t ON d.target = t.target")
def threshold(spark, d):
    rows = P.dependencies(spark, d).select("name", "version", "pin", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("target"))
    return rows.select("name", "target", V.threshold(F.col("version"), F.col("pin"), F.array(F.col("target").cast("bigint"), F.lit(6).cast("bigint"))).alias("reached"))


# ---- source text ----


@query("SELECT page_id, unnest(regexp_extract_all(html, '([A-Za-z_][A-Za-z0-9_.]*)[ \\t]*\\(', 1)) AS name FROM pages")
def call_sites(spark, d):
    return P.table(spark, d, "pages").select("page_id", F.explode(X.call_names(F.col("html"))).alias("name"))


@query("SELECT page_id, line, name, count(*) AS calls FROM (SELECT page_id, line, unnest(regexp_extract_all(words, '([A-Za-z_][A-Za-z0-9_.]*)[ \\t]*\\(', 1)) AS name FROM (SELECT page_id, unnest(l) AS words, generate_subscripts(l, 1) AS line FROM (SELECT page_id, string_split(html, chr(10)) AS l FROM pages))) GROUP BY ALL")
def call_lines(spark, d):
    rows = X.call_lines(P.table(spark, d, "pages").select("page_id", "html"), "html")
    return rows.groupBy("page_id", F.col("line").cast("long").alias("line"), "name").agg(F.count("*").alias("calls"))


SIGNALS = [("network-egress", "address", "@mail[0-9]"), ("secret-material", "key", "AKIA[0-9A-Z]{16}"), ("secret-material", "password", "password=|token = "), ("process-execution", "shout", "!!|[$]{3}")]


@query(f"""
, l AS (SELECT doc_id, unnest(lines) AS words, generate_subscripts(lines, 1) AS line FROM (SELECT doc_id, string_split(replace(text, chr(13) || chr(10), chr(10)), chr(10)) AS lines FROM documents)),
h AS ({" UNION ALL ".join(f"SELECT doc_id, '{k}' AS kind, '{n}' AS label, line FROM l WHERE length(words) <= 4000 AND regexp_matches(words, '{p}')" for k, n, p in SIGNALS)})
SELECT doc_id::VARCHAR AS file, kind, label, min(line)::BIGINT AS line FROM h GROUP BY ALL""")
def privilege_first(spark, d):
    found = C.signals(P.table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("path"), "text"), SIGNALS)
    return found.select("file", "kind", "label", F.col("line").cast("long").alias("line"))


@query(f"SELECT doc_id, array_to_string(list_filter([{', '.join(f'CASE WHEN regexp_matches(t, $${p}$$) THEN $${n}$$ END' for n, p in dims.FRAMEWORKS)}], lambda x: x IS NOT NULL), ',') AS frameworks FROM (SELECT doc_id, text || ' ' || (['import streamlit', ' Flask (x)', 'next/server', '', 'ray.serve airflow.models', 'from fastapi import y; gunicorn'])[doc_id % 6 + 1] AS t FROM documents)")
def frameworks(spark, d):
    added = F.element_at(F.array(*[F.lit(x) for x in ("import streamlit", " Flask (x)", "next/server", "", "ray.serve airflow.models", "from fastapi import y; gunicorn")]), (F.col("doc_id") % 6 + 1).cast("int"))
    return P.table(spark, d, "documents").select("doc_id", F.array_join(C.frameworks(F.concat("text", F.lit(" "), added)), ",").alias("frameworks"))


@query("""
, b AS (SELECT user_id, epoch_us(ts) AS at, event_id FROM events WHERE event_type <> 'error'), c AS (SELECT user_id, epoch_us(ts) AS at, event_id FROM events WHERE event_type = 'error')
SELECT c.event_id AS call, coalesce((SELECT arg_max(b.event_id, b.at) FROM b WHERE b.user_id = c.user_id AND b.at <= c.at), (SELECT arg_min(b.event_id, b.at) FROM b WHERE b.user_id = c.user_id)) AS bound FROM c""")
def nearest_binding(spark, d):
    e = P.table(spark, d, "events").select(F.col("user_id").cast("string").alias("scope"), F.lit("x").alias("name"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), "event_id", "event_type")
    found = C.nearest_binding(e.where("event_type = 'error'").withColumnRenamed("event_id", "call"), e.where("event_type <> 'error'").withColumn("expr", F.col("event_id").cast("string")))
    return found.select("call", F.col("bound").cast("long").alias("bound"))


@query("""
, s AS (SELECT conv_id, turn, turn % 3 AS indent FROM conversations)
SELECT a.conv_id AS file, a.turn AS site, arg_max(b.turn, (b.indent, b.turn)) AS enclosing FROM s a LEFT JOIN s b ON a.conv_id = b.conv_id AND b.turn <= a.turn AND b.indent < a.indent GROUP BY ALL""")
def enclosing_scope(spark, d):
    s = P.table(spark, d, "conversations").select(F.col("conv_id").alias("file"), F.col("turn").alias("site"), F.col("turn").alias("at"), (F.col("turn") % 3).alias("indent"), F.col("turn").alias("name"))
    return C.enclosing_scope(s, s)


@query("""
, c AS (SELECT conv_id, turn, role = 'assistant' AS code, string_split(text, chr(10)) AS lines FROM conversations)
SELECT conv_id, turn, cell::BIGINT AS cell, (before + 1)::BIGINT AS first_line, len(lines)::BIGINT AS n_lines FROM (
  SELECT *, count(*) FILTER (code) OVER w AS cell, coalesce(sum(len(lines) + 1) FILTER (code) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE code""")
def notebook_cells(spark, d):
    from loadscope.sources.notebook import cells

    rows = P.table(spark, d, "conversations").select(F.col("conv_id").alias("notebook"), F.col("turn").alias("at"), (F.col("role") == "assistant").alias("code"), F.col("text").alias("source"))
    return cells(rows).select(F.col("notebook").alias("conv_id"), F.col("at").alias("turn"), "cell", "first_line", "n_lines")


@query("SELECT event_id, CASE WHEN json_valid(j) THEN json_extract_string(j, '$.k') END AS k FROM (SELECT event_id, CASE event_id % 5 WHEN 0 THEN props || '}' WHEN 1 THEN substr(props, 2) ELSE props END AS j FROM events)")
def json_narrow(spark, d):
    from loadscope.sources.documents import json_text

    k = F.col("event_id") % 5
    j = F.when(k == 0, F.concat("props", F.lit("}"))).when(k == 1, F.substring("props", 2, 1 << 30)).otherwise(F.col("props"))
    return P.table(spark, d, "events").select("event_id", json_text(j, "$.k").alias("k"))


# Canonical names that calls may have, for matching.
NAMES = ["pickle.loads", "torch.load", "transformers.AutoModel.from_pretrained", "BertTokenizer.from_pretrained", "keras.models.load_model", "np.load", "numpy.load", "safe_open", "safetensors.torch.load_file", "yaml.load", "pipeline", "InferenceSession", "tf.loadGraphModel", "joblib.load", "load_model"]


@query(f"SELECT l_linenumber, l_partkey, name, {_case('name', {'pickle.loads': 'pickle.load', 'torch.load': 'torch.load', 'transformers.AutoModel.from_pretrained': 'transformers.from_pretrained', 'BertTokenizer.from_pretrained': 'transformers.from_pretrained', 'keras.models.load_model': 'keras.load_model', 'numpy.load': 'numpy.load', 'safe_open': 'safetensors.load_file', 'safetensors.torch.load_file': 'safetensors.load_file', 'pipeline': 'transformers.pipeline', 'InferenceSession': 'onnxruntime.InferenceSession', 'joblib.load': 'joblib.load', 'load_model': 'keras.load_model'})} AS loader FROM (SELECT l_linenumber, l_partkey, ({_list(NAMES)})[(l_partkey + l_linenumber) % 15 + 1] AS name FROM lineitem)")
def loader_match(spark, d):
    name = F.element_at(F.array(*[F.lit(n) for n in NAMES]), ((F.col("l_partkey") + F.col("l_linenumber")) % 15 + 1).cast("int"))
    rows = P.table(spark, d, "lineitem").select("l_linenumber", "l_partkey", name.alias("name"))
    return rows.withColumn("loader", A.match_loader(F.col("name"), F.lit("py")))


# ---- documents of agents, rules and headers ----

ALIASES = [("np", "numpy", "s_suppkey % 2 = 0", 1), ("np", "np2", "s_suppkey % 7 = 0", 2), ("nn", "torch.nn", "s_suppkey % 3 = 0", 1), ("a", "z", "true", 1), ("a.b", "x.y", "s_suppkey % 2 = 1", 1), ("a.b.c.d", "deep", "s_suppkey % 5 = 0", 1), ("a.b.c.d.e", "never", "true", 1)]
WRITTEN = ["np.load", "nn.functional.load", "a.b.c", "a", "a.b.c.d.e.f", "zz.load", "np", "b.a.b", "npx.load"]


@query(f"""
, al AS ({" UNION ALL ".join(f"SELECT s_suppkey AS file, '{a}' AS alias, '{f}' AS full, {at} AS place FROM supplier WHERE {c}" for a, f, c, at in ALIASES)}),
one AS (SELECT file, alias, arg_max("full", place) AS full FROM al GROUP BY ALL),
nm AS (SELECT l_suppkey AS file, ({_list(WRITTEN)})[(l_partkey + l_linenumber) % 9 + 1] AS name, count(*) AS calls FROM lineitem GROUP BY ALL),
best AS (SELECT file, name, arg_max("full" || substr(name, length(alias) + 1), length(alias)) AS canonical FROM nm JOIN one USING (file) WHERE (name = alias OR starts_with(name, alias || '.')) AND len(string_split(alias, '.')) <= 4 GROUP BY ALL)
SELECT file, name, coalesce(canonical, name) AS canonical, calls FROM nm LEFT JOIN best USING (file, name)""")
def import_aliases(spark, d):
    s = P.table(spark, d, "supplier")
    each = [s.where(c).select(F.col("s_suppkey").alias("file"), F.lit(a).alias("alias"), F.lit(f).alias("full"), F.lit(at).alias("at")) for a, f, c, at in ALIASES]
    aliases = each[0]
    for more in each[1:]:
        aliases = aliases.unionByName(more)
    name = F.element_at(F.array(*[F.lit(n) for n in WRITTEN]), ((F.col("l_partkey") + F.col("l_linenumber")) % 9 + 1).cast("int"))
    found = canonical(P.table(spark, d, "lineitem").select(F.col("l_suppkey").alias("file"), name.alias("name")), aliases)
    return found.groupBy("file", "name", "canonical").agg(F.count("*").alias("calls"))


@query("""
, c AS (SELECT c_custkey AS k, c_custkey % 9 AS depth FROM customer)
SELECT 'c' || k || '/settings.json' AS path, 'Ev' || k % 3 AS event, unnest(list_filter([CASE WHEN depth <= 6 AND k % 13 <> 7 THEN 'run-' || k END, CASE WHEN k % 4 = 0 AND depth <= 4 THEN 'more-' || k END], lambda x: x IS NOT NULL)) AS command, 2 AS line
FROM c WHERE k % 11 <> 5""")
def hook_commands(spark, d):
    """Settings with a command at any depth under changing keys, some below a reserved key, some not text."""
    from loadscope.sources.declarations import hooks

    k = F.col("c_custkey").cast("string")
    depth = F.col("c_custkey") % 9
    command = F.when(F.col("c_custkey") % 13 == 7, "7").otherwise(F.concat(F.lit('"run-'), k, F.lit('"')))
    inner = F.concat(F.lit('{"command":'), command, F.when(F.col("c_custkey") % 4 == 0, F.concat(F.lit(',"list":[{"command":"more-'), k, F.lit('"}]'))).otherwise(""), F.lit("}"))
    layer = lambda i, text: F.when(depth > i, text).otherwise("")
    inner = F.concat(*[layer(i, "[" if i % 2 else f'{{"k{i}":') for i in reversed(range(8))], inner, *[layer(i, "]" if i % 2 else "}") for i in range(8)])
    inner = F.when(F.col("c_custkey") % 11 == 5, F.concat(F.lit('{"constructor":'), inner, F.lit("}"))).otherwise(inner)
    text = F.concat(F.lit('{"command": "no", "hooks": {"__proto__": {"command": "no"},\n"Ev'), (F.col("c_custkey") % 3).cast("string"), F.lit('": '), inner, F.lit("}}"))
    return hooks(P.table(spark, d, "customer").select(F.concat(F.lit("c"), k, F.lit("/settings.json")).alias("path"), text.alias("text"))).select("path", "event", "command", "line")


@query("""SELECT 'agent:n' || p_partkey AS artifact_id, CASE p_partkey % 4 WHEN 3 THEN 'Read|p' || p_partkey ELSE 'Read|a, b|p' || p_partkey END || CASE WHEN p_partkey % 10 = 0 THEN '|*' ELSE '' END AS facts,
CASE WHEN p_partkey % 10 = 0 THEN 'the tool grant is *: every tool of the host' END AS note FROM part""")
def frontmatter_lists(spark, d):
    """Agents whose tools are written as an inline list, as lines below the key, as lines after a first list that is replaced, or as words."""
    from loadscope.sources.declarations import declarations

    key = F.col("p_partkey")
    k = key.cast("string")
    star = lambda before, after="": F.when(key % 10 == 0, f"{before}*{after}").otherwise("")
    lines = F.concat(F.lit("tools:\n  - Read\nnot a key\n  - 'a, b'\n - p"), k, star("\n  - '", "'"))
    written = F.when(key % 4 == 0, F.concat(F.lit('Tools: [Read, "a, b", p'), k, star(", "), F.lit("]"))).when(key % 4 == 1, lines).when(key % 4 == 2, F.concat(F.lit("tools: [old]\n"), lines)).otherwise(F.concat(F.lit("tools: Read, p"), k, star(", ")))
    text = F.concat(F.lit("---\nname: n"), k, F.lit("\n"), written, F.lit("\nconstructor: no\n---\nbody"))
    found = declarations(P.table(spark, d, "part").select(F.concat(F.lit("agents/n"), k, F.lit(".md")).alias("path"), text.alias("text")))
    return found.select("artifact_id", F.array_join("facts", "|").alias("facts"), "note")


TENSOR = "{'name': '%s', 'dtype': %s, 'begin': %s, 'finish': %s, 'problem': %s}"


@query(f"""
, t AS (SELECT p_partkey AS k, 4 * (p_partkey % 5) AS n FROM part WHERE p_partkey % 13 <> 5 AND p_partkey % 17 <> 4)
SELECT k, x.name, x.dtype, x.begin, x.finish, x.problem FROM (SELECT k, unnest([
  {TENSOR % ("first", "'F32'", "0", "n", "NULL")},
  {TENSOR % ("second", "'F16'", "CASE WHEN k % 7 = 0 THEN n - 1 ELSE n END", "n + 2", "CASE WHEN k % 7 = 0 AND n = 0 THEN 'outside' WHEN k % 7 = 0 THEN 'overlapping' END")},
  {TENSOR % ("third", "CASE WHEN k % 11 = 3 THEN NULL ELSE 'I8' END", "n + 2", "CASE WHEN k % 3 = 1 THEN n + 900 ELSE n + 3 END", "CASE WHEN k % 11 = 3 THEN 'shape' WHEN k % 3 = 1 THEN 'outside' END")}]) AS x FROM t)""")
def tensor_rows(spark, d):
    """The tensors of headers made of parts: some overlap, reach beyond the file or lack a type; some headers are cut off or aren't JSON."""
    from loadscope.sources import tensors

    key = F.col("p_partkey")
    n = 4 * (key % 5)
    entry = lambda name, dtype, begin, end: F.concat(F.lit(f'"{name}":{{'), dtype, F.lit('"shape":[1],"data_offsets":['), begin.cast("string"), F.lit(","), end.cast("string"), F.lit("]}"))
    text = F.concat_ws(
        ",", F.lit('{"__metadata__":{"format":"pt"}'), entry("first", F.lit('"dtype":"F32",'), F.lit(0), n), entry("second", F.lit('"dtype":"F16",'), F.when(key % 7 == 0, n - 1).otherwise(n), n + 2),
        entry("third", F.when(key % 11 == 3, "").otherwise('"dtype":"I8",'), n + 2, F.when(key % 3 == 1, n + 900).otherwise(n + 3)), F.lit('"__proto__":{}'),
    )
    text = F.concat(text, F.when(key % 17 == 4, "").otherwise("}"))
    length = F.array_join(F.reverse(F.regexp_extract_all(F.lpad(F.hex(F.octet_length(text).cast("long")), 16, "0"), F.lit("(..)"), F.lit(1))), "")
    head = F.concat(F.unhex(length), F.encode(text, "UTF-8"))
    files = P.table(spark, d, "part").select(key.alias("path"), (F.octet_length(head) + n + 3).cast("long").alias("size"), F.when(key % 13 == 5, F.substring(head, 1, 60)).otherwise(head).alias("head"))
    found = tensors.tensors(tensors.headers(files))
    return found.select(F.col("path").alias("k"), "name", "dtype", "begin", F.col("end").alias("finish"), "problem")


@query("""
, rule AS (SELECT n_nationkey AS priority, '^[^/]*/' || lower(left(n_name, 1 + n_nationkey % 2)) || CASE WHEN n_nationkey % 3 = 0 THEN '.*[02468][.]py$' ELSE '' END AS pattern, n_name AS gives FROM nation)
SELECT file, arg_min(gives, priority) AS nation FROM fil LEFT JOIN rule ON regexp_matches(file, pattern) GROUP BY file""")
def first_rules(spark, d):
    """The first of the nations' patterns that each file matches."""
    n = F.col("n_nationkey")
    pattern = F.concat(F.lit("^[^/]*/"), F.lower(F.expr("left(n_name, 1 + n_nationkey % 2)")), F.when(n % 3 == 0, ".*[02468][.]py$").otherwise(""))
    rules = P.table(spark, d, "nation").select(n.alias("priority"), pattern.alias("pattern"), F.col("n_name").alias("nation"))
    return first_rule(P.files(spark, d).select("file"), rules, "file", ["nation"])


@query("""
, c AS (SELECT conv_id, turn, role = 'assistant' AS code, len(string_split(text, chr(10))) AS n FROM conversations),
m AS (SELECT *, count(*) FILTER (code) OVER w AS cell, coalesce(sum(n + 1) FILTER (code) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + 1 AS first_line FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
l AS (SELECT DISTINCT conv_id, (turn * 3 + 1)::BIGINT AS line FROM conversations)
SELECT l.conv_id, line, cell FROM l LEFT JOIN (SELECT * FROM m WHERE code) m ON l.conv_id = m.conv_id AND line >= first_line AND line < first_line + n""")
def line_cells(spark, d):
    from loadscope.sources.notebook import cell_of_line, cells

    rows = P.table(spark, d, "conversations").select(F.col("conv_id").alias("notebook"), F.col("turn").alias("at"), (F.col("role") == "assistant").alias("code"), F.col("text").alias("source"))
    lines = P.table(spark, d, "conversations").select(F.col("conv_id").alias("notebook"), (F.col("turn") * 3 + 1).alias("line")).distinct()
    return cell_of_line(cells(rows), lines).select(F.col("notebook").alias("conv_id"), "line", "cell")


@query("""
, e AS (SELECT artifact_id, binding, min(seq) AS since FROM ev GROUP BY ALL)
SELECT artifact_id, array_to_string(environments, ',') AS environments, coalesce(b, '') AS bindings FROM rec LEFT JOIN (SELECT artifact_id, string_agg(binding, ',' ORDER BY since) AS b FROM e GROUP BY artifact_id) USING (artifact_id)""")
def insertion_order(spark, d):
    """Environments in the order of an artifact's sites, bindings in that of its evidence."""
    return P.records(spark, d).select("artifact_id", F.array_join("environments", ",").alias("environments"), F.array_join("bindings", ",").alias("bindings"))


# ---- references ----

MODEL_FILE = "[.](" + "|".join(e[1:] for e in dims.BY_EXTENSION) + ")$"
LITERALS = "(SELECT DISTINCT CASE l_orderkey % 10 WHEN 0 THEN locator WHEN 1 THEN './' || locator WHEN 2 THEN string_split(locator, '/')[-1] WHEN 3 THEN 'org' || (artifact_id % 9) || '/name' WHEN 4 THEN 'gone/' || artifact_id || '.pt' WHEN 5 THEN 'config/index' || artifact_id % 9 || '.yaml' WHEN 6 THEN 'src/main.py' WHEN 7 THEN 'org/_name-' || artifact_id % 9 WHEN 8 THEN 'org.v2/' || chr(7) || 'x' ELSE 'word' || artifact_id END AS literal FROM lineitem JOIN art ON l_partkey = artifact_id)"


@query(f"""
, lit AS (SELECT literal, regexp_replace(regexp_replace(literal, '[\\x00-\\x1f\\x7f]', '�', 'g'), '^[.]/', '') AS path FROM {LITERALS}),
suf AS (SELECT literal, min(locator) AS found, count(*) AS n FROM lit JOIN art ON locator = path OR ends_with(locator, '/' || path) GROUP BY literal)
SELECT literal, CASE WHEN path IN (SELECT locator FROM art) THEN path WHEN n = 1 THEN found WHEN regexp_matches(path, '^[A-Za-z0-9][A-Za-z0-9_.-]*/[A-Za-z0-9_.-]+$') AND NOT regexp_matches(path, '[^/][.][^./]*$') THEN 'hf:' || path WHEN regexp_matches(path, '{MODEL_FILE}') THEN 'missing:' || path END AS target
FROM lit LEFT JOIN suf USING (literal)""")
def reference_resolve(spark, d):
    arts = P.artifacts(spark, d)
    k, o, p = F.col("artifact_id"), F.col("l_orderkey") % 10, F.col("locator")
    literal = F.when(o == 0, p).when(o == 1, F.concat(F.lit("./"), p)).when(o == 2, X.basename(p)).when(o == 3, F.concat(F.lit("org"), (k % 9).cast("string"), F.lit("/name"))).when(o == 4, F.concat(F.lit("gone/"), k.cast("string"), F.lit(".pt")))
    literal = literal.when(o == 5, F.concat(F.lit("config/index"), (k % 9).cast("string"), F.lit(".yaml"))).when(o == 6, "src/main.py").when(o == 7, F.concat(F.lit("org/_name-"), (k % 9).cast("string"))).when(o == 8, "org.v2/\x07x").otherwise(F.concat(F.lit("word"), k.cast("string")))
    rows = P.table(spark, d, "lineitem").select("l_orderkey", F.col("l_partkey").alias("artifact_id")).join(unsent(arts), "artifact_id").select(literal.alias("literal"))
    return A.resolve_references(rows, arts.select(p.alias("path")))


@query("SELECT artifact_id, locator FROM art WHERE artifact_id NOT IN (SELECT artifact_id FROM sit WHERE artifact_id IS NOT NULL)")
def unreferenced(spark, d):
    return A.unreferenced(P.artifacts(spark, d), P.sites(spark, d)).select("artifact_id", "locator")


@query(f"""
, f AS (SELECT path, regexp_replace(path, '[.][^.]*$', '') AS base, CASE WHEN path LIKE '%.pt' THEN 'pytorch-zip' WHEN path LIKE '%.safetensors' THEN 'safetensors' WHEN path LIKE '%.pkl' THEN 'pickle' END AS format FROM (SELECT DISTINCT regexp_replace(path, '^.*/', 'm/') AS path FROM {DOCS}))
SELECT a.path, string_agg(b.path || '=' || b.format, ',' ORDER BY b.path) AS siblings FROM f a JOIN f b ON a.base = b.base AND a.path <> b.path AND b.format IS NOT NULL GROUP BY a.path""")
def siblings(spark, d):
    found = A.siblings(docs(spark, d).select(F.concat(F.lit("m/"), X.basename(F.col("path"))).alias("path")).distinct())
    return found.select("path", F.array_join(F.transform("siblings", lambda s: F.concat_ws("=", s["locator"], s["format"])), ",").alias("siblings"))


# ---- behaviour ----


@query(f"SELECT {SITE_ORDER}, verdict.b AS behaviour, verdict.r AS reason, verdict.g AS guard FROM res")
def behaviour_site(spark, d):
    return P.resolved(spark, d).select(*P.ORDER, "verdict.behaviour", "verdict.reason", "verdict.guard")


@query("SELECT artifact_id, verdict.b AS behaviour, verdict.r AS reason, verdict.g AS guard, sites FROM head")
def behaviour_headline(spark, d):
    return B.headline(P.resolved(spark, d), P.ORDER).select("artifact_id", "verdict.behaviour", "verdict.reason", "verdict.guard", "sites")


@query(f"SELECT artifact_id, CASE WHEN basis = 'extension' OR format = 'unknown' THEN 'unknown' WHEN i = 'code' THEN 'unknown' ELSE i END AS behaviour, CASE WHEN basis = 'extension' OR format = 'unknown' THEN 'format-undetermined' WHEN i = 'code' THEN 'artifact-unresolved' END AS reason FROM (SELECT *, {_case('format', dims.INTRINSIC)} AS i FROM art)")
def behaviour_dormant(spark, d):
    return P.artifacts(spark, d).select("artifact_id", B.dormant_verdict().alias("v")).select("artifact_id", "v.behaviour", "v.reason")


@query("SELECT artifact_id FROM head WHERE inconsistent")
def inconsistent(spark, d):
    return B.headline(P.resolved(spark, d), P.ORDER).where("inconsistent").select("artifact_id")


# ---- contexts and evidence ----


@query("SELECT file, environment, basis, privileged FROM ctx")
def context_classify(spark, d):
    return P.contexts(spark, d).drop("privileges")


@query("SELECT artifact_id, environment, privileged FROM act")
def context_distinct(spark, d):
    return C.contexts_of(P.resolved(spark, d), P.contexts(spark, d))


@query("SELECT seq, artifact_id, result, binding FROM ev")
def evidence_bind(spark, d):
    return P.evidence(spark, d).select("seq", "artifact_id", "result", "binding")


@query("SELECT behaviour, count(*) AS artifacts FROM rec WHERE evidence_state = 'absent' AND origin = 'in-tree' AND behaviour IN ('code', 'unknown') GROUP BY 1")
def evidence_gaps(spark, d):
    return E.gaps(P.records(spark, d)).groupBy("behaviour").agg(F.count("*").alias("artifacts"))


# ---- records ----


@query(f"SELECT artifact_id, alternative AS kind, CASE WHEN alternative = 'sibling-present' THEN 'safetensors' WHEN alternative = 'conversion-available' THEN {_case('format', {f: t[0] for f, t in dims.CONVERTIBLE.items()})} END AS target FROM rec")
def alternative(spark, d):
    return P.records(spark, d).select("artifact_id", "alternative.kind", "alternative.target")


@query("SELECT id, kind, disposition FROM find")
def findings(spark, d):
    return R.findings(P.records(spark, d)).select("id", "kind", "disposition")


FAMILY = _case("kind", {k: dims.FAMILIES.index(f) for k, f in dims.FINDINGS.items()})


@query(f"SELECT id, kind, disposition, row_number() OVER (ORDER BY {_case('disposition', {x: i for i, x in enumerate(dims.DISPOSITIONS)})}, {FAMILY}, id) AS place FROM find")
def finding_rank(spark, d):
    disposition, family, id_ = R.finding_rank()
    rows = R.findings(P.records(spark, d)).select("kind", "disposition", disposition.alias("d"), family.alias("f"), id_.alias("id"))
    return numbered(rows, ["d", "f", "id"], "place").select("id", "kind", "disposition", "place")


STRIPE = """
SELECT artifact_id, stage, state FROM (SELECT artifact_id, unnest([
  {'stage': 'format', 'state': CASE WHEN format = 'unknown' THEN 'unresolved' WHEN mismatch THEN 'flagged' WHEN basis = 'extension' THEN 'unresolved' ELSE 'resolved' END},
  {'stage': 'load', 'state': CASE WHEN sites = 0 THEN 'unresolved' ELSE 'resolved' END},
  {'stage': 'exec', 'state': CASE WHEN behaviour IN ('code', 'directive') THEN 'flagged' WHEN behaviour = 'unknown' THEN 'unresolved' ELSE 'resolved' END},
  {'stage': 'context', 'state': CASE WHEN len(list_filter(environments, lambda e: e <> 'unresolved')) = 0 THEN 'unresolved' WHEN privileged THEN 'flagged' ELSE 'resolved' END},
  {'stage': 'evidence', 'state': CASE WHEN list_contains(bindings, 'stale') OR current_flagged THEN 'flagged' WHEN NOT list_contains(bindings, 'current') THEN 'unresolved' ELSE 'resolved' END},
  {'stage': 'alternative', 'state': CASE WHEN alternative <> 'none-identified' THEN 'flagged' WHEN behaviour <> 'data' THEN 'unresolved' ELSE 'resolved' END}], recursive := true) FROM rec)"""


@query(STRIPE)
def stripe(spark, d):
    return R.stripe(P.records(spark, d)).select("artifact_id", "stage", "state")


COUNTS = ", ".join(f"count(*) FILTER (behaviour = '{b}') AS {b}" for b in dims.DISPLAY)
TOTALS = f"SELECT count(*) AS artifacts, {COUNTS}, count(*) FILTER (privileged) AS privileged, count(*) FILTER (alternative <> 'none-identified') AS migrations, sum(sites)::BIGINT AS sites, sum(evidence)::BIGINT AS evidence, count(*) FILTER (list_contains(bindings, 'stale')) AS stale FROM rec"


@query(TOTALS)
def summary(spark, d):
    return S.summary(P.records(spark, d))


@query("SELECT behaviour, environment, count(*) AS artifacts FROM (SELECT behaviour, unnest(shown) AS environment FROM rec) GROUP BY ALL")
def matrix(spark, d):
    return S.matrix(P.records(spark, d))


@query(f"SELECT behaviour, {', '.join(f'''count(*) FILTER (environment = '{e}') AS "{e}"''' for e in dims.REACH)} FROM (SELECT behaviour, unnest(shown) AS environment FROM rec) GROUP BY behaviour")
def matrix_pivot(spark, d):
    return S.matrix_pivot(P.records(spark, d))


@query("SELECT behaviour, environment, artifacts, round(artifacts / max(artifacts) OVER (), 6) AS share FROM (SELECT behaviour, environment, count(*) AS artifacts FROM (SELECT behaviour, unnest(shown) AS environment FROM rec) GROUP BY ALL)")
def matrix_view(spark, d):
    return S.matrix_view(P.records(spark, d))


@query(f", t AS ({TOTALS}) " + " UNION ALL ".join(f"SELECT '{k}' AS indicator, {k} AS value, {of} AS \"of\" FROM t" for k, of in (("code", "artifacts"), ("unknown", "artifacts"), ("directive", "artifacts"), ("guarded", "artifacts"), ("data", "artifacts"), ("privileged", "code"), ("migrations", "artifacts"), ("stale", "evidence"))))
def indicators(spark, d):
    return S.indicators(P.records(spark, d))


@query("SELECT behaviour, count(*) AS artifacts, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM rec GROUP BY behaviour")
def distribution(spark, d):
    return S.distribution(P.records(spark, d))


FILTERS = explore.Filters(behaviour=("code", "unknown"), environment=("production", "notebook"), evidence=("absent", "stale"))
HELD = {
    "behaviour": "behaviour IN ('code', 'unknown')",
    "environment": "list_has_any(shown, ['production', 'notebook'])",
    "evidence": "evidence_state IN ('absent', 'stale')",
}


@query(f"SELECT artifact_id FROM rec WHERE {' AND '.join(HELD.values())}")
def facet_filter(spark, d):
    return explore.apply_filters(P.records(spark, d), FILTERS).select("artifact_id")


def _facet(name: str, value: str) -> str:
    return f"SELECT '{name}' AS facet, {value} AS value FROM rec WHERE {' AND '.join(c for k, c in HELD.items() if k != name) or 'true'}"


@query(
    ", f AS ("
    + " UNION ALL ".join(_facet(n, v) for n, v in (("behaviour", "behaviour"), ("environment", "unnest(shown)"), ("format", "format"), ("migration", "CASE WHEN alternative <> 'none-identified' THEN 'available' ELSE 'none' END"), ("evidence", "evidence_state")))
    + f" UNION ALL SELECT 'privileged', 'true' FROM rec WHERE privileged AND {' AND '.join(HELD.values())}) SELECT facet, value, count(*) AS artifacts FROM f GROUP BY ALL"
)
def facet_counts(spark, d):
    return explore.facet_counts(P.records(spark, d), FILTERS)


HAY = f"""lower(concat_ws(' | ', artifact_id::VARCHAR, locator, format, {_case("format", dims.LABELS)}, behaviour, verdict.r, alternative, left(digest, 16), array_to_string(environments, ' | '),
  array_to_string(list_transform(environments, lambda e: {_case("e", {k: v[0] for k, v in dims.ENVIRONMENTS.items()})}), ' | '), privileges,
  CASE WHEN contains(privileges, 'network') THEN 'Network egress' END, CASE WHEN contains(privileges, 'secret') THEN 'Secret material' END, array_to_string(bindings, ' | ')))"""


@query(f"""
, hay AS (SELECT artifact_id, {HAY} AS h FROM rec LEFT JOIN priv USING (artifact_id)),
seen AS (SELECT artifact_id, bool_or(contains(lower(file), 'asia')) AS a, bool_or(contains(lower(loader), 'torch')) AS b FROM res WHERE artifact_id IS NOT NULL GROUP BY artifact_id)
SELECT artifact_id FROM hay LEFT JOIN seen USING (artifact_id) WHERE (contains(h, 'asia') OR coalesce(a, false)) AND (contains(h, 'torch') OR coalesce(b, false)) AND contains(h, 'egress')""")
def search(spark, d):
    return explore.search(P.records(spark, d), P.sites(spark, d), "Asia torch egress").select("artifact_id")


@query("""
, said AS (SELECT artifact_id, bool_or(contains(scanner, 'scanner3')) AS a FROM ev GROUP BY artifact_id),
found AS (SELECT artifact_id, bool_or(contains(kind, 'unpinned')) AS b FROM find GROUP BY artifact_id)
SELECT artifact_id FROM rec JOIN said USING (artifact_id) JOIN found USING (artifact_id) WHERE a AND b""")
def search_proof(spark, d):
    """A search whose words are those of evidence and of findings."""
    return explore.search(P.records(spark, d), P.sites(spark, d), "scanner3 unpinned", P.evidence(spark, d)).select("artifact_id")


SHOWN_ORDER = {
    "display": f"{_case('behaviour', dims.DISPLAY)} * 10 - CASE WHEN privileged THEN 5 ELSE 0 END", "exposure": f"{_case('behaviour', dims.EXPOSURE)} * 2 + CASE WHEN privileged THEN 1 ELSE 0 END",
    "artifact": "locator", "format": _case("format", dims.LABELS), "context": "CASE WHEN len(environments) = 0 THEN 'zzz' ELSE array_to_string(list_sort(environments), ',') END", "evidence": "evidence_state",
}


@query(" UNION ALL ".join(f"SELECT '{k}' AS key, artifact_id, row_number() OVER (ORDER BY {e} {'DESC' if k == 'exposure' else ''}, artifact_id) AS place FROM rec" for k, e in SHOWN_ORDER.items()))
def sort_records(spark, d):
    of = {key: explore.order_keys(key)[0] for key in SHOWN_ORDER}
    keys = stored(P.records(spark, d).select("artifact_id", *[(-c if key == "exposure" else c).alias(f"_{key}") for key, c in of.items()]))
    out = None
    for key in SHOWN_ORDER:
        rows = numbered(keys.select(F.col(f"_{key}").alias("_key"), "artifact_id"), ["_key", "artifact_id"], "place").select(F.lit(key).alias("key"), "artifact_id", "place")
        out = rows if out is None else out.unionByName(rows)
    return out


@query("SELECT file, count(*) AS sites, count(DISTINCT artifact_id) AS artifacts, any_value(environment) AS environment, any_value(privileged) AS privileged FROM res JOIN ctx USING (file) GROUP BY file")
def loadpaths(spark, d):
    return explore.load_paths(P.resolved(spark, d), P.contexts(spark, d))


@query(f"SELECT artifact_id, alternative AS kind, {_case('alternative', {k: i for i, k in enumerate(dims.ALTERNATIVES)})} AS rank FROM rec WHERE alternative <> 'none-identified' AND behaviour <> 'data'")
def migrations(spark, d):
    return explore.migrations(P.records(spark, d)).select("artifact_id", "alternative.kind", "rank")


@query("SELECT " + ", ".join(f"coalesce(bool_or({c}), false) AS {n}" for n, c in (("any_", "behaviour <> 'data'"), ("unknown_", "behaviour = 'unknown'"), ("privileged_", "behaviour = 'code' AND privileged"), ("execution_", "behaviour = 'code' AND format NOT IN ('mcp-server-manifest', 'agent-definition')"))) + " FROM rec")
def gate(spark, d):
    return P.records(spark, d).agg(*[F.coalesce(F.bool_or(S.gate(None, mode)), F.lit(False)).alias(f"{mode}_") for mode in ("any", "unknown", "privileged", "execution")])


@query(f"SELECT artifact_id, coalesce((['act', 'review', 'record'])[min({_case('disposition', {x: i + 1 for i, x in enumerate(dims.DISPOSITIONS)})})], 'record') AS terminal FROM rec LEFT JOIN find USING (artifact_id) GROUP BY artifact_id")
def boundary(spark, d):
    return explore.boundary(P.records(spark, d))


@query(f"SELECT {SITE_ORDER}, 'ls-' || row_number() OVER (ORDER BY {SITE_ORDER}) AS id FROM lineitem")
def site_numbers(spark, d):
    return numbered(P.table(spark, d, "lineitem").select(*P.ORDER), P.ORDER, "id", "ls-")


@query(f"""
, few AS (SELECT artifact_id FROM rec ORDER BY {_case('behaviour', dims.DISPLAY)} * 10 - CASE WHEN privileged THEN 5 ELSE 0 END, artifact_id LIMIT 9),
cell AS ({STRIPE})
SELECT artifact_id, terminal, stage, state FROM few JOIN cell USING (artifact_id) JOIN (
  SELECT artifact_id, coalesce((['act', 'review', 'record'])[min({_case('disposition', {x: i + 1 for i, x in enumerate(dims.DISPOSITIONS)})})], 'record') AS terminal FROM rec LEFT JOIN find USING (artifact_id) GROUP BY artifact_id) USING (artifact_id)""")
def boundary_cells(spark, d):
    """The load boundary's nine rows: the first records of the shown order with their cells and where they end."""
    records = P.records(spark, d)
    return explore.boundary_rows(records).select("artifact_id", "terminal", "stage", "state")


# ---- bills ----


@query(f"SELECT artifact_id, locator, origin, format, {_case('format', dims.LABELS)} AS label, basis, digest, behaviour, verdict.g AS guard, verdict.r AS reason, sites, array_to_string(list_sort(environments), ',') AS environments, privileged, array_to_string(list_sort(list_distinct(bindings)), ',') AS evidence, alternative, coalesce(privileges, '') AS privileges, coalesce(findings, '') AS findings FROM rec LEFT JOIN priv USING (artifact_id) LEFT JOIN (SELECT artifact_id, string_agg(DISTINCT kind, ',' ORDER BY kind) AS findings FROM find GROUP BY artifact_id) USING (artifact_id)")
def bom_rows(spark, d):
    return bom.rows(P.records(spark, d))


@query("""SELECT p_partkey, '"' || replace(CASE WHEN regexp_matches(v, '^[=+@-]') THEN chr(39) || v ELSE v END, '"', '""') || '"' AS cell FROM (SELECT p_partkey, (['=', '+', '-', '@', '"', '', 'x'])[p_partkey % 7 + 1] || p_name || CASE WHEN p_size % 3 = 0 THEN '"' ELSE '' END AS v FROM part)""")
def csv_cells(spark, d):
    v = F.concat(F.element_at(F.array(*[F.lit(x) for x in ("=", "+", "-", "@", '"', "", "x")]), (F.col("p_partkey") % 7 + 1).cast("int")), "p_name", F.when(F.col("p_size") % 3 == 0, '"').otherwise(""))
    return P.table(spark, d, "part").select("p_partkey", X.csv_cell(v).alias("cell"))


@query("""
SELECT coalesce(b.artifact_id, a.artifact_id) AS artifact_id, CASE WHEN b.artifact_id IS NULL THEN 'added' WHEN a.artifact_id IS NULL THEN 'removed' WHEN b IS DISTINCT FROM a THEN 'changed' ELSE 'unchanged' END AS status
FROM bb b FULL JOIN ba a ON a.artifact_id = b.artifact_id""")
def bom_diff(spark, d):
    return DF.status(*P.bills(spark, d)).select("artifact_id", "status")


@query("SELECT artifact_id, c.f AS field, c.b AS before, c.a AS after, c.d AS direction FROM chg")
def diff_fields(spark, d):
    return DF.changes(*P.bills(spark, d))


@query("SELECT artifact_id, min(CASE c.d WHEN 'opened' THEN 0 WHEN 'lateral' THEN 1 ELSE 2 END) AS rank, count(*) AS fields FROM chg GROUP BY artifact_id")
def diff_rank(spark, d):
    return DF.ranked(DF.changes(*P.bills(spark, d)))


# ---- counts, orders and views ----


@query(f"SELECT {_case('format', dims.LABELS)} AS label, count(*) AS artifacts FROM rec GROUP BY 1")
def summary_formats(spark, d):
    return S.by_format(P.records(spark, d))


@query(f"SELECT environment, {_case('environment', {k: v[0] for k, v in dims.ENVIRONMENTS.items()})} AS label, {_case('environment', {k: v[1] for k, v in dims.ENVIRONMENTS.items()})} AS short, count(*) AS artifacts FROM (SELECT unnest(shown) AS environment FROM rec) GROUP BY environment")
def summary_environments(spark, d):
    return S.by_environment(P.records(spark, d))


@query(f"SELECT privilege, {_case('privilege', dims.PRIVILEGE_LABELS)} AS label, count(*) AS artifacts FROM (SELECT unnest(string_split(privileges, ',')) AS privilege FROM priv WHERE privileges <> '') GROUP BY privilege")
def summary_privileges(spark, d):
    return S.by_privilege(P.records(spark, d))


@query("SELECT verdict.b AS behaviour, verdict.r AS reason, count(*) AS sites FROM res WHERE artifact_id IS NULL GROUP BY ALL")
def orphan_sites(spark, d):
    return S.orphans(P.resolved(spark, d))


@query("SELECT binding, count(*) AS records FROM ev GROUP BY 1 UNION ALL SELECT 'absent', count(*) FROM rec WHERE evidence_state = 'absent' AND origin = 'in-tree' AND behaviour IN ('code', 'unknown')")
def evidence_counts(spark, d):
    return E.counts(P.evidence(spark, d), P.records(spark, d))


@query("SELECT scanner, count(*) AS records, count(DISTINCT artifact_id) AS artifacts FROM ev GROUP BY scanner")
def evidence_scanners(spark, d):
    return E.scanners(P.evidence(spark, d))


@query("SELECT 'ev-' || row_number() OVER (ORDER BY seq) AS id, seq, subject FROM scn")
def evidence_numbers(spark, d):
    return numbered(P.scanned(spark, d).select("seq", "subject"), ["seq"], "id", "ev-")


@query(f"SELECT artifact_id, file, l_orderkey, l_linenumber, row_number() OVER (PARTITION BY artifact_id ORDER BY file, {SITE_ORDER}) AS place FROM sit WHERE artifact_id IS NOT NULL")
def site_order(spark, d):
    rows = P.sites(spark, d).where("artifact_id is not null").select("artifact_id", "file", *P.ORDER)
    return numbered_within(rows, ["artifact_id"], ["file", *P.ORDER], "place").select("artifact_id", "file", "l_orderkey", "l_linenumber", "place")


@query(f"""
, l AS (SELECT doc_id, unnest(lines) AS words, generate_subscripts(lines, 1) AS line FROM (SELECT doc_id, string_split(replace(text, chr(13) || chr(10), chr(10)), chr(10)) AS lines FROM documents)),
h AS ({" UNION ALL ".join(f"SELECT doc_id, '{k}' AS kind, '{n}' AS label, line FROM l WHERE length(words) <= 4000 AND regexp_matches(words, '{p}')" for k, n, p in SIGNALS)})
SELECT file, kind, label, row_number() OVER (PARTITION BY file ORDER BY kind, line, label) AS place FROM (SELECT doc_id::VARCHAR AS file, kind, label, min(line) AS line FROM h GROUP BY ALL)""")
def privilege_order(spark, d):
    found = C.signals(P.table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("path"), "text"), SIGNALS)
    return numbered_within(found.select("file", "kind", "line", "label"), ["file"], ["kind", "line", "label"], "place").select("file", "kind", "label", "place")


@query("SELECT file, row_number() OVER (ORDER BY NOT any_value(privileged), file) AS place FROM res JOIN ctx USING (file) GROUP BY file")
def loadpath_order(spark, d):
    rows = explore.load_paths(P.resolved(spark, d), P.contexts(spark, d)).select((~F.col("privileged")).alias("_later"), "file")
    return numbered(rows, ["_later", "file"], "place").select("file", "place")


@query("SELECT file, loader, artifact_id, locator, verdict.b AS behaviour, count(*) AS sites FROM res LEFT JOIN (SELECT artifact_id, locator FROM art) USING (artifact_id) GROUP BY ALL")
def loadpath_rows(spark, d):
    rows = explore.path_rows(P.resolved(spark, d), P.artifacts(spark, d))
    return rows.groupBy("file", "loader", "artifact_id", "locator", "behaviour").agg(F.count("*").alias("sites"))


@query("SELECT id, locator, format, behaviour FROM find JOIN rec USING (artifact_id)")
def finding_subjects(spark, d):
    records = P.records(spark, d)
    return explore.subjects(R.findings(records), records).select("id", "locator", "format", "behaviour")


@query(f"SELECT artifact_id, locator FROM rec WHERE {' AND '.join(HELD.values())}")
def bom_visible(spark, d):
    records = P.records(spark, d)
    return explore.visible(records.select("artifact_id", "locator"), records, FILTERS)


CONVERTED = _case("format", {f: t[0] for f, t in dims.CONVERTIBLE.items()})


@query(f"""SELECT artifact_id, format, {_case("format", dims.LABELS)} AS label, {_case("format", dims.INTRINSIC)} AS intrinsic, target, {_case("target", dims.LABELS)} AS target_label, {_case("target", dims.INTRINSIC)} AS target_intrinsic
FROM (SELECT *, CASE WHEN alternative = 'sibling-present' THEN 'safetensors' WHEN alternative = 'conversion-available' THEN {CONVERTED} END AS target FROM rec) WHERE target IS NOT NULL""")
def format_comparison(spark, d):
    return explore.compared(P.records(spark, d))


FIRST_GUARDED = f"(SELECT artifact_id, arg_min(loader, ({SITE_ORDER})) AS guarded FROM res WHERE artifact_id IS NOT NULL AND loader IN {_in(dims.GUARDS)} GROUP BY artifact_id)"


@query(f"""SELECT artifact_id, CASE WHEN alternative = 'sibling-present' THEN 'load the safetensors file beside it' WHEN alternative = 'loader-guard-available' THEN 'pass ' || {_case("guarded", dims.GUARDS)} || ' to ' || guarded
  WHEN alternative = 'conversion-available' THEN 'load ' || locator || ' once where nothing is at stake and write ' || regexp_replace(locator, '[.][^./]*$', '') || '.' || {CONVERTED}
  WHEN format = 'mcp-server-manifest' THEN 'pin the server and narrow what it may reach' WHEN behaviour = 'directive' THEN 'narrow what it is granted' END AS change FROM rec LEFT JOIN {FIRST_GUARDED} USING (artifact_id)""")
def alternative_change(spark, d):
    records = P.records(spark, d)
    return records.select("artifact_id", R.change(records).alias("change"))


# Every other page's size is raised so that all units are reached; of two equally near values the larger is shown.
SIZE = "strlen(html) * CASE page_id % 4 WHEN 1 THEN 1000 WHEN 2 THEN 1000000 WHEN 3 THEN 1024 ELSE 1 END"


@query(f"""SELECT page_id, CASE WHEN n < 1024 THEN n || ' B' WHEN n < 1048576 THEN printf('%.1f KiB', floor(n * 10 / 1024 + 0.5) / 10) WHEN n < 1073741824 THEN printf('%.1f MiB', floor(n * 10 / 1048576 + 0.5) / 10)
  ELSE printf('%.2f GiB', floor(n * 100 / 1073741824 + 0.5) / 100) END AS size FROM (SELECT page_id, {SIZE} AS n FROM pages)""")
def human_sizes(spark, d):
    k = F.col("page_id") % 4
    size = F.octet_length("html").cast("long") * F.when(k == 1, 1000).when(k == 2, 1_000_000).when(k == 3, 1024).otherwise(1)
    return P.table(spark, d, "pages").select("page_id", X.human_bytes(size).alias("size"))


@query("SELECT artifact_id, CASE WHEN length(locator) <= 30 THEN locator WHEN length(name) + 2 > 30 THEN '…' || right(name, 29) ELSE left(locator, greatest(30 - length(name) - 2, 0)::BIGINT) || '…/' || name END AS shown FROM (SELECT *, string_split(locator, '/')[-1] AS name FROM art)")
def elided_paths(spark, d):
    return P.artifacts(spark, d).select("artifact_id", X.elided(F.col("locator"), 30).alias("shown"))


# ---- graph ----

HOPS = ", hop AS (SELECT DISTINCT 'env:' || environment AS e, 'file:' || file AS f, 'loader:' || file || '#' || loader AS l, 'artifact:' || artifact_id AS a, verdict.b AS behaviour, privileged FROM res JOIN ctx USING (file) WHERE artifact_id IS NOT NULL)"
WORST = f"arg_max(behaviour, {_case('behaviour', dims.EXPOSURE)}) AS behaviour"


@query(HOPS + f" SELECT id, {WORST}, bool_or(privileged) AS privileged FROM (SELECT unnest([e, f, l, a]) AS id, behaviour, privileged FROM hop) GROUP BY id")
def graph_nodes(spark, d):
    return graph.nodes(P.resolved(spark, d), P.contexts(spark, d))


@query(HOPS + f""" SELECT x AS "from", y AS "to", {WORST} FROM (SELECT e AS x, f AS y, behaviour FROM hop UNION ALL SELECT f, l, behaviour FROM hop UNION ALL SELECT l, a, behaviour FROM hop) GROUP BY ALL""")
def graph_edges(spark, d):
    return graph.edges(P.resolved(spark, d), P.contexts(spark, d))


@query(HOPS + """, pair AS (SELECT e AS x, f AS y FROM hop UNION SELECT f, l FROM hop UNION SELECT l, a FROM hop), linked AS (SELECT x, y FROM pair UNION SELECT y, x FROM pair),
focus AS (SELECT min(a) AS id FROM hop), r(id, n) AS (SELECT id, 0 FROM focus UNION SELECT y, n + 1 FROM r JOIN linked ON id = x WHERE n < 2) SELECT id, min(n) AS distance FROM r GROUP BY id""")
def component(spark, d):
    """What is at most two links away from the first artifact in the graph of contexts, files, loaders and artifacts."""
    links = graph.edges(P.resolved(spark, d), P.contexts(spark, d)).select("from", "to")
    focus = links.where(F.startswith("to", F.lit("artifact:"))).agg(F.min("to")).first()[0]
    return graph.component(links, focus, 2)


# ---- what SQL doesn't express ----


@query(None)
def bom_digests(spark, d):
    return bom.row_digests(bom.rows(P.records(spark, d)))


@query(None)
def bom_cyclonedx(spark, d):
    return bom.cyclonedx(bom.rows(P.records(spark, d)))


def queries() -> dict[str, Query]:
    return dict(FOUND)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
