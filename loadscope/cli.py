"""Command line: scan a tree, write its bill of materials, compare two bills, gate a build."""

from __future__ import annotations

import argparse
import sys
from collections.abc import Iterator
from contextlib import nullcontext
from dataclasses import replace
from pathlib import Path

from pyspark.sql import functions as F

from loadscope.operators import bom, diff, explore
from loadscope.operators import evidence as E
from loadscope.operators import records as R
from loadscope.operators import summary as S
from loadscope.plans import dims
from loadscope.plans.analyze import analyze
from loadscope.plans.session import session
from loadscope.sources import bills, walk
from loadscope.sources.config import Config, parse_json, parse_yaml
from loadscope.sources.errors import AnalysisError

CONFIGS = ("loadscope.json", "loadscope.yaml", "loadscope.yml", ".loadscope.yaml")
#: Bytes of a configuration at most.
MOST_CONFIG = 4 << 20


def read_config(root: Path) -> Config:
    for name in CONFIGS:
        if (path := root / name).is_file():
            if path.stat().st_size > MOST_CONFIG:
                raise AnalysisError("bad-config", f"{name}: larger than {MOST_CONFIG} bytes", "A configuration is a few globs.", "Name the file that was meant.")
            return (parse_json if name.endswith("json") else parse_yaml)(path.read_text(), name)
    return Config()


def report(spark, root: Path, quiet: bool = True):
    """The analysis of a directory: its entries, with their bytes read in tasks. Stages are told on stderr."""
    base, config = str(root.resolve()), read_config(root)
    entries = walk.without(walk.tree(spark, base), config.ignore)
    walk.check(entries, str(root))

    def told(stage: str, counted: dict[str, int] | None) -> None:
        if counted is not None and not quiet:
            print(f"{stage}: " + ", ".join(f"{n} {name}" for name, n in counted.items()), file=sys.stderr)

    found = analyze(walk.read_files(entries, base), config, progress=told)
    skipped = walk.tree(spark, base, list="skipped")
    return replace(found, notices=found.notices.unionByName(skipped.select("path", F.lit("directory-skipped").alias("code"))))


def scan_lines(found) -> Iterator[str]:
    """Indicators, then how often each environment and format occurs, then notices."""
    records = found.records
    for row in S.indicators(records).collect():  # eight rows
        yield f"{row['indicator']:12} {row['value']} of {row['of']}"
    for title, counts, name in (("environments", S.by_environment(records), "environment"), ("formats", S.by_format(records), "label")):
        yield f"{title}: " + ", ".join(f"{r[name]} {r['artifacts']}" for r in S.frequent(counts, name).collect())  # as many as there are formats
    for row in found.notices.orderBy("path", "code").toLocalIterator():
        yield f"{row['code']}: {row['path']}"


def load_path_lines(found) -> Iterator[str]:
    paths = explore.load_paths(found.sites, found.contexts)
    for row in paths.orderBy(*explore.path_order()).toLocalIterator():
        yield f"{'!' if row['privileged'] else ' '} {row['file']}  {row['environment'] or 'unresolved'}  {row['sites']} loads of {row['artifacts']} artifacts"


def evidence_lines(found) -> Iterator[str]:
    for row in E.counts(found.evidence, found.records).orderBy("binding").collect():  # four rows
        yield f"{row['binding']}: {row['records']}"
    for row in E.scanners(found.evidence).orderBy("scanner").toLocalIterator():
        yield f"{row['scanner']}: {row['records']} records on {row['artifacts']} artifacts"


def explain_lines(found, term: str) -> Iterator[str]:
    """All that is known of one artifact; nothing if no artifact is meant."""
    row = next(iter(explore.lookup(found.records.withColumn("change", R.change(found.records)), term).collect()), None)
    if row is None:
        return
    yield f"{row['locator']}  {row['format']} ({row['basis']})  {row['behaviour']}"
    for name, value in (("reason", row["verdict"]["reason"]), ("guard", row["verdict"]["guard"]), ("environments", ", ".join(row["environments"])), ("privileges", ", ".join(row["privileges"])), ("evidence", ", ".join(row["bindings"])), ("alternative", row["change"]), ("tensors", ", ".join(row.asDict().get("dtypes") or []))):
        if value:
            yield f"  {name}: {value}"
    own = F.col("artifact_id") == row["artifact_id"]
    for site in found.sites.where(own).orderBy("file", "line").toLocalIterator():
        expects = dims.EXPECTED.get(site["loader"]) if site["verdict"]["reason"] == "format-undetermined" else None
        yield f"  {site['file']}:{site['line']} {site['loader']}" + (f" in cell {cell}" if (cell := site.asDict().get("cell")) else "") + (f", which expects {expects}" if expects else "")
    for f in R.findings(found.records.where(own)).orderBy(*R.finding_rank()).collect():  # fifteen at most
        yield f"  {f['disposition']}: {f['kind']}"


def migration_lines(records, markdown: bool = False) -> Iterator[str]:
    """Migrations in their order; as Markdown with a heading for each kind."""
    rows = explore.migrations(records).withColumn("change", R.change(records)).orderBy("rank", "locator")
    kind = None
    for row in rows.toLocalIterator():
        if markdown and row["alternative"]["kind"] != kind:
            kind = row["alternative"]["kind"]
            yield f"## {kind}\n"
        yield f"- [ ] `{row['locator']}`: {row['change']}" if markdown else f"{row['locator']} {row['alternative']['kind']} {row['alternative']['target'] or ''}".rstrip()


def bill_lines(records, form: str, project: str) -> Iterator[str]:
    rows = bom.rows(records)
    if form == "json":
        counted = lambda counts, name: {r[name]: r["artifacts"] for r in counts.collect()}  # noqa: E731  (as many as there are formats)
        summary = S.summary(records).first().asDict() | {"formats": counted(S.by_format(records), "label"), "environments": counted(S.by_environment(records), "environment")}
        yield from bom.document(rows, summary, project)
    elif form == "cyclonedx":
        yield from bom.cyclonedx_document(rows, project)
    else:
        lines = bom.text_lines(rows) if form == "text" else rows.select("artifact_id", bom.SPREAD[form](rows).alias("line"))
        for row in lines.orderBy("artifact_id").toLocalIterator():
            yield row["line"]


COMMANDS = ("scan", "artifacts", "loadpaths", "migrations", "plan", "evidence", "explain", "bom", "diff")


def emit(lines: Iterator[str], args) -> int:
    """Writes lines as they arrive, to a file or the terminal, and counts them."""
    n = 0
    with args.out.open("w", encoding="utf-8") if args.out else nullcontext(sys.stdout) as to:
        for line in lines:
            n += 1
            if args.out or not args.quiet:
                print(line, file=to)
    return n


def main(argv: list[str] | None = None) -> int:
    """0, or 1 where the gate fails, 2 where bills differ or the input is wrong."""
    parser = argparse.ArgumentParser(prog="loadscope")
    parser.add_argument("command", choices=COMMANDS)
    parser.add_argument("paths", nargs="+", help="a folder (explain: and what to explain), or two bills")
    parser.add_argument("--format", choices=("json", "lines", "csv", "text", "cyclonedx"), default="json")
    parser.add_argument("--fail-on", choices=("none", "any", "unknown", "privileged", "execution"), default="none")
    parser.add_argument("--out", help="write here instead of to the terminal; a bill as lines or csv to a folder (with a slash at its end) is written by tasks")
    parser.add_argument("--quiet", action="store_true", help="write nothing; the exit code tells")
    args = parser.parse_args(argv)
    args.spread, args.out = bool(args.out) and args.out.endswith("/"), args.out and Path(args.out)
    spark = session()
    try:
        if args.command == "diff":
            before, after = (bills.read(spark, str(p)) for p in args.paths[:2])
            n = emit((row["line"] for row in diff.text_lines(before, after).orderBy("line").toLocalIterator()), args)
            return 2 if n else 0
        root = Path(args.paths[0])
        found = report(spark, root, args.quiet)
        records = found.records
        project = found.project or root.resolve().name
        if args.command == "bom" and args.format in bom.SPREAD and args.spread:
            bom.spread(bom.rows(records), args.format).write.mode("overwrite").text(str(args.out))
            return 1 if not records.where(S.gate(records, args.fail_on)).isEmpty() else 0
        lines = {
            "scan": lambda: scan_lines(found), "loadpaths": lambda: load_path_lines(found), "evidence": lambda: evidence_lines(found), "explain": lambda: explain_lines(found, " ".join(args.paths[1:])),
            "migrations": lambda: migration_lines(records), "plan": lambda: migration_lines(records, True), "artifacts": lambda: bill_lines(records, "text", project), "bom": lambda: bill_lines(records, args.format, project),
        }[args.command]()
        if not emit(lines, args) and args.command == "explain":
            return 2
        return 1 if not records.where(S.gate(records, args.fail_on)).isEmpty() else 0
    except AnalysisError as e:
        print(e, file=sys.stderr)
        return 2


if __name__ == "__main__":
    sys.exit(main())
