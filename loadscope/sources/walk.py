"""Source trees as a Spark data source: entries of a directory, and bounded reads of them.

    tree(spark, path)
    tree(spark, path, list="skipped")

Folders are dealt out as partitions, a large one by the folders below it, so a wide or deep tree is
walked by many tasks. Filters on the path's beginning, the size and links are pushed into the walk: a folder that can't hold a wanted path isn't entered.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, InputPartition, IsNotNull, LessThanOrEqual, Not, StringStartsWith

from loadscope.sources.errors import AnalysisError

# Depth and number of entries of a walk, and directories that are never entered.
DEEPEST, MOST_ENTRIES = 24, 40_000
SKIPPED = frozenset(
    ".git .hg .svn node_modules .venv venv env __pycache__ .mypy_cache .pytest_cache .ruff_cache .tox .next .nuxt .turbo dist build target .gradle .idea .vscode-test site-packages .terraform".split()
)
#: Bytes at either end of a file that its format is told from.
EDGE = 65_536


#: Partitions that a tree is dealt into, if it has as many folders; so many folders are listed at once.
PARTITIONS = 64


@dataclass
class Folder(InputPartition):
    path: str
    depth: int
    whole: bool


@dataclass
class Wanted:
    """What is asked of entries: how paths begin and don't begin, the largest size, and whether they are links."""

    begins: tuple[str, ...] = ()
    lacks: tuple[str, ...] = ()
    most: int | None = None
    link: bool | None = None

    def enters(self, folder: str) -> bool:
        """Whether a folder can hold a wanted path."""
        below = f"{folder}/"
        return all(below.startswith(b) or b.startswith(below) for b in self.begins) and not any(below.startswith(x) for x in self.lacks)

    def takes(self, path: str, size: int, link: bool) -> bool:
        return all(map(path.startswith, self.begins)) and not path.startswith(self.lacks) and (self.most is None or size <= self.most) and self.link in (None, link)


class TreeReader(DataSourceReader):
    def __init__(self, root: str, skipped: bool):
        self.root, self.skipped, self.wanted = os.path.abspath(root), skipped, Wanted()

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        """Takes the filters it knows; the others are given back to Spark."""
        w = self.wanted
        for f in filters:
            match f:
                case StringStartsWith(("path",), value):
                    w.begins += (value,)
                case Not(StringStartsWith(("path",), value)):
                    w.lacks += (value,)
                case LessThanOrEqual(("size",), value):
                    w.most = value if w.most is None else min(w.most, value)
                case EqualTo(("link",), bool(value)) if w.link is None:
                    w.link = value
                case IsNotNull():  # nothing of an entry is null
                    pass
                case _:
                    yield f

    def _below(self, folder: str, depth: int) -> Iterator[tuple[str, bool]]:
        """The folders of a folder, and whether each is entered. One that no wanted path is in isn't named at all."""
        try:
            with os.scandir(os.path.join(self.root, folder)) as entries:
                names = sorted(e.name for e in entries if not e.is_symlink() and e.is_dir(follow_symlinks=False))
        except OSError:
            return
        for name in names:
            path = f"{folder}/{name}" if folder else name
            if self.wanted.enters(path):
                yield path, name not in SKIPPED and depth < DEEPEST

    def partitions(self) -> list[Folder]:
        """The root's own entries, and folders below: the shallowest are opened until there are enough."""
        done, work = [Folder("", 0, False)], [("", 0)]
        while work:
            folder, depth = work.pop(0)
            below = [(path, depth + 1) for path, enters in self._below(folder, depth) if enters]
            if folder:
                done.append(Folder(folder, depth, len(done) + len(work) >= PARTITIONS))
                if done[-1].whole:
                    continue
            work += below
        return done

    def read(self, partition: Folder) -> Iterator[tuple]:
        """(path, size, link): links are listed with size 0 and never followed; an entry that can't be read has size 0. Or (path, 0, false) of the folders that aren't entered."""
        work = [(partition.path, partition.depth)]
        while work:
            folder, depth = work.pop()
            for path, enters in self._below(folder, depth):
                if enters and partition.whole:
                    work.append((path, depth + 1))
                elif self.skipped and not enters and self.wanted.takes(path, 0, False):
                    yield path, 0, False
            if not self.skipped:
                yield from self._entries(folder)

    def _entries(self, folder: str) -> Iterator[tuple]:
        try:
            entries = sorted(os.scandir(os.path.join(self.root, folder)), key=lambda e: e.name)
        except OSError:
            return
        for e in entries:
            path, link = f"{folder}/{e.name}" if folder else e.name, e.is_symlink()
            if not link and not e.is_file(follow_symlinks=False):
                continue
            try:
                size = 0 if link else e.stat(follow_symlinks=False).st_size
            except OSError:
                size = 0
            if self.wanted.takes(path, size, link):
                yield path, size, link


class TreeSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tree"

    def schema(self) -> str:
        return "path string, size long, link boolean"

    def reader(self, schema) -> DataSourceReader:
        return TreeReader(self.options["root"], self.options.get("list", "entries") == "skipped")


def tree(spark: SparkSession, root: str, **options: str) -> DataFrame:
    """The entries of a directory (path, size, link); with list="skipped" the folders that aren't entered."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(TreeSource)
    return spark.read.format("tree").options(root=root, **options).load()


def without(entries: DataFrame, ignored: Sequence[str]) -> DataFrame:
    """Entries without the folders that are ignored as a whole (`folder/**`), as filters that the walk takes."""
    for glob in ignored:
        folder = glob.removesuffix("/**").removeprefix("./")
        if folder != glob and not set("*?[]{}\\") & set(folder):
            entries = entries.where(~F.startswith("path", F.lit(f"{folder}/")))
    return entries


def _through_skipped(path: Column) -> Column:
    folders = F.slice(F.split(path, "/"), 1, F.size(F.split(path, "/")) - 1)
    return F.exists(folders, lambda p: p.isin(list(SKIPPED)))


def picked(entries: DataFrame) -> DataFrame:
    """Entries of a picked folder: their first segment goes, and paths through a skipped directory."""
    parts = F.split("path", "/")
    return entries.where((F.size(parts) > 1) & ~_through_skipped(F.col("path"))).withColumn("path", F.array_join(F.slice(parts, 2, F.size(parts)), "/"))


def picked_skipped(entries: DataFrame) -> DataFrame:
    """(path, files): the directories of a picked folder that are skipped, each once at its outermost, with how many files it hides."""
    parts = F.slice(F.split("path", "/"), 2, 1 << 16)
    first = F.array_position(F.transform(F.slice(parts, 1, F.size(parts) - 1), lambda p: p.isin(list(SKIPPED))), True)
    rows = entries.where(F.size(F.split("path", "/")) > 1).select(parts.alias("parts"), first.cast("int").alias("n")).where("n > 0")
    return rows.groupBy(F.array_join(F.slice("parts", F.lit(1), F.col("n")), "/").alias("path")).agg(F.count("*").alias("files"))


def dropped(entries: DataFrame) -> DataFrame:
    """Entries of dropped folders and files, which keep their names: links and paths through a skipped directory or deeper than a walk goes are left out; a leading slash is no part of a path."""
    rows = entries.withColumn("path", F.regexp_replace("path", "^/+", ""))
    return rows.where((F.col("path") != "") & ~F.col("link") & ~_through_skipped(F.col("path")) & (F.size(F.split("path", "/")) <= DEEPEST + 1))


def _inside(base: str, path: str) -> str:
    """The real path of an entry; one that leads out of the root is refused."""
    full = os.path.realpath(os.path.join(base, path))
    if not full.startswith(base + os.sep):
        raise OSError(path)
    return full


def _edges(f, edge: int) -> tuple[bytes, bytes, int]:
    head = f.read(edge)
    size = f.seek(0, os.SEEK_END)
    f.seek(max(0, size - edge))
    return head, f.read(edge), size


def read_edges(entries: DataFrame, root: str, edge: int = EDGE) -> DataFrame:
    """Entries that are files with head and tail: their first and last bytes; null if unreadable. A path never leads out of the root."""
    base = os.path.realpath(root)

    def read(batches):
        for batch in batches:
            heads, tails = [], []
            for path in batch["path"]:
                try:
                    with open(_inside(base, path), "rb") as f:
                        head, tail, _ = _edges(f, edge)
                    heads.append(head)
                    tails.append(tail)
                except OSError:
                    heads.append(None)
                    tails.append(None)
            yield batch.assign(head=heads, tail=tails)

    return entries.where(~F.col("link")).select("path", "size").mapInPandas(read, "path string, size long, head binary, tail binary")


#: Bytes of a file read as text at most, of a file hashed as a whole at most, and of a piece that is hashed at once.
MOST_TEXT, MOST_HASHED, PIECE = 8 << 20, 256 << 20, 1 << 16


def read_files(entries: DataFrame, root: str) -> DataFrame:
    """Entries with content (null above MOST_TEXT), head, tail, digest and coverage; all null if unreadable.

    A file is hashed in pieces, above MOST_HASHED by both edges and its size, so that no task
    holds more than MOST_TEXT of it. Rows are handed on in small batches.
    """
    base = os.path.realpath(root)

    def one(path: str, link: bool) -> tuple:
        if link:
            return None, None, None, None, None
        try:
            with open(_inside(base, path), "rb") as f:
                head, tail, size = _edges(f, EDGE)
                f.seek(0)
                content = f.read(MOST_TEXT) if size <= MOST_TEXT else None
                f.seek(0)
                sha = hashlib.sha256()
                if size <= MOST_HASHED:
                    while piece := f.read(PIECE):
                        sha.update(piece)
                else:
                    sha.update(head + f"|{size}|".encode() + tail)
            return content, head, tail, sha.hexdigest(), "full" if size <= MOST_HASHED else "head-tail"
        except OSError:
            return None, None, None, None, None

    def read(batches):
        for batch in batches:
            for at in range(0, len(batch), 16):
                part = batch.iloc[at : at + 16]
                rows = [one(p, link) for p, link in zip(part["path"], part["link"], strict=True)]
                yield part.assign(**{name: [r[i] for r in rows] for i, name in enumerate(("content", "head", "tail", "digest", "coverage"))})

    return entries.select("path", "size", "link").mapInPandas(read, "path string, size long, link boolean, content binary, head binary, tail binary, digest string, coverage string")


def check(entries: DataFrame, root: str) -> int:
    """How many entries there are; none, or more than MOST_ENTRIES, raise: a part of a tree says less than it seems to."""
    n = entries.limit(MOST_ENTRIES + 1).count()
    if not n:
        raise AnalysisError("empty-tree", f"{root}: nothing to read", "There is no file below this folder that isn't skipped.", "Name the folder of a project.")
    if n > MOST_ENTRIES:
        raise AnalysisError("tree-too-large", f"{root}: more than {MOST_ENTRIES} entries", "A walk that stops in between would leave files out.", "Name a smaller folder, or ignore generated ones.")
    return n


def memory(spark, files: dict[str, bytes | str]) -> DataFrame:
    """(path, size, link, content) of files given as they are."""
    rows = [(p, len(raw := c.encode() if isinstance(c, str) else c), False, bytearray(raw)) for p, c in sorted(files.items())]
    return spark.createDataFrame(rows, "path string, size long, link boolean, content binary")


def decoded(files: DataFrame, content: str = "content") -> DataFrame:
    """Files whose content is base64 text, as bytes."""
    return files.withColumn(content, F.unbase64(F.col(content)))
