"""Source trees: listing, reading and extraction, all where the executors are."""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..extract import detect_language, extract_file
from ..functions.paths import glob_regex
from ..plans.graph import cut
from ..schemas import MAX_FILE_SIZE

#: Directories that are never entered.
IGNORED = frozenset(
    (".git", ".hg", ".svn", "node_modules", ".venv", "venv", "env", "__pycache__", ".mypy_cache", ".ruff_cache", ".pytest_cache", "dist", "build", ".tox", ".idea", ".vscode")
)

_NODE = (
    "struct<id:string,kind:string,name:string,qualified_name:string,file_path:string,language:string,start_line:int,end_line:int,start_column:int,end_column:int,"
    "docstring:string,signature:string,is_exported:boolean,is_async:boolean,is_static:boolean,import_module:string,import_symbol:string>"
)
_EDGE = "struct<source:string,target:string,kind:string,line:int,col:int,callee_text:string>"
EXTRACTS = f"path string, rank long, modified_at long, status string, content_hash string, language string, size long, package string, nodes array<{_NODE}>, edges array<{_EDGE}>, errors array<string>"


class Ignore:
    """Patterns of a root's ignore file; negations are dropped."""

    def __init__(self, root: str):
        self.rules: list[tuple[str, bool, re.Pattern]] = []
        try:
            with open(os.path.join(root, ".gitignore"), encoding="utf-8", errors="replace") as f:
                listed = [x.strip() for x in f]
        except OSError:
            listed = []
        for line in listed:
            bare = line.strip("/")
            if bare and line[0] not in "#!":
                self.rules.append((bare, line.endswith("/"), re.compile(glob_regex(bare), re.S)))

    def matches(self, rel: str) -> bool:
        """rel: path from the root, with a slash at the end for directories."""
        for bare, directory, pattern in self.rules:
            if directory and (rel == bare or rel.startswith(bare + "/")):
                return True
            if "/" not in bare and any(pattern.match(p) for p in rel.removesuffix("/").split("/")):
                return True
            if pattern.match(rel):
                return True
        return False


def _entered(root: str, folder: str, ignore: Ignore) -> tuple[list[str], list[tuple[str, str]]]:
    """(folders below one that are entered, its source files as (place, path)); what can't be listed is passed over."""
    try:
        entries = sorted(os.scandir(os.path.join(root, folder)), key=lambda e: e.name)
    except OSError:
        return [], []
    folders, files, prefix = [], [], f"{folder}/" if folder else ""
    for e in entries:
        rel = prefix + e.name
        if e.is_dir(follow_symlinks=False):
            if e.name not in IGNORED and not e.name.startswith(".") and not ignore.matches(f"{rel}/"):
                folders.append(rel)
            continue
        if e.is_symlink():  # a link counts under the path it leads to
            rel = os.path.relpath(os.path.realpath(e.path), os.path.realpath(root)).replace(os.sep, "/")
        if not os.path.isdir(e.path) and detect_language(rel) and not ignore.matches(rel):
            files.append((e.path, rel))
    return folders, files


class Folder(InputPartition):
    """A folder to list: itself only, or with all below it."""

    def __init__(self, path: str, deep: bool):
        self.path, self.deep = path, deep


class TreeReader(DataSourceReader):
    """Folders are opened level by level until there are PARTS of them or none is left; each is then a partition, and
    lists what is below it.  So planning sees the names of some folders, and never those of files."""

    PARTS = 256

    def __init__(self, root: str):
        self.root = root

    def partitions(self) -> list[Folder]:
        ignore, level, above = Ignore(self.root), [""], []
        while level and len(level) < self.PARTS:
            above += level
            level = [f for folder in level for f in _entered(self.root, folder, ignore)[0]]
        return [Folder(f, False) for f in above] + [Folder(f, True) for f in level]

    def read(self, partition: Folder) -> Iterator[tuple[str, int | None, int | None]]:
        ignore, folders = Ignore(self.root), [partition.path]
        while folders:
            below, files = _entered(self.root, folders.pop(), ignore)
            if partition.deep:
                folders += below
            for place, rel in files:
                try:
                    st = os.stat(place)
                except OSError:
                    yield rel, None, None
                else:
                    yield rel, st.st_size, st.st_mtime_ns // 1_000_000


class TreeSource(DataSource):
    """spark.read.format("source_tree").option("root", PATH): path, size and modified_at of the source files of a tree.

    Ignored folders are not entered.  The root must be a path that every executor sees.
    """

    @classmethod
    def name(cls) -> str:
        return "source_tree"

    def schema(self) -> str:
        return "path string, size long, modified_at long"

    def reader(self, schema) -> TreeReader:
        return TreeReader(self.options["root"])


def scan(spark: SparkSession, root: str) -> DataFrame:
    """(path, size, modified_at) of the files below root, each path once."""
    spark.dataSource.register(TreeSource)
    found = spark.read.format("source_tree").option("root", root).load()
    return found.groupBy("path").agg(F.max("size").alias("size"), F.max("modified_at").alias("modified_at"))


def listing(spark: SparkSession, root: str) -> DataFrame:
    """(path, rank) of the files below root; ranks count from 0 in byte order.

    A range sort puts paths in order over partitions; their sizes, one row a partition, give where each one's ranks begin.
    """
    parts = cut(scan(spark, root).select("path").orderBy("path").withColumns({"part": F.spark_partition_id(), "at": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))}))
    sizes = parts.groupBy("part").agg(F.count("*").alias("n"))
    begin = sizes.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("begin"))
    return parts.join(F.broadcast(begin), "part").select("path", (F.col("begin") + F.col("at")).alias("rank"))


def package_of(raw: bytes) -> str | None:
    m = re.search(rb"(?m)^[ \t]*package[ \t]+(\S+)", raw)
    return m[1].decode("utf-8", "replace") if m else None


def _read(root: str, path: str, rank: int, known: str | None) -> dict:
    row = dict.fromkeys(("content_hash", "size", "package", "modified_at"))
    row |= {"path": path, "rank": rank, "language": detect_language(path), "nodes": [], "edges": [], "errors": []}
    full = os.path.join(root, path)
    try:
        st = os.stat(full)
        row["modified_at"] = st.st_mtime_ns // 1_000_000
        if st.st_size > MAX_FILE_SIZE:
            return row | {"status": "failed", "errors": [f"{path}: size exceeded ({st.st_size} > {MAX_FILE_SIZE})"]}
        with open(full, "rb") as f:
            raw = f.read()
    except OSError as e:
        return row | {"status": "failed", "errors": [f"{path}: read failed: {e}"]}
    row |= {"content_hash": hashlib.sha1(raw).hexdigest(), "size": len(raw)}
    if row["content_hash"] == known:
        return row | {"status": "unchanged"}
    found = extract_file(path, raw)
    go = row["language"] == "go" and not path.endswith("_test.go")
    return row | {"status": "indexed", "nodes": found.nodes, "edges": found.edges, "errors": found.errors, "package": package_of(raw) if go else None}


def extracts(files: DataFrame, root: str) -> DataFrame:
    """One row per file of (path, rank, known_hash): its state and, unless its hash is known, its symbols.

    Files are read where the rows are, so the root must be a path that every executor sees.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    schema = to_arrow_schema(_parse_datatype_string(EXTRACTS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            for at in range(0, len(rows), 64):
                yield pa.RecordBatch.from_pylist([_read(root, r["path"], r["rank"], r["known_hash"]) for r in rows[at : at + 64]], schema)

    return files.select("path", "rank", "known_hash").mapInArrow(run, EXTRACTS)


def snippet(root: str, path: str, start: int, end: int, around: int = 1) -> str:
    """Numbered lines of a file; empty if it can't be read."""
    try:
        with open(os.path.join(root, path), encoding="utf-8", errors="replace", newline="") as f:
            lines = f.read().split("\n")
    except OSError:
        return ""
    first, last = max(start - 1 - around, 0), min(end + around, len(lines))
    return "\n".join(f"{i + 1:4d}: {lines[i]}" for i in range(first, last))
