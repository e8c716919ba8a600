"""A project's store: Parquet tables in buckets of files, a pointer that is swapped atomically, and metadata.

    snapshots/NAME/TABLE/bucket=B   what one run wrote of a table: the buckets that it changed
    CURRENT                         which run's folder holds each bucket of each table
    text/                           the text index of the nodes, if the store keeps one (`textindex`)
    metadata.json, errors.log

A row's bucket follows from its file, so a run that changes one file writes one bucket of each table; buckets it didn't write stay where they
are.  Readers see the state that the pointer names; a run that fails leaves it as it was.  `extracts` keeps what files
yielded, with calls still unresolved, so that an incremental run resolves from the same rows as a full one.

The store lies in a folder of this machine, or at a URI; a session whose executors run elsewhere needs the latter.
"""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import _parse_datatype_string

from ..plans.graph import Graph, need_one_machine
from ..schemas import EDGES, FILES, NODES, SCHEMA_VERSION
from .adjacency import Adjacency
from .place import Place
from .textindex import TextIndex

TABLES = ("nodes", "edges", "files")
#: The column that says which file a row belongs to, by table; an edge belongs to its source's file.
FILE_OF = {"extracts": "path", "nodes": "file_path", "edges": "source", "files": "path"}
BUCKETS = 16


def now_ms() -> int:
    return time.time_ns() // 1_000_000


def bucket_of(file: Column) -> Column:
    """The bucket of a path, and of every node id that begins with it."""
    return F.pmod(F.xxhash64(F.substring_index(file, "::", 1)), F.lit(BUCKETS)).cast("int")


class Store:
    def __init__(self, path: str):
        self.place = Place(path)
        self.path = self.place.path
        self.staged: dict = {}

    def file(self, *parts: str) -> str:
        return self.place.file(*parts)

    @property
    def current(self) -> dict:
        """The pointer: `tables` has for each table the buckets that each run's folder holds; none means all of them."""
        text = (self.place.read("CURRENT") or "").strip()
        if not text:
            return {}
        # A bare name is a snapshot that holds all of each table.
        return json.loads(text) if text.startswith("{") else {"tables": {t: {text: None} for t in FILE_OF}}

    def initialized(self) -> bool:
        return self.place.exists("metadata.json")

    # Metadata

    def meta(self) -> dict:
        try:
            return json.loads(self.place.read("metadata.json") or "{}")
        except ValueError:
            return {}

    def get(self, key: str) -> str:
        return self.meta().get(key, {}).get("value", "")

    def put(self, **values: str) -> None:
        data = self.meta() | {k: {"value": v, "updated_at": now_ms()} for k, v in values.items()}
        self.place.write("metadata.json", json.dumps(data, indent=2))

    def metadata(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(k, v["value"], v["updated_at"]) for k, v in sorted(self.meta().items())], "key string, value string, updated_at long")

    # Tables

    def _check(self, spark: SparkSession) -> None:
        if self.place.local:
            need_one_machine(spark, f"the store is in {self.path}")

    def read(self, spark: SparkSession, table: str, schema: str, staged: bool = False) -> DataFrame:
        """A table as the pointer has it, or with what is staged; columns it lacks (older data) are null, and a missing
        table is empty."""
        want = _parse_datatype_string(schema)
        found = (self.staged if staged else self.current).get("tables", {}).get(table, {})
        found = {name: buckets for name, buckets in found.items() if self.place.exists("snapshots", name, table)}
        if not found:
            return spark.createDataFrame([], want)
        self._check(spark)
        out = None
        for name, buckets in found.items():
            folder = f"{self.place.uri}/snapshots/{name}/{table}"
            df = spark.read.parquet(folder) if buckets is None else spark.read.schema(f"{schema}, bucket int").parquet(folder).where(F.col("bucket").isin(*buckets))
            df = df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in want])
            out = df if out is None else out.unionByName(df)
        return out

    def graph(self, spark: SparkSession) -> Graph:
        edges = self.read(spark, "edges", EDGES).withColumn("resolved", F.coalesce("resolved", F.lit(False)))
        state = self.current
        text = TextIndex(f"{self.place.uri}/text", state["text"]) if state.get("text") else None
        near = Adjacency(f"{self.place.uri}/snapshots/{state['near'][0]}/near", state["near"][1]) if state.get("near") else None
        return Graph(self.read(spark, "nodes", NODES), edges, self.read(spark, "files", FILES), text, near)

    def stage(self) -> str:
        """A new run's name; nothing sees what it writes before commit()."""
        self.staged = json.loads(json.dumps(self.current or {"tables": {}}))
        return uuid.uuid4().hex

    def write(self, name: str, table: str, df: DataFrame, buckets: list[int] | None = None) -> None:
        """Stages a table: all of it, or the rows of the given buckets in place of what these held."""
        self._check(df.sparkSession)
        if table in FILE_OF and FILE_OF[table] in df.columns:
            df = df.withColumn("bucket", bucket_of(F.coalesce(FILE_OF[table], F.lit(""))))
            every = list(range(BUCKETS))
            some = every if buckets is None else sorted(buckets)
            if some != every:
                df = df.where(F.col("bucket").isin(*some)) if some else df.where("false")
            # A file or more a bucket, sorted by path, so that ranges of paths prune.
            df.repartition(len(some) or 1, "bucket").sortWithinPartitions("bucket", FILE_OF[table]).write.mode("overwrite").partitionBy("bucket").parquet(f"{self.place.uri}/snapshots/{name}/{table}")
            held = {n: [b for b in (every if bs is None else bs) if b not in some] for n, bs in self.staged["tables"].get(table, {}).items()}
            self.staged["tables"][table] = {n: bs for n, bs in held.items() if bs} | ({name: some} if some else {})
        else:
            df.write.mode("overwrite").parquet(f"{self.place.uri}/snapshots/{name}/{table}")
            if table in FILE_OF:
                self.staged["tables"][table] = {name: None}

    def scratch(self, spark: SparkSession, name: str, table: str) -> DataFrame:
        """What a run wrote for itself, which the pointer doesn't name."""
        return spark.read.parquet(f"{self.place.uri}/snapshots/{name}/{table}")

    def commit(self, name: str) -> None:
        """Makes what is staged the current state; folders that it doesn't name go."""
        self.place.write("CURRENT", json.dumps(self.staged))
        named = {n for t in self.staged["tables"].values() for n in t} | {n for n, _ in [self.staged.get("near") or ("", 0)]}
        for old in self.place.names("snapshots"):
            if old not in named:
                self.place.remove("snapshots", old)
        self.place.remove("snapshots", name, "fresh")

    def discard(self, name: str) -> None:
        self.place.remove("snapshots", name)
        self.staged = {}

    def write_errors(self, errors: list[str]) -> None:
        """errors.log, which is there only if there are errors."""
        if errors:
            self.place.write("errors.log", "\n".join(errors) + "\n")
        else:
            self.place.remove("errors.log")

    def catalog(self, spark: SparkSession) -> list[dict]:
        """Tables and their rows, by name."""
        sizes = {t: self.read(spark, t, s).count() for t, s in zip(TABLES, (NODES, EDGES, FILES))}
        sizes |= {"project_metadata": len(self.meta()), "schema_versions": SCHEMA_VERSION}
        return [{"table": t, "rows": n} for t, n in sorted(sizes.items())]
