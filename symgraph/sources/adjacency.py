"""Resolved edges stored twice, bucketed and sorted by target and by source.

    by_target/   edges in BUCKETS buckets by target: who points at a node
    by_source/   the same edges by source: what a node points at

Lookups of known ids read the buckets of these ids.  A level of a walk joins a frontier to the edges where they lie: only
the frontier is shuffled, into as many partitions as there are buckets.  Edges with an end that is no node are left out when the
tables are written, so no walk has to look nodes up again.

The tables are Parquet at a path of any kind.  Spark knows of buckets from its catalog only, so a session names the
folders as an external table while it makes a DataFrame of it; the name is unique and dropped at once, the files stay.
A node with very many edges fills one bucket more than others; its edges are read by one task, as many as the node has.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 64
#: Nodes to a bucket where the number of buckets follows the graph.
A_BUCKET = 100_000
COLUMNS = "id long, source string, target string, kind string, line int, col int"
#: Ids that are looked up as literals, which prune buckets; more are joined.
LITERALS = 1000


@dataclass(frozen=True)
class Adjacency:
    """The two tables at a path."""

    path: str
    buckets: int = BUCKETS

    def write(self, nodes: DataFrame, edges: DataFrame) -> None:
        """Resolved edges between nodes, replacing what is there."""
        self._write_by(self._dealt(nodes, edges, both=True), "target")
        # The second table is the first dealt anew, so edges are made and looked up among nodes once.
        made = nodes.sparkSession.read.schema(COLUMNS).parquet(f"{self.path}/by_target")
        self._write_by(made.repartition(self.buckets, "source"), "source")

    def write_into(self, nodes: DataFrame, edges: DataFrame) -> None:
        """The edges by target alone, which is what walks and callers read; none comes to a target that is no node, so only
        sources are looked up."""
        self._write_by(self._dealt(nodes, edges, both=False), "target")

    def _dealt(self, nodes: DataFrame, edges: DataFrame, both: bool) -> DataFrame:
        """Resolved edges from nodes, and to nodes if both, one task a bucket by target.

        Edges are sent to their buckets once and meet the nodes there; both joins are by hash, so edges are sorted when they are
        written only.  A task holds its share of the nodes, each once.  Semi-joins would do, but are moved below a union of edges
        and below the shuffle, and done for each part of it.
        """
        e = edges.where("resolved").select(*[c.split(" ")[0] for c in COLUMNS.split(", ")])
        known = lambda end, *n: nodes.select(F.col("id").alias(end)).repartition(*n, end).distinct().hint("shuffle_hash")
        e = e.join(known("source"), "source").repartition(self.buckets, "target")
        return e.join(known("target", self.buckets), "target") if both else e

    def _write_by(self, dealt: DataFrame, end: str) -> None:
        """One task a bucket: each bucket is one sorted file."""
        name, names = f"edges_{uuid.uuid4().hex}", [c.split(" ")[0] for c in COLUMNS.split(", ")]
        dealt.select(*names).write.mode("overwrite").bucketBy(self.buckets, end).sortBy(end, "id").option("path", f"{self.path}/by_{end}").format("parquet").saveAsTable(name)
        dealt.sparkSession.sql(f"DROP TABLE {name}")

    def _table(self, spark: SparkSession, end: str) -> DataFrame:
        name, place = f"edges_{uuid.uuid4().hex}", f"{self.path}/by_{end}".replace("'", "\\'")
        spark.sql(f"CREATE TABLE {name} ({COLUMNS}) USING parquet CLUSTERED BY ({end}) SORTED BY ({end}, id) INTO {self.buckets} BUCKETS LOCATION '{place}'")
        try:
            return spark.table(name)
        finally:
            spark.sql(f"DROP TABLE {name}")

    def into(self, spark: SparkSession) -> DataFrame:
        """Edges by target."""
        return self._table(spark, "target")

    def out_of(self, spark: SparkSession) -> DataFrame:
        """Edges by source."""
        return self._table(spark, "source")


def near(path: str, nodes: DataFrame, least: int) -> Adjacency:
    """Tables at a path in as many buckets as the nodes ask for, so that a bucket's share of edges doesn't grow with them."""
    return Adjacency(path, max(least, nodes.count() // A_BUCKET))


def of(edges: DataFrame, end: str, ids: DataFrame) -> DataFrame:
    """Edges whose `end` (target or source) is one of the ids (column id), of which a lookup has few: these become
    literals, so that other buckets are not read.  Where there are more than LITERALS they are joined."""
    few = [r["id"] for r in ids.select("id").distinct().limit(LITERALS + 1).collect()]
    if len(few) <= LITERALS:
        return edges.where(F.col(end).isin(*few)) if few else edges.where("false")
    return edges.join(ids.select(F.col("id").alias(end)), end, "left_semi")
