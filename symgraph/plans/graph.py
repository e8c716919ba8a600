"""The graph as three DataFrames."""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterable
from dataclasses import dataclass
from typing import TYPE_CHECKING

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

if TYPE_CHECKING:
    from ..sources.adjacency import Adjacency
    from ..sources.textindex import TextIndex

@dataclass(frozen=True)
class Graph:
    """nodes, edges and files; see `schemas` for their columns.

    text and near are what a store keeps for lookups: a text index of the nodes (`sources.textindex`) and the resolved
    edges bucketed by either end (`sources.adjacency`); operators work without them, on whole tables.  at makes those of
    `edges` that go from or to a few ids, where making them all can be spared.
    """

    nodes: DataFrame
    edges: DataFrame
    files: DataFrame
    text: TextIndex | None = None
    near: Adjacency | None = None
    at: Callable[[Iterable[str]], DataFrame] | None = None

    @property
    def resolved(self) -> DataFrame:
        return self.edges.where("resolved")

    def edges_at(self, ids: Iterable[str]) -> DataFrame:
        """Edges of which those from or to the ids are all there; others may be, too."""
        return self.edges if self.at is None else self.at(ids)


def degrees(edges: DataFrame, few: DataFrame | None = None) -> DataFrame:
    """(id, out_degree, in_degree) of every endpoint of a resolved edge: one shuffle of pre-aggregated counts.

    few: ids (column id) to count for, of a number that the caller bounds; they are sent to the edges, so only their
    counts are shuffled.
    """
    ends = edges.where("resolved").select(F.explode(F.array(F.struct(F.col("source").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("target").alias("id"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("x")).select("x.*")
    if few is not None:
        ends = ends.join(F.broadcast(few.select("id")), "id", "left_semi")
    return ends.groupBy("id").agg(F.sum("o").alias("out_degree"), F.sum("i").alias("in_degree"))


def with_degrees(nodes: DataFrame, edges: DataFrame, few: bool = False) -> DataFrame:
    """Nodes with in_degree, out_degree and degree; 0 for those without edges.  few: the nodes' number is bounded."""
    out = nodes.join(degrees(edges, nodes if few else None), "id", "left")
    out = out.withColumns({c: F.coalesce(c, F.lit(0)).cast("long") for c in ("in_degree", "out_degree")})
    return out.withColumn("degree", F.col("in_degree") + F.col("out_degree"))


def shared_folder(spark: SparkSession) -> str:
    """The cluster's spark.checkpoint.dir; a local folder only where it is unset and everything is on this machine."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if found is None:
        need_one_machine(spark, "spark.checkpoint.dir is not set")
        found = "file://" + tempfile.mkdtemp(prefix="symgraph-")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(found)
    return found


def cut(df: DataFrame) -> DataFrame:
    """Cut lineage by a checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def need_one_machine(spark: SparkSession, why: str) -> None:
    """Raises where executors run on other machines, which don't see this one's folders."""
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"{why}: executors on other machines would not find local files")
