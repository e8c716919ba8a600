"""Writes as DataFrame transformations: replace by key, mark, delete by file, upsert, snippets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.graph import Graph
from ..schemas import PLACEHOLDER


def replace_by_key(df: DataFrame, key: str, *order: str) -> DataFrame:
    """Of the rows with one key the last in order; partial maxima are taken before the shuffle."""
    rest = [c for c in df.columns if c not in (key, *order)]
    last = df.groupBy(key).agg(F.max_by(F.struct(*order, *rest), F.struct(*order)).alias("x"))
    return last.select(*[F.col(key) if c == key else F.col(f"x.{c}").alias(c) for c in df.columns])


def mark_resolved(edges: DataFrame) -> DataFrame:
    """Edges with their state: placeholders are open, all others resolved."""
    return edges.withColumn("resolved", ~F.col("target").startswith(PLACEHOLDER))


def delete_files(graph: Graph, paths: DataFrame) -> Graph:
    """The graph without the files (column path), their nodes, and all edges from or to these."""
    gone = graph.nodes.join(paths.select(F.col("path").alias("file_path")), "file_path", "left_semi").select("id")
    edges = graph.edges.join(gone.select(F.col("id").alias("source")), "source", "left_anti").join(gone.select(F.col("id").alias("target")), "target", "left_anti")
    nodes = graph.nodes.join(paths.select(F.col("path").alias("file_path")), "file_path", "left_anti")
    return Graph(nodes, edges, graph.files.join(paths.select("path"), "path", "left_anti"))


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Old rows but for the keys that are written anew, and the new ones."""
    return old.join(new.select(key), key, "left_anti").unionByName(new)


def snippet(content: Column, start: Column, end: Column, around: int = 1) -> Column:
    """Numbered lines of a text from start to end (1-based), with some more around."""
    lines = F.split(content, "\n")
    first = F.greatest(start - around, F.lit(1))
    part = F.slice(lines, first, F.greatest(F.least(end + around, F.size(lines)) - first + 1, F.lit(0)))
    return F.array_join(F.transform(part, lambda x, i: F.format_string("%4d: %s", i + first, x)), "\n")
