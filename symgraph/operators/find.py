"""Finding nodes and the edges between them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.graph import Graph
from ..sources import adjacency

NODE = ["id", "kind", "name", "qualified_name", "file_path", "language", "start_line", "end_line"]


def find_nodes(graph: Graph, refs: DataFrame) -> DataFrame:
    """Nodes of each reference (column ref): by id, else by qualified name, else by name (imports left out).

    All references at once: three equi-joins, of which the lowest tier that hits is kept.
    """
    n = graph.nodes.select(*NODE, "is_exported")
    tiers = [
        refs.join(n, F.col("ref") == F.col("id")).withColumn("tier", F.lit(0)),
        refs.join(n, F.col("ref") == F.col("qualified_name")).withColumn("tier", F.lit(1)),
        refs.join(n.where("kind <> 'import'"), F.col("ref") == F.col("name")).withColumn("tier", F.lit(2)),
    ]
    hits = tiers[0].unionByName(tiers[1]).unionByName(tiers[2])
    return hits.withColumn("best", F.min("tier").over(Window.partitionBy("ref"))).where("tier = best").drop("best")


def find_node(graph: Graph, ref: str) -> DataFrame:
    """The same for one reference: predicates reach the scan, nothing is joined."""
    n = graph.nodes.select(*NODE, "is_exported")
    tier = F.when(F.col("id") == ref, 0).when(F.col("qualified_name") == ref, 1).when((F.col("name") == ref) & (F.col("kind") != "import"), 2)
    hits = n.where((F.col("id") == ref) | (F.col("qualified_name") == ref) | (F.col("name") == ref)).withColumn("tier", tier).where("tier is not null")
    return hits.where(F.col("tier") == hits.agg(F.min("tier").alias("best")).scalar())


def in_order(found: DataFrame) -> DataFrame:
    """Hits in the order of a lookup: by name the exported first, then place."""
    by_name = F.col("tier") == 2
    return found.orderBy(F.when(by_name, F.col("is_exported")).desc_nulls_last(), F.when(by_name, F.col("file_path")), F.when(by_name, F.col("start_line")), "id")


def resolved_edges(graph: Graph, source: str = "", target: str = "", kind: str = "") -> DataFrame:
    """Resolved edges with both ends' names; conditions that are empty don't apply."""
    e = graph.resolved
    for col, value in (("source", source), ("target", target), ("kind", kind)):
        if value:
            e = e.where(F.col(col) == value)
    s = graph.nodes.select(F.col("id").alias("source"), F.col("name").alias("source_name"), F.col("file_path").alias("source_file"))
    t = graph.nodes.select(
        F.col("id").alias("target"), F.col("name").alias("target_name"), F.col("file_path").alias("target_file"), F.col("kind").alias("target_kind"),
        F.col("qualified_name").alias("target_qname"), F.col("start_line").alias("target_line"),
    )
    joined = e.select("id", "source", "target", "kind", "line", "col").join(s, "source").join(t, "target")
    return joined.select("id", "source", "target", "kind", "line", "col", "source_name", "source_file", "target_name", "target_file", "target_kind", "target_qname", "target_line")


def _edges_at(graph: Graph, end: str, roots: DataFrame) -> DataFrame:
    """Resolved edges at the roots: their buckets only, where the graph has its edges bucketed."""
    if graph.near is None:
        return graph.resolved
    spark = graph.nodes.sparkSession
    return adjacency.of(graph.near.into(spark) if end == "target" else graph.near.out_of(spark), end, roots.select(F.col(f"{end}_id").alias("id")))


def callers(graph: Graph, symbol: str) -> DataFrame:
    """Calls that reach the symbol's nodes."""
    roots = find_node(graph, symbol).select(F.col("id").alias("target_id"), F.col("qualified_name").alias("target_qname"))
    source = graph.nodes.select(F.col("id").alias("caller_id"), F.col("name").alias("caller_name"), F.col("file_path").alias("caller_file"))
    calls = _edges_at(graph, "target", roots).where("kind = 'calls'").select(F.col("id").alias("edge_id"), F.col("source").alias("caller_id"), F.col("target").alias("target_id"), "line")
    return calls.join(roots, "target_id").join(source, "caller_id").select("edge_id", "caller_id", "caller_name", "caller_file", "line", "target_id", "target_qname")


def callees(graph: Graph, symbol: str) -> DataFrame:
    """Calls that leave the symbol's nodes."""
    roots = find_node(graph, symbol).select(F.col("id").alias("source_id"), F.col("qualified_name").alias("source_qname"))
    target = graph.nodes.select(F.col("id").alias("callee_id"), F.col("name").alias("callee_name"), F.col("qualified_name").alias("callee_qname"), F.col("file_path").alias("callee_file"), F.col("start_line").alias("callee_line"))
    calls = _edges_at(graph, "source", roots).where("kind = 'calls'").select(F.col("id").alias("edge_id"), F.col("source").alias("source_id"), F.col("target").alias("callee_id"), "line")
    return calls.join(roots, "source_id").join(target, "callee_id").select("edge_id", "source_id", "source_qname", "callee_id", "callee_name", "callee_qname", "callee_file", "callee_line", "line")


def limited(df: DataFrame, limit: int, *order: str) -> tuple[list, bool]:
    """(rows up to the limit, whether there were more): one row over the limit is asked for."""
    rows = df.orderBy(*order).limit(limit + 1).collect()
    return rows[:limit], len(rows) > limit


def nodes_in_order(graph: Graph, ids: DataFrame) -> DataFrame:
    """Nodes of (pos, id), order kept, unknown ids dropped, the first of repeated ids counting."""
    first = ids.where("id <> ''").groupBy("id").agg(F.min("pos").alias("pos"))
    return graph.nodes.select(*NODE).join(first, "id")
