"""Reverse reachability: what a change of a symbol or file may reach."""

from __future__ import annotations

import uuid
from dataclasses import replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.graph import Graph, cut, shared_folder
from ..schemas import IMPACT_KINDS
from ..sources import adjacency

#: What marks a test file when no pattern is given.
TEST_PARTS = (".test.", ".spec.", "/tests/", "/test/", "__tests__/")
TEST_END = "_test.go"


def incoming(graph: Graph) -> DataFrame:
    """Edges that carry impact; those of a bucketed graph lie by target, so joins on it don't shuffle them."""
    edges = graph.resolved if graph.near is None else graph.near.into(graph.nodes.sparkSession)
    return edges.where(F.col("kind").isin(*IMPACT_KINDS)).select(F.col("id").alias("edge_id"), "source", "target", "kind", "line", "col")


def _from_nodes(graph: Graph, found: DataFrame) -> DataFrame:
    """Found edges whose source is a node; bucketed edges have no others.  After the join with a frontier few are left to look up."""
    return found if graph.near is not None else found.join(graph.nodes.select(F.col("id").alias("source")), "source", "left_semi")


def reach(graph: Graph, roots: DataFrame, depth: int) -> DataFrame:
    """(id, level) of all nodes within `depth` reverse steps of the roots (column id), all roots at once.

    Each level joins the frontier to the edges' targets, keeps new nodes by an anti-join, and is cut by a
    checkpoint; the driver sees one count per level.
    """
    edges = incoming(graph).select("source", "target")
    frontier = cut(roots.select("id").distinct().withColumn("level", F.lit(0)))
    visited = frontier
    for level in range(1, depth + 1):
        step = edges.join(frontier, edges["target"] == frontier["id"], "left_semi").select(F.col("source").alias("id")).distinct()
        fresh = step.join(visited, "id", "left_anti")
        fresh = fresh if graph.near is not None else fresh.join(graph.nodes.select("id"), "id", "left_semi")
        frontier = cut(fresh.withColumn("level", F.lit(level)))
        if frontier.isEmpty():
            break
        visited = visited.unionByName(frontier)
    return visited


def impact(graph: Graph, roots: DataFrame, depth: int = 2, limit: int = 100) -> tuple[DataFrame, DataFrame]:
    """(nodes reached with level and rank, edges into expanded nodes), as a queue would find them.

    roots: (id, rank).  Before a node is expanded the number of nodes found so far must be below the limit, so
    the result may pass it by one node's callers.  Nodes have ranks in order of discovery: by their first
    parent's rank, then edge id.  A level's parents are cut where the running total, over parents before them,
    reaches the limit; as expansion only goes on below the limit, ranked sets are smaller than it.
    """
    edges = incoming(graph)
    frontier = cut(roots.select("id", F.col("rank").cast("long").alias("rank"), F.lit(0).alias("level")))
    visited, total, taken = frontier, frontier.count(), []
    for level in range(1, depth + 1):
        if total >= limit or frontier.isEmpty():
            break
        parents = frontier.select(F.col("id").alias("target"), F.col("rank").alias("parent_rank"))
        found = cut(_from_nodes(graph, edges.join(parents, "target")))
        first = found.groupBy(F.col("source").alias("id")).agg(F.min(F.struct("parent_rank", "edge_id")).alias("by")).join(visited, "id", "left_anti")
        first = first.select("id", "by.parent_rank", "by.edge_id")
        # Fewer parents than the limit are ranked here.
        fresh = parents.join(first.groupBy("parent_rank").agg(F.count("*").alias("n")), "parent_rank", "left").fillna(0, ["n"])
        before = F.sum("n").over(Window.orderBy("parent_rank").rowsBetween(Window.unboundedPreceding, -1))
        kept = fresh.withColumn("before", F.coalesce(before, F.lit(0))).where(F.col("before") + total < limit).select("parent_rank")
        taken.append(found.join(kept, "parent_rank", "left_semi").withColumn("level", F.lit(level)))
        new = cut(first.join(kept, "parent_rank", "left_semi"))
        total += new.count()
        if total < limit and level < depth:
            frontier = cut(new.select("id", F.row_number().over(Window.orderBy("parent_rank", "edge_id")).cast("long").alias("rank"), F.lit(level).alias("level")))
        else:
            frontier = new.select("id", F.lit(0).cast("long").alias("rank"), F.lit(level).alias("level"))
        visited = visited.unionByName(frontier)
    out = graph.edges.select(F.col("id").alias("edge_id"), "source", "target", "kind", "line", "col").limit(0).withColumns({"parent_rank": F.lit(0).cast("long"), "level": F.lit(0)})
    for part in taken:
        out = out.unionByName(part)
    return visited, out


def impact_each(graph: Graph, roots: DataFrame, depth: int, limit: int) -> DataFrame:
    """(root, id, level) of what each root (column id) reaches on its own, under the rule of `impact`: a node is expanded
    only while fewer than `limit` nodes were found for its root.

    All roots go level by level together.  Ranks are needed only of roots that are below the limit still, so no window's
    group has more rows than that; what passes the limit in one step is kept unranked.
    """
    edges = incoming(graph).select("edge_id", "source", "target")
    frontier = cut(roots.select(F.col("id").alias("root"), "id", F.lit(0).cast("long").alias("rank"), F.lit(1).cast("long").alias("total")).distinct())
    visited = frontier.select("root", "id", F.lit(0).alias("level"))
    for level in range(1, depth + 1):
        parents = frontier.where(F.col("total") < limit).select("root", F.col("id").alias("target"), F.col("rank").alias("parent_rank"), "total")
        found = _from_nodes(graph, edges.join(parents, "target"))
        first = found.groupBy("root", F.col("source").alias("id")).agg(F.min(F.struct("parent_rank", "edge_id")).alias("by")).join(visited.select("root", "id"), ["root", "id"], "left_anti")
        first = cut(first.select("root", "id", "by.parent_rank", "by.edge_id"))
        fresh = parents.join(first.groupBy("root", "parent_rank").agg(F.count("*").alias("n")), ["root", "parent_rank"], "left").fillna(0, ["n"])
        before = F.coalesce(F.sum("n").over(Window.partitionBy("root").orderBy("parent_rank").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        kept = fresh.withColumn("before", before).where(F.col("before") + F.col("total") < limit)
        new = first.join(kept.select("root", "parent_rank"), ["root", "parent_rank"], "left_semi")
        total = kept.groupBy("root").agg((F.max("total") + F.sum("n")).alias("total"))
        new = cut(new.join(total, "root"))
        if new.isEmpty():
            break
        visited = visited.unionByName(new.select("root", "id", F.lit(level).alias("level")))
        rank = F.row_number().over(Window.partitionBy("root").orderBy("parent_rank", "edge_id")).cast("long")
        frontier = new.where(F.col("total") < limit).select("root", "id", rank.alias("rank"), "total")
    return visited


def is_test(path: Column, pattern: str = "") -> Column:
    """By an unanchored regular expression, or by the built-in marks."""
    if pattern:
        return path.rlike(pattern)
    marks = path.endswith(TEST_END)
    for part in TEST_PARTS:
        marks = marks | path.contains(part)
    return marks


def walkable(graph: Graph) -> Graph:
    """The graph with its edges that carry impact written once by target, in a new folder of the shared one, so that each
    level of a walk shuffles its frontier and no edges."""
    spark = graph.nodes.sparkSession
    near = adjacency.near(f"{shared_folder(spark)}/walk-{uuid.uuid4().hex}", graph.nodes, int(spark.conf.get("spark.sql.shuffle.partitions")))
    near.write_into(graph.nodes, graph.edges.where(F.col("kind").isin(*IMPACT_KINDS)))
    return replace(graph, near=near)


#: Fixed value: nodes up to which each root symbol of a changed file is followed.
AFFECTED_LIMIT = 1000


def affected(graph: Graph, changed: DataFrame, depth: int = 5, pattern: str = "", limit: int = AFFECTED_LIMIT) -> tuple[DataFrame, DataFrame]:
    """(root symbols, impacted files with is_test) of changed files (column path; a leading ./ is dropped)."""
    paths = changed.select(F.regexp_replace("path", r"^\./", "").alias("file_path")).distinct()
    roots = graph.nodes.where("kind <> 'import'").join(paths, "file_path", "left_semi")
    reached = impact_each(graph if graph.near is not None or depth < 2 else walkable(graph), roots, depth, limit)
    files = graph.nodes.select("id", "file_path").join(reached, "id", "left_semi").select(F.col("file_path").alias("path")).distinct()
    return roots, files.withColumn("is_test", is_test(F.col("path"), pattern))
