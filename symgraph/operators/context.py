"""Context of a task: entry points, their neighbours and calls, and source snippets; compact forms of it."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import context_terms_of
from ..plans.graph import Graph, cut
from ..schemas import ENTRY_KINDS
from . import find
from .search import search_each

_EDGE = ["id", "source", "target", "kind", "line", "col", "source_name", "source_file", "target_name", "target_file", "target_kind", "target_qname", "target_line"]


def entrypoints(graph: Graph, task: str, max_nodes: int) -> DataFrame:
    """(pos, node columns) of the hits of the task's terms in turn, entry kinds first, each node once, up to max_nodes.

    All terms are searched for in one plan.  What is put in order here are at most max(max_nodes, 10) hits a term.
    """
    terms = context_terms_of(task)
    if not terms:
        return graph.nodes.limit(0).withColumn("pos", F.lit(0).cast("long"))
    hits = search_each(graph, terms, limit=max(max_nodes, 10)).withColumn("turn", F.struct("query", (~F.col("kind").isin(*ENTRY_KINDS)).alias("late"), F.col("pos").alias("at")))
    rest = [c for c in hits.columns if c not in ("id", "turn", "pos", "query")]
    first = hits.groupBy("id").agg(F.min("turn").alias("turn"), F.min_by(F.struct(*rest), "turn").alias("x"))
    top = first.orderBy("turn").limit(max_nodes)
    return top.select((F.row_number().over(Window.orderBy("turn")) - 1).cast("long").alias("pos"), "id", "x.*")


def neighbours(graph: Graph, ids: DataFrame) -> DataFrame:
    """Calls out of and into nodes (pos, id), in that order for each: one join a direction for all nodes at once.

    A call between two of the nodes appears twice, once from either end.  The nodes, whose number the caller bounds, are sent
    to the edges, so only their calls are looked up among nodes.
    """
    at = lambda end: find.resolved_edges(replace(graph, at=None, edges=graph.edges.join(F.broadcast(ids.select(F.col("id").alias(end)).distinct()), end, "left_semi")), kind="calls")
    out = at("source").join(ids.select("pos", F.col("id").alias("source")), "source").withColumns({"side": F.lit(0), "other": F.col("target")})
    into = at("target").join(ids.select("pos", F.col("id").alias("target")), "target").withColumns({"side": F.lit(1), "other": F.col("source")})
    return out.select("pos", "side", "other", *_EDGE).unionByName(into.select("pos", "side", "other", *_EDGE))


def related(graph: Graph, ids: DataFrame, limit: int) -> DataFrame:
    """(pos, node columns) of the first distinct neighbours of nodes (pos, id)."""
    n = neighbours(graph, ids)
    first = n.groupBy(F.col("other").alias("id")).agg(F.min(F.struct("pos", "side", F.col("id").alias("edge"))).alias("by"))
    top = first.orderBy("by").limit(limit).withColumn("pos", F.row_number().over(Window.orderBy("by")).cast("long"))
    return find.nodes_in_order(graph, top.select("pos", "id"))


def sections(graph: Graph, task: str, max_nodes: int = 20) -> DataFrame:
    """(section, pos, id): a task's entry points, their neighbours, and the calls at them, as one result."""
    found = cut(entrypoints(graph, task, max_nodes)).select("pos", "id")
    near = related(graph, found, max_nodes)
    calls = neighbours(graph, found).orderBy("pos", "side", "id").limit(2 * max_nodes)
    calls = calls.select(F.row_number().over(Window.orderBy("pos", "side", "id")).alias("pos"), F.col("id").cast("string").alias("id"))
    part = lambda df, name: df.select(F.lit(name).alias("section"), F.col("pos").cast("long").alias("pos"), "id")
    return part(found.withColumn("pos", F.col("pos") + 1), "entry").unionByName(part(near, "related")).unionByName(part(calls, "call"))


def build(spark: SparkSession, graph: Graph, root: str, task: str, max_nodes: int = 20, max_code: int = 8, code: bool = True) -> dict:
    from ..sources.tree import snippet

    found = cut(entrypoints(graph, task, max_nodes))
    ids = found.select("pos", "id")
    entries = [{k: v for k, v in r.asDict().items() if k != "pos"} for r in found.orderBy("pos").collect()]
    near = [r.asDict() for r in related(graph, ids, max_nodes).orderBy("pos").drop("pos").collect()] if entries else []
    calls = [r.asDict() for r in neighbours(graph, ids).orderBy("pos", "side", "id").select(*_EDGE).limit(2 * max_nodes).collect()] if entries else []
    blocks = []
    for node in (entries + near)[:max_code] if code else ():
        block = {k: node[k] for k in find.NODE}
        blocks.append(block | {"code": snippet(root, node["file_path"], node["start_line"], node["end_line"])})
    return {"task": task, "entrypoints": entries, "related": near, "relationships": calls, "code_blocks": blocks}


def compact(payload: dict) -> dict:
    """Heads of the lists with their full counts."""
    out: dict = {"task": payload["task"]}
    for key, limit in (("entrypoints", 8), ("related", 8), ("relationships", 12)):
        items = payload.get(key) or []
        if key == "relationships":
            head = [{k: e[k] for k in ("kind", "source_name", "source_file", "target_file", "line")} | {"target_name": e["target_qname"] or e["target_name"]} for e in items[:limit]]
        else:
            head = [{k: n[k] for k in ("qualified_name", "kind", "file_path", "start_line")} for n in items[:limit]]
        out |= {key: head, f"{key}_count": len(items)}
    out["truncated"] = any(out[f"{k}_count"] > len(out[k]) for k in ("entrypoints", "related", "relationships"))
    return out
