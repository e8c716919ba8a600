"""Indexing a source tree: difference by content hash, extraction of what changed, resolution of what that touches, and a
new state of the store that shares the buckets that stayed as they were."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.paths import path_dir
from .operators import resolve, sink
from .operators.search import WEIGHTS
from .plans.graph import cut
from .schemas import EDGES, FILES, NODES
from .sources import config, tree
from .sources.adjacency import BUCKETS, Adjacency
from .sources.snapshot import Store, bucket_of, now_ms
from .sources.textindex import TextIndex

#: Edges of a file have numbers below this; files have at most 1 MiB.
_PER_FILE = 1 << 20
_EDGE_COLUMNS = [c.split(" ")[0] for c in EDGES.split(", ")]
#: Edges of a bucket of the lookup tables, as their number follows from the number of edges.
_PER_BUCKET = 1 << 20


def nodes_of(extracts: DataFrame, stamp: int) -> DataFrame:
    """Nodes of all files; of rows with one id the last stays, at its place."""
    n = extracts.select(F.posexplode("nodes").alias("seq", "n")).select("n.*", F.col("seq").cast("long").alias("node_ordinal"))
    return sink.replace_by_key(n, "id", "file_path", "node_ordinal").withColumn("updated_at", F.lit(stamp))


def edges_of(extracts: DataFrame) -> DataFrame:
    """Edges of all files with their path, numbered by file and place; calls are still placeholders."""
    e = extracts.select("path", "rank", F.posexplode("edges").alias("seq", "e")).select("path", (F.col("rank") * _PER_FILE + F.col("seq") + 1).alias("id"), "e.*")
    return sink.mark_resolved(e).select("path", *_EDGE_COLUMNS)


def files_of(extracts: DataFrame, stamp: int) -> DataFrame:
    errors = F.when(F.size("errors") > 0, F.col("errors"))
    return extracts.select("path", "content_hash", "language", "size", "modified_at", F.lit(stamp).alias("indexed_at"), F.size("nodes").alias("node_count"), errors.alias("errors"))


def go_packages(extracts: DataFrame) -> DataFrame:
    """(dir, package) by the first Go file of each directory."""
    go = extracts.where("package is not null").select(path_dir(F.col("path")).alias("dir"), "path", "package")
    return go.groupBy("dir").agg(F.min_by("package", "path").alias("package"))


def rules_of(root: str) -> tuple[str, list[tuple[str, str]]]:
    """What resolution takes from the tree besides its sources: the Go module, the path aliases."""
    return config.go_module(root), config.path_aliases(root)


def resolved_edges(extracts: DataFrame, nodes: DataFrame, rules: tuple[str, list]) -> DataFrame:
    """Edges of all files, with what can be resolved resolved."""
    edges = edges_of(extracts).select(*_EDGE_COLUMNS)
    return resolve.apply(edges, resolve.resolve(nodes, edges, *rules, go_packages(extracts)))


def changed_edges(extracts: DataFrame, nodes: DataFrame, rules: tuple[str, list], before: tuple[DataFrame, DataFrame, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(edges, those before) of the buckets in which an edge may have changed since the state before.

    before: (extracts, nodes, edges) made under the same rules.  Edges of unchanged files keep what they were resolved
    to, unless a name that they want has got, lost or changed a symbol, or a package its name; the buckets of these, of
    changed files and of files with another rank are put together anew.  The rest is looked through, but not shuffled.
    """
    extracts_before, nodes_before, edges_before = before
    packages = go_packages(extracts)
    both = extracts.select("path", "rank", "content_hash").join(extracts_before.select("path", F.col("rank").alias("old_rank"), F.col("content_hash").alias("old_hash")), "path", "full_outer")
    both = cut(both.withColumn("same", F.coalesce(F.col("content_hash") == F.col("old_hash"), F.lit(False))))
    same = both.where("same").select("path", "rank", "old_rank")
    left = resolve.placeholders(edges_of(extracts).withColumn("source_file", F.col("path")), "source_file")
    targets = resolve.import_targets(nodes, *rules)
    again = resolve.touched(left, targets, cut(resolve.changed_names(nodes_before, nodes)), resolve.changed_packages(go_packages(extracts_before), packages))
    anew = left.join(both.where("not same").select(F.col("path").alias("source_file")), "source_file", "left_semi").select(*left.columns).unionByName(again).distinct()
    anew = cut(anew.join(nodes.select(F.col("id").alias("source")), "source", "left_semi").drop("source"))
    hits = resolve.resolve_pending(resolve.of_interest(nodes, anew, targets), anew, *rules, packages)
    moved = both.where("not same or rank <> old_rank").select(F.col("path").alias("file"))
    some = _buckets(moved.unionByName(anew.select(F.col("source_file").alias("file"))))
    inside = lambda df, col: df.where(bucket_of(F.col(col)).isin(*some)) if some else df.where("false")
    edges, old = inside(edges_of(extracts), "path").select(*_EDGE_COLUMNS), inside(edges_before, "source")
    # An edge's number holds its file's rank and its place in the file.
    place = old.where("callee_text is not null and resolved").select((F.col("id") - 1).bitwiseAND(F.lit(_PER_FILE - 1)).alias("seq"), F.shiftright(F.col("id") - 1, 20).alias("old_rank"), "target")
    kept = place.join(same, "old_rank").select((F.col("rank") * _PER_FILE + F.col("seq") + 1).alias("edge_id"), F.col("target").alias("hit"), F.lit(0).alias("tier"))
    kept = kept.join(anew.select("edge_id"), "edge_id", "left_anti")
    return resolve.apply(edges, kept.unionByName(hits)), old


def _buckets(changed: DataFrame) -> list[int]:
    """Distinct buckets of a column `file`; there are no more than the store has."""
    return [r[0] for r in changed.select(bucket_of(F.col("file")).alias("b")).distinct().collect()]


def _write_edges(store: Store, name: str, edges: DataFrame, old: DataFrame | None) -> None:
    """Stages the buckets whose edges differ from the old ones; all of them without these."""
    differ = None if old is None else _buckets(edges.exceptAll(old).unionByName(old.exceptAll(edges)).select(F.col("source").alias("file")))
    store.write(name, "edges", edges, differ)


def _write_lookups(spark: SparkSession, store: Store, name: str, nodes: DataFrame, upserts: DataFrame | None, gone: DataFrame | None) -> None:
    """Stages the text index, by the nodes that came and went or else in full, and the bucketed edges."""
    run = (store.staged.get("text") or 0) + 1
    index = TextIndex(f"{store.place.uri}/text")
    fields = list(WEIGHTS)
    if run == 1 or upserts is None:
        index.sync(spark, run, nodes, fields)
    else:
        index.put(spark, run, upserts, fields, gone)
    edges = store.read(spark, "edges", EDGES, staged=True)
    buckets = min(BUCKETS, max(1, edges.count() // _PER_BUCKET))
    near = Adjacency(f"{store.place.uri}/snapshots/{name}/near", buckets)
    near.write(nodes, edges)
    store.staged |= {"text": run, "near": [name, buckets]}


def index_all(spark: SparkSession, root: str, store_dir: str, force: bool = False, lookups: bool = False) -> dict:
    """Brings the store up to the tree and gives the counts.

    Files whose hash is known are not extracted again; those that vanished go; those that fail keep their old rows,
    unless forced.  If nothing changed, only the time of the run is noted.  Of each table the buckets are written whose
    rows changed.  lookups: keep a text index and bucketed edges; a store that has them keeps them.
    """
    root, store, stamp = config.absolute(root), Store(store_dir), now_ms()
    old = store.read(spark, "extracts", tree.EXTRACTS)
    known = old.select("path", F.col("content_hash").alias("known_hash"))
    listed = tree.listing(spark, root)
    now = listed.join(known, "path", "left") if not force else listed.withColumn("known_hash", F.lit(None).cast("string"))
    parts = max(1, min(spark.sparkContext.defaultParallelism * 4, listed.count()))
    name = store.stage()
    store.write(name, "fresh", tree.extracts(now.repartition(parts, "path"), root))
    fresh = store.scratch(spark, name, "fresh")
    by = {r[0]: r[1] for r in fresh.groupBy("status").count().collect()}
    errors = [e for r in fresh.where("size(errors) > 0").select("path", "status", "errors").orderBy("path").collect() if r["status"] == "failed" for e in r["errors"]]
    gone = 0 if force else known.join(listed, "path", "left_anti").count()
    stats = {
        "files_scanned": sum(by.values()), "files_indexed": by.get("indexed", 0), "files_skipped": by.get("unchanged", 0), "files_failed": by.get("failed", 0), "files_deleted": gone,
        "nodes": 0, "edges": 0, "edges_resolved": 0, "edges_still_unresolved": 0, "errors": errors, "errors_total": len(errors),
    }
    before = store.graph(spark)
    rules = rules_of(root)
    lookups = lookups or before.text is not None
    ruled = store.get("resolved_with") == json.dumps(rules)
    whole = force or not store.current
    if force or stats["files_indexed"] or gone or not store.get("last_resolved_at") or not ruled or (lookups and before.text is None):
        made = fresh.where("status = 'indexed'")
        kept = fresh.where("status = 'unchanged'" if force else "status <> 'indexed'").select("path", "rank")
        extracts = made.select(*old.columns).unionByName(old.drop("rank").join(kept, "path").select(*old.columns))
        # Files that changed, came, went, or have another rank than before.
        ranks = old.select("path", F.col("rank").alias("old_rank")).join(kept, "path").where("rank <> old_rank").select("path")
        left_out = old.select("path").join(made.select("path").unionByName(kept.select("path")), "path", "left_anti")
        changed = made.select("path").unionByName(left_out)
        written = None if whole else _buckets(changed.unionByName(ranks).select(F.col("path").alias("file")))
        store.write(name, "extracts", extracts, written)
        extracts = store.read(spark, "extracts", tree.EXTRACTS, staged=True)
        new_nodes = nodes_of(made, stamp).select(*before.nodes.columns)
        stay = kept.select(F.col("path").alias("file_path"))
        nodes = new_nodes.unionByName(before.nodes.join(stay, "file_path", "left_semi").select(*before.nodes.columns))
        differ = None if whole else _buckets(changed.select(F.col("path").alias("file")))
        store.write(name, "nodes", nodes, differ)
        nodes = store.read(spark, "nodes", NODES, staged=True)
        if whole or not ruled:
            edges, edges_before = resolved_edges(extracts, nodes, rules), None if whole else before.edges
        else:
            edges, edges_before = changed_edges(extracts, nodes, rules, (old, before.nodes, before.edges))
        _write_edges(store, name, cut(edges), edges_before)
        files = files_of(made, stamp).unionByName(before.files.join(kept.select("path"), "path", "left_semi").select(*before.files.columns))
        store.write(name, "files", files, differ)
        if lookups:
            out = before.nodes.join(changed.select(F.col("path").alias("file_path")), "file_path", "left_semi").select("id")
            _write_lookups(spark, store, name, nodes, None if whole or before.text is None else new_nodes, out.join(new_nodes.select("id"), "id", "left_anti"))
        sizes = made.agg(F.sum(F.size("nodes")), F.sum(F.size("edges"))).first()
        stats |= {"nodes": sizes[0] or 0, "edges": sizes[1] or 0}
        resolved_before = before.edges.where("resolved and callee_text is not null").count()
        done, open_ = store.read(spark, "edges", EDGES, staged=True).agg(F.count_if(F.expr("resolved and callee_text is not null")), F.count_if(~F.col("resolved"))).first()
        store.commit(name)
        store.put(last_resolved_at=str(now_ms()), resolved_with=json.dumps(rules))
        stats |= {"edges_resolved": done if force else max(0, done - resolved_before), "edges_still_unresolved": open_}
    else:
        store.discard(name)
        stats["edges_still_unresolved"] = before.edges.where("not resolved").count()
    store.put(last_indexed=str(stamp), project_root=root)
    store.write_errors(errors)
    return stats


def resolve_all(spark: SparkSession, store_dir: str) -> dict:
    """Resolves the store's placeholders again, under the tree's rules as they are now, and writes the edges that differ;
    a second run changes nothing."""
    store = Store(store_dir)
    graph = store.graph(spark)
    total, before = graph.edges.agg(F.count("*"), F.count_if("resolved")).first()
    name, rules = store.stage(), rules_of(store.get("project_root"))
    extracts = store.read(spark, "extracts", tree.EXTRACTS)
    edges = cut(resolved_edges(extracts, graph.nodes, rules))
    after = edges.where("resolved").count()
    _write_edges(store, name, edges, graph.edges)
    if graph.near is not None:
        _write_lookups(spark, store, name, graph.nodes, graph.nodes.limit(0), None)
    store.commit(name)
    store.put(last_resolved_at=str(now_ms()), resolved_with=json.dumps(rules))
    return {"edges_total": total, "edges_resolved_before": before, "edges_resolved_now": max(0, after - before), "edges_still_unresolved": total - after}


def resolution_snapshot(spark: SparkSession, store_dir: str) -> dict:
    row = Store(store_dir).graph(spark).edges.agg(F.count("*"), F.count_if(F.col("resolved"))).first()
    return {"edges_total": row[0], "edges_resolved_before": row[1], "edges_resolved_now": 0, "edges_still_unresolved": row[0] - row[1]}
