"""The star-schema view at scale: where its edges are dealt, and that repeated line items collapse."""

import os
import re
import shutil

from pyspark.sql import functions as F

from symgraph.plans.graph import with_degrees
from symgraph.sources import star

SF = "/root/testdata/sf0.001"


def exchanges(df):
    return re.findall(r"Exchange hashpartitioning\(([^,]*), (\d+)\)", df._jdf.queryExecution().executedPlan().toString())


def test_edges_are_dealt_by_source_once_and_to_tasks_that_follow_the_tables(spark, monkeypatch):
    by_source = star.edges(spark, SF).groupBy("source").count()
    assert all(a.startswith("source") for a, _ in exchanges(by_source))  # dealt below the union, not again for the count
    monkeypatch.setattr(star, "A_TASK", 500)
    lines = spark.read.parquet(f"{SF}/lineitem.parquet").count()
    assert {int(n) for _, n in exchanges(star.edges(spark, SF).groupBy("source").count())} == {lines // 500}
    g = star.graph(spark, SF)
    got = {r["id"]: (r["out_degree"], r["in_degree"]) for r in with_degrees(g.nodes.select("id"), g.edges).collect()}
    ends = g.edges.select("source", "target").collect()
    assert sum(o for o, _ in got.values()) == sum(i for _, i in got.values()) == len(ends)


def test_repeated_line_items_collapse(spark, tmp_path):
    for t in ("region", "nation", "customer", "supplier", "part", "orders"):
        shutil.copy(f"{SF}/{t}.parquet", tmp_path)
    item = spark.read.parquet(f"{SF}/lineitem.parquet")
    odd = item.limit(3).withColumn("l_suppkey", F.lit(None).cast("long"))
    item.unionByName(item).unionByName(odd).repartition(3).write.parquet(os.path.join(tmp_path, "lineitem.parquet"))
    rows = lambda df: sorted(map(str, df.where("target is not null").collect()))
    assert rows(star.edges(spark, str(tmp_path))) == rows(star.edges(spark, SF))
    assert star.edges(spark, str(tmp_path)).where("target is null").select("source", "kind", "line").distinct().count() == star.edges(spark, str(tmp_path)).where("target is null").count()


def test_nodes_of_resolution_are_dealt_to_tasks_that_follow_the_tables(spark, monkeypatch):
    monkeypatch.setattr(star, "A_TASK", 10)
    nodes, _ = star.placeholders(spark, SF)
    rows = sum(spark.read.parquet(f"{SF}/{t}.parquet").count() for t in ("customer", "supplier", "part"))
    assert nodes.rdd.getNumPartitions() == rows // 10
    assert nodes.where("kind <> 'import'").count() == rows


def test_what_changed_among_edges_is_found_where_they_are_dealt(spark):
    from symgraph.operators import kept

    edges = star.edges(spark, SF)
    early = edges.where("kind <> 'imports'").unionByName(edges.where("kind = 'contains'"))
    assert all(a.startswith("source") for a, _ in exchanges(kept.net(edges.where("kind <> 'imports'"), edges)))
    gone, come = kept.both_ways(early, edges)
    assert {r["kind"] for r in gone.collect()} == {"contains"} and gone.count() == edges.where("kind = 'contains'").count()
    assert sorted(map(str, come.collect())) == sorted(map(str, edges.where("kind = 'imports'").collect()))


def test_a_walk_makes_its_edges_once(spark):
    from symgraph.operators import impact
    from symgraph.plans.graph import Graph

    chain = [(k, f"n{k + 1}", f"n{k}", "calls", True) for k in range(5)] + [(9, "lost", "n1", "calls", True), (10, "n0", "n3", "contains", True)]
    made = spark.sparkContext.accumulator(0)
    seen = F.udf(lambda x: (made.add(1), x)[1], "string").asNondeterministic()
    edges = spark.createDataFrame(chain, "id long, source string, target string, kind string, resolved boolean").selectExpr("*", "1 as line", "0 as col")
    nodes = spark.createDataFrame([(f"n{k}", "function", f"d/f{k}_test.go") for k in range(6)], "id string, kind string, file_path string")
    g = Graph(nodes, edges.withColumn("source", seen("source")), nodes)
    changed = spark.createDataFrame([("./d/f0_test.go",)], "path string")
    files = {r["path"] for r in impact.affected(g, changed, 3)[1].collect()}
    assert files == {f"d/f{k}_test.go" for k in range(4)} and made.value <= len(chain)


def test_only_calls_at_the_nodes_are_looked_up(spark):
    from symgraph.operators import context

    ids = spark.createDataFrame([(0, "customer:7"), (1, "order:5")], "pos long, id string")
    df = context.neighbours(star.graph(spark, SF), ids)
    assert "LeftSemi" in df._jdf.queryExecution().executedPlan().toString()
    ends = {"customer:7", "order:5"}
    want = [r for r in star.edges(spark, SF).where("kind = 'calls'").select("source", "target").collect()]
    assert df.count() == sum(r["source"] in ends for r in want) + sum(r["target"] in ends for r in want)


def test_the_overview_makes_its_edges_once(spark):
    """Counts, degrees and dependencies of edges with unknown, null and unresolved ends, as the single operators give them."""
    from symgraph.operators import overview, status
    from symgraph.plans.graph import Graph

    nodes = [(f"n{k}", "function" if k % 3 else "method", f"q{k}", f"d{k % 4}/f{k}{'_test' if k % 5 == 0 else ''}.go", k, k % 2 == 0) for k in range(30)]
    nodes = spark.createDataFrame(nodes, "id string, kind string, qualified_name string, file_path string, start_line int, is_exported boolean").selectExpr("*", "qualified_name as name")
    files = nodes.selectExpr("file_path as path", "'go' as language", "1L as node_count")
    pairs = [(f"n{k % 23}", f"n{k * k % 19}", "calls" if k % 7 else "imports", k % 11 > 0) for k in range(200)]
    pairs += [("lost", "n1", "calls", True), ("n1", "lost", "calls", True), (None, "n2", "calls", True), ("n2", None, "calls", True), ("n3", "n4", "calls", None), (None, None, "calls", False)]
    made = spark.sparkContext.accumulator(0)
    seen = F.udf(lambda x: (made.add(1), x)[1], "string").asNondeterministic()
    edges = spark.createDataFrame(pairs, "source string, target string, kind string, resolved boolean")
    g = Graph(nodes, edges, files)
    got = {}
    once = edges.withColumn("source", seen("source"))
    for r in overview.whole(Graph(nodes, once, files)).orderBy("section", "pos").collect():
        got.setdefault(r["section"], []).append((r["name"], r["detail"], r["n"]))
    assert made.value == len(pairs)
    c = status.counts(g).first()
    assert got["summary"] == [(k, "", c[k]) for k in ("files", "nodes", "edges", "resolved_edges")] and c["edges"] == 206
    assert got["symbol"] == [(r["id"], f"{r['kind']};{r['file_path']};{r['start_line']}", r["degree"]) for r in overview.core_symbols(g).collect()]
    assert got["dependency"] == [(f"{r['source']} -> {r['target']}", r["kind"], r["n"]) for r in overview.dependencies(g).collect()]
    none = {r["section"]: r["n"] for r in overview.whole(Graph(nodes, edges.limit(0), files)).where("section <> 'package'").orderBy("pos").collect()}
    assert none == {"summary": 0, "symbol": 0}


def test_kept_aggregates_shuffle_edges_once_and_sort_none(spark):
    """Degrees and dependencies of both states come from one making of the edges, and rows are never compared."""
    from symgraph import queries

    df = queries.kept_aggregates(spark, SF)
    df.collect()
    final = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert "SortMergeJoin" not in final
    dealt = [x for x in final.splitlines() if re.search(r"^[^A-Za-z]*Exchange hashpartitioning\(source#\d+, \d+\), REPARTITION_BY_NUM", x)]
    # Of customers, suppliers, parts and nations only the keys are dealt again, to be counted by source; of line items nothing is.
    assert sum("(l_" in x for x in final.splitlines() if "FileScan" in x) <= 2 and len(dealt) <= 10


def test_kept_aggregates_with_ends_that_are_no_nodes(spark):
    """Null, unknown and unresolved ends in either state: what is brought up equals a recount, for follow as for one pass."""
    from symgraph.operators import kept
    from symgraph.plans.graph import Graph

    def state(nodes, edges, files):
        return Graph(*(spark.createDataFrame(rows, schema) for rows, schema in (
            (nodes, "id string, kind string, file_path string"), (edges, "source string, target string, kind string, resolved boolean"), (files, "path string, language string, node_count int"),
        )))

    edges = [("a", "b", "calls", True), ("a", "lost", "calls", True), ("lost", "b", "imports", True), (None, "b", "calls", True), ("a", None, "calls", True), ("a", "b", None, True), ("a", "b", "calls", False), ("a", "b", "calls", None)]
    before = state([("a", "f", "p/a.go"), ("b", "f", "b.go"), ("gone", "g", "p/a.go")], edges + [("a", "b", "calls", True), ("gone", "a", "calls", True)], [("p/a.go", "go", 2), ("b.go", "go", None)])
    after = state([("a", "f", "q/a.go"), ("b", "f", "b.go"), ("new", "h", None)], edges[:-1] + [("new", "b", "calls", True), ("a", "new", "calls", True), ("lost", "lost", "calls", True)], [("q/a.go", "go", 3), ("b.go", "go", None)])
    rows = lambda df: sorted(map(repr, (tuple(r) for r in df.collect())))
    now = kept.follow({name: measure(before) for name, measure in kept.MEASURES.items()}, before, after)
    made = kept.brought_up(kept.states(before, after))
    for name, measure in kept.MEASURES.items():
        want = rows(measure(after).select(*kept.KEYS[name], *kept.SUMS[name]))
        assert rows(now[name].select(*kept.KEYS[name], *kept.SUMS[name])) == want, name
        assert rows(made.where(F.col("measure") == name).select(*[f"key_{k}" for k in range(len(kept.KEYS[name]))], *"xy"[: len(kept.SUMS[name])])) == want, name


def test_calls_to_resolve_do_not_pass_through_the_driver(spark):
    """Suppliers are a small file, but their calls are many rows; a guess from the file's size must not broadcast them."""
    _, edges = star.placeholders(spark, SF)
    plan = edges._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ShuffledHashJoin") == 2 and "Broadcast" not in plan


def test_candidates_that_name_no_file_multiply_no_calls(spark):
    from symgraph.operators import resolve

    syms = spark.createDataFrame([("a/b/x.go", "f", "1", 0), ("top.go", "g", "2", 0), ("a/y.py", "h", "3", 0)], "file_path string, name string, hit string, hit_ordinal long")
    targets = spark.createDataFrame([(c,) for c in ("a/*.go", "a/b/*.go", "top.go", "a/b/x.go", "a/y.py", "a/b/x.py", "c/*.go", "top.go/*.go")] + [(None,)], "candidate string")
    got = {r["candidate"]: r["there"] for r in resolve.there(targets, syms).collect()}
    assert len(got) == 9 and {c for c, there in got.items() if there} == {"a/*.go", "a/b/*.go", "top.go", "a/b/x.go", "a/y.py"}
    nodes, _ = star.placeholders(spark, SF)
    every = resolve.there(resolve.import_targets(nodes, "world"), resolve.symbols(nodes))
    assert every.where("there and symbol = '*'").groupBy("source_file").count().where("count > 1").isEmpty() and every.where("not there").count() > every.where("there").count() > 0
