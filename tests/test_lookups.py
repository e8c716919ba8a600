"""The persisted text index and the bucketed edges: equal to whole-table plans, increments equal to rebuilds, pruned reads."""

import glob
import os
import random
from dataclasses import replace

import pytest
from test_engine import small_graph

from symgraph.operators import find, impact, search
from symgraph.plans.graph import Graph
from symgraph.sources.adjacency import Adjacency
from symgraph.sources.textindex import TextIndex

WORDS = "open close the Théâtre table tab of-the store2 naïve 漢字 x_y a".split()
FIELDS = list(search.WEIGHTS)


def docs_of(rng, n):
    text = lambda k: None if rng.random() < 0.15 else " ".join(rng.choice(WORDS) for _ in range(rng.randrange(k)))
    return {f"d{i}": (text(2), text(4), text(30), text(6)) for i in range(n)}


def frame(spark, docs):
    rows = [(i, "function", *v, "f.py", True, f"{k}") for k, (i, v) in enumerate(sorted(docs.items()))]
    return spark.createDataFrame(rows, "id string, kind string, name string, qualified_name string, docstring string, signature string, file_path string, is_exported boolean, clash string")


def scores(df):
    return {r["id"]: round(r["score"], 9) for r in df.select("id", "score").collect()}


def rows(df):
    return sorted(str(tuple(r)) for r in df.collect())


QUERIES = ["the", "tab", "of-the", "open the", "theatre", "naive 漢", "a-tab close", "nothing", "", "x_y of"]


@pytest.fixture(scope="module")
def indexed(spark, tmp_path_factory):
    """Three runs: documents come, change and go; one run is written twice."""
    rng = random.Random(8)
    docs = docs_of(rng, 60)
    index = TextIndex(f"file://{tmp_path_factory.mktemp('text')}")
    index.put(spark, 1, frame(spark, docs), FIELDS)
    docs |= {k: v for k, v in docs_of(rng, 60).items() if rng.random() < 0.3}
    for k in rng.sample(sorted(docs), 9):
        del docs[k]
    index.sync(spark, 2, frame(spark, {k: v for k, v in docs.items() if k < "d3"}), FIELDS)  # a run that is done again below
    index.sync(spark, 2, frame(spark, docs), FIELDS)
    docs["d2"] = docs["new"] = ("open", "open", "the theatre of the town", "")
    gone = sorted(docs)[5]
    wrote = index.put(spark, 3, frame(spark, {k: docs[k] for k in ("d2", "new", "d50")} if "d50" in docs else {k: docs[k] for k in ("d2", "new")}), FIELDS, frame(spark, {gone: docs.pop(gone)}))
    assert {r["id"] for r in wrote.collect()} == {"d2", "new", gone}  # d50 is as it was
    return index, docs


def test_increments_equal_a_rebuild(spark, indexed, tmp_path):
    index, docs = indexed
    full, compacted = TextIndex(f"file://{tmp_path}/full"), index.compact(spark, f"file://{tmp_path}/one")
    full.put(spark, 1, frame(spark, docs), FIELDS)
    for part in (lambda x: x.live_postings(spark).drop("run"), lambda x: x.current(spark).drop("run"), lambda x: x.stats(spark)):
        want = rows(part(full))
        assert rows(part(index)) == want and rows(part(compacted)) == want
    assert TextIndex(index.path, 1).stats(spark).first()["n"] == 60  # an earlier state can still be read


@pytest.mark.parametrize("query", QUERIES)
def test_scores_equal_the_scan(spark, indexed, query):
    index, docs = indexed
    nodes = frame(spark, docs)
    assert scores(search.bm25_index(spark, index, query)) == pytest.approx(scores(search.bm25(nodes, query)))
    g = Graph(nodes, spark.createDataFrame([], "id long, source string, target string, kind string, resolved boolean"), nodes)
    if query.strip() and query != "nothing":
        ids = lambda x: [r["id"] for r in search.search_text(x, query).collect()]
        assert ids(replace(g, text=index)) == ids(g) != []


def test_many_queries_at_once(spark, indexed):
    """search_each() gives each query what search() gives it alone, by scan and from the index; one has substring hits only."""
    index, docs = indexed
    nodes = frame(spark, docs)
    edges = [(k, f"d{k % 7}", f"d{k % 11}", "calls", True) for k in range(40)]
    g = Graph(nodes, spark.createDataFrame(edges, "id long, source string, target string, kind string, resolved boolean"), nodes)
    asked = ["open", "he", "tab of-the", "héâ", "zzz", "d2", "the", "%"]
    alone = {k: [r["id"] for r in search.search(g, q, limit=6)] for k, q in enumerate(asked)}
    assert alone[3] and not alone[4]
    for graph in (g, replace(g, text=index)):
        got = {k: [] for k in alone}
        for r in search.search_each(graph, asked, limit=6).orderBy("query", "pos").collect():
            got[r["query"]].append(r["id"])
        assert got == alone


def test_reads_only_its_terms(spark, indexed):
    """Folders of other letters may be gone, and the term's range reaches the scan."""
    index, _ = indexed
    plan = search.bm25_index(spark, index, "tab")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(term,tab)" in plan and "LessThan(term,tab" in plan and "(head" in plan and "docstring#" not in plan
    want, path = scores(search.bm25_index(spark, index, "tab")), index.path.removeprefix("file://")
    for folder in glob.glob(f"{path}/postings/run=*/head=[!t]"):
        os.rename(folder, folder.replace("head=", ".head-"))
    try:
        assert scores(search.bm25_index(spark, index, "tab")) == want != {}
    finally:
        for folder in glob.glob(f"{path}/postings/run=*/.head-*"):
            os.rename(folder, folder.replace(".head-", "head="))


def test_nothing_put_in(spark, tmp_path):
    index = TextIndex(f"file://{tmp_path}/none")
    assert scores(search.bm25_index(spark, index, "the")) == {}
    index.put(spark, 1, frame(spark, {}), FIELDS)
    index.put(spark, 2, frame(spark, {"e": (None,) * 4}), FIELDS)
    assert scores(search.bm25_index(spark, index, "the")) == {} and scores(search.bm25_index(spark, index, "e")).keys() == {"e"}


@pytest.fixture(scope="module")
def bucketed(spark, tmp_path_factory):
    rng = random.Random(9)
    g = small_graph(spark, [(i, f"n{rng.randrange(40)}", f"n{rng.randrange(40)}") for i in range(150)])
    g = replace(g, nodes=g.nodes.selectExpr("*", "'go' as language", "1 as start_line", "2 as end_line"))
    dangling = spark.createDataFrame([(900, "gone", "n1", "calls", True, 1, 0), (901, "n1", "gone", "calls", True, 1, 0), (902, "n2", "n1", "calls", False, 1, 0)], g.edges.schema)
    g = Graph(g.nodes, g.edges.unionByName(dangling), g.files)
    near = Adjacency(f"file://{tmp_path_factory.mktemp('near')}", buckets=8)
    near.write(g.nodes, g.edges)
    return g, replace(g, near=near)


def test_bucketed_lookups_equal_scans(spark, bucketed):
    plain, near = bucketed
    for name in ("n1", "n7", "zzz"):
        assert rows(find.callers(near, name)) == rows(find.callers(plain, name)) and rows(find.callees(near, name)) == rows(find.callees(plain, name))
    roots = plain.nodes.where("id in ('n1', 'n5')").select("id")
    assert rows(impact.reach(near, roots, 3)) == rows(impact.reach(plain, roots, 3))
    ranked = roots.selectExpr("id", "case id when 'n1' then 0L else 1L end as rank")
    for a, b in zip(impact.impact(near, ranked, 3, 9), impact.impact(plain, ranked, 3, 9)):
        assert rows(a.select(*sorted(a.columns))) == rows(b.select(*sorted(b.columns)))
    assert rows(impact.impact_each(near, roots, 3, 6)) == rows(impact.impact_each(plain, roots, 3, 6))
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("edges_")]


def test_one_bucket_is_read(spark, bucketed, tmp_path):
    """All files but the bucket's may be empty of sense."""
    plain, near = bucketed
    want, path = rows(find.callers(plain, "n1")), near.near.path.removeprefix("file://")
    files = sorted(glob.glob(f"{path}/by_target/part-*"))
    of = {f: int(os.path.basename(f).split("_")[1].split(".")[0]) for f in files}
    bucket = spark.sql("select pmod(hash('n1'), 8) as b").first()["b"]
    kept = {f: open(f, "rb").read() for f in files if of[f] != bucket}
    assert kept and len(kept) < len(files)
    crc = lambda f: os.path.join(os.path.dirname(f), f".{os.path.basename(f)}.crc")
    sums = {f: open(crc(f), "rb").read() for f in kept}
    for f in kept:
        os.remove(crc(f))
        open(f, "wb").write(b"no parquet")
    try:
        assert rows(find.callers(near, "n1")) == want != []
    finally:
        for f, raw in kept.items():
            open(f, "wb").write(raw)
            open(crc(f), "wb").write(sums[f])


def test_levels_shuffle_frontiers_only(spark, bucketed):
    _, near = bucketed
    edges = impact.incoming(near)
    frontier = spark.createDataFrame([("n1",)], "target string").repartition(3)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = edges.join(frontier, "target")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert "Bucketed: true" in plan and plan.count("Exchange hashpartitioning") == 1


def test_both_bucketed_tables_come_from_one_pass_over_the_edges(spark, tmp_path):
    """Edges whose columns are other ones each time they are made are the same in both tables."""
    import random

    from pyspark.sql import functions as F

    from symgraph.sources.adjacency import Adjacency

    drawn = F.udf(lambda _: random.SystemRandom().randrange(1 << 30), "int").asNondeterministic()
    nodes = spark.range(5).select(F.concat(F.lit("n"), "id").alias("id"))
    end = lambda k: F.concat(F.lit("n"), (F.col("id") % k).cast("string"))
    edges = spark.range(20).select("id", end(5).alias("source"), end(7).alias("target"), F.lit("calls").alias("kind"), drawn("id").alias("line"), F.lit(0).alias("col"), F.lit(True).alias("resolved"))
    near = Adjacency(f"file://{tmp_path}/near", buckets=2)
    near.write(nodes, edges)
    rows = lambda df: sorted(map(tuple, df.select("id", "source", "target", "kind", "line", "col").collect()))
    assert rows(near.into(spark)) == rows(near.out_of(spark)) != []


def test_buckets_follow_the_nodes_and_edges_are_sent_to_them_once(spark, monkeypatch):
    from symgraph import queries
    from symgraph.sources import adjacency, star

    sf = "/root/testdata/sf0.001"
    monkeypatch.setattr(adjacency, "A_BUCKET", 40, raising=False)
    g = queries._bucketed(spark, sf)
    assert g.near.buckets == g.nodes.count() // 40 > 16
    names = ("id", "source", "target", "kind", "line", "col")
    assert rows(g.near.into(spark).select(*names)) == rows(star.edges(spark, sf).where("target is not null").select(*names))
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for both in (False, True):
            plan = g.near._dealt(g.nodes, g.edges, both)._jdf.queryExecution().executedPlan().toString()
            # Of the nodes one shuffle for each end; of the edges one, after they were dealt by source; no sort.
            assert plan.count("Exchange hashpartitioning(target") == 1 + both and plan.count("ShuffledHashJoin") == 1 + both and "Sort" not in plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
