"""Every registered graph query against its SQL, and properties of the operators."""

import random

import duckdb
import pytest
from test_engine import small_graph

from symgraph import queries
from symgraph.operators import impact

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def rows(columns, found):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(str(tuple(float(r[i]) if isinstance(r[i], float) else r[i] for i in order)) for r in found)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, duck, name):
    df = queries.QUERIES[name](spark, SF)
    found = df.collect()
    if name not in queries.ORACLE_SQL:
        assert found
        return
    want = duck.execute(queries.ORACLE_SQL[name])
    columns = [c[0] for c in want.description]
    assert sorted(columns) == sorted(df.columns)
    assert rows(df.columns, found) == rows(columns, want.fetchall())


def test_reach_grows_with_depth_and_unites_over_roots(spark):
    rng = random.Random(7)
    g = small_graph(spark, [(i, f"n{rng.randrange(20)}", f"n{rng.randrange(20)}") for i in range(40)])
    reach = lambda ids, d: {r["id"] for r in impact.reach(g, g.nodes.where(g.nodes["id"].isin(ids)), d).collect()}
    assert reach(["n1"], 1) <= reach(["n1"], 2) <= reach(["n1"], 4)
    assert reach(["n1", "n2"], 3) == reach(["n1"], 3) | reach(["n2"], 3)


def brute_impact(edges, root, depth, limit):
    """A queue: nodes are expanded in the order of discovery while fewer than `limit` were found."""
    seen, queue = {root}, [(root, 0)]
    while queue:
        node, level = queue.pop(0)
        if level == depth or len(seen) >= limit:
            continue
        for _, source, target in edges:
            if target == node and source not in seen:
                seen.add(source)
                queue.append((source, level + 1))
    return seen


@pytest.mark.parametrize("limit", [1, 4, 9, 1000])
def test_each_root_has_its_own_limit(spark, limit):
    rng = random.Random(limit)
    edges = [(i, f"n{rng.randrange(25)}", f"n{rng.randrange(25)}") for i in range(60)]
    g = small_graph(spark, edges)
    ids = [r["id"] for r in g.nodes.select("id").collect()]
    roots = g.nodes.where(g.nodes["id"].isin(ids[:8]))
    got = {}
    for r in impact.impact_each(g, roots, 3, limit).collect():
        got.setdefault(r["root"], set()).add(r["id"])
    assert got == {i: brute_impact(edges, i, 3, limit) for i in ids[:8]}


def test_clean_paths(spark):
    from pyspark.sql import functions as F

    from symgraph.functions import paths

    cases = {"a/./b": "a/b", "../../x": "x", "a/../../b//c/": "b/c", "": "", "/": "", "a/b/..": "a"}
    df = spark.createDataFrame([(k,) for k in cases], "p string").select("p", paths.clean_posix(F.col("p")).alias("c"))
    assert {r["p"]: r["c"] for r in df.collect()} == cases


def test_aliases_and_modules(spark):
    from pyspark.sql import functions as F

    from symgraph.functions import paths

    aliases = [("@lib/*", "src/lib/*"), ("exact", "one/two"), ("*.css", "styles/*")]
    df = spark.createDataFrame([("@lib/a/b",), ("exact",), ("x.css",), ("app.org/m/pkg",), ("..pkg.mod",), (".",), ("./u.ts",)], "m string")
    got = {r["m"]: r["c"] for r in df.select("m", paths.module_candidates(F.col("m"), F.lit("d/e/f.py"), "app.org/m", aliases).alias("c")).collect()}
    assert got["@lib/a/b"][0] == "src/lib/a/b.py" and "one/two/index.js" in got["exact"] and got["x.css"][0] == "styles/x.py"
    assert "pkg/*.go" in got["app.org/m/pkg"] and got["..pkg.mod"][0] == "d/e/pkg/mod.py" and got["."] == [] and got["./u.ts"] == ["d/e/u.ts"]


@pytest.mark.parametrize("pattern, yes, no", [("*.go", ["a.go"], ["b/a.go", "a.gox"]), ("a/**/c", ["a/x/c"], ["a/c", "a/x/y/c"]), ("[a-c]?.t", ["bz.t"], ["dz.t", "b.t"]), ("[^a]x", ["bx"], ["ax"]), ("a.b+", ["a.b+"], ["axbb"])])
def test_globs(pattern, yes, no):
    import re

    from symgraph.functions.paths import glob_regex

    p = re.compile(glob_regex(pattern))
    assert all(p.match(x) for x in yes) and not any(p.match(x) for x in no)


@pytest.mark.parametrize("pattern, prefix", [("src/*.go", "src/"), ("*.go", ""), ("a\\\\*b?", "a*b"), ("plain.py", "plain.py"), ("d[0-9]x", "d")])
def test_glob_prefixes(pattern, prefix):
    from symgraph.functions.paths import glob_prefix

    assert glob_prefix(pattern.replace("\\\\", "\\")) == prefix


def test_globs_reach_the_scan(spark, tmp_path):
    """A pattern's literal beginning is a range of paths for the scan; results are those of the regular expression."""
    from symgraph.functions.paths import glob_regex
    from symgraph.operators import status

    paths_ = [f"{a}/{b}{c}" for a in ("src", "srcs", "doc") for b in "xyz" for c in (".go", ".py")] + ["src/x.go\U0010ffff", "src/[x].go"]
    spark.createDataFrame([(p,) for p in paths_], "path string").write.parquet(str(tmp_path / "files"))
    files = spark.read.parquet(str(tmp_path / "files"))
    import re

    for globs in (["src/*.go"], ["src/x*", "doc/[yz].py"], ["*/x.go"], ["src/\\[x].go"]):
        want = sorted(p for p in paths_ if any(re.match(glob_regex(g), p, re.S) for g in globs))
        assert sorted(r["path"] for r in status.matching_files(files, globs).collect()) == want
    plan = status.matching_files(files, ["src/*.go"])._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(path,src/)" in plan and "LessThan(path,src/" in plan


def test_kept_aggregates_follow_random_edits(spark):
    """Nodes come, go and move between files, edges repeat and dangle, files change: deltas equal a recount."""
    from symgraph.operators import kept
    from symgraph.plans.graph import Graph

    rng = random.Random(12)

    def state(nodes, edges, files):
        n = spark.createDataFrame([(f"n{i}", k, p) for i, (k, p) in nodes.items()], "id string, kind string, file_path string")
        e = spark.createDataFrame(edges, "id long, source string, target string, kind string, resolved boolean")
        return Graph(n, e, spark.createDataFrame([(p, *x) for p, x in files.items()], "path string, language string, node_count int"))

    node = lambda: (rng.choice("ab"), f"{rng.choice('pqr')}/{rng.choice('xy')}.go")
    edge = lambda: (rng.randrange(30), f"n{rng.randrange(14)}", f"n{rng.randrange(14)}", rng.choice(("calls", "imports")), rng.random() < 0.8)
    nodes, edges = {i: node() for i in range(10)}, [edge() for _ in range(40)]
    files = {f"{d}/{f}": (rng.choice("gp"), rng.randrange(5)) for d in "pqr" for f in "xy"}
    before = state(nodes, edges, files)
    for i in rng.sample(range(14), 6):
        nodes[i] = node() if rng.random() < 0.7 else nodes.pop(i, node())
    for i in rng.sample(sorted(nodes), 2):
        del nodes[i]
    edges = [x for x in edges if rng.random() < 0.8] + [edge() for _ in range(8)] + edges[:2]
    files |= {"s/new": ("g", 3), "p/x": ("z", 9)}
    del files["q/y"]
    after = state(nodes, edges, files)
    rows_of = lambda name, df: sorted(map(tuple, df.select(*kept.KEYS[name], *kept.SUMS[name]).collect()))
    now = kept.follow({name: measure(before) for name, measure in kept.MEASURES.items()}, before, after)
    for name, measure in kept.MEASURES.items():
        assert rows_of(name, now[name]) == rows_of(name, measure(after)), name
