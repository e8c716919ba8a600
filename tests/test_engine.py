"""Trees, stores, resolution and the command line, end to end on small projects."""

import io
import json
import os

import pytest

from symgraph import cli, index
from symgraph.functions import strings
from symgraph.operators import find, impact
from symgraph.plans.graph import Graph
from symgraph.sources import config, registry, tree
from symgraph.sources.snapshot import Store


def write(root, files):
    for path, text in files.items():
        full = os.path.join(root, path)
        os.makedirs(os.path.dirname(full), exist_ok=True)
        with open(full, "w", encoding="utf-8") as f:
            f.write(text)


@pytest.fixture
def project(tmp_path, monkeypatch):
    monkeypatch.setenv("SYMGRAPH_HOME", str(tmp_path / "home"))
    root = tmp_path / "proj"
    root.mkdir()
    return str(root), str(tmp_path / "store")


def targets(spark, store):
    e = Store(store).graph(spark).edges.where("kind = 'calls'").collect()
    return {(r["source"].split("::")[1], r["callee_text"]): r["target"] for r in e}


def test_listing(spark, project, monkeypatch):
    root, _ = project
    write(root, {"a.py": "", "pkg/__init__.py": "", "pkg/b.ts": "", "skip/c.py": "", "gen/x_gen.go": "", "node_modules/d.js": "", ".hid/e.py": "", "dist/f.py": "", "z.txt": "", "deep/skipme/g.py": "", "B.PY": "", ".gitignore": "# c\nskip/\n*_gen.go\n!a.py\n\nskipme\n"})
    write(root, {"far/one/two/three/h.go": "", "far/one/é.py": ""})
    os.symlink(os.path.join(root, "pkg/b.ts"), os.path.join(root, "far/link.ts"))
    os.symlink(os.path.join(root, "far"), os.path.join(root, "pkg/loop"))
    os.symlink(os.path.join(root, "nowhere.py"), os.path.join(root, "dangling.py"))
    want = ["B.PY", "a.py", "far/one/two/three/h.go", "far/one/é.py", "nowhere.py", "pkg/__init__.py", "pkg/b.ts"]
    for parts in (256, 3, 1):  # a partition a folder, or one for all below some
        monkeypatch.setattr(tree.TreeReader, "PARTS", parts)
        reader = tree.TreeReader(root)
        assert sorted({f[0] for p in reader.partitions() for f in reader.read(p)}) == want
    assert [tuple(r) for r in tree.listing(spark, root).orderBy("rank").collect()] == [(p, k) for k, p in enumerate(want)]
    assert tree.listing(spark, os.path.join(root, "empty")).count() == 0


def test_incremental_equals_full(spark, project):
    root, store = project
    write(root, {"pkg/__init__.py": "", "pkg/a.py": "from pkg.b import work\n\ndef top():\n    work()\n", "pkg/b.py": "def work():\n    return 1\n", "big.py": "x = 1\n" * 200_000})
    s = index.index_all(spark, root, store)
    assert (s["files_scanned"], s["files_indexed"], s["files_failed"], s["edges_resolved"]) == (4, 3, 1, 1)
    assert "size exceeded" in open(os.path.join(store, "errors.log")).read()
    again = index.index_all(spark, root, store)
    assert (again["files_skipped"], again["files_indexed"], again["edges_resolved"]) == (3, 0, 0)
    # A change of the callee's file alone leaves the caller's edge in place.
    write(root, {"pkg/b.py": "import os\n\n\ndef work():\n    return 2\n"})
    s = index.index_all(spark, root, store)
    assert (s["files_indexed"], s["files_skipped"]) == (1, 2)
    assert targets(spark, store)["top", "work"] == "pkg/b.py::work::4"
    full = store + "-full"
    index.index_all(spark, root, full)
    rows = lambda d, t: sorted(str(tuple(r)) for r in getattr(Store(d).graph(spark), t).drop("updated_at", "indexed_at").collect())
    assert all(rows(store, t) == rows(full, t) for t in ("nodes", "edges", "files"))
    os.remove(os.path.join(root, "pkg/b.py"))
    os.remove(os.path.join(root, "big.py"))
    s = index.index_all(spark, root, store)
    assert s["files_deleted"] == 1 and targets(spark, store)["top", "work"] == "name:work"
    assert not os.path.exists(os.path.join(store, "errors.log"))
    assert index.index_all(spark, root, store, force=True)["files_indexed"] == 2
    assert index.resolve_all(spark, store)["edges_resolved_now"] == 0


def test_resolution_tiers(spark, project):
    root, store = project
    write(root, {
        "go.mod": "module example.com/app\n\ngo 1.22\n",
        "cmd/main.go": 'package main\n\nimport (\n\tst "example.com/app/internal/store"\n\t"example.com/app/internal/odd"\n)\n\nfunc main() {\n\thelper()\n\tst.Open()\n\tweird.Go()\n\tlocal()\n\tShared()\n}\nfunc local() {}\n',
        "cmd/help.go": "package main\n\nfunc helper() {}\n",
        "internal/store/db.go": "package store\n\nfunc Open() {}\nfunc Shared() {}\n",
        "internal/odd/x.go": "package weird\n\nfunc Go() {}\n",
        "tsconfig.json": '{"compilerOptions": {"paths": {"@lib/*": ["web/lib/*"]}}}',
        "web/app.ts": "import { pick as choose } from '@lib/util';\nimport * as U from './lib/util';\nfunction start() {\n  choose(1);\n  U.pick(2);\n  only();\n  twice();\n  amb();\n}\n",
        "web/lib/util.ts": "export function pick(x) {}\nexport function twice() {}\n",
        "web/other.ts": "export function only() {}\nexport function twice() {}\nexport function amb() {}\n",
        "web/third.ts": "export function amb() {}\n",
        "py/a.py": "from .b import go as run\nfrom py.c import *\n\ndef f():\n    run()\n    starred()\n    nowhere()\n",
        "py/b.py": "def go():\n    pass\n", "py/c.py": "def starred():\n    pass\n",
    })
    index.index_all(spark, root, store)
    got = targets(spark, store)
    assert got["main", "helper"] == "cmd/help.go::helper::3" and got["main", "local"] == "cmd/main.go::local::15"
    assert got["main", "st.Open"] == "internal/store/db.go::Open::3" and got["main", "weird.Go"] == "internal/odd/x.go::Go::3"
    assert got["main", "Shared"] == "internal/store/db.go::Shared::4"
    assert got["start", "choose"] == got["start", "U.pick"] == "web/lib/util.ts::pick::1"
    assert got["start", "only"] == "web/other.ts::only::1" and got["start", "twice"] == "web/lib/util.ts::twice::2" and got["start", "amb"] == "name:amb"
    assert got["f", "run"] == "py/b.py::go::1" and got["f", "starred"] == "py/c.py::starred::1" and got["f", "nowhere"] == "name:nowhere"
    g = Store(store).graph(spark)
    tier = lambda ref: [(r["id"], r["tier"]) for r in find.in_order(find.find_node(g, ref)).collect()]
    assert tier("py/b.py::go::1") == [("py/b.py::go::1", 0)] and tier("twice") == [("web/lib/util.ts::twice::2", 1), ("web/other.ts::twice::2", 1)]


def small_graph(spark, edges):
    ids = sorted({x for _, a, b in edges for x in (a, b)})
    nodes = spark.createDataFrame([(i, "function", i, i, f"{i}.go", i == "t") for i in ids], "id string, kind string, name string, qualified_name string, file_path string, is_exported boolean")
    e = spark.createDataFrame([(i, a, b, "calls", True, 1, 0) for i, a, b in edges], "id long, source string, target string, kind string, resolved boolean, line int, col int")
    return Graph(nodes, e, nodes)


def queue_impact(edges, roots, depth, limit):
    """The walk with a queue, for comparison."""
    seen, queue, taken = dict.fromkeys(roots, 0), [(r, 0) for r in roots], []
    while queue and len(seen) < limit:
        node, d = queue.pop(0)
        if d >= depth:
            continue
        for i, a, b in sorted(edges):
            if b == node:
                taken.append(i)
                if a not in seen:
                    seen[a] = d + 1
                    queue.append((a, d + 1))
    return seen, taken


def test_impact_follows_the_queue(spark):
    import random

    rng = random.Random(2)
    for case in range(4):
        n = 14
        edges = [(i, f"n{rng.randrange(n)}", f"n{rng.randrange(n)}") for i in range(26)]
        g = small_graph(spark, edges)
        roots = ["n0", "n1"][: 1 + case % 2]
        roots = [r for r in roots if any(r in e for e in edges)]
        df = spark.createDataFrame([(r, k) for k, r in enumerate(roots)], "id string, rank long")
        for depth, limit in ((2, 100), (3, 5), (3, 2)):
            reached, taken = impact.impact(g, df, depth, limit)
            seen, order = queue_impact(edges, roots, depth, limit)
            assert {r["id"]: r["level"] for r in reached.collect()} == seen
            assert sorted(r["edge_id"] for r in taken.collect()) == sorted(order)
        full, _ = queue_impact(edges, roots, 3, 10**9)
        assert {r["id"]: r["level"] for r in impact.reach(g, df, 3).collect()} == full


def run(spark, *args, cwd="/"):
    import contextlib

    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        cli.run(list(args), spark, cwd)
    return out.getvalue()


def test_command_line(spark, project, monkeypatch):
    root, _ = project
    write(root, {"pkg/m.py": 'def unique_one(a):\n    """Does quixotic things."""\n    return a\n\ndef caller():\n    return unique_one(2)\n', "pkg/m_test.go": "package m\n\nfunc TestX() { Target() }\n", "pkg/m.go": "package m\n\nfunc Target() {}\n"})
    made = json.loads(run(spark, "--json", "init", root, "--index", "--name", "team/demo"))
    assert made["indexed"] and made["name"] == "team/demo" and made["index"]["files_indexed"] == 3
    ask = lambda *a: json.loads(run(spark, "--json", *a, "--path", root))
    found = ask("query", "quixotic")
    assert found["count"] == 1 and found["results"][0]["name"] == "unique_one" and found["stale"]["is_stale"] is False
    assert ask("query", "nique_on")["results"][0]["name"] == "unique_one"  # found as a substring only
    assert ask("query", "unique_one", "--kind", "class")["count"] == 0
    got = ask("callers", "unique_one")
    assert [c["caller_name"] for c in got["callers"]] == ["caller"] and got["matched"] == 1 and not got["truncated"]
    assert [c["callee_name"] for c in ask("callees", "caller")["callees"]] == ["unique_one"]
    hit = ask("impact", "Target")
    assert [n["name"] for n in hit["nodes"]] == ["Target", "TestX"] and len(hit["edges"]) == 1 and ask("impact", "nothing")["matched"] == 0
    assert ask("affected", "./pkg/m.go")["affected_tests"] == ["pkg/m_test.go"]
    assert run(spark, "affected", "pkg/m.go", "--quiet", "--path", root) == "pkg/m_test.go\n"
    view = ask("overview")
    assert view["packages"][0]["path"] == "pkg" and view["summary"]["files"] == 3 and view["packages"][0]["languages"] == {"go": 2, "python": 1}
    ctx = ask("context", "where", "is", "unique_one")
    assert ctx["entrypoints"][0]["name"] == "unique_one" and ctx["related"][0]["name"] == "caller" and "   1: def unique_one" in ctx["code_blocks"][0]["code"]
    small = ask("context", "unique_one", "--max-json-bytes", "1")
    assert small["output"]["truncated"] and "code_blocks" not in small and "code_blocks" in ask("context", "unique_one", "--max-json-bytes=1", "--allow-large")
    assert "code_blocks" not in ask("context", "unique_one", "--summary")
    assert "## Entrypoints" in run(spark, "context", "unique_one", "--path", root) and "## Packages" in run(spark, "architecture", "--path", root)
    assert [f["path"] for f in ask("files", "--glob", "pkg/*.go")["files"]] == ["pkg/m.go", "pkg/m_test.go"]
    state = ask("status")
    assert state["files"] == 3 and state["nodes_by_kind"] == {"function": 4} and state["schema_version"] == 3
    later = os.stat(os.path.join(root, "pkg/m.py")).st_mtime + 3600
    os.utime(os.path.join(root, "pkg/m.py"), (later, later))
    assert ask("query", "caller")["stale"]["reason"] == "source file modified after last_indexed"
    assert ask("sync")["files_skipped"] == 3
    with pytest.raises(cli.Failure, match="did you mean `--limit`"):
        run(spark, "query", "x", "--limt", "3")
    with pytest.raises(cli.Failure, match="--target is global"):
        run(spark, "query", "x", "--target", "y")
    assert json.loads(run(spark, "--json", "--target", "demo", "info"))["root"] == root
    monkeypatch.setattr("sys.stdin", io.StringIO("no\n"))
    with pytest.raises(cli.Failure, match="aborted"):
        run(spark, "rm", "team/demo")
    assert json.loads(run(spark, "--json", "rm", "team/demo", "-y", "--purge"))["purged_store"] and json.loads(run(spark, "--json", "list"))["entries"] == []
    with pytest.raises(cli.Failure, match="unknown command"):
        run(spark, "nope")
    assert "Commands:" in run(spark) and run(spark, "--version").startswith("symgraph ")


def test_registry(project):
    for name, key in (("x/api", "host/x/api"), ("y/api", "host/y/api")):
        registry.upsert(name, key, f"/src/{name}", f"git@host:{name}.git")
    assert registry.resolve("x/api", "/")[0] == "x/api" and registry.resolve("/src/y/api", "/")[0] == "y/api"
    with pytest.raises(registry.Ambiguous) as e:
        registry.resolve("api", "/")
    assert e.value.candidates == ["x/api", "y/api"]
    with pytest.raises(registry.NotFound):
        registry.resolve("zzz", "/")
    assert registry.default_name("host/z/api", "/src/z") == "api"
    registry.upsert("api", "k", "/src/k", None)
    assert registry.default_name("host/z/api", "/src/z") == "z/api" and registry.default_name("host/x/api", "/src/x/api") == "z/api"[:0] + "x/api"
    created = registry.load()["entries"]["api"]["created_at"]
    registry.upsert("api", "k2", "/src/k", None)
    assert registry.load()["entries"]["api"]["created_at"] == created and registry.remove("api") and not registry.remove("api")
    open(config.registry_path(), "w").write("{broken")
    assert registry.load() == {"version": 1, "entries": {}}


def test_strings():
    assert strings.edit_distance("kitten", "sitting") == 3 and strings.similar("limt", ["path", "limit"]) == "limit" and strings.similar("zzzzz", ["path"]) == ""
    assert [strings.human_size(n) for n in (0, 1023, 1024, 1536, 5 << 20, 3 << 40)] == ["0B", "1023B", "1.0KB", "1.5KB", "5.0MB", "3072.0GB"]
    assert [strings.normalize_remote(u) for u in ("git@h.org:a/b.git", "https://me@h.org/a/b/", "plain")] == ["h.org/a/b", "h.org/a/b", "plain"]
    assert strings.safe_key("/a b/ü/") == "a_b/_" and strings.safe_key("//") == "unnamed"


def test_older_tables(spark, project):
    _, store = project
    s = Store(store)
    name = s.stage()
    s.write(name, "nodes", spark.createDataFrame([("a", "function")], "id string, kind string"))
    s.write(name, "edges", spark.createDataFrame([(1, "a", "b", "calls")], "id long, source string, target string, kind string"))
    s.commit(name)
    g = s.graph(spark)
    assert g.nodes.first()["import_module"] is None and g.edges.first()["resolved"] is False and g.files.count() == 0
    assert s.get("missing") == "" and {t["table"]: t["rows"] for t in s.catalog(spark)}["nodes"] == 1


def test_stream_runs_increments(spark, project, tmp_path):
    from symgraph.streaming.sync import sync_stream

    root, store = project
    write(root, {"a.py": "def f():\n    pass\n"})
    notices = tmp_path / "in"
    notices.mkdir()
    (notices / "1.txt").write_text("a.py\n")
    q = sync_stream(spark.readStream.text(str(notices)), root, store, str(tmp_path / "cp"))
    q.awaitTermination(120)
    assert [n["name"] for n in Store(store).graph(spark).nodes.collect()] == ["f"]
