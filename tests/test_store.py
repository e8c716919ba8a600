"""Partial writes, incremental resolution, lookups that are kept, and stores at URIs."""

import os
import random
import shutil

import pytest
from test_engine import project, targets, write  # noqa: F401

from symgraph import index
from symgraph.operators import find, impact, resolve, search
from symgraph.sources.snapshot import BUCKETS, Store

TABLES = ("nodes", "edges", "files")


def rows(spark, store, table):
    return sorted(str(tuple(r)) for r in getattr(Store(store).graph(spark), table).drop("updated_at", "indexed_at", "modified_at").collect())


def written(store):
    """Buckets by table that the newest run wrote."""
    now = Store(store).current["tables"]
    newest = max({n for t in now.values() for n in t}, key=lambda n: os.stat(os.path.join(store, "snapshots", n)).st_mtime_ns)
    return {t: len(held.get(newest, ())) for t, held in now.items()}


def test_resolve_writes_what_it_finds(spark, project):  # noqa: F811
    root, store = project
    write(root, {"web/app.ts": "import { pick } from '@lib/util';\nfunction start() {\n  pick(1);\n}\n", "web/lib/util.ts": "export function pick(x) {}\n", "web/lib/other.ts": "export function pick(x) {}\n"})
    index.index_all(spark, root, store)
    assert targets(spark, store)["start", "pick"] == "name:pick"
    alias = '{"compilerOptions": {"paths": {"@lib/*": ["web/lib/*"]}}}'
    write(root, {"tsconfig.json": alias})
    s = index.resolve_all(spark, store)
    assert (s["edges_resolved_now"], s["edges_still_unresolved"]) == (1, 0)
    assert targets(spark, store)["start", "pick"] == "web/lib/util.ts::pick::1"
    s = index.resolve_all(spark, store)
    assert (s["edges_resolved_now"], s["edges_resolved_before"]) == (0, s["edges_total"])
    # Other aliases take effect in an ordinary run as well, though no source changed.
    write(root, {"tsconfig.json": alias.replace("web/lib/*", "nowhere/*")})
    s = index.index_all(spark, root, store)
    assert s["files_indexed"] == 0 and targets(spark, store)["start", "pick"] == "name:pick"


def edited(rng, files):
    """Random sources: functions that call names, import them, rename them; files of three languages come, change, go."""
    names = [f"f{i}" for i in range(7)]
    for _ in range(rng.randrange(1, 4)):
        k, ending = rng.randrange(12), rng.choice([".py", ".ts", ".go"])
        path = f"d{k % 3}/m{k}{ending}"
        if path in files and rng.random() < 0.25:
            del files[path]
            continue
        a, b, c, module = *rng.sample(names, 3), rng.randrange(12)
        files[path] = {
            ".py": f"from d{module % 3}.m{module} import {b} as {c}\nfrom d{k % 3}.m{module} import *\n\ndef {a}():\n    {b}()\n    {c}()\n",
            ".ts": f"import {{ {b} as {c} }} from '../d{module % 3}/m{module}';\nexport function {a}() {{\n  {c}();\n  {b}();\n}}\n",
            ".go": f'package p{rng.randrange(3)}\n\nimport "app/d{module % 3}"\n\nfunc {a.title()}() {{\n\tp{rng.randrange(3)}.{b.title()}()\n\t{c.title()}()\n}}\n',
        }[ending]


def test_increments_equal_full_runs(spark, project, tmp_path, monkeypatch):  # noqa: F811
    root, store = project
    rng, files = random.Random(11), {"go.mod": "module app\n"}
    for _ in range(8):
        edited(rng, files)
    looked, plain = [], resolve.resolve_pending
    monkeypatch.setattr(resolve, "resolve_pending", lambda nodes, left, *a: looked.append(left.count()) or plain(nodes, left, *a))
    for step in range(3):
        shutil.rmtree(root)
        os.mkdir(root)
        write(root, files)
        stats = index.index_all(spark, root, store)
        if step:
            full = f"{store}-{step}"
            index.index_all(spark, root, full)
            for t in TABLES:
                assert rows(spark, store, t) == rows(spark, full, t), (step, t)
        edited(rng, files)
    assert stats["files_skipped"] and min(looked) < max(looked)


def test_one_changed_file_writes_one_bucket(spark, project):  # noqa: F811
    root, store = project
    files = {f"p/m{i}.py": f"def f{i}():\n    f{(i + 1) % 40}()\n" for i in range(40)}
    write(root, files)
    index.index_all(spark, root, store, lookups=True)
    assert set(written(store).values()) == {BUCKETS}
    write(root, {"p/m7.py": '"""Other words."""\ndef f7():\n    """Quixotic."""\n    f8()\n'})
    s = index.index_all(spark, root, store)
    assert s["files_indexed"] == 1
    # f7 is at another line, so the edge of its caller, in another bucket or the same, is written too.
    got = written(store)
    assert (got["nodes"], got["files"], got["extracts"]) == (1, 1, 1) and got["edges"] in (1, 2)
    write(root, {"p/m7.py": '"""Other words."""\ndef f7():\n    """Quixotical."""\n    f8()\n'})
    index.index_all(spark, root, store)
    assert written(store) == {"nodes": 1, "files": 1, "extracts": 1, "edges": 0}  # edges stay where they are
    full = store + "-full"
    index.index_all(spark, root, full)
    assert all(rows(spark, store, t) == rows(spark, full, t) for t in TABLES)
    # The kept lookups answer as whole tables do.
    mine, other = Store(store).graph(spark), Store(full).graph(spark)
    assert mine.text is not None and mine.near is not None and other.text is None
    ask = lambda g, q: [(r["id"], round(r["score"], 9)) for r in search.search_text(g, q).collect()]
    for q in ("quixotic", "f7", "other f1", "m7 py"):
        assert ask(mine, q) == ask(other, q) != []
    assert [r["caller_name"] for r in find.callers(mine, "f7").collect()] == ["f6"]
    root_ids = mine.nodes.where("name = 'f7'").select("id")
    assert sorted(map(tuple, impact.reach(mine, root_ids, 3).collect())) == sorted(map(tuple, impact.reach(other, root_ids, 3).collect()))


def test_a_failed_run_leaves_the_store_as_it_was(spark, project, monkeypatch):  # noqa: F811
    root, store = project
    write(root, {"a.py": "def f():\n    g()\n", "b.py": "def g():\n    pass\n"})
    index.index_all(spark, root, store)
    before = {t: rows(spark, store, t) for t in TABLES}
    write(root, {"b.py": "\ndef g():\n    f()\n"})
    monkeypatch.setattr(Store, "commit", lambda self, name: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        index.index_all(spark, root, store)
    monkeypatch.undo()
    assert {t: rows(spark, store, t) for t in TABLES} == before
    assert index.index_all(spark, root, store)["files_indexed"] == 1
    assert targets(spark, store)["f", "g"] == "b.py::g::2"


def test_a_store_at_a_uri(spark, project, tmp_path):  # noqa: F811
    """A path that only Spark's file systems can open."""
    root, _ = project
    (tmp_path / "far").mkdir()
    spark._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.far.link./s", f"file://{tmp_path}/far")
    store = "viewfs://far/s/proj"
    write(root, {"a.py": "def f():\n    g()\n", "b.py": "def g():\n    pass\n", "big.py": "x = 1\n" * 200_000})
    assert index.index_all(spark, root, store, lookups=True)["files_indexed"] == 2
    write(root, {"b.py": '\ndef g():\n    """Far."""\n'})
    assert index.index_all(spark, root, store)["files_indexed"] == 1 and index.index_all(spark, root, store)["files_skipped"] == 2
    assert targets(spark, store)["f", "g"] == "b.py::g::2"
    g = Store(store).graph(spark)
    assert [r["name"] for r in search.search_text(g, "far").collect()] == ["g"] and [r["caller_name"] for r in find.callers(g, "g").collect()] == ["f"]
    assert "size exceeded" in Store(store).place.read("errors.log") and Store(store).get("project_root") == root
    assert len(os.listdir(tmp_path / "far" / "proj" / "snapshots")) <= 2 + BUCKETS
    os.remove(os.path.join(root, "big.py"))
    index.index_all(spark, root, store)
    assert Store(store).place.read("errors.log") is None
