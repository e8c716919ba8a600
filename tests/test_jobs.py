"""The jobs: growing input in two runs, runs done again, command lines, and their SQL."""

import json
import os
import re
import shutil

import duckdb
import pytest
from pyspark.sql import Observation
from test_queries import SF, TABLES, rows

from jobs import index_documents, package_report
from jobs import queries as job_queries
from symgraph.operators import search
from symgraph.plans.graph import Graph
from symgraph.sources import star
from symgraph.sources.textindex import TextIndex

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def write(spark, folder, docs):
    made = [(i, t, "en", "s", 0) for i, t in docs]
    spark.createDataFrame(made, SCHEMA).coalesce(1).write.mode("append").parquet(folder)


def whole(spark, out):
    return sorted(map(str, index_documents.read_back(spark, out).collect()))


@pytest.mark.parametrize("name", sorted(job_queries.QUERIES))
def test_equals_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = job_queries.QUERIES[name](spark, SF)
    want = con.execute(job_queries.ORACLE_SQL[name])
    columns = [c[0] for c in want.description]
    assert sorted(columns) == sorted(df.columns) and rows(df.columns, df.collect()) == rows(columns, want.fetchall())


def test_index_takes_what_is_new(spark, tmp_path):
    docs, out, mark = f"file://{tmp_path}/documents.parquet", f"file://{tmp_path}/out", f"file://{tmp_path}/mark"
    run = lambda: index_documents.run(spark, docs, out, mark, files_per_batch=1)
    write(spark, docs, [(1, "the old tale"), (2, "a tale of two"), (3, None), (None, "nobody's"), (4, "")])
    first = run()
    assert (first["documents_read"], first["documents_put_in"]) == (5, 4)
    before = whole(spark, out)
    assert run() == dict.fromkeys(first, 0) and whole(spark, out) == before
    # A changed, an equal and a new document, and a document that comes twice in one file.
    write(spark, docs, [(1, "the new tale"), (2, "a tale of two"), (5, "tales"), (6, "x"), (6, "y")])
    second = run()
    assert second["batches"] == 1 and second["documents_read"] == 5 and second["documents_put_in"] == 3
    fresh = f"file://{tmp_path}/fresh"
    write(spark, fresh, [(1, "the new tale"), (2, "a tale of two"), (3, None), (4, ""), (5, "tales"), (6, "y")])
    index_documents.run(spark, fresh, f"{out}-fresh", f"{mark}-fresh")
    assert whole(spark, out) == whole(spark, f"{out}-fresh")
    found = {r["id"] for r in search.bm25_index(spark, TextIndex(out), "tale old", {"text": 1.0}).collect()}
    assert found == {"s/1.txt", "s/2.txt", "s/5.txt"}


def test_a_lost_checkpoint(spark, tmp_path):
    """All files are read again: that changes nothing in an index of one run, and is refused where there are more."""
    docs, out = f"file://{tmp_path}/docs", f"file://{tmp_path}/out"
    write(spark, docs, [(1, "one two"), (2, "two")])
    index_documents.run(spark, docs, out, f"file://{tmp_path}/mark1")
    before = whole(spark, out)
    index_documents.run(spark, docs, out, f"file://{tmp_path}/mark2")
    assert whole(spark, out) == before
    write(spark, docs, [(3, "three")])
    index_documents.run(spark, docs, out, f"file://{tmp_path}/mark2")
    with pytest.raises(Exception, match="later runs"):
        index_documents.run(spark, docs, out, f"file://{tmp_path}/mark3")
    assert len(whole(spark, out)) == 4


def test_a_failed_batch_is_done_again(spark, tmp_path, monkeypatch):
    docs, out, mark = f"file://{tmp_path}/docs", f"file://{tmp_path}/out", f"file://{tmp_path}/mark"
    write(spark, docs, [(1, "one two"), (2, "two")])
    index_documents.run(spark, docs, out, mark)
    write(spark, docs, [(2, "three"), (3, "two")])
    put = TextIndex.put

    def fails(self, *args):
        put(self, *args)
        raise OSError("lost after the write")

    monkeypatch.setattr(TextIndex, "put", fails)
    with pytest.raises(Exception, match="lost after the write"):
        index_documents.run(spark, docs, out, mark)
    monkeypatch.undo()
    again = index_documents.run(spark, docs, out, mark)
    assert again["documents_put_in"] == 2
    assert {r["path"]: r["term"] for r in index_documents.read_back(spark, out).where("path <> 's/1.txt'").collect()} == {"s/2.txt": "three", "s/3.txt": "two"}


def test_report_rewrites_the_roots_it_is_asked_for(spark, tmp_path):
    tables, out = f"{tmp_path}/tables", f"file://{tmp_path}/out"
    os.mkdir(tables)
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "documents"):
        shutil.copy(f"{SF}/{t}.parquet", tables)
    made = package_report.run(spark, tables, out)
    every = lambda: {r["package"]: r for r in package_report.read_back(spark, out).collect()}
    before = every()
    assert made["packages_written"] == len(before) and package_report.run(spark, tables, out) == made and every() == before
    # Parts and line items grow (a copy with other keys); only the report on parts is made anew.
    part = spark.read.parquet(f"{SF}/part.parquet")
    part.selectExpr("p_partkey + 1000000 as p_partkey", *part.columns[1:]).unionByName(part).write.parquet(f"{tables}/more")
    os.remove(f"{tables}/part.parquet")
    os.rename(f"{tables}/more", f"{tables}/part.parquet")
    some = package_report.run(spark, tables, out, "parts")
    after = every()
    grown = [p for p in after if after[p] != before[p]]
    assert grown and all(p.startswith("parts/") for p in grown) and some["packages_written"] == sum(p.startswith("parts/") for p in after)
    assert all(after[p]["symbols"] == 2 * before[p]["symbols"] for p in grown)
    assert sorted(package_report.report(star.graph(spark, tables), ["parts"]).collect()) == sorted(r for p, r in after.items() if p.startswith("parts/"))


def test_command_lines(spark, tmp_path, monkeypatch, capsys):
    for job in (index_documents, package_report):
        monkeypatch.setattr(job, "start", lambda name: spark)
    monkeypatch.setattr(type(spark), "stop", lambda self: None)
    config = tmp_path / "c.json"
    config.write_text(json.dumps({"documents": f"{SF}/documents.parquet", "out": f"file://{tmp_path}/o", "checkpoint": "nowhere", "files_per_batch": 5}))
    index_documents.main(["--config", str(config), "--checkpoint", f"file://{tmp_path}/m"])
    assert "'documents_put_in': 200" in capsys.readouterr().out
    package_report.main(["--tables", SF, "--out", f"file://{tmp_path}/p"])
    assert "packages_written" in capsys.readouterr().out
    config.write_text(json.dumps({"documents": "x", "odd": 1}))
    for bad in (["--config", str(config)], ["--nope", "1"]):
        with pytest.raises(SystemExit):
            index_documents.main(bad)


def test_report_shuffles_edges_once_from_sources_to_targets(spark):
    """Degrees and pairs of files read the same six shuffles below the edges, one for each part of their union."""
    g = star.graph(spark, SF)
    seen = Observation()
    df = package_report.report(g, None, 7, seen)
    df.collect()
    final = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    by_source = [x for x in final.splitlines() if re.search(r"^[^A-Za-z]*Exchange hashpartitioning\(source#\d+, \d+\), REPARTITION_BY_NUM", x)]
    assert len(by_source) == 6 and seen.get["edges"] == g.edges.count()


def test_ends_that_are_no_nodes_count_for_degrees_only(spark):
    nodes = spark.createDataFrame([("a", "p/a_test.go", "x.a"), ("b", "q/b.go", "y.b")], "id string, file_path string, qualified_name string")
    nodes = nodes.selectExpr("*", "1 as start_line", "true as is_exported")
    edges = [(1, "a", "b", "calls", True), (2, "a", "lost", "calls", True), (3, "lost", "b", "calls", True), (4, "a", "b", "contains", True), (5, "a", "b", "calls", False), (6, None, "b", "calls", True)]
    g = Graph(nodes, spark.createDataFrame(edges, "id long, source string, target string, kind string, resolved boolean"), None)
    got = {r["package"]: r.asDict() for r in package_report.report(g).collect()}
    assert got["p"]["top_degree"] == 3 and got["q"]["top_degree"] == 4
    assert (got["p"]["out_edges"], got["q"]["in_edges"], got["q"]["dependents"], got["q"]["tests"], got["p"]["tests"]) == (2, 2, 1, 1, 0)
