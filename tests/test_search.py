"""The text search over whole tables, against brute force."""

import math
import re

import pytest

from symgraph import queries
from symgraph.functions.text import fold
from symgraph.sources import star

SF = "/root/testdata/sf0.001"
COLUMNS = {"id": 0.0, "name": 20.0, "qualified_name": 5.0, "docstring": 1.0, "signature": 2.0}


def brute_bm25(rows, phrases):
    """Scores by place; rows: dicts of the indexed columns."""
    words = [{c: re.findall(r"[^\W_]+", fold(r[c] or "")) for c in COLUMNS} for r in rows]
    length = [sum(map(len, w.values())) for w in words]

    def hits(w, p):
        return sum(w[i : i + len(p) - 1] == p[:-1] and w[i + len(p) - 1].startswith(p[-1]) for i in range(len(w) - len(p) + 1))

    score, mean = {}, sum(length) / len(rows)
    for p in phrases:
        found = [{c: hits(w[c], p) for c in COLUMNS} for w in words]
        df = sum(any(f.values()) for f in found)
        idf = math.log((len(rows) - df + 0.5) / (df + 0.5))
        idf = idf if idf > 0 else 1e-6
        for k, f in enumerate(found):
            if any(f.values()):
                x = sum(f[c] * w for c, w in COLUMNS.items())
                score[k] = score.get(k, 0.0) + idf * x * 2.2 / (x + 1.2 * (0.25 + 0.75 * length[k] / mean))
    return score


def test_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    rows = [{"id": str(d["doc_id"]), "name": d["source"], "qualified_name": f"{d['source']}.{d['lang']}", "docstring": d["text"], "signature": d["lang"]} for d in docs]
    want = {docs[k]["doc_id"]: s for k, s in brute_bm25(rows, [["src1"], ["en"], ["ther"], ["of", "th"]]).items()}
    got = {r["doc_id"]: r["score"] for r in queries.QUERIES["search_bm25_documents"](spark, SF).collect()}
    assert len(got) > 100 and got == pytest.approx(want, abs=1e-6)


def test_ranked(spark):
    nodes = star.nodes(spark, SF).collect()
    into, out = {}, {}
    for e in star.edges(spark, SF).collect():
        out[e["source"]] = out.get(e["source"], 0) + 1
        into[e["target"]] = into.get(e["target"], 0) + 1
    score = brute_bm25([r.asDict() for r in nodes], [["wid"]])
    tier = lambda n: 0 if n["name"] == "wid" else 1 if n["name"].lower().startswith("wid") else 2
    some = sorted(((tier(nodes[k]), s, nodes[k]["name"], nodes[k]["id"], nodes[k]) for k, s in score.items()), key=lambda x: (x[0], round(x[1], 9), *x[2:4]))[:200]

    def rank(s, n):
        name, i, o = n["name"].lower(), into.get(n["id"], 0), out.get(n["id"], 0)
        match = 100 if name == "wid" else 70 if name.startswith("wid") else 40 if "wid" in name else 20 if "wid" in n["qualified_name"].lower() else 0
        kind = 10 if n["kind"] in ("function", "method", "class") else 8 if n["kind"] in ("struct", "interface") else 0
        own = min(i + o, 40) * 1.5 + min(i, 20) + min(o, 20) * 0.5 + 6 * n["is_exported"] - 12 * n["file_path"].endswith("_test.go")
        return s + match + kind + own

    full = sorted(((rank(x[1], x[4]), *x[:4]) for x in some), key=lambda x: (-round(x[0], 9), x[3], x[1], round(x[2], 9), x[4]))[:40]
    got = [tuple(r) for r in queries.QUERIES["search_text"](spark, SF).select("id", "score", "rank").collect()]
    assert len(got) > 20 and [r[0] for r in got] == [x[4] for x in full]
    assert [r[1:] for r in got] == [pytest.approx((x[2], x[0]), abs=1e-6) for x in full]


def test_postings_are_grouped_where_the_tokens_are(spark):
    """Repeats, empty and null texts and two fields, in slices of a few tokens: as counted by hand, without a shuffle."""
    import re
    from collections import defaultdict

    from symgraph.sources import textindex

    rows = [("a", "x y x", "z"), ("b", None, "x"), ("c", "", ""), ("d", "y " * 50, None), ("e", "Éa q.y", "y y")]
    docs = spark.createDataFrame(rows, "id string, text string, more string").coalesce(1)
    want = defaultdict(list)
    for i, *texts in rows:
        for field, t in zip(("text", "more"), texts):
            for k, term in enumerate(re.findall(r"\w+", (t or "").lower().replace("é", "e"))):
                want[term, i, field].append(k)
    size = textindex._AT_ONCE
    try:
        for textindex._AT_ONCE in (3, size):
            made = textindex.postings(docs, ["text", "more"])
            assert {(r["term"], r["id"], r["field"]): r["positions"] for r in made.collect()} == want
            plan = made._jdf.queryExecution().executedPlan().toString()
            assert "Exchange" not in plan and "Aggregate" not in plan
    finally:
        textindex._AT_ONCE = size


def test_a_run_makes_its_postings_once_and_spreads_them_evenly(spark, tmp_path, monkeypatch):
    """No pass over the texts but one for the postings; tasks follow the tokens, also for a term that all texts hold."""
    import glob

    from pyspark.sql import functions as F

    from symgraph.sources import textindex

    made, plain = spark.sparkContext.accumulator(0), textindex.postings
    seen = F.udf(lambda x: (made.add(1), x)[1], "string").asNondeterministic()
    monkeypatch.setattr(textindex, "postings", lambda docs, fields: plain(docs, fields).withColumn("term", seen("term")))
    monkeypatch.setattr(textindex, "_A_TASK", 500)
    monkeypatch.setattr(textindex, "_SAMPLE", 1000, raising=False)
    docs = spark.range(2000).selectExpr("string(id) as id", "concat('the the ', if(id % 50 = 0, 'é1 ', ''), if(id % 4 = 0, concat('z', id), '')) as text")
    index = textindex.TextIndex(f"file://{tmp_path}/even")
    index.put(spark, 1, docs, ["text"])
    rows = index.table(spark, "postings", textindex.POSTINGS)
    assert made.value == rows.count() == 2000 + 40 + 500
    sizes = [r["count"] for r in rows.where("term = 'the'").groupBy(F.input_file_name()).count().collect()]
    assert len(sizes) >= 5 and max(sizes) < 600  # 4540 tokens are nine tasks
    for f in glob.glob(f"{tmp_path}/even/postings/run=1/head=*/*.parquet"):
        of = [(r["term"], r["id"]) for r in spark.read.parquet(f).collect()]
        assert of == sorted(of)


def test_candidates_edges_alone_are_made(spark):
    """Edges at some ids are those of the whole graph at them, and other rows don't leave the scan."""
    ids = ["order:5", "customer:7", "part:3", "supplier:2", "nation:4", "region:1", "part:x", "strange", "order:-1"]
    at = star.edges(spark, SF, ids)
    want = star.edges(spark, SF).where(" or ".join(f"{end} in ({', '.join(map(repr, ids))})" for end in ("source", "target")))
    assert sorted(map(str, at.collect())) == sorted(map(str, want.collect())) != []
    assert star.edges(spark, SF, []).count() == 0
    assert "l_orderkey#" in (plan := at._jdf.queryExecution().executedPlan().toString()) and plan.count("PushedFilters: [Or(") >= 4
