"""Ranked symbol search: a phrase and prefix index with BM25, and a substring search where that finds nothing.

With a persisted index (`sources.textindex`) only the postings of the query's terms are read; without one, all texts.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scores import expanded_limit, importance, match_score, name_tier
from ..functions.text import phrases, tokens
from ..plans.graph import Graph, cut, with_degrees
from ..sources.textindex import TextIndex, head

#: Weight of each indexed column, and BM25's parameters.
WEIGHTS = {"id": 0.0, "name": 20.0, "qualified_name": 5.0, "docstring": 1.0, "signature": 2.0}
K1, B = 1.2, 0.75
LEAST_IDF = 1e-6


def index(nodes: DataFrame) -> DataFrame:
    """Nodes with a token array for each indexed column and the number of all their tokens."""
    cols = {f"t_{c}": tokens(F.col(c)) for c in WEIGHTS}
    made = nodes.withColumns(cols)
    return made.withColumn("length", sum((F.size(c) for c in cols), F.lit(0)).cast("long"))


def occurrences(col: str, phrase: list[str]):
    """How often a phrase stands in a token array; its last token is a prefix.

    An array expression in place of postings: rows are scanned once for all phrases, and nothing is shuffled.
    No lambda refers to anything outside, since the tokens would be made anew for each of them.
    """
    arr, last = F.col(col), len(phrase) - 1
    if not last:
        return F.size(F.filter(arr, lambda t: t.startswith(phrase[0])))
    hit = F.transform(arr, lambda t: t == phrase[0])
    for k in range(1, last + 1):
        same = (lambda t: t == phrase[k]) if k < last else (lambda t: t.startswith(phrase[k]))
        hit = F.zip_with(hit, F.slice(arr, k + 1, 1 << 30), lambda a, t: a & same(t))
    return F.size(F.filter(hit, lambda a: F.coalesce(a, F.lit(False))))


def _numbered(queries: list[str]) -> tuple[list[list[str]], dict[int, list[int]]]:
    """(distinct phrases, the phrases of each query by number)."""
    distinct: dict[tuple, int] = {}
    of = {q: [distinct.setdefault(tuple(p), len(distinct)) for p in phrases(query)] for q, query in enumerate(queries)}
    return [list(p) for p in distinct], of


def bm25_each(nodes: DataFrame, queries: list[str]) -> DataFrame:
    """Nodes that match a query, with its number (column query) and their score; one row for each such pair.

    Two passes over the nodes for all queries together, one for the corpus' counts and one for scores.  The counts
    (documents, mean length, documents per phrase) are one row, joined as scalar subqueries.
    """
    found, of = _numbered(queries)
    idx = index(nodes)
    per = {f"p{i}_{c}": occurrences(f"t_{c}", p) for i, p in enumerate(found) for c in WEIGHTS}
    df = idx.withColumns(per)
    there = [reduce(lambda a, b: a | b, [F.col(f"p{i}_{c}") > 0 for c in WEIGHTS]) for i in range(len(found))]
    stats = df.agg(F.count("*").alias("n"), F.avg("length").alias("avg"), *[F.count_if(t).alias(f"df{i}") for i, t in enumerate(there)])
    n, avg = stats.select("n").scalar(), stats.select("avg").scalar()
    part = []
    for i in range(len(found)):
        docs = stats.select(f"df{i}").scalar()
        idf = F.log((n - docs + 0.5) / (docs + 0.5))
        idf = F.when(idf <= 0, F.lit(LEAST_IDF)).otherwise(idf)
        f = sum((F.col(f"p{i}_{c}") * w for c, w in WEIGHTS.items()), F.lit(0.0))
        part.append(idf * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("length") / avg)))
    hit = [F.when(reduce(lambda a, b: a | b, [there[i] for i in ps]), F.struct(F.lit(q).alias("query"), sum((part[i] for i in ps), F.lit(0.0)).alias("score"))) for q, ps in of.items() if ps]
    if not hit:
        return nodes.withColumns({"query": F.lit(0), "score": F.lit(0.0)}).where("false")
    hits = df.withColumn("hit", F.explode(F.array_compact(F.array(*hit))))
    return hits.withColumns({"query": F.col("hit.query"), "score": F.col("hit.score")}).drop("hit", *per, *[f"t_{c}" for c in WEIGHTS], "length")


def bm25(nodes: DataFrame, query: str) -> DataFrame:
    """Matching nodes with their score."""
    return bm25_each(nodes, [query]).drop("query")


#: Above all characters that a term can hold, in the order of UTF-8.
_TOP = "\U0010ffff"


def term_filter(found: list[list[str]]):
    """Postings of the phrases' terms: folders and ranges of the term that reach the scan."""
    wanted = F.lit(False)
    for p in found:
        for t in p[:-1]:
            wanted = wanted | (F.col("term") == t)
        wanted = wanted | ((F.col("term") >= p[-1]) & (F.col("term") < p[-1] + _TOP))
    # A token begins with a letter or a digit, so its folder is known even where it is a prefix.
    folders = {t[0] if t[0].isascii() else "_" for p in found for t in p}
    return F.col("head").isin(*sorted(folders)) & wanted


def phrase_counts(postings: DataFrame, phrase: list[str], number: int) -> DataFrame:
    """(id, field, length, phrase, f): how often a phrase stands in a field, from its terms' postings.

    The last token is a prefix, so several terms may fill its place.  Places of token k are moved back by k and met with
    those of the token before: joins of the documents that hold them.
    """
    last, key = len(phrase) - 1, ["id", "field", "length"]
    prefix = postings.where((F.col("term") >= phrase[-1]) & (F.col("term") < phrase[-1] + _TOP))
    if not last:
        return prefix.groupBy(*key).agg(F.sum("n").cast("long").alias("f")).withColumn("phrase", F.lit(number))
    back = lambda col, k: F.transform(col, lambda x: x - k)
    at = prefix.groupBy(*key).agg(F.flatten(F.collect_list(back("positions", last))).alias("at"))
    for k in range(last):
        at = at.join(postings.where(F.col("term") == phrase[k]).select(*key, back("positions", k).alias("here")), key).select(*key, F.array_intersect("at", "here").alias("at"))
    return at.select(*key, F.size("at").cast("long").alias("f"), F.lit(number).alias("phrase")).where("f > 0")


def bm25_index_each(spark: SparkSession, index: TextIndex, queries: list[str], weights: dict[str, float] = WEIGHTS) -> DataFrame:
    """(query, id, score) of what bm25_each() finds, from a persisted index: the postings of the queries' terms, dead rows
    and statistics."""
    found, of = _numbered(queries)
    if not found:
        return spark.createDataFrame([], "query int, id string, score double")
    postings = index.live_postings(spark, term_filter(found)).where(F.col("field").isin(*weights))
    counts = reduce(DataFrame.unionByName, [phrase_counts(postings, p, i) for i, p in enumerate(found)])
    first, *more = weights.items()
    weight = reduce(lambda a, cw: a.when(F.col("field") == cw[0], F.lit(float(cw[1]))), more, F.when(F.col("field") == first[0], F.lit(float(first[1]))))
    per = counts.groupBy("id", "length", "phrase").agg(F.sum(F.col("f") * weight).alias("f"))
    # One row a phrase, which the queries' words bound.
    docs = per.groupBy("phrase").agg(F.count("*").alias("docs"))
    stats = index.stats(spark)
    n, avg = stats.select("n").scalar(), stats.select("avg").scalar()
    idf = F.log((n - F.col("docs") + 0.5) / (F.col("docs") + 0.5))
    asks = F.create_map(*[x for i in range(len(found)) for x in (F.lit(i), F.array(*[F.lit(q) for q, ps in of.items() for p in ps if p == i]))])
    per = per.join(F.broadcast(docs), "phrase").withColumn("idf", F.when(idf <= 0, F.lit(LEAST_IDF)).otherwise(idf))
    score = F.col("idf") * F.col("f") * (K1 + 1) / (F.col("f") + K1 * (1 - B + B * F.col("length") / avg))
    return per.select("id", score.alias("part"), F.explode(asks[F.col("phrase")]).alias("query")).groupBy("query", "id").agg(F.sum("part").alias("score"))


def bm25_index(spark: SparkSession, index: TextIndex, query: str, weights: dict[str, float] = WEIGHTS) -> DataFrame:
    """(id, score) for one query."""
    return bm25_index_each(spark, index, [query], weights).drop("query")


def like_each(nodes: DataFrame, queries: list[str]) -> DataFrame:
    """Nodes that hold a query in name, qualified name, docstring or signature, with its number and no score; % and _ of a
    query are wild.  One scan for all queries."""
    cond = lambda q: reduce(lambda a, b: a | b, [F.coalesce(F.col(c).ilike(f"%{q}%"), F.lit(False)) for c in ("name", "qualified_name", "docstring", "signature")])
    hits = nodes.withColumn("query", F.explode(F.array_compact(F.array(*[F.when(cond(q), F.lit(i)) for i, q in enumerate(queries)]))))
    return hits.withColumn("score", F.lit(None).cast("double"))


def ranked_each(graph: Graph, hits: DataFrame, queries: list[str], limit: int, order: str = "compat") -> DataFrame:
    """ranked() for the hits of many queries at once: (query, pos, node columns), pos from 1.

    Candidates and results are cut by a rank within each query, which Spark also applies before the shuffle; there are at
    most 200 candidates a query, so the degrees of no others are counted.
    """
    text = F.element_at(F.array(*[F.lit(q) for q in queries]), F.col("query") + 1)
    by = F.col("score") if order == "compat" else F.desc("score")
    hits = hits.withColumn("asked", text)
    tiered = hits.withColumn("tier", name_tier(F.col("asked")))
    best = F.row_number().over(Window.partitionBy("query").orderBy("tier", by, "name", "id"))
    some = cut(tiered.withColumn("k", best).where(F.col("k") <= expanded_limit(limit)).drop("k"))
    full = with_degrees(some, graph.edges_at(r["id"] for r in some.select("id").distinct().collect()), few=True)
    full = full.withColumn("rank", F.coalesce("score", F.lit(0.0)) + match_score(F.col("asked")) + importance())
    pos = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("rank"), "name", "tier", by, "id"))
    return full.withColumn("pos", pos).where(F.col("pos") <= limit).drop("asked")


def search_each(graph: Graph, queries: list[str], limit: int = 20, order: str = "compat") -> DataFrame:
    """The text search for many queries in one plan, with the substring search for those that it finds nothing for."""
    text = bm25_each(graph.nodes, queries) if graph.text is None else graph.nodes.join(bm25_index_each(graph.nodes.sparkSession, graph.text, queries), "id")
    names = [*graph.nodes.columns, "query", "score"]
    text = text.select(*names)
    like = like_each(graph.nodes, queries).select(*names).join(text.select("query").distinct(), "query", "left_anti").select(*names)
    return ranked_each(graph, text.unionByName(like), queries, limit, order)


def ranked(graph: Graph, hits: DataFrame, query: str, limit: int, order: str = "compat") -> DataFrame:
    """Candidates cut to the expanded limit, ranked by score, match, kind and importance.

    order: 'compat' keeps the weakest scores inside a tier at the cut, 'best_first' the strongest.

    The candidates, 200 at most, are fetched and sent to the edges, of which none but theirs are counted, or made where the
    graph can spare that.
    """
    by = F.col("score") if order == "compat" else F.desc("score")
    some = hits.withColumn("tier", name_tier(query)).orderBy("tier", by, "name", "id").limit(expanded_limit(limit))
    rows = some.collect()
    some = some.sparkSession.createDataFrame(rows, some.schema)
    full = with_degrees(some, graph.edges_at(r["id"] for r in rows), few=True)
    rank = F.coalesce("score", F.lit(0.0)) + match_score(query) + importance()
    return full.withColumn("rank", rank).orderBy(F.desc("rank"), "name", "tier", by, "id").limit(limit)


def search_text(graph: Graph, query: str, kind: str = "", limit: int = 20, order: str = "compat") -> DataFrame:
    """With the graph's text index if it has one: then nodes are only looked up by id."""
    hits = bm25(graph.nodes, query) if graph.text is None else graph.nodes.join(bm25_index(graph.nodes.sparkSession, graph.text, query), "id")
    return ranked(graph, hits.where(F.col("kind") == kind) if kind else hits, query, limit, order)


def search_like(graph: Graph, query: str, kind: str = "", limit: int = 20) -> DataFrame:
    """Substring hits in name, qualified name, docstring and signature; % and _ of the query are wild."""
    hits = like_each(graph.nodes, [query]).drop("query")
    return ranked(graph, hits.where(F.col("kind") == kind) if kind else hits, query, limit)


def search(graph: Graph, query: str, kind: str = "", limit: int = 20, order: str = "compat") -> list:
    """Rows of the text search, or of the substring search if it finds none."""
    limit = limit if limit > 0 else 20
    rows = search_text(graph, query, kind, limit, order).collect() if phrases(query) else []
    return rows or search_like(graph, query, kind, limit).collect()
