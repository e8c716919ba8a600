"""The queries of the training-data operators, over the driver's tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import bpe, codes, ctw, decontaminate, line_dedup, lines, pairs, pii, quality, repeats, secrets, simhash
from .common import table


def op1_context_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ctw.score(table(spark, sf_dir, "documents"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup(table(spark, sf_dir, "documents"))


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.cluster(table(spark, sf_dir, "documents"))


def op5_line_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return lines.rules(docs, lines.fit(docs, table(spark, sf_dir, "labels")))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(table(spark, sf_dir, "documents"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"))


def op10_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.dedup(table(spark, sf_dir, "documents"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes.encode(table(spark, sf_dir, "embeddings"))


def op12_pair_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs.round_trip(table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_context_tree, op2_line_dedup, op3_byte_bpe, op4_simhash, op5_line_crf, op6_decontaminate, op7_pii, op8_quality, op9_secret_scan, op10_repeats, op11_vector_codes, op12_pair_bpe,
    )
}

_SPACE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

#: One round: each part's nearest entry (the lower of equally near ones), then entries as floors of means.
_CODE_ROUND = """
a{r} AS MATERIALIZED (SELECT vec_id, q, arg_min(e, (list_dot_product(c, c) - 2 * list_dot_product(p, c), e)) AS e FROM parts JOIN b{r} USING (q) GROUP BY vec_id, q),
s{r} AS (SELECT q, e, i, sum(x::BIGINT)::BIGINT AS s, count(*) AS n FROM (SELECT q, e, unnest(p) AS x, unnest(range(len(p))) AS i FROM a{r} JOIN parts USING (vec_id, q)) GROUP BY q, e, i),
m{r} AS (SELECT q, e, list(((s - (s % n + n) % n) // n)::DOUBLE ORDER BY i) AS c FROM s{r} GROUP BY q, e),
b{t} AS MATERIALIZED (SELECT b.q, b.e, coalesce(m.c, b.c) AS c FROM b{r} b LEFT JOIN m{r} m USING (q, e))"""

ORACLE_SQL: dict[str, str] = {
    "op2_line_dedup": f"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents
),
used AS (
  SELECT doc_id, i, trim(line, {_SPACE}) AS t, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS p FROM lines WHERE trim(line, {_SPACE}) <> ''
),
windows AS (
  SELECT a.doc_id, a.p, [a.i, b.i, c.i] AS covered, row_number() OVER (PARTITION BY a.t, b.t, c.t ORDER BY a.doc_id, a.p) AS nth
  FROM used a JOIN used b ON b.doc_id = a.doc_id AND b.p = a.p + 1 JOIN used c ON c.doc_id = a.doc_id AND c.p = a.p + 2
),
gone AS (SELECT DISTINCT doc_id, unnest(covered) AS i FROM windows WHERE nth > 1),
kept AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY i) AS t FROM lines ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id),
removed AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT d.doc_id, CASE WHEN coalesce(text, '') = '' THEN 0 ELSE len(string_split(text, chr(10))) END::BIGINT AS n_lines, coalesce(r.n, 0)::BIGINT AS n_removed, sha256(coalesce(k.t, '')) AS kept_sha256
FROM documents d LEFT JOIN kept k USING (doc_id) LEFT JOIN removed r USING (doc_id)""",
    "op6_decontaminate": r"""
WITH low AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
items AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
sized AS (SELECT item_id, w, least(len(w), 10) AS n FROM items WHERE len(w) > 0),
wanted AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS k FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM sized)),
places AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM low, (SELECT DISTINCT n FROM wanted) WHERE len(w) >= n),
hits AS (SELECT doc_id, item_id, i, p.n FROM places p JOIN wanted q ON q.n = p.n AND q.k = array_to_string(p.w[p.i:p.i + p.n - 1], ' ')),
words AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest(range(i, i + n)) AS j FROM hits) GROUP BY doc_id),
found AS (SELECT doc_id, count(*) AS n, string_agg(x, ',' ORDER BY x) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS x FROM hits) GROUP BY doc_id)
SELECT l.doc_id, len(l.w)::BIGINT AS n_words, coalesce(words.n, 0)::BIGINT AS n_hit, coalesce(found.n, 0)::BIGINT AS n_items, sha256(coalesce(found.ids, '')) AS items_sha256, coalesce(words.n, 0) > 0 AS contaminated
FROM low l LEFT JOIN words USING (doc_id) LEFT JOIN found USING (doc_id)""",
    "op11_vector_codes": f"""
WITH v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS p FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
),
parts AS MATERIALIZED (SELECT vec_id, q, p[q * (len(p) // 4) + 1:(q + 1) * (len(p) // 4)] AS p FROM v, (SELECT unnest(range({codes.PARTS})) AS q)),
b0 AS MATERIALIZED (
  SELECT q, row_number() OVER (PARTITION BY q ORDER BY vec_id) - 1 AS e, p AS c FROM parts JOIN (SELECT vec_id FROM v ORDER BY vec_id LIMIT {codes.ENTRIES}) USING (vec_id)
),{",".join(_CODE_ROUND.format(r=r, t=r + 1) for r in range(codes.ROUNDS))},
a AS MATERIALIZED (
  SELECT vec_id, q, (arg_min(e, (d, e)))::BIGINT AS e, min(d)::BIGINT AS d
  FROM (SELECT vec_id, q, e, list_dot_product(p, p) + list_dot_product(c, c) - 2 * list_dot_product(p, c) AS d FROM parts JOIN b{codes.ROUNDS} USING (q)) GROUP BY vec_id, q
),
coded AS (SELECT vec_id, string_agg(printf('%02x', e), '' ORDER BY q) AS code, sum(d)::BIGINT AS error FROM a GROUP BY vec_id)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
  (SELECT sha256(string_agg(x::BIGINT::VARCHAR, ',' ORDER BY q, e, i)) FROM (SELECT q, e, unnest(c) AS x, unnest(range(len(c))) AS i FROM b{codes.ROUNDS})) AS codebooks_sha256
FROM coded JOIN v USING (vec_id)""",
}
