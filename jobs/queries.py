"""The jobs as queries: each runs twice into one new folder of the shared one and gives its whole output."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from symgraph.functions.text import FOLD_FROM, FOLD_TO
from symgraph.plans.graph import shared_folder
from symgraph.queries import _EDGES, _NODES, _PACKAGE

from . import index_documents, package_report


def job1_index_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_folder(spark)}/job1-{uuid.uuid4().hex}"
    for _ in range(2):
        index_documents.run(spark, f"{sf_dir}/documents.parquet", f"{folder}/index", f"{folder}/checkpoint")
    return index_documents.read_back(spark, f"{folder}/index")


def job2_package_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = f"{shared_folder(spark)}/job2-{uuid.uuid4().hex}/packages"
    for _ in range(2):
        package_report.run(spark, sf_dir, out)
    return package_report.read_back(spark, out)


QUERIES = {f.__name__: f for f in (job1_index_documents, job2_package_report)}

ORACLE_SQL = {
    "job1_index_documents": f"""
WITH words AS (
  SELECT coalesce(source, '') || '/' || doc_id || '.txt' AS path, regexp_extract_all(translate(lower(coalesce(text, '')), '{FOLD_FROM}', '{FOLD_TO}'), '[\\p{{L}}\\p{{N}}]+') AS w FROM documents
),
each AS (SELECT path, unnest(w) AS term, unnest(range(len(w))) AS i FROM words),
terms AS (SELECT path, term, count(*) AS n, min(i) AS first FROM each GROUP BY path, term)
SELECT path, len(w)::BIGINT AS length, term, n::BIGINT AS n, first::BIGINT AS first FROM words LEFT JOIN terms USING (path)""",
    "job2_package_report": f"""
WITH {_NODES}, {_EDGES},
own AS (SELECT *, {_PACKAGE.format("file_path")} AS package FROM nodes),
degree AS (SELECT id, count(*) AS degree FROM (SELECT source AS id FROM edges UNION ALL SELECT target FROM edges) GROUP BY id),
ranked AS (SELECT own.*, coalesce(degree, 0)::BIGINT AS degree FROM own LEFT JOIN degree USING (id)),
size AS (
  SELECT package, count(DISTINCT file_path) AS files, count(*) AS symbols, count(*) FILTER (is_exported) AS exported, arg_min(qualified_name, (-degree, NOT is_exported, file_path, start_line, id)) AS top_symbol, max(degree) AS top_degree
  FROM ranked GROUP BY package
),
ends AS (
  SELECT e.kind, s.package AS source, t.package AS target, regexp_matches(s.file_path, '\\.test\\.|\\.spec\\.|/tests/|/test/|__tests__/|_test\\.go$') AS is_test, s.file_path AS test FROM edges e JOIN own s ON s.id = e.source JOIN own t ON t.id = e.target
),
inside AS (SELECT source AS package, count(*) AS internal_edges FROM ends WHERE source = target GROUP BY 1),
incoming AS (SELECT target AS package, count(*) AS in_edges, count(DISTINCT source) AS dependents FROM ends WHERE source <> target GROUP BY 1),
outgoing AS (SELECT source AS package, count(*) AS out_edges, count(DISTINCT target) AS dependencies FROM ends WHERE source <> target GROUP BY 1),
tests AS (SELECT target AS package, count(DISTINCT test) AS tests FROM ends WHERE is_test AND kind IN ('calls', 'references', 'imports') GROUP BY 1)
SELECT package, files, symbols, exported, coalesce(internal_edges, 0) AS internal_edges, coalesce(in_edges, 0) AS in_edges, coalesce(out_edges, 0) AS out_edges, coalesce(dependents, 0) AS dependents,
  coalesce(dependencies, 0) AS dependencies, coalesce(tests, 0) AS tests, top_symbol, top_degree, split_part(package, '/', 1) AS root
FROM size LEFT JOIN inside USING (package) LEFT JOIN incoming USING (package) LEFT JOIN outgoing USING (package) LEFT JOIN tests USING (package)""",
}
