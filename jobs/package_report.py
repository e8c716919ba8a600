"""Writes a report of every package of a graph: its size, who depends on it, what it depends on, what tests it.

    python -m jobs.package_report [--config FILE] [--tables PATH] [--out PATH] [--roots A,B]

Reads the tables of the star schema as a graph (`symgraph.sources.star`) and writes Parquet partitioned by `root`, the
first folder of a package's path.  Without `roots` the whole report is replaced.  With `roots` only the packages of these
are made and only their partitions overwritten: what a nightly run does for the parts of a tree that changed.  Either way
a second run writes the same rows in the same place.

Edges go once from their sources to their targets, files in place of symbols; all counts of packages come from the sums by
pairs of files that this gives.
"""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from symgraph.functions.paths import package_path
from symgraph.operators import impact
from symgraph.plans.graph import Graph, with_degrees
from symgraph.schemas import IMPACT_KINDS
from symgraph.sources import star

from .common import settings, start

NAME = "package_report"
SCHEMA = (
    "package string, files long, symbols long, exported long, internal_edges long, in_edges long, out_edges long, dependents long, dependencies long, tests long, "
    "top_symbol string, top_degree long, root string"
)
log = logging.getLogger(f"jobs.{NAME}")


def root_of(package):
    return F.split_part(package, F.lit("/"), F.lit(1))


def between_files(graph: Graph, tasks: int | None = None, seen: Observation | None = None) -> DataFrame:
    """(source_file, target_file, carries, n): resolved edges by the files of their ends, null for an end that is no node,
    and by whether they carry impact.

    tasks: how many look targets up.  seen: gets the number of edges, resolved or not, as `edges`.
    """
    edges = graph.edges.select("source", "target", F.col("kind").isin(*IMPACT_KINDS).alias("carries"), "resolved")
    edges = (edges if seen is None else edges.observe(seen, F.count(F.lit(1)).alias("edges"))).where("resolved")
    of = lambda end: graph.nodes.select(F.col("id").alias(end), F.col("file_path").alias(f"{end}_file"))
    # Outer joins: edges go through them as the degrees read them, so both use the same shuffle.
    found = edges.join(of("source"), "source", "left").select("target", "source_file", "carries")
    found = (found.repartition(tasks, "target") if tasks else found).join(of("target"), "target", "left")
    return found.groupBy("source_file", "target_file", "carries").agg(F.count("*").alias("n"))


def report(graph: Graph, roots: list[str] | None = None, tasks: int | None = None, seen: Observation | None = None) -> DataFrame:
    """One row a package, of the given roots or of all."""
    mine = (lambda df: df.where(root_of(F.col("package")).isin(*roots))) if roots else (lambda df: df)
    package = package_path(F.col("file_path"))
    nodes = graph.nodes.select("id", "qualified_name", "file_path", "start_line", F.col("is_exported").alias("exported"), package.alias("package"))
    own = with_degrees(mine(nodes).drop("package"), graph.edges).withColumn("package", package)
    first = F.struct(-F.col("degree"), ~F.col("exported"), "file_path", "start_line", "id")
    size = own.groupBy("package").agg(
        F.count("*").alias("symbols"), F.count_if("exported").alias("exported"), F.min_by("qualified_name", first).alias("top_symbol"), F.max("degree").alias("top_degree"),
    )
    files = mine(nodes).select("package", "file_path").distinct().groupBy("package").agg(F.count("*").alias("files"))
    # Each pair of files is seen from both packages; test files are those with an edge that carries impact into the package.
    source, target = package_path(F.col("source_file")), package_path(F.col("target_file"))
    side = lambda into, this, other: F.struct(F.lit(into).alias("into"), this.alias("package"), other.alias("other"))
    both = F.col("source_file").isNotNull() & F.col("target_file").isNotNull()
    test = F.when(F.col("carries") & impact.is_test(F.col("source_file")), F.col("source_file"))
    pairs = between_files(graph, tasks, seen).select("n", both.alias("both"), test.alias("test"), F.explode(F.array(side(True, target, source), side(False, source, target))).alias("x")).select("n", "both", "test", "x.*")
    apart, into = F.col("package") != F.col("other"), F.col("both") & F.col("into")
    out_of = F.col("both") & ~F.col("into")
    met = mine(pairs).groupBy("package").agg(
        F.sum(F.when(into & ~apart, F.col("n"))).alias("internal_edges"), F.sum(F.when(into & apart, F.col("n"))).alias("in_edges"), F.count_distinct(F.when(into & apart, F.col("other"))).alias("dependents"),
        F.sum(F.when(out_of & apart, F.col("n"))).alias("out_edges"), F.count_distinct(F.when(out_of & apart, F.col("other"))).alias("dependencies"), F.count_distinct(F.when(into, F.col("test"))).alias("tests"),
    )
    out = size.join(files, "package").join(met, "package", "left").fillna(0).withColumn("root", root_of(F.col("package")))
    return out.select(*[c.split(" ")[0] for c in SCHEMA.split(", ")])


#: Nodes to a task that looks their edges up.
A_TASK = 100_000


def run(spark: SparkSession, tables: str, out: str, roots: str = "") -> dict:
    """Writes the report to `out`; roots: names parted by commas, empty for all."""
    graph, some = star.graph(spark, tables), [r for r in roots.split(",") if r]
    nodes, seen = graph.nodes.count(), Observation()
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), nodes // A_TASK)
    rows = report(graph, some, tasks, seen).repartition("root")
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic" if some else "static").partitionBy("root").parquet(out)
    counts = {"nodes_read": nodes, "edges_read": seen.get["edges"]}
    log.info("read %s: %s", tables, counts)
    wrote = read_back(spark, out)
    counts["packages_written"] = (wrote.where(F.col("root").isin(*some)) if some else wrote).count()
    log.info("wrote %d packages of %s to %s", counts["packages_written"], roots or "all roots", out)
    return counts


def read_back(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.schema(SCHEMA).parquet(out)


def main(argv: list[str] | None = None) -> None:
    values = settings(NAME, "Report on packages.", argv, tables=str, out=str, roots=str)
    spark = start(NAME)
    try:
        print(run(spark, **values))
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
