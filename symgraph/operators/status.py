"""Counts of a graph, staleness, and the difference between two states of its files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.paths import glob_filter
from ..plans.graph import Graph


def counts(graph: Graph) -> DataFrame:
    """One row: files, nodes, edges, resolved and unresolved edges."""
    e = graph.edges.agg(F.count("*").alias("edges"), F.count_if("resolved").alias("resolved_edges"), F.count_if(~F.col("resolved")).alias("unresolved_edges"))
    n, f = graph.nodes.agg(F.count("*").alias("nodes")), graph.files.agg(F.count("*").alias("files"))
    return f.withColumns({"nodes": n.scalar(), "edges": e.select("edges").scalar(), "resolved_edges": e.select("resolved_edges").scalar(), "unresolved_edges": e.select("unresolved_edges").scalar()})


def group_counts(df: DataFrame, by: str) -> DataFrame:
    return df.groupBy(by).agg(F.count("*").alias("n"))


def counts_map(df: DataFrame, by: str) -> DataFrame:
    """One row with a map of counts; the number of groups is that of kinds or languages."""
    return group_counts(df, by).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(by, "n")))).alias(f"by_{by}"))


def latest(files: DataFrame, path: str, mtime: str) -> DataFrame:
    """One row: the largest time and the first path (in order) that has it."""
    best = F.max(F.struct(F.col(mtime).alias("t")))
    top = files.agg(best.alias("m"))
    return files.join(F.broadcast(top), F.col(mtime) == F.col("m.t")).agg(F.max(mtime).alias("latest_source_mtime"), F.min(path).alias("latest_source_file"))


def staleness(files: DataFrame, last_indexed, path: str = "path", mtime: str = "modified_at") -> DataFrame:
    """latest() and whether it is after last_indexed, with the reason."""
    stale = F.coalesce(F.col("latest_source_mtime") > F.lit(last_indexed), F.lit(False))
    return latest(files, path, mtime).withColumns({"is_stale": stale, "reason": F.when(stale, "source file modified after last_indexed")})


def staleness_each(projects: DataFrame, files: DataFrame) -> DataFrame:
    """(project, is_stale, reason, latest_source_mtime, latest_source_file) of many projects at once.

    projects: (project, last_indexed as text or null, failure: why its files couldn't be listed, or null); files: (project,
    path, modified_at in the unit of last_indexed).  The reasons in the order in which they are looked for: no run yet, a
    time that is no number, files that can't be listed, a file that is newer.  The latest file is the first path that has the
    largest time; partial maxima are taken before the shuffle, so a project of very many files is no hot key.
    """
    first = F.min_by(F.struct("modified_at", "path"), F.struct(-F.col("modified_at"), "path"))
    latest_of = files.groupBy("project").agg(first.alias("f"))
    j = projects.join(latest_of, "project", "left")
    number = F.when(F.col("last_indexed").rlike(r"^-?\d{1,18}$"), F.col("last_indexed")).cast("long")
    reason = (
        F.when(F.coalesce("last_indexed", F.lit("")) == "", "never_indexed")
        .when(number.isNull(), "invalid_last_indexed")
        .when(F.col("failure").isNotNull(), F.concat(F.lit("staleness_check_failed: "), "failure"))
        .when(F.col("f.modified_at") > number, "source file modified after last_indexed")
    )
    known = number.isNotNull() & F.col("failure").isNull()
    return j.select("project", reason.isNotNull().alias("is_stale"), reason.alias("reason"), F.when(known, F.col("f.modified_at")).alias("latest_source_mtime"), F.when(known, F.col("f.path")).alias("latest_source_file"))


def matching_files(files: DataFrame, globs: list[str]) -> DataFrame:
    """Files whose path any of the patterns matches; all without patterns."""
    return files.where(glob_filter(F.col("path"), globs)) if globs else files


def diff(current: DataFrame, cached: DataFrame) -> DataFrame:
    """(path, state): new, changed, unchanged or deleted, by content hash."""
    c = cached.select("path", F.col("content_hash").alias("old_hash"))
    now = current.select("path", F.col("content_hash").alias("new_hash"))
    both = now.join(c, "path", "full_outer")
    state = (
        F.when(F.col("new_hash").isNull(), "deleted").when(F.col("old_hash").isNull(), "new").when(F.col("new_hash") == F.col("old_hash"), "unchanged").otherwise("changed")
    )
    return both.select("path", state.alias("state"))


def deleted(current: DataFrame, cached: DataFrame) -> DataFrame:
    return cached.select("path").join(current.select("path"), "path", "left_anti")
