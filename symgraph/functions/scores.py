"""Scores of symbols."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def expanded_limit(limit: int) -> int:
    """Candidates taken before ranking."""
    return 20 if limit <= 0 else min(max(5 * limit, 50), 200)


def importance() -> Column:
    """Degree, export, place and name of a row with in_degree, out_degree, is_exported, file_path, name."""
    degree = F.col("in_degree") + F.col("out_degree")
    flag = lambda c, x: F.when(c, F.lit(float(x))).otherwise(0.0)
    return (
        F.least(degree, F.lit(40)) * 1.5
        + F.least("in_degree", F.lit(20))
        + F.least("out_degree", F.lit(20)) * 0.5
        + flag(F.col("is_exported"), 6)
        + flag(F.col("file_path").startswith("cmd/") | F.col("file_path").startswith("internal/cli/"), 4)
        + flag(F.col("name").isin("Run", "Main") | F.col("name").startswith("cmd"), 3)
        + flag(F.col("file_path").endswith("_test.go"), -12)
    )


def match_score(query: str | Column) -> Column:
    """How a row's name answers the whole query, and what its kind is worth."""
    q, name = F.lower(F.lit(query)), F.lower("name")
    text = F.when(name == q, 100.0).when(name.startswith(q), 70.0).when(name.contains(q), 40.0).when(F.lower("qualified_name").contains(q), 20.0).otherwise(0.0)
    kind = F.when(F.col("kind").isin("function", "method", "class"), 10.0).when(F.col("kind").isin("struct", "interface"), 8.0).when(F.col("kind") == "import", -40.0).otherwise(0.0)
    return text + kind


def name_tier(query: str | Column) -> Column:
    """0 for the name itself, 1 for names that begin with it (case-insensitively; % and _ are wild), 2 else."""
    q = F.lit(query)
    return F.when(F.col("name") == q, 0).when(F.ilike(F.col("name"), F.concat(q, F.lit("%"))), 1).otherwise(2)
