"""Aggregates that are kept: counts, degrees and dependencies follow a graph's changes by signed deltas.

A measure is a set of sums by key, so what went is subtracted and what came is added; rows whose sums are all zero are
dropped.  From the two states of a few files the new counts and degrees follow without a look at the rest.  Every measure
of a graph equals that of another graph, updated by what went and came between the two.

Sums take no notice of which rows are in both states, so both are summed side by side in one pass (`sums`), and rows are
never compared; `net` and `both_ways` do that where the rows themselves are wanted.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.paths import package_path
from ..plans.graph import Graph, degrees
from .overview import package_edges

#: Keys and sums of each measure.
KEYS = {"kinds": ("kind",), "languages": ("language",), "packages": ("path",), "degrees": ("id",), "dependencies": ("source", "target", "kind")}
SUMS = {"kinds": ("n",), "languages": ("n",), "packages": ("files", "nodes"), "degrees": ("out_degree", "in_degree"), "dependencies": ("n",)}
MEASURES: dict[str, Callable[[Graph], DataFrame]] = {
    "kinds": lambda g: g.nodes.groupBy("kind").agg(F.count("*").alias("n")),
    "languages": lambda g: g.files.groupBy("language").agg(F.count("*").alias("n")),
    "packages": lambda g: g.files.groupBy(package_path(F.col("path")).alias("path")).agg(F.count("*").alias("files"), F.sum("node_count").cast("long").alias("nodes")),
    "degrees": lambda g: degrees(g.edges),
    "dependencies": package_edges,
}


def net(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rows that are there more or less often after than before, and how much more (column d, negative for less).

    One pass over both: where they are dealt by a column alike, as the star view's edges are, nothing is shuffled.
    """
    names = before.columns
    signed = before.select(*names, F.lit(-1).alias("d")).unionByName(after.select(*names, F.lit(1).alias("d")))
    return signed.groupBy(*names).agg(F.sum("d").alias("d")).where("d <> 0")


def both_ways(before: DataFrame, after: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows that went, rows that came), repeated rows counted."""
    changed, names = net(before, after), before.columns
    often = F.explode(F.array_repeat(F.lit(0), F.abs("d").cast("int"))).alias("k")
    return tuple(changed.where(c).select(*names, often).select(*names) for c in ("d < 0", "d > 0"))


def states(before: Graph, after: Graph) -> Graph:
    """Both states in one graph: its rows tell how often they are in that before (was) and in that after (now)."""
    mark = lambda df, was, now: df.withColumns({"was": F.lit(was), "now": F.lit(now)})
    return Graph(*(mark(b, 1, 0).unionByName(mark(a, 0, 1)) for b, a in ((before.nodes, after.nodes), (before.edges, after.edges), (before.files, after.files))))


#: Two sums of each row of `sums`, in the state before and in that after.
_SUMS = ("x_was", "x_now", "y_was", "y_now")


def _rows(df: DataFrame, measure: str, keys: list[Column], x: Column, y: Column | None = None) -> DataFrame:
    """Sums of one measure: of x, and of y where there are two, over the rows of either state."""
    sides = [F.sum(F.when(F.col(c) > 0, v * F.col(c))).cast("long").alias(f"{n}_{c}") for n, v in (("x", x), ("y", F.lit(0) if y is None else y)) for c in ("was", "now")]
    named = [F.lit(measure).alias("measure"), *[(keys[k] if k < len(keys) else F.lit(None).cast("string")).alias(f"key_{k}") for k in range(3)]]
    return df.groupBy(*named).agg(*sides)


def _edge_rows(both: Graph) -> DataFrame:
    """Degrees and dependencies of both states.

    Edges meet their sources' packages by hash, so they are not sorted, and go once to their targets: there they are summed by
    target, kind and packages, and only the sums meet the targets' packages.  Edges by source are counted where they are dealt.
    An edge that is in both states counts where a node at its end went, came or moved to another package.  Ids of nodes are
    unique in a state.
    """
    c, zero, none = F.col, F.lit(0), F.lit(None).cast("string")
    state = lambda s: F.max(F.when(c(s) > 0, c("package"))).alias(f"package_{s}")
    places = both.nodes.select("id", package_path(c("file_path")).alias("package"), "was", "now").repartition("id").groupBy("id").agg(state("was"), state("now"))
    source = places.withColumnsRenamed({"id": "source", "package_was": "source_was", "package_now": "source_now"})
    edges = both.edges.where("resolved")
    # Outer joins: ends that are no nodes have degrees, too.
    found = edges.select("source", "target", "kind", "was", "now").join(source.hint("shuffle_hash"), "source", "left")
    met = found.select(c("target").alias("id"), "kind", "source_was", "source_now", "was", "now").repartition("id")
    met = met.groupBy("id", "kind", "source_was", "source_now").agg(F.sum("was").alias("was"), F.sum("now").alias("now")).join(places.hint("shuffle_hash"), "id", "left")
    row = lambda measure, keys, *sums: F.struct(F.lit(measure).alias("measure"), *[k.alias(f"key_{i}") for i, k in enumerate(keys)], *[n.cast("long").alias(s) for s, n in zip(_SUMS, sums)])
    side = lambda end, *sums: F.when(c(f"source_{end}").isNotNull() & c(f"package_{end}").isNotNull(), row("dependencies", (c(f"source_{end}"), c(f"package_{end}"), c("kind")), *sums, zero, zero))
    into = F.array(row("degrees", (c("id"), none, none), zero, zero, c("was"), c("now")), side("was", c("was"), zero), side("now", zero, c("now")))
    out = edges.groupBy("source").agg(F.sum("was").alias("was"), F.sum("now").alias("now")).select(row("degrees", (c("source"), none, none), c("was"), c("now"), zero, zero).alias("x"))
    made = met.select(F.explode(into).alias("x")).where("x is not null").unionByName(out).select("x.*")
    return made.groupBy("measure", "key_0", "key_1", "key_2").agg(*[F.sum(s).alias(s) for s in _SUMS])


def sums(both: Graph) -> DataFrame:
    """(measure, key_0, key_1, key_2, x_was, x_now, y_was, y_now) of all measures, from `states`: keys and sums as in KEYS and
    SUMS, those of the state before and those of the state after."""
    package = package_path(F.col("path"))
    return (
        _rows(both.nodes, "kinds", [F.col("kind")], F.lit(1))
        .unionByName(_rows(both.files, "languages", [F.col("language")], F.lit(1)))
        .unionByName(_rows(both.files, "packages", [package], F.lit(1), F.col("node_count")))
        .unionByName(_edge_rows(both))
    )


def with_moved(sums: DataFrame) -> DataFrame:
    """The sums with x and y, how much more or less there is after than before."""
    less = lambda n: F.coalesce(F.col(f"{n}_now") - F.col(f"{n}_was"), F.col(f"{n}_now"), -F.col(f"{n}_was"))
    return sums.withColumns({n: less(n) for n in "xy"})


def brought_up(both: Graph) -> DataFrame:
    """(measure, key_0, key_1, key_2, x, y): all measures of the state before, brought up to that after by what moved.

    As `follow` brings up those that are kept; here they come from the same pass as what moved.
    """
    up = lambda n: F.coalesce(F.col(f"{n}_was") + F.col(n), F.col(n))
    return with_moved(sums(both)).select("measure", "key_0", "key_1", "key_2", *[up(n).alias(n) for n in "xy"]).where("x <> 0 or y <> 0")


def update(name: str, kept: DataFrame, *changes: DataFrame) -> DataFrame:
    """A measure after signed changes of its sums."""
    keys, sums = KEYS[name], SUMS[name]
    made = kept.select(*keys, *sums)
    for change in changes:
        made = made.unionByName(change.select(*keys, *[F.col(c).cast("long").alias(c) for c in sums]))
    out = made.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in sums])
    return out.where(" or ".join(f"{c} <> 0" for c in sums))


def follow(kept: dict[str, DataFrame], before: Graph, after: Graph) -> dict[str, DataFrame]:
    """Measures of the graph before, by name, brought up to the graph after."""
    change = with_moved(sums(states(before, after)))
    of = lambda name: change.where(F.col("measure") == name).select(*[F.col(f"key_{k}").alias(c) for k, c in enumerate(KEYS[name])], *[F.col(n).alias(c) for n, c in zip("xy", SUMS[name])])
    return {name: update(name, df, of(name)) for name, df in kept.items()}
