"""Placeholder calls to nodes, by ordered relational rules.

Tiers, of which the first that hits wins: 1 same file, 2 another Go file of the directory, 3 imports of the
file, 4 star imports, 5 the only exported symbol of that name.  Each tier is equi-joins over what is left of the
tiers before, which is written by a checkpoint, so later ones get few rows and no tier is computed twice.  Inside a tier the first hit counts: by import order, candidate order,
path, and node order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.paths import module_candidates, path_dir, qualifier
from ..plans.graph import cut
from ..schemas import PLACEHOLDER


def symbols(nodes: DataFrame) -> DataFrame:
    """The first node of each (file, name) in row order."""
    first = nodes.where("kind <> 'import'").groupBy("file_path", "name").agg(F.min(F.struct("node_ordinal", "id")).alias("x"))
    return first.select("file_path", "name", F.col("x.id").alias("hit"), F.col("x.node_ordinal").alias("hit_ordinal"))


def placeholders(edges: DataFrame, *more: str) -> DataFrame:
    """Unresolved edges as (edge_id, source, name, qualifier) and more columns of theirs."""
    e = edges.where(~F.col("resolved") & F.col("target").startswith(PLACEHOLDER))
    name = F.substring("target", F.lit(len(PLACEHOLDER) + 1), F.char_length("target")).alias("name")
    return e.select(F.col("id").alias("edge_id"), "source", name, F.coalesce(qualifier(F.col("callee_text")), F.lit("")).alias("qualifier"), *more)


def pending(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Unresolved edges whose source is a node, as (edge_id, source_file, name, qualifier)."""
    return placeholders(edges).join(nodes.select(F.col("id").alias("source"), F.col("file_path").alias("source_file")), "source").drop("source")


def wanted(left: DataFrame, targets: DataFrame) -> DataFrame:
    """(edge_id, name): the names whose symbols decide what becomes of each pending edge.

    These are the called name and what imports of that local name rename it from.
    """
    renamed = targets.where("symbol is not null and symbol not in ('default', '*')").select("source_file", F.col("local").alias("name"), "symbol").distinct()
    via = left.where("qualifier = ''").join(renamed, ["source_file", "name"]).select("edge_id", F.col("symbol").alias("name"))
    return left.select("edge_id", "name").unionByName(via).distinct()


def changed_names(before: DataFrame, after: DataFrame) -> DataFrame:
    """(name) of the symbols that came, went, or differ in what resolution looks at."""
    key = ["name", "id", "file_path", "node_ordinal", "is_exported"]
    a, b = (x.where("kind <> 'import'").select(*key) for x in (before, after))
    return a.exceptAll(b).unionByName(b.exceptAll(a)).select("name").distinct()


def changed_packages(before: DataFrame, after: DataFrame) -> DataFrame:
    """(package) names that a directory has got or lost."""
    a, b = before.select("dir", "package"), after.select("dir", "package")
    return a.exceptAll(b).unionByName(b.exceptAll(a)).select("package").distinct()


def touched(left: DataFrame, targets: DataFrame, names: DataFrame, packages: DataFrame) -> DataFrame:
    """The pending edges that the changed names and packages may resolve otherwise than before.

    An edge's own file and its imports are as they were: edges of changed files are resolved anew in any case.  Names and
    packages are few after a small change, and meet the edges and imports where these lie.
    """
    named = left.join(names, "name", "left_semi")
    via = targets.where("symbol is not null and symbol not in ('default', '*')").join(names.select(F.col("name").alias("symbol")), "symbol", "left_semi")
    renamed = left.where("qualifier = ''").join(via.select("source_file", F.col("local").alias("name")).distinct(), ["source_file", "name"], "left_semi").select(*left.columns)
    packaged = left.join(packages.select(F.col("package").alias("qualifier")), "qualifier", "left_semi").select(*left.columns)
    return named.select(*left.columns).unionByName(renamed).unionByName(packaged).distinct()


def of_interest(nodes: DataFrame, left: DataFrame, targets: DataFrame) -> DataFrame:
    """The nodes that can matter to the pending edges: imports of their files, symbols of the names they want."""
    imports = nodes.where("kind = 'import'").join(left.select(F.col("source_file").alias("file_path")).distinct(), "file_path", "left_semi").select(*nodes.columns)
    symbols_ = nodes.where("kind <> 'import'").join(wanted(left, targets).select("name").distinct(), "name", "left_semi").select(*nodes.columns)
    return imports.unionByName(symbols_)


def same_file(left: DataFrame, syms: DataFrame) -> DataFrame:
    return left.join(syms, (F.col("source_file") == F.col("file_path")) & (left["name"] == syms["name"])).select("edge_id", "hit", F.lit(1).alias("tier"))


def sibling(left: DataFrame, syms: DataFrame) -> DataFrame:
    """Go files of the same directory; the smallest path, then row order.

    Symbols are reduced to the two first files of each (directory, name): one of them is not the source itself.
    """
    go = syms.where(F.col("file_path").endswith(".go")).withColumn("dir", path_dir(F.col("file_path")))
    two = go.withColumn("k", F.row_number().over(Window.partitionBy("dir", "name").orderBy("file_path"))).where("k <= 2").drop("k")
    mine = left.where(F.col("source_file").endswith(".go")).withColumn("dir", path_dir(F.col("source_file")))
    hits = mine.join(two, ["dir", "name"]).where("file_path <> source_file")
    return hits.groupBy("edge_id").agg(F.min_by("hit", "file_path").alias("hit")).withColumn("tier", F.lit(2))


def import_targets(nodes: DataFrame, go_module: str = "", aliases: list[tuple[str, str]] = ()) -> DataFrame:
    """(file, local, symbol, import_seq, module, cand_seq, candidate) of every import."""
    im = nodes.where("kind = 'import'").select(F.col("file_path").alias("source_file"), F.col("name").alias("local"), F.col("import_symbol").alias("symbol"), F.struct("node_ordinal", "id").alias("import_seq"), F.coalesce("import_module", F.lit("")).alias("module"))
    return im.select("*", F.posexplode(module_candidates(F.col("module"), F.col("source_file"), go_module, list(aliases))).alias("cand_seq", "candidate"))


def _above(path: Column) -> Column:
    """The directories that a path lies in."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))


def there(targets: DataFrame, syms: DataFrame) -> DataFrame:
    """Import targets with a column `there`: whether any file with symbols is the candidate.  Others hit nothing, and most
    candidates of a module name no file, so pending edges need not be multiplied by them."""
    files = syms.select("file_path").distinct()
    go = files.where(F.col("file_path").endswith(".go") & F.col("file_path").contains("/"))
    dirs = go.select(F.explode(_above(F.col("file_path"))).alias("dir")).select(F.concat("dir", F.lit("/*.go")).alias("candidate"))
    real = files.select(F.col("file_path").alias("candidate")).unionByName(dirs).distinct().withColumn("there", F.lit(True))
    return targets.join(real, "candidate", "left").withColumn("there", F.coalesce("there", F.lit(False))).select(*targets.columns, "there")


def candidate_hits(wanted: DataFrame, syms: DataFrame) -> DataFrame:
    """Hits of (candidate, wanted): a file's symbol, or for dir/*.go that of any Go file below dir.

    The prefix search is an equi-join too: every Go file is listed under each of its ancestor directories, and of
    each (directory, name) the smallest path is kept.
    """
    plain = wanted.join(syms, (F.col("candidate") == F.col("file_path")) & (F.col("wanted") == syms["name"]))
    go = syms.where(F.col("file_path").endswith(".go") & F.col("file_path").contains("/"))
    under = go.select("name", "hit", "file_path", F.explode(_above(F.col("file_path"))).alias("dir")).groupBy("dir", "name").agg(F.min_by("hit", "file_path").alias("hit"))
    under = under.select(F.concat("dir", F.lit("/*.go")).alias("candidate"), F.col("name").alias("wanted"), "hit")
    deep = wanted.where(F.col("candidate").endswith("/*.go")).join(under, ["candidate", "wanted"])
    cols = ["edge_id", "import_seq", "cand_seq", "hit"]
    return plain.select(*cols).unionByName(deep.select(*cols))


def _first(hits: DataFrame, tier: int) -> DataFrame:
    return hits.groupBy("edge_id").agg(F.min_by("hit", F.struct("import_seq", "cand_seq")).alias("hit")).withColumn("tier", F.lit(tier))


def matching_imports(left: DataFrame, targets: DataFrame, packages: DataFrame | None) -> DataFrame:
    """Pending edges with the imports they may mean, one row a candidate, and the name wanted there.

    A qualified call means imports of that local name, or (Go) of a directory whose package has it; an unqualified
    one those of its own name.  Three equi-joins, united; never a join on alternatives.
    """
    named = left.where("qualifier <> ''").join(targets, (left["source_file"] == targets["source_file"]) & (F.col("qualifier") == F.col("local"))).drop(targets["source_file"])
    plain = left.where("qualifier = ''").join(targets, (left["source_file"] == targets["source_file"]) & (left["name"] == F.col("local"))).drop(targets["source_file"])
    made = named.withColumn("wanted", F.col("name"))
    renamed = F.col("symbol").isNotNull() & ~F.col("symbol").isin("default", "*")
    made = made.unionByName(plain.withColumn("wanted", F.when(renamed, F.col("symbol")).otherwise(F.col("name"))))
    if packages is not None:
        where = F.when(F.col("candidate").endswith("/*.go"), F.regexp_replace("candidate", r"/\*\.go$", "")).otherwise(path_dir(F.col("candidate")))
        go = targets.where(F.col("source_file").endswith(".go")).withColumn("dir", where).join(packages, "dir").select("source_file", "import_seq", "package").distinct()
        by = left.where("qualifier <> ''").join(go, (left["source_file"] == go["source_file"]) & (F.col("qualifier") == F.col("package"))).drop(go["source_file"])
        by = by.join(targets.where("true"), ["source_file", "import_seq"]).where("local <> qualifier").withColumn("wanted", F.col("name"))
        made = made.unionByName(by.select(*made.columns))
    return made


def unique_names(nodes: DataFrame) -> DataFrame:
    """(name, hit) of names that exactly one exported node has."""
    n = nodes.where("kind <> 'import' and is_exported").groupBy("name").agg(F.count("*").alias("n"), F.min("id").alias("hit"))
    return n.where("n = 1").select("name", "hit")


def resolve(nodes: DataFrame, edges: DataFrame, go_module: str = "", aliases: list[tuple[str, str]] = (), packages: DataFrame | None = None) -> DataFrame:
    """(edge_id, hit, tier) of the placeholder edges that some tier resolves.

    packages: (dir, package) of Go directories, for imports whose package name differs from the path.
    """
    return resolve_pending(nodes, pending(nodes, edges), go_module, aliases, packages)


def resolve_pending(nodes: DataFrame, left: DataFrame, go_module: str = "", aliases: list[tuple[str, str]] = (), packages: DataFrame | None = None) -> DataFrame:
    """The same for edges in the form of pending(); nodes may be cut to those of interest."""
    syms = cut(symbols(nodes))
    left = cut(left)
    targets = cut(there(import_targets(nodes, go_module, aliases), syms))
    # What a tier leaves over is an anti-join with its hits; only hits are written.
    done = cut(same_file(left, syms))
    left = left.join(done, "edge_id", "left_anti")
    second = cut(sibling(left, syms))
    left = left.join(second, "edge_id", "left_anti")
    meant = cut(matching_imports(left, targets, packages))
    third = cut(_first(candidate_hits(meant.where("there").select("edge_id", "import_seq", "cand_seq", "candidate", "wanted"), syms), 3))
    left = left.join(third, "edge_id", "left_anti")
    stars = left.join(targets.where("symbol = '*' and there"), "source_file").select("edge_id", "import_seq", "cand_seq", "candidate", F.col("name").alias("wanted"))
    fourth = cut(_first(candidate_hits(stars, syms), 4))
    left = left.join(fourth, "edge_id", "left_anti")
    last = meant.groupBy("edge_id").agg(F.max_by("wanted", "import_seq").alias("wanted"))
    only = unique_names(nodes)
    via = left.join(last, "edge_id").join(only.withColumnRenamed("name", "wanted"), "wanted").select("edge_id", "hit", F.lit(0).alias("k"))
    own = left.join(only, "name").select("edge_id", "hit", F.lit(1).alias("k"))
    fifth = via.unionByName(own).groupBy("edge_id").agg(F.min_by("hit", "k").alias("hit")).withColumn("tier", F.lit(5))
    return done.unionByName(second).unionByName(third).unionByName(fourth).unionByName(fifth)


def apply(edges: DataFrame, hits: DataFrame) -> DataFrame:
    """Edges with the resolved ones' targets put in."""
    h = hits.select(F.col("edge_id").alias("id"), "hit")
    out = edges.join(h, "id", "left")
    return out.withColumns({"target": F.coalesce("hit", "target"), "resolved": F.col("resolved") | F.col("hit").isNotNull()}).drop("hit").select(*edges.columns)
