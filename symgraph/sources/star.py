"""The graph view of the star-schema tables: places, parties, parts and orders as symbols."""

from __future__ import annotations

from collections.abc import Iterable
from functools import partial, reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.graph import Graph


#: Keys beyond an int's range wrap around as line numbers.
LINES = 2**31 - 1
#: Line items of a task that makes edges, and nodes of one that resolution starts from.
A_TASK = 500_000


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _id(kind: str, key: Column) -> Column:
    return F.concat(F.lit(f"{kind}:"), key.cast("string"))


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One node per region, nation, customer, supplier, part and order.

    Regions are interfaces, nations structs, customers and suppliers classes, parts functions, orders methods.
    Customers and suppliers live in files of their nation, parts in one of their brand, orders in one of their
    priority.
    """
    t = lambda name: read(spark, sf_dir, name)
    region, nation = t("region"), t("nation")
    places = nation.join(F.broadcast(region), F.col("n_regionkey") == F.col("r_regionkey"))  # both are fixed in size

    def party(df: DataFrame, p: str, kind: str, file: str) -> DataFrame:
        df = df.join(F.broadcast(places), F.col(f"{p}_nationkey") == F.col("n_nationkey"))
        path = F.concat_ws("/", "r_name", "n_name", F.lit(file))
        return _row(df, kind, "class", F.col(f"{p}_{'custkey' if p == 'c' else 'suppkey'}"), F.col(f"{p}_name"), F.concat_ws(".", "n_name", f"{p}_name"), path, F.col(f"{p}_acctbal") > 0)

    return (
        _row(region, "region", "interface", F.col("r_regionkey"), F.col("r_name"), F.col("r_name"), F.lit("world.go"), F.lit(True))
        .unionByName(_row(places, "nation", "struct", F.col("n_nationkey"), F.col("n_name"), F.concat_ws(".", "r_name", "n_name"), F.concat_ws("/", "r_name", F.lit("nations.go")), F.lit(True)))
        .unionByName(party(t("customer"), "c", "customer", "customers.go"))
        .unionByName(party(t("supplier"), "s", "supplier", "suppliers.go"))
        .unionByName(_row(t("part"), "part", "function", F.col("p_partkey"), F.col("p_name"), F.concat_ws(".", "p_brand", "p_name"), F.concat_ws("/", F.lit("parts"), "p_brand", F.lit("part.ts")), F.lit(True)))
        .unionByName(_row(t("orders"), "order", "method", F.col("o_orderkey"), F.concat(F.lit("order_"), F.col("o_orderkey").cast("string")), F.concat_ws(".", "o_orderpriority", F.col("o_orderkey").cast("string")), F.concat_ws("/", F.lit("orders"), "o_orderpriority", F.lit("order_test.go")), F.col("o_totalprice") > 100000))
    )


def _row(df: DataFrame, prefix: str, kind: str, key: Column, name: Column, qualified: Column, path: Column, exported: Column) -> DataFrame:
    return df.select(
        _id(prefix, key).alias("id"), F.lit(kind).alias("kind"), name.alias("name"), qualified.alias("qualified_name"), path.alias("file_path"),
        F.when(path.endswith(".ts"), "typescript").otherwise("go").alias("language"), (key % LINES).cast("int").alias("start_line"), (key % LINES).cast("int").alias("end_line"),
        F.lit(None).cast("string").alias("docstring"), F.lit(None).cast("string").alias("signature"), exported.alias("is_exported"), key.cast("long").alias("node_ordinal"),
    )


def edges(spark: SparkSession, sf_dir: str, at: Iterable[str] | None = None) -> DataFrame:
    """contains: region to nation; references: parties to nations; calls: order to customer, parts, suppliers;
    imports: part to supplier.  Repeated line items collapse.

    Ids are built from the keys, in a mixed radix by the largest part and supplier key, so that no global numbering is
    needed; they are unique while eight times the largest order key times the largest part key is below 10^18.

    Edges are dealt by their source, to as many tasks as the line items ask for: what repeats is found there, a join on the
    source or a count by it shuffles no edge again, and no task's share grows with the tables.

    at: ids of nodes, of a number that the caller bounds; only edges from or to these are made, and rows that give none are
    left where they are read.
    """
    t = lambda name: read(spark, sf_dir, name)
    ends = None if at is None else sorted(set(at))
    keys: dict[str, list[int]] = {}
    for kind, _, k in (x.partition(":") for x in ends or ()):
        if k.removeprefix("-").isdecimal():
            keys.setdefault(kind, []).append(int(k))
    any_of = lambda df, **kinds: df if ends is None else df.where(reduce(or_, [F.col(c).isin(keys.get(kind, [])) for kind, c in kinds.items()]))
    above = lambda name, key: (t(name).agg(F.max(key).cast("long").alias("m")).scalar() + 1)
    parts, suppliers = above("part", "p_partkey"), above("supplier", "s_suppkey")
    number = lambda code, key: F.lit(code * 10**18) + key
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), t("lineitem").count() // A_TASK)
    deal = lambda df, source, *more: df.select(source.alias("source"), *more).repartition(tasks, "source")
    row = lambda df, i, b, kind, line: df.select(i.alias("id"), "source", b.alias("target"), F.lit(kind).alias("kind"), F.lit(True).alias("resolved"), line.cast("int").alias("line"), F.lit(0).alias("col"))
    key = lambda c: F.element_at(F.split(c, ":"), -1).cast("long")
    c, n, none = F.col, F.col("n"), F.lit(None)
    # An order's lines hold both kinds of its calls; what repeats is found where the order is.
    lines = deal(any_of(t("lineitem"), order="l_orderkey", part="l_partkey", supplier="l_suppkey"), _id("order", c("l_orderkey")), c("l_partkey").alias("p"), c("l_suppkey").alias("s"), c("l_linenumber").alias("n"))
    call = F.explode(F.array(F.struct(F.lit(5).alias("code"), c("p").alias("k")), F.struct(F.lit(6).alias("code"), c("s").alias("k")))).alias("x")
    calls = lines.select("source", "n", call).select("source", "n", "x.code", "x.k").distinct()
    part = c("code") == 5
    of_order = key("source")
    calls = row(calls, F.when(part, number(5, (of_order * parts + c("k")) * 8 + n)).otherwise(number(6, (of_order * suppliers + c("k")) * 8 + n)), F.when(part, _id("part", c("k"))).otherwise(_id("supplier", c("k"))), "calls", n)
    nation = deal(any_of(t("nation"), region="n_regionkey", nation="n_nationkey"), _id("region", c("n_regionkey")), "n_nationkey")
    customer = deal(any_of(t("customer"), customer="c_custkey", nation="c_nationkey"), _id("customer", c("c_custkey")), "c_custkey", "c_nationkey")
    supplier = deal(any_of(t("supplier"), supplier="s_suppkey", nation="s_nationkey"), _id("supplier", c("s_suppkey")), "s_suppkey", "s_nationkey")
    orders = deal(any_of(t("orders"), order="o_orderkey", customer="o_custkey"), _id("order", c("o_orderkey")), "o_orderkey", "o_custkey")
    made_by = deal(any_of(t("lineitem"), part="l_partkey", supplier="l_suppkey"), _id("part", c("l_partkey")), c("l_suppkey").alias("s")).distinct()
    made = (
        row(nation, number(1, c("n_nationkey")), _id("nation", c("n_nationkey")), "contains", none)
        .unionByName(row(customer, number(2, c("c_custkey")), _id("nation", c("c_nationkey")), "references", none))
        .unionByName(row(supplier, number(3, c("s_suppkey")), _id("nation", c("s_nationkey")), "references", none))
        .unionByName(row(orders, number(4, c("o_orderkey")), _id("customer", c("o_custkey")), "calls", none))
        .unionByName(calls)
        .unionByName(row(made_by, number(7, key("source") * suppliers + c("s")), _id("supplier", c("s")), "imports", none))
    )
    return made if ends is None else made.where(F.col("source").isin(ends) | F.col("target").isin(ends))


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files of their source."""
    text = F.coalesce("text", F.lit(""))
    return read(spark, sf_dir, "documents").select(
        F.concat_ws("/", "source", F.concat(F.col("doc_id").cast("string"), F.lit(".txt"))).alias("path"), F.sha1(text.cast("binary")).alias("content_hash"), F.col("lang").alias("language"),
        F.octet_length(text).cast("long").alias("size"), F.size(F.split(text, "\n")).cast("int").alias("node_count"), F.col("doc_id").alias("indexed_at"),
    )


def graph(spark: SparkSession, sf_dir: str) -> Graph:
    return Graph(nodes(spark, sf_dir), edges(spark, sf_dir), files(spark, sf_dir), at=partial(edges, spark, sf_dir))


#: Calls of each supplier to customers, and as many to parts: there are that many parts to a supplier.
CALLS = 20


def placeholders(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, unresolved edges): suppliers call customers, parts and themselves by name, all keys in turn.

    Each nation's supplier file imports the package of the nation after it under the alias `next`, all of that of the
    one after that, and under the alias `alias` first one and then another customer from a module that isn't there.
    """
    t = lambda name: read(spark, sf_dir, name)
    supplier, places = t("supplier"), t("nation").join(F.broadcast(t("region")), F.col("n_regionkey") == F.col("r_regionkey"))
    here = F.concat_ws("/", "r_name", "n_name", F.lit("suppliers.go"))
    module = places.select(F.col("n_nationkey").alias("k"), F.concat_ws("/", F.lit("world"), "r_name", "n_name").alias("module"))
    shown = t("customer").where("c_acctbal > 0").agg(F.min("c_name").alias("a"), F.max("c_name").alias("b"))

    def imported(df: DataFrame, line: int, local: str, module: Column, symbol: Column) -> DataFrame:
        return df.select(
            F.concat_ws("::", here, F.lit(local), F.lit(str(line))).alias("id"), F.lit("import").alias("kind"), F.lit(local).alias("name"), F.lit(local).alias("qualified_name"), here.alias("file_path"),
            F.lit("go").alias("language"), F.lit(line).alias("start_line"), F.lit(False).alias("is_exported"), module.alias("import_module"), symbol.cast("string").alias("import_symbol"), F.lit(line - 100).cast("long").alias("node_ordinal"),
        )

    after = lambda step: places.join(F.broadcast(module), F.col("k") == (F.col("n_nationkey") + step) % 25)
    lost = places.crossJoin(F.broadcast(shown))  # one row
    imports = (
        imported(after(1), 1, "next", F.col("module"), F.lit(None))
        .unionByName(imported(after(2), 2, "*", F.col("module"), F.lit("*")))
        .unionByName(imported(lost, 3, "alias", F.lit("no/where"), F.col("a")))
        .unionByName(imported(lost, 4, "alias", F.lit("no/where"), F.col("b")))
    )
    own = nodes(spark, sf_dir).where("id like 'customer:%' or id like 'supplier:%' or id like 'part:%'")
    all_ = own.select("id", "kind", "name", "qualified_name", "file_path", "language", "start_line", "is_exported", F.lit(None).cast("string").alias("import_module"), F.lit(None).cast("string").alias("import_symbol"), "node_ordinal").unionByName(imports)
    place = supplier.select("s_suppkey", "s_name", F.explode(F.sequence(F.lit(0), F.lit(CALLS - 1))).alias("j")).withColumn("i", F.col("s_suppkey") * CALLS + F.col("j"))
    rows = lambda name: t(name).agg(F.count("*").alias("n")).scalar()
    # Suppliers are a small file, but their places are CALLS times as many rows: by its guess of their size Spark would send all
    # of them through the driver to every task.
    people = t("customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name")).hint("shuffle_hash")
    goods = t("part").select(F.col("p_partkey").alias("k"), F.col("p_name").alias("name")).hint("shuffle_hash")
    calls = (
        place.where("j = 0").select("s_suppkey", "i", "j", F.lit(0).alias("t"), F.col("s_name").alias("name"))
        .unionByName(place.withColumn("k", F.col("i") % rows("customer")).join(people, "k").select("s_suppkey", "i", "j", F.lit(1).alias("t"), "name"))
        .unionByName(place.withColumn("k", F.col("i") % rows("part")).join(goods, "k").select("s_suppkey", "i", "j", F.lit(2).alias("t"), "name"))
        .unionByName(place.where("j = 0").select("s_suppkey", "i", "j", F.lit(3).alias("t"), F.lit("alias").alias("name")))
    )
    # These tables are few files; sorts by name must not run in as few tasks.
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), sum(t(name).count() for name in ("customer", "supplier", "part")) // A_TASK)
    return all_.repartition(tasks, "id"), calls.select(
        (F.col("i") * 4 + F.col("t")).alias("id"), _id("supplier", F.col("s_suppkey")).alias("source"), F.concat(F.lit("name:"), "name").alias("target"), F.lit("calls").alias("kind"), F.lit(False).alias("resolved"),
        F.col("j").cast("int").alias("line"), F.lit(0).alias("col"), F.when((F.col("t") == 1) & (F.col("j") % 5 > 2), F.concat(F.lit("next."), "name")).otherwise(F.col("name")).alias("callee_text"),
    )
