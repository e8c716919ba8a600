"""A persisted text index: postings with positions, kept by deltas, in plain Parquet folders at any path that Spark reads.

    docs/run=R       id, digest, length, alive, old_run, old_length: what run R put in, changed or took out
    postings/run=R   term, id, field, positions, n, length; in folders by the term's first character, sorted by term
    stats/run=R      documents and length that run R added, less what it took out

A run writes its own folders only, so running it again replaces what it wrote before.  Readers name the last run they
want.  A row of an earlier run is dead once a later run has put in or taken out its id; `docs` says which (`old_run`).  So
a search reads the postings of its terms (a folder by first character, and within it the row groups whose range holds the
term), the few dead rows and one row of statistics a run; the texts are not read.

Postings are dealt to as many tasks as the number of tokens asks for: each folder has the share of them that its terms had
in a sample of the texts, and within it (term, id) is spread evenly, so a term that all documents hold is no hot task.  Each
file is sorted by (term, id).  Positions are gathered where the document's tokens are, once.

Ids are unique within what is put in; null ids are left out.  Null texts have no tokens.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import tokens

DOCS = "id string, digest string, length long, alive boolean, old_run long, old_length long, run long"
POSTINGS = "term string, id string, field string, positions array<int>, n int, length long, run long, head string"
STATS = "documents long, length long, run long"
_LAST = 2**62


def head(term: Column) -> Column:
    """The folder of a term: its first letter or digit, `_` for what is not ASCII."""
    first = F.substring(term, 1, 1)
    return F.when(first.between("0", "9") | first.between("a", "z"), first).otherwise("_")


def read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The table at a path; empty if there is none yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        # As a query of no rows, which the optimizer knows to be empty.
        return spark.range(0).select(*[F.lit(None).cast(t).alias(c) for c, t in (x.split(" ") for x in schema.split(", "))])


def _tokens(docs: DataFrame, fields: list[str]) -> DataFrame:
    """id, token arrays t_<field>, and the number of all tokens."""
    made = docs.select("id", *[tokens(F.col(c)).alias(f"t_{c}") for c in fields])
    return made.withColumn("length", sum((F.size(f"t_{c}") for c in fields), F.lit(0)).cast("long"))


#: Tokens that are grouped at once, unless one text has more, and tokens of a task that sorts postings.
_AT_ONCE, _A_TASK = 1 << 20, 2_000_000
#: Tokens of the sample that says how large folders are; the layout depends on it, what is found does not.
_SAMPLE = 1_000_000
_HEADS = "0123456789_abcdefghijklmnopqrstuvwxyz"


def postings(docs: DataFrame, fields: list[str]) -> DataFrame:
    """One row for each (id, field, term) with the term's positions, counted from 0, and the document's length.

    Tokens are grouped where they are made, a batch of texts at a time: nothing is shuffled, and nothing sorted outside of
    memory.
    """
    made = _tokens(docs.select("id", *[c for c in fields if c != "id"]), fields)
    at_once = _AT_ONCE

    def grouped(batches):
        import numpy as np
        import pyarrow as pa

        def group(rows, field):
            lists = rows.column(f"t_{field}")
            terms = lists.flatten().dictionary_encode()
            if not len(terms):
                return
            counts = lists.value_lengths().to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(len(counts)), counts)
            place = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
            key = row * np.int64(len(terms.dictionary)) + terms.indices.to_numpy(zero_copy_only=False)
            order = np.argsort(key, kind="stable")  # places stay ascending
            key = key[order]
            first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
            of = pa.array(row[order[first]])
            ends = pa.array(np.append(first, len(key)).astype(np.int32))
            name = pa.array([field]).take(pa.array(np.zeros(len(first), np.int32)))
            cols = [terms.dictionary.take(terms.indices.take(pa.array(order[first]))), rows.column("id").take(of), name, pa.ListArray.from_arrays(ends, pa.array(place[order].astype(np.int32))), rows.column("length").take(of)]
            yield pa.RecordBatch.from_arrays(cols, names=["term", "id", "field", "positions", "length"])

        for batch in batches:
            ends = np.cumsum(batch.column("length").to_numpy(zero_copy_only=False))
            start = 0
            while start < batch.num_rows:
                done = ends[start - 1] if start else 0
                stop = max(start + 1, int(np.searchsorted(ends, done + at_once, side="right")))
                for field in fields:
                    yield from group(batch.slice(start, stop - start), field)
                start = stop

    return made.select("id", "length", *[f"t_{c}" for c in fields]).mapInArrow(grouped, "term string, id string, field string, positions array<int>, length long")


def _heads_of(docs: DataFrame, fields: list[str]) -> DataFrame:
    """(head, n) of the postings that documents will have."""
    terms = F.flatten(F.array(*[F.array_distinct(tokens(F.col(c))) for c in fields]))
    return docs.select(F.explode(terms).alias("term")).groupBy(head(F.col("term")).alias("head")).agg(F.count("*").alias("n"))


def _dealt(rows: DataFrame, tasks: int, heads: DataFrame) -> DataFrame:
    """Rows (head, term, id) dealt to tasks: each head has a stretch of them by its share of (head, n), and a row's place in
    it is by hash."""
    n = dict.fromkeys(_HEADS, 1)  # a head that a sample missed has a place, too
    for r in heads.collect():
        n[r["head"]] += r["n"]
    total, before, stretch = sum(n.values()), 0, {}
    for h in _HEADS:
        stretch[ord(h)] = (before / total, n[h] / total)
        before += n[h]
    codes = range(ord(_HEADS[0]), ord(_HEADS[-1]) + 1)
    of = lambda k: F.get(F.array(*[F.lit(float(stretch.get(c, (0, 0))[k])) for c in codes]), F.ascii("head") - codes[0])
    place = F.pmod(F.xxhash64("term", "id"), F.lit(1 << 30)) / float(1 << 30)
    return rows.repartitionById(tasks, F.least(F.floor((of(0) + of(1) * place) * tasks).cast("int"), F.lit(tasks - 1)))


def _write_postings(rows: DataFrame, length: int, heads: DataFrame, path: str) -> None:
    """Writes postings of so many tokens sorted by term; the number of tasks grows with the tokens, so none sorts more than
    its memory holds.  heads: (head, n), how the postings, or a sample of them, are spread."""
    tasks = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), length // _A_TASK)
    dealt = _dealt(rows.select("term", "id", "field", "positions", "length", head(F.col("term")).alias("head")), tasks, heads)
    full = dealt.select("term", "id", "field", "positions", F.size("positions").alias("n"), "length", "head")
    full.sortWithinPartitions("head", "term", "id").write.mode("overwrite").partitionBy("head").parquet(path)


@dataclass(frozen=True)
class TextIndex:
    """An index at a path, as it stood after run `upto`."""

    path: str
    upto: int = _LAST

    def table(self, spark: SparkSession, name: str, schema: str) -> DataFrame:
        return read(spark, f"{self.path}/{name}", schema).where(F.col("run") <= self.upto)

    def current(self, spark: SparkSession, of: DataFrame | None = None) -> DataFrame:
        """(id, digest, length, run) of the documents that are in the index, or of those among some (column id)."""
        rows, dead = self.table(spark, "docs", DOCS).where("alive"), self.dead(spark)
        rows = (rows if of is None else rows.join(of, "id", "left_semi")).select("id", "digest", "length", "run")
        return rows if dead.isEmpty() else rows.join(dead, ["id", "run"], "left_anti").select(rows.columns)

    def dead(self, spark: SparkSession) -> DataFrame:
        """(id, run) of rows that a later run replaced."""
        return self.table(spark, "docs", DOCS).where("old_run is not null").select("id", F.col("old_run").alias("run"))

    def live_postings(self, spark: SparkSession, where: Column | None = None) -> DataFrame:
        found, dead = self.table(spark, "postings", POSTINGS), self.dead(spark)
        found = found if where is None else found.where(where)
        return found if dead.isEmpty() else found.join(dead, ["id", "run"], "left_anti").select(found.columns)

    def stats(self, spark: SparkSession) -> DataFrame:
        """One row: documents, and their mean length."""
        s = self.table(spark, "stats", STATS)
        return s.agg(F.sum("documents").alias("n"), (F.sum("length").cast("double") / F.sum("documents")).alias("avg"))

    # Writing

    def put(self, spark: SparkSession, run: int, docs: DataFrame, fields: list[str], gone: DataFrame | None = None) -> DataFrame:
        """Run number `run`: documents (id and fields) are put in where they are new or changed, ids of `gone` taken out.

        Returns the rows of docs that it wrote.
        """
        ids = docs.select("id") if gone is None else docs.select("id").unionByName(gone.select("id"))
        return self._put(spark, run, docs, fields, lambda known: known.current(spark, ids.distinct()), gone)

    def sync(self, spark: SparkSession, run: int, docs: DataFrame, fields: list[str]) -> DataFrame:
        """put() of all documents there are: those that are in the index but not among them go."""
        return self._put(spark, run, docs, fields, lambda known: known.current(spark), None, whole=True)

    def _put(self, spark: SparkSession, run: int, docs: DataFrame, fields: list[str], find, gone: DataFrame | None, whole: bool = False) -> DataFrame:
        """find: what of the index as it was before the documents meet.  whole: what of it they don't name goes."""
        known = TextIndex(self.path, run - 1)
        first = known.table(spark, "docs", DOCS).isEmpty()
        docs = docs.where("id is not null").select("id", *[c for c in fields if c != "id"])
        lengths = sum((F.size(tokens(F.col(c))) for c in fields), F.lit(0)).cast("long")
        # Digests and lengths meet what was there before, once; texts stay where they are.
        stamped = docs.select("id", F.sha1(F.to_json(F.struct(*fields)).cast("binary")).alias("digest"), lengths.alias("length"))
        none = lambda t: F.lit(None).cast(t)
        if first:
            rows = stamped.select("id", "digest", "length", F.lit(True).alias("alive"), none("long").alias("old_run"), none("long").alias("old_length"))
        else:
            before = find(known).select("id", F.col("digest").alias("old_digest"), F.col("length").alias("old_length"), F.col("run").alias("old_run"))
            met = stamped.withColumn("alive", F.lit(True)).join(before, "id", "full" if whole else "left").where("alive is null or old_digest is null or digest <> old_digest")
            rows = met.select("id", "digest", F.coalesce("length", F.lit(0)).cast("long").alias("length"), F.col("alive").isNotNull().alias("alive"), "old_run", "old_length")
            if gone is not None:
                out = before.join(gone.select("id").distinct(), "id", "left_semi")
                rows = rows.unionByName(out.select("id", none("string").alias("digest"), F.lit(0).cast("long").alias("length"), F.lit(False).alias("alive"), "old_run", "old_length"))
        rows.write.mode("overwrite").parquet(f"{self.path}/docs/run={run}")
        wrote = read(spark, f"{self.path}/docs", DOCS).where(F.col("run") == run)
        only = lambda df: df if first else df.join(wrote.where("alive").select("id"), "id", "left_semi")
        length = wrote.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
        some = docs if length <= _SAMPLE else docs.sample(_SAMPLE / length, seed=1)
        _write_postings(postings(only(docs), fields), length, _heads_of(only(some), fields), f"{self.path}/postings/run={run}")
        signed = wrote.agg((F.count_if("alive") - F.count("old_run")).alias("documents"), (F.coalesce(F.sum("length"), F.lit(0)) - F.coalesce(F.sum("old_length"), F.lit(0))).alias("length"))
        signed.write.mode("overwrite").parquet(f"{self.path}/stats/run={run}")
        return wrote

    def compact(self, spark: SparkSession, path: str) -> TextIndex:
        """The same index at another path as one run, without dead rows."""
        new = TextIndex(path)
        none = F.lit(None).cast("long")
        self.current(spark).select("id", "digest", "length", F.lit(True).alias("alive"), none.alias("old_run"), none.alias("old_length")).write.mode("overwrite").parquet(f"{path}/docs/run=0")
        length = self.table(spark, "stats", STATS).agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
        rows = self.live_postings(spark)
        _write_postings(rows, length, rows.groupBy("head").agg(F.count("*").alias("n")), f"{path}/postings/run=0")
        self.table(spark, "stats", STATS).agg(F.sum("documents").alias("documents"), F.sum("length").alias("length")).write.mode("overwrite").parquet(f"{path}/stats/run=0")
        return new
