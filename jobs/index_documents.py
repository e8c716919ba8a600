"""Keeps the text index of a growing table of documents up to date.

    python -m jobs.index_documents [--config FILE] [--documents PATH] [--out PATH] [--checkpoint PATH] [--files-per-batch N]

A file stream takes the Parquet files that have come since the last run (the checkpoint knows), a batch of files at a time,
until there are none, and ends.  Each batch is one run of the index (`symgraph.sources.textindex`): documents that are
new or whose text differs are put in, the rest is left as it is.  A batch that fails is read again from the same files
under the same number and replaces its own folders, so the index holds each text once, however often it ran.  Index and
checkpoint belong together: a checkpoint that knows of fewer runs than the index has is refused.

A document is the file <source>/<doc_id>.txt.  Where a batch brings several rows of one document, that of the latest
file counts (then the later path, then the larger text).  Null texts are empty documents; rows without an id are passed
over.  Searches: `symgraph.operators.search.bm25_index(spark, TextIndex(out), "terms", {"text": 1.0})`.
"""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from symgraph.operators import sink
from symgraph.sources.textindex import STATS, TextIndex

from .common import settings, start

NAME = "index_documents"
FIELDS = ["text"]
log = logging.getLogger(f"jobs.{NAME}")


def as_files(rows: DataFrame) -> DataFrame:
    """(id, text, seen): documents as files, and which of several rows is the latest."""
    path = F.concat(F.coalesce("source", F.lit("")), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt"))
    seen = F.struct(F.col("_metadata.file_modification_time").alias("at"), F.col("_metadata.file_path").alias("file"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.select(path.alias("id"), "text", seen.alias("seen"))


def run(spark: SparkSession, documents: str, out: str, checkpoint: str, files_per_batch: int = 1000) -> dict:
    """Brings the index at `out` up to the files at `documents`; gives what this run read and wrote."""
    total = {"batches": 0, "documents_read": 0, "documents_put_in": 0, "terms_written": 0}

    def put(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        last = TextIndex(out).table(session, "stats", STATS).agg(F.max("run")).first()[0] or 0
        if last > number + 1:
            raise ValueError(f"{out} has later runs than {checkpoint} knows of")
        read = batch.count()
        rows = batch.where("id is not null")
        # Texts are shuffled only where a batch brings a document twice.
        once = rows.groupBy("id").count().where("count > 1").isEmpty()
        latest = (rows if once else sink.replace_by_key(rows, "id", "seen")).select("id", "text")
        wrote = TextIndex(out).put(session, number + 1, latest, FIELDS).count()
        terms = TextIndex(out, number + 1).table(session, "postings", "term string, run long").where(F.col("run") == number + 1).count()
        log.info("batch %d: read %d rows of %s, put in %d documents, wrote %d terms to %s", number, read, documents, wrote, terms, out)
        for key, n in zip(total, (1, read, wrote, terms)):
            total[key] += n

    schema, place = spark.read.parquet(documents).schema, documents.rstrip("/")
    place = f"{place[:-1]}[{place[-1]}]"  # a pattern of one path: a stream takes a single file under a pattern only
    stream = as_files(spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(place))
    query = stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    log.info("done: %s", total)
    return total


def read_back(spark: SparkSession, out: str) -> DataFrame:
    """The whole index: one row for each document and term with count and first place; a document without terms has one
    row without a term."""
    index = TextIndex(out)
    row = lambda df, term, n, first: df.select(F.col("id").alias("path"), "length", term.cast("string").alias("term"), n.cast("long").alias("n"), first.cast("long").alias("first"))
    none = F.lit(None)
    terms = row(index.live_postings(spark), F.col("term"), F.col("n"), F.col("positions")[0])
    return terms.unionByName(row(index.current(spark).where("length = 0"), none, none, none))


def main(argv: list[str] | None = None) -> None:
    values = settings(NAME, "Index documents that are new.", argv, documents=str, out=str, checkpoint=str, files_per_batch=int)
    spark = start(NAME)
    try:
        print(run(spark, **values))
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
