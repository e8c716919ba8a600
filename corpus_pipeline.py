"""The corpus pipeline: five stages over documents, each written as Parquet and read again by the next.

STAGES lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame.  All but the
last return the columns of documents; n_chars follows a changed text.

1. quality         documents that the classifier (trained on `labels`) rejects go
2. line_dedup      later occurrences of three-line windows are taken out of the texts; a document all of whose
                   lines are repeats goes
3. near_dedup      of each group of near-duplicates (five-word shingles, similarity of 0.8 or more) the document
                   with the smallest id stays
4. decontaminate   documents with a ten-word window of `benchmark` go
5. byte_bpe        texts become token ids and back: counts and digests
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from symgraph.llm import bpe, decontaminate, line_dedup, quality, similar
from symgraph.llm.common import shared_path, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_dedup.without_repeats(docs).withColumn("n_chars", F.char_length("text").cast("long"))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return similar.representatives(docs)


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def byte_bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.round_trip(docs)


STAGES = [
    ("quality", quality_stage),
    ("line_dedup", line_dedup_stage),
    ("near_dedup", near_dedup_stage),
    ("decontaminate", decontaminate_stage),
    ("byte_bpe", byte_bpe_stage),
]

#: The classifier, line windows, shingle sets and tokenizer are no SQL; tests hold the rows against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir; what lies between them is written to the shared folder."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_path(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs.write.parquet(f"{folder}/{k}-{name}")
            docs = spark.read.parquet(f"{folder}/{k}-{name}")
    return docs
