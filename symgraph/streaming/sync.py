"""Keeping a store in step as a stream: each batch of changed-path notices runs one incremental index.

An extension; the operators themselves are batch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..index import index_all


def sync_stream(notices: DataFrame, root: str, store: str, checkpoint: str) -> StreamingQuery:
    """notices: a streaming DataFrame whose rows say that something changed; what changed is found by hashes.

    A batch that is run again after a failure finds nothing new, so results do not depend on how often it ran.
    """

    def run(batch: DataFrame, _: int) -> None:
        if not batch.isEmpty():
            index_all(batch.sparkSession, root, store)

    return notices.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
