"""A stream of points into a collection, one version a micro-batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from tidemark.sources.collections import VectorStore


def stream_into(points: DataFrame, store: VectorStore, name: str, checkpoint: str) -> StreamingQuery:
    """Starts a query that upserts a stream of (id, embedding, payload, at) by id; of one id the latest `at` counts.

    `at` is kept with the point, so a row that arrives late, in whatever micro-batch, overwrites nothing newer. A
    micro-batch that runs again after a failure writes the same points, so the outcome is that of one run.
    """

    def put(batch: DataFrame, _: int) -> None:
        batch.persist()  # its width is checked and its ids are joined before it is written
        try:
            if batch.head(1):
                store.upsert(name, batch, newest=True)
        finally:
            batch.unpersist()

    return points.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
