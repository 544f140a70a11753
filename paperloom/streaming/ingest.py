"""Streams: files as they arrive, analysed and upserted a batch at a time."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming.query import StreamingQuery

from paperloom.sources.buckets import Bucketed


def ingest(stream: DataFrame, analyse: Callable[[DataFrame], DataFrame], table: Bucketed, checkpoint: str) -> StreamingQuery:
    """Runs ``analyse`` on what arrives and upserts its rows by key into a bucketed table, a batch of the stream as a batch of the table.

    A batch that comes again after a failure is left out if it was committed, and
    written anew if not.
    """

    def step(batch: DataFrame, number: int) -> None:
        table.upsert(analyse(batch), number)

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
