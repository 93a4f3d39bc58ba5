"""Batch jobs on scans that arrive continuously."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming.query import StreamingQuery


def on_arrival(rows: DataFrame, job: Callable[[DataFrame], DataFrame], path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Run a batch job on every micro-batch of a stream of whole scans and store its result.

    The result of a batch goes to its own folder, so a repeated batch replaces it.
    """

    def store(batch: DataFrame, number: int) -> None:
        job(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    writer = rows.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
