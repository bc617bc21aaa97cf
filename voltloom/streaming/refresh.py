"""Incremental refresh of mergeable summaries as files arrive."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from voltloom.operators.summaries import KEYS, merge_summaries, partial_summary
from voltloom.sources.store import BATCH, BatchStore


def summary_store(spark: SparkSession, path: str, metrics: Sequence[str], keys: Sequence[str] = KEYS, **options: int) -> BatchStore:
    """A store of partial summaries, which add up when they are read."""

    def merge(parts: DataFrame) -> DataFrame:
        return merge_summaries(parts, metrics, keys).withColumn(BATCH, F.lit(0).cast("long"))

    return BatchStore(spark, path, merge, **options)


def refresh_summaries(spark: SparkSession, rows: DataFrame, store: str, checkpoint: str, metrics: Sequence[str], keys: Sequence[str] = KEYS, *, ts: str = "ts") -> StreamingQuery:
    """Append the summary of each batch of a stream to the store, until what is there has been read.

    A batch costs what it holds, not what is stored; one that runs again after a
    failure counts once.
    """

    def append(batch: DataFrame, number: int) -> None:
        summary_store(spark, store, metrics, keys).append(partial_summary(batch, metrics, keys, ts), number)

    return rows.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
