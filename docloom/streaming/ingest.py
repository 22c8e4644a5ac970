"""Incremental ingestion: a file stream of documents, chunked and upserted batch by batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.operators.store import Collection


def ingest(spark: SparkSession, source: str, schema: T.StructType, collection: Collection, checkpoint: str,
           build: Callable[[DataFrame], DataFrame], fmt: str = "parquet", force: bool = False, files_per_batch: int = 1000):
    """Start a stream that reads new files below ``source``, builds points and upserts them.

    Documents that have points already are left out unless ``force``. A batch that is run again after a
    failure replaces its own rows, so each document ends up in the collection once.
    """
    collection.ensure()

    def load(batch: DataFrame, _: int) -> None:
        todo = batch if force else collection.pending(batch)
        collection.upsert(build(todo))

    stream = spark.readStream.format(fmt).schema(schema).option("maxFilesPerTrigger", files_per_batch).load(source)
    return stream.writeStream.foreachBatch(load).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, size: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts and sums of ``events`` (ts, event_type, value) by event-time window; works on streams and tables."""
    marked = events.withWatermark("ts", late) if events.isStreaming else events
    return marked.groupBy(F.window("ts", size), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
