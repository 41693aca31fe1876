"""Incremental ingestion: micro-batches that can be resumed, deduplicated across batches and merged into a store."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_new(spark: SparkSession, path: str, schema, files_each: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", files_each) if files_each else reader).parquet(path)


def ingest(stream: DataFrame, out: str, checkpoint: str, change: Callable[[DataFrame], DataFrame] = lambda x: x) -> None:
    """Everything new, in micro-batches. Each goes to its own folder by batch id, so a batch that is run again after a failure replaces itself; progress is in the checkpoint, and deleting that starts anew."""

    def write(batch: DataFrame, batch_id: int) -> None:
        change(batch).withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def first_seen(stream: DataFrame, keys: list[str], when: str | None = None, late: str | None = None) -> DataFrame:
    """One row for each key over all batches; with a watermark, within it."""
    if when and late:
        return stream.withWatermark(when, late).dropDuplicatesWithinWatermark(keys)
    return stream.dropDuplicates(keys)


def windowed(events: DataFrame, when: str, key: str, value: str, length: str, late: str | None = None) -> DataFrame:
    """Extension: counts and sums of tumbling windows; works on streams and tables."""
    rows = events.withWatermark(when, late) if late else events
    w = F.window(when, length)
    return rows.groupBy(w.alias("w"), key).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(value), 2).alias("total")).select(F.col("w.start").alias("start"), key, "n", "total")


def sessions(events: DataFrame, when: str, key: str, gap: str) -> DataFrame:
    """Extension: runs of events of a key without a pause of ``gap`` or more."""
    return events.groupBy(F.session_window(when, gap).alias("w"), key).agg(F.count(F.lit(1)).alias("n"), F.min(when).alias("first"), F.max(when).alias("last")).select(key, "first", "last", "n")
