"""Continuous ingest: the batch operators on a stream of landing files."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType


def landing(spark: SparkSession, path: str, schema: StructType, files_per_trigger: int = 100, fmt: str = "parquet") -> DataFrame:
    """Rows of the files that arrive in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).format(fmt).load(path)


def counts_by_window(events: DataFrame, ts: str, key: str, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts of each key in tumbling windows; rows later than the watermark are dropped by Spark."""
    return (
        events.withWatermark(ts, late)
        .groupBy(F.window(ts, width), key)
        .agg(F.count("*").alias("n"))
        .select(F.col("window.start").alias("window_start"), key, "n")
    )


def each_batch(stream: DataFrame, build: Callable[[DataFrame], DataFrame], target: str, checkpoint: str, fmt: str = "parquet") -> StreamingQuery:
    """Run a batch operator on every micro-batch and append its result, then stop when the folder is read.

    A batch is written under its number, so a repeated batch replaces itself.
    """

    def write(batch: DataFrame, number: int) -> None:
        build(batch).write.mode("overwrite").format(fmt).save(f"{target}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def only_new(rows: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not done yet: resuming skips finished work."""
    return rows.join(done.select(key).distinct(), key, "left_anti")


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Old rows with those of ``new`` in place of the same keys."""
    return only_new(old, new, key).unionByName(new)
