"""Incremental ingest of files: each file once, by the stream's checkpoint, into a table without repeated keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def ingest_once(spark: SparkSession, source: str, schema: T.StructType, target: str, checkpoint: str, key: str, order: str, fmt: str = "parquet") -> None:
    """Read the files of source that no earlier run has read and append rows whose key the target hasn't got; returns when all are in.

    The first row by order of each key in a batch wins; the target is read with the key column only. A batch that is
    tried again finds its keys already there, so its rows come once.
    """
    from ..sources.files import insert_or_ignore

    def add(batch: DataFrame, _number: int) -> None:
        try:
            there = spark.read.parquet(target).select(key)
        except Exception as e:  # the first batch has no target yet
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
            there = None
        insert_or_ignore(batch, key, order, there).write.mode("append").parquet(target)

    stream = spark.readStream.format(fmt).schema(schema).load(source)
    stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def windowed_counts(events: DataFrame, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(window_start, event_type, n, value) of a stream or table of events (ts, event_type, value); an extension for live visit feeds."""
    e = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if e.isStreaming:
        e = e.withWatermark("ts", late)
    g = e.groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("value"))
    return g.select(F.col("w.start").cast("timestamp_ntz").alias("window_start"), "event_type", "n", F.round("value", 4).alias("value"))
