"""Continuous ingest: new message files, each message once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def new_messages(spark: SparkSession, path: str, schema: str, delay: str = "7 days") -> DataFrame:
    """Messages of Parquet files as they arrive; repeats of a uid within `delay` of event
    time are dropped, with state bounded by the watermark."""
    return spark.readStream.schema(schema).parquet(path).withWatermark("date", delay).dropDuplicatesWithinWatermark(["uid"])


def to_table(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append what has arrived, then stop; run again to go on."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def monthly_counts(stream: DataFrame, delay: str = "7 days") -> DataFrame:
    """Messages per folder in 30-day windows of event time."""
    return stream.withWatermark("date", delay).groupBy(F.window("date", "30 days"), "folder").agg(F.count("*").alias("n"))
