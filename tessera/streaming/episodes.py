"""Continuous ingest: a stream of events becomes episodes, deduplicated as they come."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """A stream over Parquet files of events (event_id, ts, user_id, event_type, ...)."""
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(path)


def episodes(events: DataFrame, delay: str = "1 hour") -> DataFrame:
    """One episode per (type, day, user): the first to come. State is kept for the watermark's delay past the day."""
    rows = events.select(
        F.concat(F.lit("mem/ep/"), "event_id").alias("episode_id"),
        F.lit("episode").alias("type"),
        F.col("event_type").alias("title"),
        F.to_date("ts").alias("event_time"),
        F.col("ts").cast("timestamp_ltz").alias("ingest_time"),
        F.concat(F.lit("user-"), "user_id").alias("owner"),
    )
    return rows.withWatermark("ingest_time", delay).dropDuplicatesWithinWatermark(["title", "event_time", "owner"])


def activity(events: DataFrame, window: str = "1 day", delay: str = "1 hour") -> DataFrame:
    """Events by type in tumbling windows; late ones beyond the delay are dropped."""
    timed = events.withColumn("at", F.col("ts").cast("timestamp_ltz")).withWatermark("at", delay)
    return timed.groupBy(F.window("at", window), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def ingest(stream: DataFrame, path: str, checkpoint: str):
    """Write a stream of episodes to Parquet, each row once, and stop when what is there has been read."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
