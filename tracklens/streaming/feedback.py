"""Feedback as a stream: sliding counts, sessions and first-seen events, with a watermark of one day."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracklens.functions.columns import action, track

WATERMARK = "1 day"


def event_stream(spark: SparkSession, folder: str) -> DataFrame:
    """The Parquet files of ``folder`` as they arrive: event_id, ts, user_id, track, act."""
    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    raw = spark.readStream.schema(schema).parquet(folder)
    return raw.select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", track(F.col("props")).alias("track"), action(F.col("event_type")).alias("act"))


def sliding_counts(events: DataFrame, width: str = "7 days", slide: str = "1 day") -> DataFrame:
    """Events of each action in overlapping windows; state older than the watermark goes."""
    windows = events.withWatermark("ts", WATERMARK).groupBy(F.window("ts", width, slide), "act")
    return windows.agg(F.count("*").alias("events")).select(F.col("window.start").alias("start"), "act", "events")


def user_sessions(events: DataFrame, gap: str = "24 hours") -> DataFrame:
    """Sessions of each user by gaps in event time."""
    found = events.withWatermark("ts", WATERMARK).groupBy("user_id", F.session_window("ts", gap))
    return found.agg(F.count("*").alias("events")).select("user_id", F.col("session_window.start").alias("started"), "events")


def first_seen(events: DataFrame) -> DataFrame:
    """Events without those that repeat an event_id within the watermark."""
    return events.withWatermark("ts", WATERMARK).dropDuplicatesWithinWatermark(["event_id"])


def run_once(stream: DataFrame, out: str, checkpoint: str, mode: str = "append") -> None:
    """Works off what has arrived and stops; a run after a failure goes on from the checkpoint."""
    query = stream.writeStream.format("parquet").outputMode(mode).option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
