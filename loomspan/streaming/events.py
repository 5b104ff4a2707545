"""Windows over the event table, batch and streaming by the same plans."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LATENESS = "10 minutes"


def _watermarked(events: DataFrame, late: str) -> DataFrame:
    return events.withWatermark("ts", late) if events.isStreaming else events


def tumbling(events: DataFrame, size: str, late: str = LATENESS) -> DataFrame:
    """(start, event_type, n, v) of fixed windows; events later than ``late`` are dropped from a stream."""
    stamped = _watermarked(events.withColumn("ts", F.col("ts").cast("timestamp")), late)
    rows = stamped.groupBy(F.window("ts", size), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("v"))
    return rows.select(F.col("window.start").cast("timestamp_ntz").alias("start"), "event_type", "n", "v")


def sliding(events: DataFrame, size: str, step: str, late: str = LATENESS) -> DataFrame:
    stamped = _watermarked(events.withColumn("ts", F.col("ts").cast("timestamp")), late)
    rows = stamped.groupBy(F.window("ts", size, step), "event_type").agg(F.count("*").alias("n"))
    return rows.select(F.col("window.start").cast("timestamp_ntz").alias("start"), "event_type", "n")


def sessions(events: DataFrame, gap: str, late: str = LATENESS) -> DataFrame:
    """(user_id, start, end, n): a user's events with less than ``gap`` between them."""
    stamped = _watermarked(events.withColumn("ts", F.col("ts").cast("timestamp")), late)
    rows = stamped.groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"))
    return rows.select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def deduplicated(events: DataFrame, late: str = LATENESS) -> DataFrame:
    """Each event id once; a stream forgets ids behind its watermark."""
    stamped = _watermarked(events.withColumn("ts", F.col("ts").cast("timestamp")), late)
    return stamped.dropDuplicatesWithinWatermark(["event_id"]) if events.isStreaming else stamped.dropDuplicates(["event_id"])
