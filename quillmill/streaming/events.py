"""Windowed aggregation of events, for batch and stream alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def _timed(events: DataFrame, watermark: str | None) -> DataFrame:
    """Event time as a timestamp with a zone, which watermarks need."""
    src = events.withColumn("ts", F.col("ts").cast("timestamp"))
    return src.withWatermark("ts", watermark) if watermark else src


def windowed_counts(events: DataFrame, size: str = "5 minutes", slide: str | None = None, watermark: str | None = "10 minutes") -> DataFrame:
    """(window_start, event_type, n, total); late events beyond the watermark are left out of a stream."""
    src = _timed(events, watermark)
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    return src.groupBy(w.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("window_start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", watermark: str | None = "1 hour") -> DataFrame:
    """(user_id, start, end, n): a user's events without a pause longer than ``gap``."""
    src = _timed(events, watermark)
    return src.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")
