"""Streaming forms of the activity queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def activity(events: DataFrame, every: str = "1 day", late: str = "1 day") -> DataFrame:
    """(start, event_type, n) of tumbling windows; a window is final when the watermark passes it."""
    n = events.withWatermark("ts", late).groupBy(F.window("ts", every).alias("w"), "event_type").agg(F.count("*").alias("n"))
    return n.select(F.col("w.start").alias("start"), "event_type", "n")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 day") -> DataFrame:
    n = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"))
    return n.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")
