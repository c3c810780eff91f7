"""Streaming forms of trajectory summaries (an extension: the batch library has none)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def counts(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Rows and mean value of each type in tumbling windows of ts."""
    marked = events.withWatermark("ts", late)
    return marked.groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.avg("value").alias("mean"))


def lives(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """First and last time of each object's sessions."""
    marked = events.withWatermark("ts", late)
    return marked.groupBy(F.session_window("ts", gap), "user_id").agg(F.min("ts").alias("birth"), F.max("ts").alias("end"), F.count("*").alias("n"))
