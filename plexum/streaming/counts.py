"""Streaming counts, an extension: the tables' counting query kept up to date as events arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_counts(events: DataFrame, key: str, time: str = "ts", width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts of each key in windows of event time; later events than `late` are dropped by the watermark."""
    return events.withWatermark(time, late).groupBy(F.window(time, width), key).agg(F.count("*").alias("n")).select("window.start", "window.end", key, "n")
