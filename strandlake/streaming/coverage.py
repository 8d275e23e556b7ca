"""Streaming variants: the reference has none; these follow its binned coverage and region counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def binned_stream(events: DataFrame, key: str, time: str, value: str, width: str, delay: str) -> DataFrame:
    """key, start, end, mean_value, n of event-time windows; a window is final once the watermark, ``delay`` behind the latest event, has passed it. Later rows are dropped."""
    windowed = events.withWatermark(time, delay).groupBy(key, F.window(time, width).alias("w"))
    return windowed.agg(F.avg(value).alias("mean_value"), F.count("*").alias("n")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "mean_value", "n")


def sessions_stream(events: DataFrame, key: str, time: str, gap: str, delay: str) -> DataFrame:
    """key, start, end, n of runs of events less than ``gap`` apart."""
    windowed = events.withWatermark(time, delay).groupBy(key, F.session_window(time, gap).alias("w"))
    return windowed.agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def first_seen_stream(events: DataFrame, key: str, time: str, delay: str) -> DataFrame:
    """Each key once within the watermark: duplicates that arrive within ``delay`` are dropped."""
    return events.withWatermark(time, delay).dropDuplicatesWithinWatermark([key])
