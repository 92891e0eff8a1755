"""Means of repeated samples over event-time windows, from a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def windowed_means(events: DataFrame, key: str = "user_id", time: str = "ts", value: str = "value", window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(key, start, n, mean) per tumbling window; works on batch and streaming tables. A streaming
    window is emitted once the watermark has passed it, and its state is dropped."""
    groups = events.withWatermark(time, late).groupBy(key, F.window(time, window).alias("w"))
    return groups.agg(F.count(value).alias("n"), F.avg(value).alias("mean")).select(key, F.col("w.start").alias("start"), "n", "mean")
