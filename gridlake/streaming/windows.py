"""Windowed event counts with a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_counts(
    events: DataFrame, time: str, keys: list[str], length: str, slide: str | None = None,
    delay: str | None = None,
) -> DataFrame:
    """Events per window and key; with a delay, late events drop and windows close."""
    source = events if delay is None else events.withWatermark(time, delay)
    span = F.window(time, length, slide) if slide else F.window(time, length)
    return source.groupBy(span, *keys).agg(F.count("*").alias("n_events")).select(
        F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"),
        *keys, "n_events")
