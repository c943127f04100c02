"""Event counts kept up to date from a stream of deliveries."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def windowed_counts(stream: DataFrame, time: str, kind: str, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """``(start, kind, n)``: events per window and kind; deliveries later than ``late`` are left out, as the state ends with the watermark."""
    counted = stream.withWatermark(time, late).groupBy(F.window(time, window), F.col(kind).alias("kind")).agg(F.count("*").alias("n"))
    return counted.select(F.col("window.start").alias("start"), "kind", "n")


def first_deliveries(stream: DataFrame, time: str, *key: str, late: str = "1 day") -> DataFrame:
    """Rows delivered again within ``late`` are dropped."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark(list(key))
