"""The square grid summary over a stream of points."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_cells(events: DataFrame, time: str, x, y, value: str, sx: float, sy: float, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Start of the window, ix, iy, sum and count of values; events later than `late` are left out of streams."""
    rows = events.withWatermark(time, late) if events.isStreaming else events
    cells = rows.select(F.col(time), F.floor(x / sx).alias("ix"), F.floor(y / sy).alias("iy"), F.col(value).alias("v"))
    grouped = cells.groupBy(F.window(time, width).alias("w"), "ix", "iy").agg(F.sum("v").alias("value"), F.count("v").alias("count"))
    return grouped.select(F.col("w.start").alias("start"), "ix", "iy", "value", "count")
