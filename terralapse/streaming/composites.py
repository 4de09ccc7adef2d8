"""Composites of scenes that arrive as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def daily_sums(scenes: DataFrame, band: str, *, late: str = "10 days", mask: str | None = None, mask_values: list[int] | None = None) -> DataFrame:
    """(row, col, t, total, n) of each finished day of a stream (scene_ts TIMESTAMP, row, col, bands...); t is its month.

    A day is final, and leaves the state, once the watermark has passed its end; scenes later than
    ``late`` are dropped. Means can be kept as sums, so the state is two numbers a pixel and day;
    medians can't, and belong to the batch composites.
    """
    seen = scenes.withWatermark("scene_ts", late)
    if mask:
        seen = seen.where(F.col(mask).isNull() | ~F.col(mask).isin(list(mask_values or [])))
    daily = seen.where(F.col(band).isNotNull()).groupBy("row", "col", F.window("scene_ts", "1 day").alias("day")).agg(F.sum(band).alias("total"), F.count(F.lit(1)).alias("n"))
    return daily.select("row", "col", F.trunc(F.col("day.start"), "month").alias("t"), "total", "n")


def month_of_days(daily: DataFrame) -> DataFrame:
    """Rolls finished days up to months: (row, col, t, mean, n)."""
    return daily.groupBy("row", "col", "t").agg((F.sum("total") / F.sum("n")).alias("mean"), F.sum("n").alias("n"))
