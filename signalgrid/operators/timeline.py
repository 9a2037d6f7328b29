"""Volume and tone timelines."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F


def timeline(
    df: DataFrame, stamp: str, subject: str, tone: str, width: str = "1 day"
) -> DataFrame:
    """Count, share of the period's total and mean tone per period and subject."""
    counted = (
        df.groupBy(F.window(stamp, width).alias("w"), F.col(subject).alias("subject"))
        .agg(F.count("*").alias("count"), F.avg(tone).alias("tone"))
        .select(F.col("w.start").alias("t"), "subject", "count", "tone")
    )
    # One row per period and subject from here on.
    whole = F.sum("count").over(Window.partitionBy("t"))
    return counted.withColumn("volume", F.col("count") / whole)


def series_stats(series: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Number of points and value range per series."""
    return series.groupBy(*keys).agg(
        F.count("*").alias("points"), F.min(value).alias("low"), F.max(value).alias("high")
    )
