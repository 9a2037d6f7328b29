"""Severity over whole tables, tallies and the pressure index."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from signalgrid.functions.scoring import pressure_score, severity_by_share, threat_band


def peak_count(df: DataFrame, count: str = "count") -> DataFrame:
    """Largest positive count, 1 if there is none; always one row."""
    positive = F.when(F.col(count) > 0, F.col(count).cast("double"))
    return df.agg(F.coalesce(F.max(positive), F.lit(1.0)).alias("peak"))


def add_share_severity(
    df: DataFrame, count: str = "count", over: DataFrame | None = None
) -> DataFrame:
    """Add severity relative to the largest count in ``over`` (default: ``df``).

    The largest count comes in as a scalar subquery, so the rows stay in one
    stage; pass the rows before clipping as ``over`` to scale by all of them.
    """
    peak = peak_count(df if over is None else over, count).scalar()
    return df.withColumn("severity", severity_by_share(F.col(count), peak))


def tally(signals: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Number of signals and summed severity per key."""
    return signals.groupBy(*keys).agg(
        F.count("*").alias("events"), F.sum("severity").alias("severity_sum")
    )


def share_parts(df: DataFrame, keys: Sequence[str], count: str = "count") -> DataFrame:
    """Per key, all that a share-of-peak tally needs, from one scan.

    sum(sqrt(c / peak)) = sum(sqrt(c)) / sqrt(peak), so the peak need not be
    known while the rows are read.
    """
    positive = F.when(F.col(count) > 0, F.col(count).cast("double"))
    return df.groupBy(*keys).agg(
        F.count("*").alias("events"),
        F.coalesce(F.sum(F.sqrt(positive)), F.lit(0.0)).alias("root_sum"),
        F.max(positive).alias("peak"),
    )


def merge_share_parts(parts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Roll parts up to coarser keys."""
    return parts.groupBy(*keys).agg(
        F.sum("events").alias("events"),
        F.sum("root_sum").alias("root_sum"),
        F.max("peak").alias("peak"),
    )


def finish_share_tally(parts: DataFrame) -> DataFrame:
    """Turn parts into a tally; the peak comes in as a scalar subquery."""
    peak = parts.agg(F.coalesce(F.max("peak"), F.lit(1.0)).alias("peak")).scalar()
    return parts.withColumn("severity_sum", F.col("root_sum") / F.sqrt(peak)).drop(
        "root_sum", "peak"
    )


def pressure_index(
    tallied: DataFrame, members: DataFrame, keys: Sequence[str] = ("theater", "code")
) -> DataFrame:
    """Score and threat band for every member subject of every theater.

    ``members`` lists who belongs where; subjects without signals count as zero.
    Volume is relative to the busiest subject of the same theater.
    """
    # One row per member from here on.
    joined = members.join(tallied, [k for k in keys if k in tallied.columns], "left")
    events = F.coalesce(F.col("events"), F.lit(0)).cast("bigint")
    busiest = F.greatest(F.lit(1), F.max("events").over(Window.partitionBy(keys[0])))
    intensity = F.when(
        F.col("events") > 0, F.col("severity_sum") / F.col("events")
    ).otherwise(F.lit(0.0))
    return (
        joined.withColumn("events", events)
        .withColumn("score", pressure_score(F.col("events") / busiest, intensity))
        .withColumn("threat", threat_band(F.col("score")))
        .drop("severity_sum")
    )
