"""Incremental forms of the volume timeline and of the fetch state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def volume_stream(
    stream: DataFrame, stamp: str, subject: str, tone: str, width: str, delay: str
) -> DataFrame:
    """Count and summed tone per period and subject, for update mode.

    Windows stay open for ``delay``; shares and means are taken when read.
    """
    return (
        stream.withWatermark(stamp, delay)
        .groupBy(F.window(stamp, width).alias("w"), F.col(subject).alias("subject"))
        .agg(F.count("*").alias("count"), F.sum(tone).alias("tone_sum"))
        .select(F.col("w.start").alias("t"), "subject", "count", "tone_sum")
    )


def fetch_state_stream(stream: DataFrame, key: str, at: str, ok: Column) -> DataFrame:
    """Time of the last success per key, for update mode.

    State is one row per feed key, and a failure never replaces a success.
    """
    return stream.groupBy(key).agg(
        F.max(F.when(ok, F.col(at))).alias("last_ok"), F.count_if(~ok).alias("failures")
    )
