"""Top-k, per-group caps and arg-max."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

SALTS = 32


def top_k(df: DataFrame, order: Sequence[Column], k: int) -> DataFrame:
    """The first ``k`` rows of a total order."""
    return df.orderBy(*order).limit(k)


def top_k_per_group(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    k: int,
    spread: Sequence[str] | None = None,
    salts: int = SALTS,
) -> DataFrame:
    """The first ``k`` rows per group, with their ``rank``.

    Spark cuts each input partition to ``k`` rows per group before the shuffle.
    ``spread`` names columns that split a group over ``salts`` tasks first, so a
    group holding much of the table does not end in one task.
    """
    if spread:
        salted = df.withColumn("_salt", F.pmod(F.xxhash64(*spread), F.lit(salts)))
        part = Window.partitionBy(*keys, "_salt").orderBy(*order)
        df = (
            salted.withColumn("_rank", F.row_number().over(part))
            .filter(F.col("_rank") <= k)
            .drop("_salt", "_rank")
        )
    whole = Window.partitionBy(*keys).orderBy(*order)
    return (
        df.withColumn("rank", F.row_number().over(whole))
        .filter(F.col("rank") <= k)
        .withColumn("rank", F.col("rank").cast("bigint"))
    )


def hottest(
    signals: DataFrame, keys: Sequence[str], columns: Sequence[str], ties: Sequence[Column]
) -> DataFrame:
    """The most severe signal per key; on equal severity the first by ``ties``.

    ``ties`` must sort larger-is-first.  Partial results are combined before the
    shuffle, so at most one row per key and partition travels.
    """
    best = F.max_by(F.struct(*columns, "severity"), F.struct("severity", *ties))
    return signals.groupBy(*keys).agg(best.alias("hot")).select(*keys, "hot.*")


def last_by_position(
    series: DataFrame, keys: Sequence[str], position: str, value: str, out: str
) -> DataFrame:
    """Value at the largest position per key, 0 where it is missing."""
    return series.groupBy(*keys).agg(
        F.coalesce(F.max_by(value, position), F.lit(0.0)).alias(out)
    )
