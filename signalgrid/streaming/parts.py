"""Answers kept up to date as mergeable parts per day.

Each batch of a stream writes small parts of its own, in folders by day and batch. Nothing is held
as state: parts are merged when the answer is read, over the days of the look-back only, and days
that leave it are dropped.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from signalgrid import fixed_values as fv
from signalgrid.functions.scoring import severity_by_share
from signalgrid.operators import pressure
from signalgrid.operators.freshness import success_spans
from signalgrid.operators.ranking import top_k_per_group
from signalgrid.session import remove_folder, subfolders
from signalgrid.streaming.ingest import _trigger, replace_folders


def start_parts(stream: DataFrame, make: Callable[[DataFrame], DataFrame], table: str, checkpoint: str,
                every: str | None = None) -> StreamingQuery:
    """Write the parts that ``make`` forms of each batch; its result has a day ``dt``."""
    def write(batch: DataFrame, batch_id: int) -> None:
        replace_folders(make(batch).withColumn("batch", F.lit(batch_id)), table, "dt", "batch")

    return (
        stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
        .trigger(**_trigger(every)).start()
    )


def read_parts(spark: SparkSession, table: str, first: str | None = None, last: str | None = None) -> DataFrame:
    """Parts of all batches for the days from ``first`` to ``last``; folders of other days stay closed."""
    parts = spark.read.parquet(table)
    if first is not None:
        parts = parts.filter(F.col("dt") >= F.lit(first).cast("date"))
    if last is not None:
        parts = parts.filter(F.col("dt") <= F.lit(last).cast("date"))
    return parts.drop("batch")


def drop_days(spark: SparkSession, table: str, before: str) -> list[str]:
    """Remove the parts of days before a day, and return those days. Run it while no batch is written."""
    gone = sorted(d[3:] for d in subfolders(spark, table) if d.startswith("dt=") and d[3:] < before)
    for day in gone:
        remove_folder(spark, f"{table}/dt={day}")
    return gone


# --- Strongest signals -------------------------------------------------------

ORDER = ("source_rank", "subject_priority", "pos", "id")


def strongest(signals: DataFrame, count: Column, k: int = fv.SIGNAL_CAP) -> DataFrame:
    """Per theater, source and day: the ``k`` strongest signals; and per day the largest count of all.

    ``signals`` has the columns of a signal and an array ``theaters``. ``count`` is what severity is relative to,
    NULL for signals with a severity of their own. Whatever the peak turns out to be, it never
    changes the order among the signals of one source, so the top of tops is exact.
    """
    told = signals.withColumn("told", count.cast("double")).withColumn("dt", F.col("observed_at").cast("date"))
    # Both kinds of order stay apart, as a day's parts are cut per source.
    weight = F.when(F.col("told").isNotNull(), F.greatest("told", F.lit(0.0))).otherwise(F.col("severity"))
    placed = told.withColumn("theater", F.explode("theaters")).drop("theaters").withColumn("weight", weight)
    top = top_k_per_group(placed, ["theater", "source", "dt"], [F.desc("weight"), *map(F.asc, ORDER)], k, spread=["id"])
    peaks = told.groupBy("dt").agg(F.max("told").alias("told"))
    return top.drop("rank", "weight").unionByName(peaks, allowMissingColumns=True)


def strongest_now(parts: DataFrame, k: int = fv.SIGNAL_CAP) -> DataFrame:
    """The ``k`` strongest signals per theater, from the parts of any days."""
    peak = parts.agg(F.coalesce(F.max(F.when(F.col("told") > 0, F.col("told"))), F.lit(1.0))).scalar()
    scored = parts.filter(F.col("theater").isNotNull()).withColumn("severity", F.when(
        F.col("told").isNotNull(), severity_by_share(F.col("told"), peak)).otherwise(F.col("severity")))
    return top_k_per_group(scored, ["theater"], [F.desc("severity"), *map(F.asc, ORDER)], k).drop("told")


# --- Pressure ----------------------------------------------------------------

def pressure_parts(signals: DataFrame, count: str = "count") -> DataFrame:
    """Per theater, code and day: count, sum of roots and peak; and per day the peak of all rows.

    ``signals`` has ``theaters`` (array), ``code`` and ``observed_at``.
    """
    dated = signals.withColumn("dt", F.col("observed_at").cast("date"))
    placed = dated.filter(F.col("code").isNotNull()).withColumn("theater", F.explode("theaters"))
    own = pressure.share_parts(placed, ["theater", "code", "dt"], count)
    positive = F.when(F.col(count) > 0, F.col(count).cast("double"))
    return own.unionByName(dated.groupBy("dt").agg(F.max(positive).alias("peak")), allowMissingColumns=True)


def pressure_now(parts: DataFrame, members: DataFrame) -> DataFrame:
    """The pressure index from the parts of any days; severities are scaled by those days' peak."""
    keys = ["theater", "code"]
    tallied = pressure.finish_share_tally(pressure.merge_share_parts(parts, keys))
    return pressure.pressure_index(tallied.filter(F.col("theater").isNotNull()), members, keys)


# --- Volume ------------------------------------------------------------------

def volume_parts(rows: DataFrame, stamp: str, subject: str, tone: str) -> DataFrame:
    """Per subject and day: count and summed tone."""
    return rows.groupBy(F.col(stamp).cast("date").alias("dt"), F.col(subject).alias("subject")).agg(
        F.count("*").alias("count"), F.sum(tone).alias("tone_sum"))


def volume_now(parts: DataFrame) -> DataFrame:
    return parts.groupBy("dt", "subject").agg(F.sum("count").alias("count"), F.sum("tone_sum").alias("tone_sum"))


# --- Status ------------------------------------------------------------------

def status_parts(log: DataFrame, keys: Sequence[str], at: str, good: Column, ttl_seconds: int) -> DataFrame:
    """Spans of successes and the first fetch, per key and day; what ``status_of_spans`` needs."""
    return success_spans(log.withColumn("dt", F.col(at).cast("date")), [*keys, "dt"], at, good, ttl_seconds)
