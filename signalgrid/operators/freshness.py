"""Freshness of answers and last-known-good values over a log of fetches.

A fetch log has a key, a time, an ``ok`` flag and the number of rows fetched.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from signalgrid.operators.asof import as_of_time


def _age_limit(stamp: Column, seconds: int) -> Column:
    return stamp + F.expr(f"INTERVAL {int(seconds)} SECONDS")


def freshness(
    log: DataFrame, key: str, at: str, ok: Column, as_of: Column, ttl_seconds: int
) -> DataFrame:
    """Time of the last success up to ``as_of`` per key and whether it still counts as fresh."""
    last = log.groupBy(key).agg(F.max(F.when(ok & (F.col(at) <= as_of), F.col(at))).alias("last_ok"))
    fresh = as_of <= _age_limit(F.col("last_ok"), ttl_seconds)
    return last.withColumn("fresh", F.coalesce(fresh, F.lit(False)))


def last_known_good(
    log: DataFrame, key: str, at: str, ok: Column, bucket: str = "hour"
) -> DataFrame:
    """For every fetch, the time of the newest success so far for its key.

    A plain running window would put a whole key in one task.  Here each key is
    cut into calendar buckets: rows only look back inside their own bucket, and the
    best earlier success comes from a per-bucket summary joined back on.  Fetches
    without a time are kept, with no answer.
    """
    stamped = log.withColumn("_bucket", F.date_trunc(bucket, at)).withColumn(
        "_good", F.when(ok, F.col(at))
    )
    per_bucket = stamped.groupBy(key, "_bucket").agg(F.max("_good").alias("_bucket_good"))
    earlier = Window.partitionBy(key).orderBy("_bucket").rowsBetween(
        Window.unboundedPreceding, -1
    )
    carried = per_bucket.select(
        key, "_bucket", F.max("_bucket_good").over(earlier).alias("_carried")
    )
    # RANGE frame: rows of equal time see each other, so no tie-break is needed.
    inside = Window.partitionBy(key, "_bucket").orderBy(at).rangeBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    running = stamped.withColumn("_running", F.max("_good").over(inside))
    good = F.coalesce("_running", "_carried")
    return running.join(carried, [key, "_bucket"], "left").select(
        *log.columns, good.alias("last_good")
    )


def feed_state(
    log: DataFrame,
    keys: Sequence[str],
    at: str,
    ok: Column,
    rows: str,
    as_of: Column,
    ttl_seconds: int,
    ties: Sequence[str] = (),
    otherwise: str = "offline",
) -> DataFrame:
    """Status per key: ok, degraded, or ``otherwise`` when nothing is on hand.

    Failures never erase the last good answer. Fetches after ``as_of`` count for nothing.
    """
    known = F.col(at) <= as_of
    newest = F.max_by(F.struct(at, rows), F.when(ok & known, F.struct(at, *ties)))
    state = log.groupBy(*keys).agg(newest.alias("good"), F.count_if(~ok & known).alias("failures"))
    live = F.coalesce(F.col(f"good.{rows}") > 0, F.lit(False))
    fresh = F.coalesce(
        as_of <= _age_limit(F.col(f"good.{at}"), ttl_seconds), F.lit(False)
    )
    status = (
        F.when(live & fresh, F.lit("ok"))
        .when(live, F.lit("degraded"))
        .otherwise(F.lit(otherwise))
    )
    return state.select(
        *keys, F.col(f"good.{at}").alias("last_ok"),
        F.col(f"good.{rows}").alias("rows_on_hand"), "failures", status.alias("status"),
    )


def success_spans(
    log: DataFrame, keys: Sequence[str], at: str, good: Column, ttl_seconds: int
) -> DataFrame:
    """Per key and period of the ttl's length: first and last success, and the first fetch at all.

    Successes of one period lie within the ttl of each other, so nothing is lost by keeping only the
    ends, and a busy key shrinks to one row per period before any shuffle. Spans of parts of a log may
    be put together in any way.
    """
    period = F.floor(F.unix_micros(F.col(at).cast("timestamp")) / (ttl_seconds * 1_000_000))
    when = F.when(F.coalesce(good, F.lit(False)), F.col(at))
    return log.filter(F.col(at).isNotNull()).groupBy(*keys, period.alias("_period")).agg(
        F.min(when).alias("first_good"), F.max(when).alias("last_good"), F.min(at).alias("first_at")).drop("_period")


def status_of_spans(
    spans: DataFrame, keys: Sequence[str], ttl_seconds: int, until: Column, bucket: str = "day"
) -> DataFrame:
    """Intervals of ok, degraded and offline per key, without gap or overlap.

    A key is ok from a success until the ttl after it, that moment included, and as long as successes follow
    within it; then degraded, on its last good answer, until the next success; offline from its
    first fetch to its first success. Intervals end at ``until``; what is later counts for nothing.
    """
    until = until.cast("timestamp")
    cut = spans.filter(F.col("first_at") <= until)
    good = cut.filter(F.col("first_good") <= until).withColumn(
        "last_good", F.least("last_good", until)).withColumn("_start", F.col("first_good").cast("timestamp"))
    # One session per unbroken run of successes; each span keeps its session open for the ttl after its end.
    gap = F.concat((F.unix_micros(F.col("last_good").cast("timestamp")) - F.unix_micros("_start")
                    + F.lit(ttl_seconds * 1_000_000)).cast("string"), F.lit(" microseconds"))
    runs = good.groupBy(*keys, F.session_window("_start", gap).alias("_run")).agg(F.count("*").alias("_spans"))
    runs = runs.select(*keys, F.col("_run.start").alias("start"), F.col("_run.end").alias("end"))
    followed = as_of_time(runs, runs.select(*keys, F.col("start").alias("_next")), keys, "end", "_next", bucket, forward=True, out="next")
    after = F.coalesce("next", until)
    known = followed.select(*keys, F.explode(F.array(
        F.struct(F.lit("ok").alias("status"), F.col("start").alias("since"), F.least("end", until).alias("till")),
        F.struct(F.lit("degraded").alias("status"), F.col("end").alias("since"), after.alias("till")))).alias("i"))
    begun = cut.groupBy(*keys).agg(
        F.min(F.col("first_at").cast("timestamp")).alias("since"),
        F.coalesce(F.min(F.when(F.col("first_good") <= until, F.col("first_good").cast("timestamp"))), until).alias("till"))
    before = begun.select(*keys, F.struct(F.lit("offline").alias("status"), "since", "till").alias("i"))
    # An interval without length is none, but for an answer that came at the very end.
    real = (F.col("since") < F.col("till")) | ((F.col("status") == "ok") & (F.col("since") == until))
    return known.unionByName(before).select(*keys, "i.*").filter(real)


def status_intervals(
    log: DataFrame, keys: Sequence[str], at: str, good: Column, ttl_seconds: int, until: Column
) -> DataFrame:
    """Status over time from a fetch log; ``good`` says which fetches brought an answer.

    An empty answer is none if ``good`` says so: the last one that held rows is then served on.
    """
    early = log.filter(F.col(at) <= until)
    return status_of_spans(success_spans(early, keys, at, good, ttl_seconds), keys, ttl_seconds, until)


def missing_keys(expected: DataFrame, arrived: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Expected keys for which nothing arrived, such as zero-byte answers."""
    return expected.join(arrived.select(*keys).distinct(), list(keys), "left_anti")
