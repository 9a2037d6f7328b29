"""As-of lookups: for each ask, the time of the nearest fact of its key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F


def as_of_time(
    asks: DataFrame, facts: DataFrame, keys: Sequence[str], at: str, fact_at: str,
    bucket: str = "day", forward: bool = False, out: str = "found_at",
) -> DataFrame:
    """Add the newest time of a fact of the same keys that is not later than ``at``.

    ``forward`` asks for the earliest one that is not earlier instead. NULL if there is none, or if a
    key or ``at`` is NULL; every ask is kept, repeated ones too.

    A sort of a whole key would put a busy key in one task. Here keys are cut into calendar
    buckets: asks and facts meet inside their bucket only, and what lies in other buckets comes from a
    summary of one row per key and bucket. Only times travel; other fields of a fact are joined
    on keys and time afterwards.
    """
    best = F.min if forward else F.max
    ahead = (1, Window.unboundedFollowing) if forward else (Window.unboundedPreceding, -1)
    near = (0, Window.unboundedFollowing) if forward else (Window.unboundedPreceding, 0)
    # Windows would let NULL keys meet.
    fact = facts.dropna(subset=[*keys, fact_at]).select(
        *keys, F.date_trunc(bucket, fact_at).alias("_bucket"), F.col(fact_at).alias("_fact"))
    ask = asks.withColumn("_bucket", F.date_trunc(bucket, at)).withColumn("_asks", F.lit(True))
    # Asks have a row per bucket too, so that each finds what its bucket inherits.
    spots = fact.groupBy(*keys, "_bucket").agg(best("_fact").alias("_best")).unionByName(
        ask.select(*keys, "_bucket").distinct(), allowMissingColumns=True)
    spots = spots.groupBy(*keys, "_bucket").agg(best("_best").alias("_best"))
    beyond = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(*ahead)
    inherited = spots.select(*keys, "_bucket", best("_best").over(beyond).alias("_inherited"))
    both = ask.withColumn("_time", F.col(at)).unionByName(
        fact.withColumn("_time", F.col("_fact")), allowMissingColumns=True)
    inside = Window.partitionBy(*keys, "_bucket").orderBy("_time").rangeBetween(*near)
    own = both.withColumn("_own", best("_fact").over(inside)).filter(F.col("_asks"))
    found = own.join(inherited, [*keys, "_bucket"], "left")
    # A NULL time sorts first and would see later facts.
    return found.select(*asks.columns, F.when(
        F.col(at).isNotNull(), F.coalesce("_own", "_inherited")).alias(out))
