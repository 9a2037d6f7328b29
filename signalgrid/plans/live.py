"""Answers from a committed table of fetched signals, as of any moment.

A theater's density features are fetched under the theater's id and its subjects' conflict
records under the subjects' codes; each fetch brings what is new. The answer at a moment stands on the newest
good fetch of each key, however old, and on good fetches before it as far as the look-back reaches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from signalgrid import dims, fixed_values as fv
from signalgrid.dims import THEATER_BOXES
from signalgrid.functions.clock import moment
from signalgrid.functions.geometry import inside
from signalgrid.operators.asof import as_of_time
from signalgrid.operators.freshness import feed_state
from signalgrid.operators.merge import seed_signals
from signalgrid.operators.ranking import top_k_per_group
from signalgrid.plans import payloads
from signalgrid.sources.batches import ROW, fetch_log, part_of
from signalgrid.sources.signals import SIGNAL

LOOKBACK_DAYS = {fv.SOURCE_GEO: fv.EVENT_LOOKBACK_DAYS, fv.SOURCE_CONFLICT: fv.CONFLICT_LOOKBACK_DAYS}


def last_good_answer(asks: DataFrame, log: DataFrame, rows: DataFrame, bucket: str = "day") -> DataFrame:
    """For each ask (source, key, as_of): the rows of the newest good batch up to then.

    ``log`` is the log of committed batches and ``rows`` the rows of all batches, so a failed fetch changes
    nothing and a half-written batch is not there. An ask without a good batch before it has no rows, and
    neither has one whose last good batch was empty. A batch written again under another name counts once, by
    its larger name. Adds ``last_good`` and ``batch`` to the rows; two asks may share a batch.
    """
    keys = ["source", "key"]
    good = log.filter("ok").groupBy(*keys, "at").agg(F.max("batch").alias("batch"))
    served = as_of_time(asks, good, keys, "as_of", "at", bucket, out="last_good")
    chosen = served.filter(F.col("last_good").isNotNull()).join(
        good.withColumnRenamed("at", "last_good"), [*keys, "last_good"])
    return chosen.join(rows.withColumnRenamed("at", "last_good"), [*keys, "last_good", "batch"])


def live_signals(signals: DataFrame, log: DataFrame, as_of: str) -> DataFrame:
    """Signals of all good fetches that the look-back of the newest good one reaches.

    Conflict records are bound by their own day, inclusive, and capped to the newest per subject
    asked for. Each key is anchored at its own last good fetch, so an outage does not empty its answer.
    """
    known = log.filter(F.col("ok") & (F.col("at") <= moment(as_of)))
    newest = known.groupBy("source", "key").agg(F.max("at").alias("anchor"))
    days = F.element_at(F.create_map(*[x for s, d in LOOKBACK_DAYS.items() for x in (F.lit(s), F.lit(d))]), F.col("source"))
    reach = known.groupBy("source", "key", "at").agg(F.max("batch").alias("batch")).join(newest, ["source", "key"])
    reach = reach.filter(F.datediff("anchor", "at") <= days).filter(
        (F.col("source") != fv.SOURCE_GEO) | (F.col("at") > F.col("anchor") - F.make_dt_interval(days)))
    rows = signals.join(reach, ["source", "key", "at", "batch"])
    geo = rows.filter(F.col("source") == fv.SOURCE_GEO)
    day = F.col("observed_at").cast("date")
    conflict = rows.filter((F.col("source") == fv.SOURCE_CONFLICT) & day.between(
        F.date_sub("anchor", fv.CONFLICT_LOOKBACK_DAYS), F.col("anchor").cast("date")))
    capped = top_k_per_group(
        conflict, ["key"], [F.desc("observed_at"), F.asc("pos"), F.asc("id")], fv.CONFLICT_CAP, spread=["id"])
    return geo.unionByName(capped.drop("rank"))


def placed_signals(signals: DataFrame, members: DataFrame) -> DataFrame:
    """Density signals inside the box of the theater asked for; conflict signals of its members."""
    lon, lat = F.col("lon"), F.col("lat")
    held = [(F.col("key") == b.code) & inside(lon, lat, b.west, b.south, b.east, b.north) for b in THEATER_BOXES]
    own = held[0]
    for test in held[1:]:
        own = own | test
    geo = signals.filter((F.col("source") == fv.SOURCE_GEO) & own).withColumn("theater", F.col("key"))
    member = members.select("theater", F.col("code").alias("key"), F.col("position").alias("_position"))
    conflict = signals.filter(F.col("source") == fv.SOURCE_CONFLICT).join(member, "key")
    conflict = conflict.withColumn("subject_priority", F.col("_position")).drop("_position")
    return geo.unionByName(conflict)


def theater_status(log: DataFrame, as_of: Column) -> DataFrame:
    """Status of each theater from its own fetches; sources fail one by one."""
    mine = log.filter(F.col("source") == fv.SOURCE_GEO)
    state = feed_state(mine, ["key"], "at", F.col("ok"), "n_rows", as_of, fv.TTL_SECONDS["events"],
                       ties=["n_rows"], otherwise="degraded")
    return state.select(F.col("key").alias("theater"), "status")


def events_answers(spark: SparkSession, table: str, as_of: str, theater: str | None = None) -> DataFrame:
    """The events answer of every theater, or of one, from a table of batches.

    Bodies landed by ``batches.land`` of ``signal_parts`` are all it needs.
    """
    theaters, members = dims.dim_theater(spark), dims.theater_subject(spark)
    log, signals = fetch_log(spark, table), part_of(spark, table, ROW, SIGNAL)
    if theater is not None:
        name = dims.resolve_theater(theater)
        theaters, members = (d.filter(F.col("theater") == name) for d in (theaters, members))
        codes = [name] + [c for row in fv.THEATERS if row[0] == name for c in row[3]]
        log, signals = (d.filter(F.col("key").isin(codes)) for d in (log, signals))
    placed = placed_signals(live_signals(signals, log, as_of), members)
    picture = payloads.events_picture(placed, seed_signals(spark), theaters)
    return payloads.events_payload(
        picture, theaters, dims.dim_subject(spark), members, theater_status(log, moment(as_of)), moment(as_of))
