"""The four questions a dashboard asks, answered from canonical tables.

``log`` is the fetch log: key, at, ok, n_rows. Keys are ``<kind>:<subject>``, for
example ``events:middle-east``. Filters on the theater or subject come first, so
only that part of a partitioned table is read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from signalgrid import dims, fixed_values as fv
from signalgrid.functions.clock import moment, since_date, within_days
from signalgrid.operators.freshness import feed_state
from signalgrid.operators.merge import seed_signals
from signalgrid.operators.ranking import top_k_per_group
from signalgrid.operators.timeline import timeline
from signalgrid.plans import payloads


def fetch_status(
    log: DataFrame, kind: str, name: str, out: str, as_of: str, otherwise: str = "offline"
) -> DataFrame:
    """Status of one kind of answer for one theater or subject."""
    mine = log.filter(F.col("key") == f"{kind}:{name}")
    state = feed_state(
        mine, ["key"], "at", F.col("ok"), "n_rows", moment(as_of),
        fv.TTL_SECONDS[kind], ties=["n_rows"], otherwise=otherwise)
    return state.select(F.substring_index("key", ":", -1).alias(out), "status")


def _until(df: DataFrame, stamp: str, as_of: str) -> DataFrame:
    """Rows that are not later than ``as_of``; those without a time stay."""
    return df.filter(~F.coalesce(F.col(stamp) > moment(as_of), F.lit(False)))


def _recent(signals: DataFrame, as_of: str) -> DataFrame:
    """Signals inside their source's look-back, and of conflict records the newest per subject.

    Density features count for a day; conflict records by their day for two weeks, up to the cap.
    """
    known = _until(signals, "observed_at", as_of)
    at, conflict = F.col("observed_at"), F.col("source") == fv.SOURCE_CONFLICT
    inside = F.when(conflict, since_date(at, as_of, fv.CONFLICT_LOOKBACK_DAYS)).otherwise(
        within_days(at, as_of, fv.EVENT_LOOKBACK_DAYS))
    recent = known.filter(F.coalesce(inside, F.lit(True)))
    capped = top_k_per_group(
        recent.filter(conflict), ["theater", "nation"], [F.desc_nulls_last("observed_at"), F.asc("pos"), F.asc("id")],
        fv.CONFLICT_CAP, spread=["id"]).drop("rank")
    return recent.filter(~F.coalesce(conflict, F.lit(False))).unionByName(capped)


def _theater(df: DataFrame, name: str) -> DataFrame:
    return df.filter(F.col("theater") == name)


def events(signals: DataFrame, log: DataFrame, as_of: str, theater: str | None = None) -> DataFrame:
    """Strongest signals, arcs and subject metrics of a theater; unknown means default."""
    name = dims.resolve_theater(theater)
    spark = signals.sparkSession
    theaters = _theater(dims.dim_theater(spark), name)
    recent = _recent(_theater(signals, name), as_of)
    picture = payloads.events_picture(recent, seed_signals(spark), theaters)
    return payloads.events_payload(
        picture, theaters, dims.dim_subject(spark), _theater(dims.theater_subject(spark), name),
        fetch_status(log, "events", name, "theater", as_of, "degraded"), moment(as_of))


def feed(articles: DataFrame, log: DataFrame, as_of: str, theater: str | None = None) -> DataFrame:
    """Newest matching articles of a theater, attributed to subjects."""
    name = dims.resolve_theater(theater)
    routes = [q for q in dims.THEATER_QUERIES if q.code == name]
    recent = articles.filter(within_days(F.col("seen"), as_of, fv.ARTICLE_LOOKBACK_DAYS))
    return payloads.items_payload(
        payloads.feed_items(recent, routes), _theater(dims.dim_theater(articles.sparkSession), name),
        fetch_status(log, "feed", name, "theater", as_of), moment(as_of), fv.NOTE_FEED)


def situation(
    reports: DataFrame, log: DataFrame, as_of: str, theater: str | None = None
) -> DataFrame:
    """Newest situation reports on the subjects of a theater."""
    name = dims.resolve_theater(theater)
    spark = reports.sparkSession
    members = _theater(dims.theater_subject(spark), name)
    return payloads.items_payload(
        payloads.situation_items(_until(reports, "seen", as_of), members), _theater(dims.dim_theater(spark), name),
        fetch_status(log, "situation", name, "theater", as_of), moment(as_of),
        fv.NOTE_SITUATION)


def pulse(series: DataFrame, log: DataFrame, as_of: str, subject: str) -> DataFrame:
    """Volume and tone timelines of a subject; an unknown subject is an error."""
    code = dims.resolve_subject(subject)
    recent = series.filter(
        (F.col("subject") == code) & within_days(F.col("t"), as_of, fv.PULSE_LOOKBACK_DAYS))
    subjects = dims.dim_subject(series.sparkSession).select(
        F.col("code").alias("subject")).filter(F.col("subject") == code)
    return payloads.pulse_payload(
        recent, subjects, fetch_status(log, "pulse", code, "subject", as_of), moment(as_of))


def subject_timeline(articles: DataFrame, as_of: str, width: str = "1 day") -> DataFrame:
    """Volume and tone series of every subject from attributed articles.

    ``articles`` has seen, nation and tone; the result is what ``pulse`` reads.
    """
    recent = articles.filter(
        within_days(F.col("seen"), as_of, fv.PULSE_LOOKBACK_DAYS) & F.col("nation").isNotNull())
    counted = timeline(recent, "seen", "nation", "tone", width)
    placed = counted.withColumn(
        "pos", F.row_number().over(Window.partitionBy("subject").orderBy("t")).cast("bigint"))
    both = F.create_map(F.lit("volume"), F.col("volume"), F.lit("tone"), F.col("tone"))
    return placed.select("subject", "pos", "t", F.explode(both).alias("metric", "v"))
