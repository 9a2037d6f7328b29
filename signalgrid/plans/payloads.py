"""The four answers, as one nested row per theater or subject.

Inputs may be of any size; each is cut to its fixed cap per theater before
anything is nested, so the arrays stay small.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from signalgrid import fixed_values as fv
from signalgrid.dims import SUBJECT_KEYWORDS, THEATER_QUERIES, Keywords
from signalgrid.functions.text import first_keyword
from signalgrid.operators.arcs import adversary_pairs, tension_arcs
from signalgrid.operators.keywords import route_by_mention
from signalgrid.operators.merge import with_fallback_capped
from signalgrid.operators.pressure import pressure_index, tally
from signalgrid.operators.ranking import hottest, last_by_position, top_k_per_group
from signalgrid.session import written

EVENT_FIELDS = ("id", "lat", "lon", "name", "count", "nation", "severity", "source")
ITEM_FIELDS = ("id", "title", "url", "domain", "country", "seen", "nation")


def signal_order() -> list[Column]:
    """Most severe first; ties keep conflict rows before density rows, then input order."""
    return [
        F.desc("severity"), F.asc("source_rank"), F.asc("subject_priority"),
        F.asc("pos"), F.asc("id"),
    ]


def newest_first() -> list[Column]:
    """Newest first; ties keep input order."""
    return [F.desc("seen"), F.asc("pos"), F.asc("id")]


def nested(df: DataFrame, key: str, order: str, fields: Sequence[str], out: str) -> DataFrame:
    """Rows of a capped table as one ordered array per key."""
    entry = F.struct(F.col(order).alias("_order"), *fields)
    ordered = F.sort_array(F.collect_list(entry))
    return df.groupBy(key).agg(
        F.transform(ordered, lambda e: F.struct(*[e[f].alias(f) for f in fields])).alias(out)
    )



def _note(live: Column, text: str) -> Column:
    return F.when(~live, F.lit(text))


def events_picture(
    live: DataFrame, seeds: DataFrame, theaters: DataFrame, cap: int = fv.SIGNAL_CAP
) -> DataFrame:
    """The strongest live signals per theater, or the reference hotspots if none.

    At most ``cap`` rows per theater.  Several parts of the answer read it, so it is
    written once.
    """
    capped = top_k_per_group(live, ["theater"], signal_order(), cap, spread=["id"])
    placed = seeds.withColumn("rank", F.col("pos") + 1)
    return written(with_fallback_capped(capped, placed, theaters, "theater"), "picture")


def events_payload(
    picture: DataFrame,
    theaters: DataFrame,
    subjects: DataFrame,
    members: DataFrame,
    status: DataFrame,
    as_of: Column,
) -> DataFrame:
    """Events, arcs and subject metrics per theater.

    ``status`` has theater and status; without live rows the status is degraded.
    """
    coded = picture.filter(F.col("nation").isNotNull()).withColumnRenamed("nation", "code")
    events = nested(picture, "theater", "rank", EVENT_FIELDS, "events")
    hot = hottest(coded, ["theater", "code"], ["lon", "lat"], [-F.col("rank")])
    arcs = tension_arcs(adversary_pairs(subjects, members), hot)
    metrics = pressure_index(tally(coded, ["theater", "code"]), members)
    liveness = picture.groupBy("theater").agg(
        F.max("live").alias("live"), F.max("observed_at").alias("data_at")
    )
    arc_fields = ("arc_id", "from_lon", "from_lat", "to_lon", "to_lat", "label",
                  "intensity", "derived")
    live = F.coalesce(F.col("live"), F.lit(False))
    return (
        theaters.select("theater")
        .join(liveness, "theater", "left")
        .join(events, "theater", "left")
        .join(nested(arcs, "theater", "position", arc_fields, "arcs"), "theater", "left")
        .join(nested(metrics, "theater", "position",
                     ("code", "events", "score", "threat"), "nations"), "theater", "left")
        .join(status, "theater", "left")
        .select(
            "theater",
            F.when(live, F.coalesce("status", F.lit("degraded")))
            .otherwise(F.lit("degraded")).alias("status"),
            "events", "arcs", "nations",
            "data_at", as_of.alias("updated_at"), _note(live, fv.NOTE_EVENTS).alias("note"),
        )
    )


def feed_items(
    articles: DataFrame,
    routes: Sequence[Keywords] = THEATER_QUERIES,
    keywords: Sequence[Keywords] = SUBJECT_KEYWORDS,
    cap: int = fv.ARTICLE_CAP,
) -> DataFrame:
    """Newest articles per theater whose query they match, attributed to subjects."""
    routed = route_by_mention(articles, F.col("title"), routes, "theater")
    newest = top_k_per_group(routed, ["theater"], newest_first(), cap, spread=["id"])
    own = first_keyword(F.concat_ws(" ", "country", "title"), keywords)
    return newest.withColumn("nation", F.coalesce(own, F.col("nation")))


def situation_items(
    reports: DataFrame,
    members: DataFrame,
    per_subject: int = fv.REPORT_CAP_PER_SUBJECT,
    cap: int = fv.REPORT_CAP,
) -> DataFrame:
    """Newest reports per subject, then per theater; ties follow the subjects' order."""
    newest = top_k_per_group(
        reports, ["nation"], newest_first(), per_subject, spread=["id"]).drop("rank")
    member = members.select("theater", F.col("code").alias("nation"), "position")
    order = [F.desc("seen"), F.asc("position"), F.asc("pos"), F.asc("id")]
    return top_k_per_group(newest.join(member, "nation"), ["theater"], order, cap)


def items_payload(
    items: DataFrame, theaters: DataFrame, status: DataFrame, as_of: Column, note: str
) -> DataFrame:
    """Ranked feed items per theater; without items the status is offline."""
    listed = nested(items, "theater", "rank", ITEM_FIELDS, "items")
    live = F.size(F.coalesce(F.col("items"), F.array())) > 0
    return (
        theaters.select("theater")
        .join(listed, "theater", "left")
        .join(status, "theater", "left")
        .select(
            "theater",
            F.when(live, F.coalesce("status", F.lit("degraded")))
            .otherwise(F.lit("offline")).alias("status"),
            "items", as_of.alias("updated_at"), _note(live, note).alias("note"),
        )
    )


def pulse_payload(
    series: DataFrame, subjects: DataFrame, status: DataFrame, as_of: Column
) -> DataFrame:
    """Volume and tone timelines and the latest tone per subject.

    ``series`` has subject, metric (volume or tone), pos, t and v.
    """
    parts = {}
    for metric in ("volume", "tone"):
        rows = series.filter(F.col("metric") == metric)
        parts[metric] = nested(rows, "subject", "pos", ("t", "v"), metric)
    now = last_by_position(
        series.filter(F.col("metric") == "tone"), ["subject"], "pos", "v", "tone_now"
    )
    live = F.col("volume").isNotNull() | F.col("tone").isNotNull()
    return (
        subjects.select("subject")
        .join(parts["volume"], "subject", "left")
        .join(parts["tone"], "subject", "left")
        .join(now, "subject", "left")
        .join(status, "subject", "left")
        .select(
            "subject",
            F.when(live, F.coalesce("status", F.lit("degraded")))
            .otherwise(F.lit("offline")).alias("status"),
            "volume", "tone", F.coalesce("tone_now", F.lit(0.0)).alias("tone_now"),
            as_of.alias("updated_at"), _note(live, fv.NOTE_PULSE).alias("note"),
        )
    )
