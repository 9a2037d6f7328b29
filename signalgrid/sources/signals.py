"""From landing bodies of several feeds to canonical signals, in one parse.

``asked`` lists what was fetched: origin, source, key (theater or subject asked for), asked (the
subject's name) and at. A body that never came is found by its absence.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from signalgrid import fixed_values as fv
from signalgrid.dims import SUBJECT_BOXES, Box
from signalgrid.functions.display import signal_id
from signalgrid.functions.scoring import severity_by_fatalities, severity_by_share
from signalgrid.operators.zones import attribute_zones
from signalgrid.schemas import CONFLICT_DOCUMENT, GEO_DOCUMENT
from signalgrid.sources.batches import ASIDE, FETCH, PART, ROW
from signalgrid.sources.feeds import conflict_entry, geo_entry, usable
from signalgrid.sources.landing import parse_bodies

DOCUMENT = f"{GEO_DOCUMENT}, {CONFLICT_DOCUMENT}"
# What a signal carries besides the columns of every canonical signal.
SIGNAL = (
    "source string, key string, at timestamp, origin string, pos bigint, id string, lat double, lon double, "
    "name string, count bigint, nation string, severity double, source_rank int, subject_priority int, "
    "observed_at timestamp"
)


def signal_parts(
    asked: DataFrame, bodies: DataFrame, zones: Sequence[Box] | DataFrame = SUBJECT_BOXES
) -> DataFrame:
    """One row per body asked for, one per signal in it, and one per body set aside.

    Both feeds go through one parse and one explode: a body's entries become the same struct
    whatever its source, behind a head entry that stands for the fetch itself. ``part`` tells the rows
    apart. Signals have the columns of ``SIGNAL``; a conflict record was observed on its day, a density
    feature when it was fetched. Severity is relative to the peak of the feature's own body. A body
    may be missing, empty, markup or malformed; that costs only itself, and a feature or record
    without usable coordinates only itself as well. ``zones`` is a list of a few boxes or a table of zones
    of any size.
    """
    here = bodies.select("origin", "body", F.lit(True).alias("arrived"))
    parsed = parse_bodies(asked.join(here, "origin", "left"), DOCUMENT)
    reason = F.when(F.col("arrived").isNull(), F.lit("missing")).otherwise(F.col("reason"))
    geo = F.col("source") == fv.SOURCE_GEO
    found = F.when(geo, F.transform("doc.features", geo_entry)).otherwise(
        F.transform("doc.data", lambda r: conflict_entry(r, F.col("asked"))))
    # Taken once per body: a later use of the entries would otherwise read every path again.
    read = parsed.withColumn("reason", reason).withColumn("entries", F.explode(F.array(
        F.coalesce(found, F.array().cast(found_type())))))
    told = F.filter("entries", lambda e: usable(e["lon"]) & usable(e["lat"]))
    peak = F.coalesce(F.array_max(F.filter(F.transform("entries", lambda e: e["told"]), lambda c: c > 0)), F.lit(1.0))
    heads = F.array(F.lit(None).cast(found_type()[6:-1]))
    rows = read.select(
        "origin", "source", "key", "at", "reason", "body", F.size(told).cast("bigint").alias("n_rows"),
        peak.alias("peak"), F.posexplode(F.concat(heads, "entries")).alias("place", "e"))
    head = F.col("place") == 0
    rows = rows.filter(head | (usable(F.col("e.lon")) & usable(F.col("e.lat"))))
    kind = F.when(~head, F.array(F.lit(ROW))).when(
        F.col("reason").isNull() | (F.col("reason") == "missing"), F.array(F.lit(FETCH))).otherwise(
        F.array(F.lit(FETCH), F.lit(ASIDE)))
    flat = rows.select("*", "e.*", F.explode(kind).alias(PART))
    pos = (F.col("place") - 1).cast("bigint")
    signal = F.col(PART) == ROW
    geo = F.col("source") == fv.SOURCE_GEO
    priority = F.coalesce(*[F.when(F.col("key") == b.code, F.lit(b.priority)) for b in SUBJECT_BOXES], F.lit(len(SUBJECT_BOXES)))

    def of_signal(value: Column) -> Column:
        return F.when(signal, value)

    told = flat.select(
        PART, "source", "key", "at", "origin", "reason", "n_rows",
        F.when(F.col(PART) == ASIDE, F.col("body")).alias("body"),
        of_signal(pos).alias("pos"),
        of_signal(signal_id(F.col("source"), F.col("origin"), pos)).alias("id"), "lat", "lon", "name",
        of_signal(F.when(geo, F.coalesce("told", F.lit(0.0))).otherwise(1 + F.col("toll")).try_cast("bigint")).alias("count"),
        of_signal(F.when(geo, severity_by_share(F.col("told"), F.col("peak"))).otherwise(
            severity_by_fatalities(F.col("toll")))).alias("severity"),
        of_signal(F.when(geo, F.lit(1)).otherwise(F.lit(0))).alias("source_rank"),
        of_signal(F.when(geo, F.lit(0)).otherwise(priority)).alias("subject_priority"),
        of_signal(F.when(geo, F.col("at")).otherwise(F.col("day").cast("timestamp"))).alias("observed_at"),
    )
    # Attributed last, when rows no longer carry the body they came from; a head has no place and no nation.
    names = told.columns
    after = names.index("count") + 1
    return attribute_zones(told, zones, "nation").select(*names[:after], "nation", *names[after:])


def found_type() -> str:
    return "array<struct<lon:double,lat:double,name:string,told:double,toll:double,day:date>>"
