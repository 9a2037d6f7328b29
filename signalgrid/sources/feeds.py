"""The five feeds: from parsed documents to canonical rows.

Every function takes documents (``origin``, ``doc`` and pass-through columns) and
returns rows; ``pos`` is the place in the document's array.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from signalgrid import fixed_values as fv
from signalgrid.dims import SUBJECT_BOXES, Box
from signalgrid.functions.clock import compact_timestamp, moment
from signalgrid.functions.display import signal_id
from signalgrid.functions.scoring import severity_by_fatalities, severity_by_share
from signalgrid.functions.text import host_of, present
from signalgrid.operators.zones import attribute_zones

DECIMAL = r"^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$"


def geo_entry(feature: Column) -> Column:
    """A density feature as (lon, lat, name, told, toll, day); each path is read once."""
    return F.struct(
        F.try_variant_get(feature, "$.geometry.coordinates[0]", "double").alias("lon"),
        F.try_variant_get(feature, "$.geometry.coordinates[1]", "double").alias("lat"),
        F.coalesce(F.try_variant_get(feature, "$.properties.name", "string"), F.lit(fv.UNKNOWN_PLACE)).alias("name"),
        number(F.try_variant_get(feature, "$.properties.count", "string")).alias("told"),
        F.lit(None).cast("double").alias("toll"), F.lit(None).cast("date").alias("day"),
    )


def conflict_entry(record: Column, asked: Column) -> Column:
    """A conflict record in the same shape; a toll that is no number counts as zero."""
    told = number(record["fatalities"])
    kind = F.coalesce(record["sub_event_type"], record["event_type"], F.lit(fv.UNKNOWN_EVENT))
    return F.struct(
        number(record["longitude"]).alias("lon"), number(record["latitude"]).alias("lat"),
        F.concat_ws(" — ", kind, F.coalesce(record["location"], asked)).alias("name"),
        F.lit(None).cast("double").alias("told"),
        F.when(usable(told) & (told > 0), told).otherwise(F.lit(0.0)).alias("toll"),
        record["event_date"].try_cast("date").alias("day"),
    )


def geo_signals(
    docs: DataFrame, zones: Sequence[Box] | DataFrame = SUBJECT_BOXES, carry: Sequence[str] = ()
) -> DataFrame:
    """Density features as signals; severity is relative to the document's peak.

    The peak is taken over all features, also those dropped here or clipped later. ``zones`` is a list of a
    few boxes or a table of zones of any size. Columns of the documents named in ``carry`` stay.
    """
    # Exploding a one-element array keeps the reading in one place, before the peak and the rows.
    read = docs.select("origin", *carry, F.explode(F.array(F.transform("doc.features", geo_entry))).alias("entries"))
    counts = F.filter(F.transform("entries", lambda e: e["told"]), lambda c: c > 0)
    rows = read.select(
        "origin", *carry, F.coalesce(F.array_max(counts), F.lit(1.0)).alias("peak"),
        F.posexplode("entries").alias("pos", "e"),
    ).select("origin", *carry, "peak", "pos", "e.*").filter(usable(F.col("lon")) & usable(F.col("lat")))
    count = F.coalesce("told", F.lit(0.0))
    return attribute_zones(rows, zones, "nation").select(
        signal_id(F.lit(fv.SOURCE_GEO), F.col("origin"), F.col("pos")).alias("id"),
        "origin", F.col("pos").cast("bigint").alias("pos"), "lat", "lon", "name",
        count.try_cast("bigint").alias("count"), "nation",
        severity_by_share(count, F.col("peak")).alias("severity"),
        F.lit(fv.SOURCE_GEO).alias("source"), *carry,
    )


def usable(value: Column) -> Column:
    return value.isNotNull() & ~F.isnan(value) & (F.abs(value) < float("inf"))


def number(text: Column) -> Column:
    """A decimal number, NULL for anything else, such as ``12d`` or a blank."""
    plain = F.trim(text)
    return F.when(plain.rlike(DECIMAL), plain.try_cast("double"))


def conflict_signals(docs: DataFrame, zones: Sequence[Box] | DataFrame = SUBJECT_BOXES) -> DataFrame:
    """Conflict records, whose numbers arrive as text, as signals.

    ``docs`` carries ``asked``, the country asked for.  Rows without usable
    coordinates are dropped; a toll that is no number counts as zero. ``zones`` is a list of a few
    boxes or a table of zones of any size.
    """
    rows = docs.select("origin", "asked", F.posexplode("doc.data").alias("pos", "r")).select(
        "origin", "pos", conflict_entry(F.col("r"), F.col("asked")).alias("e")
    ).select("origin", "pos", "e.*").filter(usable(F.col("lat")) & usable(F.col("lon")))
    return attribute_zones(rows, zones, "nation").select(
        signal_id(F.lit(fv.SOURCE_CONFLICT), F.col("origin"), F.col("pos")).alias("id"),
        "origin", F.col("pos").cast("bigint").alias("pos"), "lat", "lon", "name",
        (1 + F.col("toll")).try_cast("bigint").alias("count"), "nation",
        severity_by_fatalities(F.col("toll")).alias("severity"),
        F.lit(fv.SOURCE_CONFLICT).alias("source"),
        F.col("day").alias("event_date"),
    )


def article_items(docs: DataFrame, as_of: str | Column) -> DataFrame:
    """Articles as feed items; a stamp that is no time becomes ``as_of``, a moment or a column of the documents."""
    rows = docs.select("origin", moment(as_of).alias("as_of"), F.posexplode("doc.articles").alias("pos", "a"))
    stamp = compact_timestamp(F.col("a.seendate"))
    return rows.filter(present(F.col("a.url"), F.col("a.title"))).select(
        signal_id(F.lit("art"), F.col("origin"), F.col("pos")).alias("id"),
        "origin", F.col("pos").cast("bigint").alias("pos"),
        F.col("a.title").alias("title"), F.col("a.url").alias("url"),
        F.coalesce(F.col("a.domain"), host_of(F.col("a.url"))).alias("domain"),
        F.coalesce("a.sourcecountry", F.lit(fv.UNKNOWN_COUNTRY)).alias("country"),
        F.coalesce(stamp, "as_of").alias("seen"),
        stamp.isNotNull().alias("seen_ok"),
        F.lit(None).cast("string").alias("nation"),
    )


def report_items(docs: DataFrame, as_of: str | Column) -> DataFrame:
    """Situation reports as feed items.

    ``docs`` carries ``asked`` (the country asked for) and ``nation`` (its code).
    """
    rows = docs.select(
        "origin", "asked", "nation", moment(as_of).alias("as_of"), F.posexplode("doc.data.fields").alias("pos", "f")
    )
    stamp = F.col("f.date.created").try_cast("timestamp")
    return rows.filter(present(F.col("f.url"), F.col("f.title"))).select(
        signal_id(F.lit("rw"), F.col("origin"), F.col("pos")).alias("id"),
        "origin", F.col("pos").cast("bigint").alias("pos"),
        F.col("f.title").alias("title"), F.col("f.url").alias("url"),
        F.coalesce(
            F.try_element_at("f.source", F.lit(1))["shortname"], F.lit(fv.DEFAULT_REPORT_DOMAIN)
        ).alias("domain"),
        F.coalesce(F.try_element_at("f.country", F.lit(1))["name"], "asked").alias("country"),
        F.coalesce(stamp, "as_of").alias("seen"),
        stamp.isNotNull().alias("seen_ok"),
        "nation",
    )


def timeline_points(docs: DataFrame, as_of: str | Column) -> DataFrame:
    """Points of each document's first series; a missing value or one that is no number is zero.

    ``docs`` carries ``subject`` and ``metric``.
    """
    series = F.try_element_at("doc.timeline", F.lit(1))["data"]
    points = docs.select("subject", "metric", moment(as_of).alias("as_of"), F.posexplode(series).alias("pos", "p"))
    stamp = compact_timestamp(F.col("p.date"))
    return points.select(
        "subject", "metric", F.col("pos").cast("bigint").alias("pos"),
        F.coalesce(stamp, "as_of").alias("t"),
        F.coalesce(number(F.col("p.value")), F.lit(0.0)).alias("v"),
    )
