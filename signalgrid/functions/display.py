"""Report projections as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from signalgrid import fixed_values as fv


def percent(share: Column) -> Column:
    return F.round(share * 100, 0)


def bar_width(share: Column, least: float) -> Column:
    return F.greatest(F.lit(float(least)), share * 100)


def day_label(stamp: Column) -> Column:
    return F.date_format(stamp, "MM-dd")


def short_title(title: Column, width: int = fv.TITLE_WIDTH) -> Column:
    cut = F.concat(F.substring(title, 1, width), F.lit("…"))
    return F.when(F.length(title) > width, cut).otherwise(title)


def coordinate(value: Column) -> Column:
    return F.round(value, 3)


def arrow_label(origin: Column, target: Column) -> Column:
    return F.concat_ws(" → ", origin, target)


def signal_id(*parts: Column) -> Column:
    """Stable key of a record from its source, its document and its place in it."""
    return F.sha2(F.concat_ws("|", *[p.cast("string") for p in parts]), 256)
