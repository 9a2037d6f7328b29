"""Timestamps and look-back windows as column expressions.

``as_of`` is always an argument, never the wall clock, so results repeat.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

ISO = "yyyy-MM-dd'T'HH:mm:ss'Z'"


def moment(as_of: str | Column, like: str = "timestamp") -> Column:
    """A moment as ``timestamp`` or ``timestamp_ntz``; text is folded at planning."""
    return F.lit(as_of).cast(like)


def within_days(stamp: Column, as_of: str, days: int, like: str = "timestamp") -> Column:
    """Rows up to ``as_of`` and not older than ``days``; the bare column is pushed down."""
    oldest = moment(as_of, like) - F.expr(f"INTERVAL {int(days)} DAYS")
    return (stamp >= oldest) & (stamp <= moment(as_of, like))


def since_date(stamp: Column, as_of: str, days: int, like: str = "timestamp") -> Column:
    """Up to ``as_of``, with an inclusive lower bound by calendar date; pushed down."""
    oldest = F.date_sub(F.lit(as_of).cast("date"), days).cast(like)
    return (stamp >= oldest) & (stamp <= moment(as_of, like))


def compact_timestamp(raw: Column) -> Column:
    """Parse compact stamps such as ``20240115T093000Z``; NULL if not a time.

    Only digits count, missing parts are zero, digits past the seconds are ignored.
    """
    digits = F.regexp_replace(raw, "[^0-9]", "")
    padded = F.rpad(F.left(digits, F.lit(14)), 14, "0")
    return F.when(
        F.length(digits) >= 8,
        F.try_to_timestamp(padded, F.lit("yyyyMMddHHmmss")),
    )


def iso_text(stamp: Column) -> Column:
    return F.date_format(stamp, ISO)
