"""Configuration rows as plain Python records and as Spark dimension tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from signalgrid import fixed_values as fv
from signalgrid.session import local_table


@dataclass(frozen=True)
class Box:
    """A named bounding box; ``priority`` orders first-match attribution."""

    code: str
    west: float
    south: float
    east: float
    north: float
    priority: int = 0


@dataclass(frozen=True)
class Keywords:
    """Words that attribute a text to ``code``."""

    code: str
    words: tuple[str, ...]


SUBJECT_BOXES = tuple(
    Box(row[0], *row[6:10], priority=i) for i, row in enumerate(fv.SUBJECTS)
)
THEATER_BOXES = tuple(
    Box(row[0], *row[4:8], priority=i) for i, row in enumerate(fv.THEATERS)
)
SUBJECT_KEYWORDS = tuple(Keywords(code, words) for code, words in fv.KEYWORDS)
SUBJECT_QUERIES = tuple(Keywords(row[0], (row[11],)) for row in fv.SUBJECTS)
THEATER_QUERIES = tuple(Keywords(row[0], row[8]) for row in fv.THEATERS)


def resolve_theater(theater: str | None) -> str:
    """Return a known theater id; anything unknown means the default one."""
    known = {row[0] for row in fv.THEATERS}
    return theater if theater in known else fv.DEFAULT_THEATER


def resolve_subject(code: str) -> str:
    """Return a known subject code or raise ``ValueError``."""
    if code not in {row[0] for row in fv.SUBJECTS}:
        raise ValueError(f"unknown subject: {code!r}")
    return code


def dim_subject(spark: SparkSession) -> DataFrame:
    rows = [(*row, i) for i, row in enumerate(fv.SUBJECTS)]
    return local_table(
        spark,
        rows,
        "code string, name string, callsign string, capital string, "
        "capital_lon double, capital_lat double, west double, south double, "
        "east double, north double, adversary string, query string, "
        "accent string, priority int",
    )


def dim_theater(spark: SparkSession) -> DataFrame:
    rows = [
        (r[0], r[1], r[2], *r[4:8], i) for i, r in enumerate(fv.THEATERS)
    ]
    return local_table(
        spark,
        rows,
        "theater string, name string, label string, west double, "
        "south double, east double, north double, position int",
    )


def theater_subject(spark: SparkSession) -> DataFrame:
    """Bridge table: one row per theater and member subject, in listed order."""
    rows = [
        (row[0], code, i)
        for row in fv.THEATERS
        for i, code in enumerate(row[3])
    ]
    return local_table(spark, rows, "theater string, code string, position int")


def boxes(spark: SparkSession, rows: tuple[Box, ...]) -> DataFrame:
    return local_table(
        spark,
        [(b.code, b.west, b.south, b.east, b.north, b.priority) for b in rows],
        "code string, west double, south double, east double, north double, "
        "priority int",
    )


def keyword_words(spark: SparkSession, rows: tuple[Keywords, ...]) -> DataFrame:
    """Keyword dictionary as a table: one row per word, with its list's priority."""
    return local_table(
        spark,
        [(k.code, i, w) for i, k in enumerate(rows) for w in k.words],
        "code string, priority int, word string",
    )


def boundary_ids(spark: SparkSession) -> DataFrame:
    return local_table(spark, list(fv.BOUNDARY_IDS), "id string, code string")
