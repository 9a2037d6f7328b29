"""The five feeds as streams of landing files, each into folders by source and day."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from signalgrid.schemas import (
    ARTICLE_DOCUMENT, CONFLICT_DOCUMENT, GEO_DOCUMENT, REPORT_DOCUMENT, TIMELINE_DOCUMENT,
)
from signalgrid.sources import feeds
from signalgrid.sources.landing import good_documents, parse_bodies, quarantined
from signalgrid.streaming.ingest import _trigger, body_stream, replace_folders


@dataclass(frozen=True)
class Feed:
    """How a feed's bodies become rows, what its folders tell, and which column gives a row's day."""

    document: str
    rows: Callable[[DataFrame, Column], DataFrame]
    folders: tuple[str, ...]
    day: str


FEEDS = {
    "geo": Feed(GEO_DOCUMENT, lambda docs, at: feeds.geo_signals(
        docs.withColumn("observed_at", at), carry=["observed_at"]), (), "observed_at"),
    "conflict": Feed(CONFLICT_DOCUMENT, lambda docs, at: feeds.conflict_signals(docs), ("asked",), "event_date"),
    "articles": Feed(ARTICLE_DOCUMENT, feeds.article_items, (), "seen"),
    "reports": Feed(REPORT_DOCUMENT, feeds.report_items, ("asked", "nation"), "seen"),
    "timelines": Feed(TIMELINE_DOCUMENT, feeds.timeline_points, ("subject", "metric"), "t"),
}


def landing_stream(spark: SparkSession, feed: str, path: str, per_file: bool = True,
                   files_per_trigger: int | None = None) -> DataFrame:
    """New bodies of a feed; the time of the fetch and what was asked come from folder names.

    Files lie below ``path`` in folders such as ``at=2024-01-15 09:00:00/asked=Ukraine``.
    """
    return body_stream(spark, path, per_file, files_per_trigger, ("at", *FEEDS[feed].folders))


def start_feed(bodies: DataFrame, feed: str, table: str, checkpoint: str, as_of: str | None = None,
               every: str | None = None) -> StreamingQuery:
    """Turn a feed's bodies into rows below ``<table>/source=<feed>/dt=<day>``, bad bodies into ``aside``.

    A row without a time of its own has that of its fetch, or ``as_of`` if the folders do not tell it. A
    batch owns the folders ``batch=<id>`` below the days it touches, so writing it again replaces what it
    wrote and nothing else.
    """
    kind = FEEDS[feed]

    def write(batch: DataFrame, batch_id: int) -> None:
        fetched = F.coalesce(F.col("at").try_cast("timestamp"), F.lit(as_of).cast("timestamp"))
        parsed = parse_bodies(batch, kind.document).persist()
        try:
            rows = kind.rows(good_documents(parsed), fetched)
            dated = rows.withColumn("dt", F.col(kind.day).cast("date")).withColumn("batch", F.lit(batch_id))
            replace_folders(dated, f"{table}/source={feed}", "dt", "batch")
            quarantined(parsed).write.mode("overwrite").parquet(f"{table}/aside/source={feed}/batch={batch_id}")
        finally:
            parsed.unpersist()

    return (
        bodies.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
        .trigger(**_trigger(every)).start()
    )


def read_feed(spark: SparkSession, table: str, feed: str, as_of: str | None = None, days: int | None = None) -> DataFrame:
    """Rows of a feed; with a look-back only the folders of its days are opened."""
    rows = spark.read.parquet(f"{table}/source={feed}")
    if as_of is not None:
        last = F.lit(as_of).cast("date")
        rows = rows.filter(F.col("dt") <= last)
        if days is not None:
            rows = rows.filter(F.col("dt") >= F.date_sub(last, days))
    return rows.drop("batch")


def read_aside(spark: SparkSession, table: str, feed: str) -> DataFrame:
    """Bodies of a feed that were set aside."""
    return spark.read.parquet(f"{table}/aside/source={feed}").drop("batch")
