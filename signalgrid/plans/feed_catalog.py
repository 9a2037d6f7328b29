"""Queries that go from bodies of feeds to answers, over the given tables seen as fetched bodies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from signalgrid import dims, fixed_values as fv
from signalgrid.dims import SUBJECT_BOXES, THEATER_BOXES
from signalgrid.functions import clock
from signalgrid.functions.geometry import boxes_holding, first_box
from signalgrid.operators import freshness
from signalgrid.plans import live
from signalgrid.plans.bindings import (
    AS_OF, conflict_columns, event_columns, event_points, geo_columns, order_columns, order_points, table,
)
from signalgrid.plans.catalog import (
    answer_parts, article_bodies, conflict_bodies, report_bodies, streamed, supplier_areas, timeline_bodies,
)
from signalgrid.schemas import TABLES
from signalgrid.session import remove_at_exit, work_folder, written
from signalgrid.sources import batches
from signalgrid.sources.signals import SIGNAL, signal_parts
from signalgrid.streaming import ingest, parts

POLL_HOURS = 6
# Entries of a page share a span of keys, dealt over the theaters and over the subjects.
GEO_SPAN, CONFLICT_SPAN = 50 * len(fv.THEATERS), 50 * len(fv.SUBJECTS)


def _dealt(key: str, names: list[str]):
    return F.element_at(F.array(*map(F.lit, names)), (F.pmod(F.col(key), F.lit(len(names))) + 1).cast("int"))


def _pages(rows: DataFrame, source: str, key: str, span: int, entry, field: str) -> DataFrame:
    """Pages of up to 50 entries, one body each, per key and time of the fetch."""
    paged = rows.select("key", "at", F.floor(F.col(key) / span).alias("page"), F.struct(
        F.col(key).alias("k"), entry.alias("e")).alias("row"))
    listed = paged.groupBy("key", "at", "page").agg(F.sort_array(F.collect_list("row")).alias("rows"))
    body = F.to_json(F.struct(F.transform("rows", lambda r: r["e"]).alias(field)))
    origin = F.concat_ws("/", F.lit(source), "key", F.date_format("at", "yyyyMMddHH"), "page")
    return listed.select(F.lit(source).alias("source"), "key", "at", "page", origin.alias("origin"), body.alias("body"))


def _geo_polls(spark, sf_dir):
    """Events as density features, fetched every six hours for the theater they are dealt to."""
    hours = F.make_dt_interval(hours=F.floor(F.hour("ts") / POLL_HOURS).cast("int") * POLL_HOURS + POLL_HOURS)
    points = event_points(spark, sf_dir).withColumn(
        "at", (F.date_trunc("day", "ts") + hours).cast("timestamp")).withColumn(
        "key", _dealt("event_id", [r[0] for r in fv.THEATERS]))
    feature = F.struct(
        F.struct(F.array("lon", "lat").alias("coordinates")).alias("geometry"),
        F.struct(F.col("event_type").alias("name"), "count").alias("properties"))
    return _pages(points, fv.SOURCE_GEO, "event_id", GEO_SPAN, feature, "features")


def _conflict_polls(spark, sf_dir):
    """Orders as conflict records, fetched on the day after for the subject they are dealt to."""
    points = order_points(spark, sf_dir, "o_orderstatus", "o_orderpriority")
    day = F.date_add(F.lit("2024-01-10").cast("date"), F.pmod("o_orderkey", F.lit(25)).cast("int"))
    points = points.withColumn("day", day).withColumn("at", F.date_add("day", 1).cast("timestamp")).withColumn(
        "key", _dealt("o_orderkey", [r[0] for r in fv.SUBJECTS]))
    record = F.struct(
        F.when(F.col("o_orderstatus") != "P", F.col("lat").cast("string")).otherwise(F.lit("")).alias("latitude"),
        F.col("lon").cast("string").alias("longitude"), F.col("o_orderpriority").alias("event_type"),
        F.col("fatalities").cast("string").alias("fatalities"), F.date_format("day", "yyyy-MM-dd").alias("event_date"))
    return _pages(points, fv.SOURCE_CONFLICT, "o_orderkey", CONFLICT_SPAN, record, "data")


def _polls(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """What was asked for and what came: some fetches bring markup, half a document, or nothing."""
    pages = written(_geo_polls(spark, sf_dir).unionByName(_conflict_polls(spark, sf_dir)), "pages")
    names = F.create_map(*[F.lit(x) for row in fv.SUBJECTS for x in row[:2]])
    asked = pages.select("origin", "source", "key", "at", F.try_element_at(names, F.col("key")).alias("asked"))
    key, hour, even = F.col("key"), F.hour("at"), F.dayofmonth("at") % 2 == 0
    markup = (key == "eastern-europe") | ((key == "middle-east") & (hour == 12)) | ((key == "IL") & even)
    half = (key == "middle-east") & (hour == 18) & even
    missing = ((key == "global") & (hour == 0)) | key.isin("UA", "RU")
    body = F.when(markup, F.lit(" <html>busy</html>")).when(
        half, F.expr("left(body, cast(length(body) / 2 as int))")).otherwise(F.col("body"))
    return asked, pages.filter(~missing).select("origin", body.alias("body"))


def _landed(spark, sf_dir) -> str:
    """A table of two batches: fetches before and after the middle of the month."""
    table = work_folder(spark, "batches")
    remove_at_exit(spark, table)
    asked, bodies = _polls(spark, sf_dir)
    middle = F.col("at") < clock.moment("2024-01-16 00:00:00")
    for batch, some in ((0, middle), (1, ~middle)):
        batches.land(signal_parts(asked.filter(some), bodies), table, batch)
    return table


def fetch_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log that landing writes: a row per fetch, good or not."""
    log = batches.fetch_log(spark, _landed(spark, sf_dir))
    return log.select("source", "key", clock.iso_text(F.col("at")).alias("at"), "ok", "n_bodies", "n_rows", "reason")


def landing_to_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events answer from bodies alone, one row per event, arc and subject in it."""
    return answer_parts(live.events_answers(spark, _landed(spark, sf_dir), AS_OF))


def last_good_answer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What was served on each day: the rows of the newest good batch, whatever failed since.

    Each user's events of a day are a fetched answer. One in seven is half-written, without a
    commit; of the others one in four is a failure.
    """
    table = work_folder(spark, "answers")
    remove_at_exit(spark, table)
    events = event_points(spark, sf_dir).select(
        F.lit("poll").alias("source"), F.concat(F.lit("k"), F.pmod("user_id", F.lit(40))).alias("key"),
        F.date_trunc("day", "ts").cast("timestamp").alias("at"), F.pmod("user_id", F.lit(40)).alias("k"), "event_id")
    turn = F.col("k") + F.dayofmonth("at")
    rows = events.withColumn(batches.PART, F.lit(batches.ROW)).withColumn("reason", F.lit(None).cast("string"))
    kept = [batches.PART, "source", "key", "at", "reason", "event_id"]
    batches.write_rows(rows.filter(turn % 7 != 0).select(kept), table, "whole")
    batches.write_rows(rows.filter(turn % 7 == 0).select(kept), table, "torn")
    log = events.filter(turn % 7 != 0).groupBy("source", "key", "at", "k").agg(F.count("*").alias("n_rows")).select(
        "source", "key", "at", (turn % 4 != 1).alias("ok"), F.lit(1).cast("bigint").alias("n_bodies"), "n_rows",
        F.when(turn % 4 == 1, F.lit("markup")).alias("reason"))
    batches.commit(spark, table, "whole", log)
    days = F.sequence(F.lit("2024-01-01").cast("timestamp"), F.lit("2024-02-02").cast("timestamp"), F.expr("INTERVAL 1 DAY"))
    asks = events.select("source", "key").distinct().select("source", "key", F.explode(days).alias("as_of"))
    own = "source string, key string, at timestamp, event_id bigint"
    served = live.last_good_answer(
        asks, batches.fetch_log(spark, table), batches.part_of(spark, table, batches.ROW, own))
    return served.select("key", clock.iso_text(F.col("as_of")).alias("as_of"),
                         clock.iso_text(F.col("last_good")).alias("last_good"), "event_id")


# --- Streams of the other feeds ----------------------------------------------

def stream_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, _ = streamed(spark, "articles", article_bodies(spark, sf_dir))
    return rows.select("title", "url", "domain", "country", clock.iso_text(F.col("seen")).alias("seen"), "seen_ok")


def _either(bodies: DataFrame, **pairs: tuple[str, str]) -> DataFrame:
    """What was asked for, by turns from page to page."""
    even = F.col("origin") % 2 == 0
    return bodies.withColumns({k: F.when(even, a).otherwise(b) for k, (a, b) in pairs.items()})


def stream_conflict(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.date_add(F.lit("2024-01-10").cast("date"), F.pmod("o_orderkey", F.lit(25)).cast("int"))
    rows, _ = streamed(spark, "conflict", _either(conflict_bodies(spark, sf_dir, day), asked=("Ukraine", "Iran & Iraq+")))
    return rows.select("name", "count", "nation", F.round("severity", 6).alias("severity"),
                       F.date_format("event_date", "yyyy-MM-dd").alias("event_date"))


def stream_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, _ = streamed(spark, "reports", _either(
        report_bodies(spark, sf_dir), asked=("Ukraine", "Iran"), nation=("UA", "IR")))
    return rows.select("title", "url", "domain", "country", "seen_ok", "nation", clock.iso_text(F.col("seen")).alias("seen"))


def stream_timelines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, _ = streamed(spark, "timelines", timeline_bodies(spark, sf_dir))
    return rows.select("subject", "metric", "pos", clock.iso_text(F.col("t")).alias("t"), F.round("v", 6).alias("v"))


# --- Answers kept up to date -------------------------------------------------

STATUS_TTL = 6 * 3600


def _held(df: DataFrame) -> DataFrame:
    return df.withColumn("theaters", boxes_holding(THEATER_BOXES))


def _kept(spark, stream: DataFrame, make) -> DataFrame:
    folder = work_folder(spark, "parts")
    remove_at_exit(spark, folder)
    parts.start_parts(stream, make, f"{folder}/table", f"{folder}/state").awaitTermination()
    return parts.read_parts(spark, f"{folder}/table")


def _streamed_table(spark, sf_dir, name: str) -> DataFrame:
    return ingest.file_stream(spark, f"{sf_dir}/{name}.parque[t]", TABLES[name])


def _told_signals(spark, sf_dir) -> DataFrame:
    """Both sources as one stream; the severity of density signals waits for the peak."""
    events = geo_columns(event_columns(_streamed_table(spark, sf_dir, "events")), F.lit(None).cast("double"))
    geo = _held(events).withColumn("told", F.col("count"))
    # A month of days, so that the parts' folders do not grow with the calendar of the table.
    day = F.date_add(F.lit("2024-01-10").cast("date"), F.pmod("pos", F.lit(25)).cast("int")).cast("timestamp_ntz")
    records = conflict_columns(order_columns(_streamed_table(spark, sf_dir, "orders"))).withColumn("observed_at", day)
    members = F.create_map(*[F.lit(x) for x in (y for b in SUBJECT_BOXES for y in (b.code, ",".join(
        r[0] for r in fv.THEATERS if b.code in r[3])))])
    theaters = F.coalesce(F.split(F.try_element_at(members, F.col("nation")), ","), F.array().cast("array<string>"))
    conflict = records.withColumn("theaters", theaters).withColumn("told", F.lit(None).cast("bigint"))
    return geo.unionByName(conflict)


def feed_zone_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signals of both feeds, from bodies, attributed to the suppliers' zones in the same pass."""
    rows = signal_parts(*_polls(spark, sf_dir), supplier_areas(spark, sf_dir))
    return rows.filter(F.col(batches.PART) == batches.ROW).select("source", "key", "pos", "id", "name", "count", "nation")


def stream_top_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = _kept(spark, _told_signals(spark, sf_dir), lambda rows: parts.strongest(rows, F.col("told")))
    best = parts.strongest_now(kept)
    return best.select("theater", "rank", "id", "source", "count", "nation", F.round("severity", 6).alias("severity"))


def stream_pressure(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = event_columns(_streamed_table(spark, sf_dir, "events")).withColumn("code", first_box(SUBJECT_BOXES))
    kept = _kept(spark, _held(points).withColumnRenamed("ts", "observed_at"), parts.pressure_parts)
    scored = parts.pressure_now(kept, dims.theater_subject(spark))
    return scored.select("theater", "code", "events", F.round("score", 6).alias("score"), "threat")


def _intervals(rows: DataFrame) -> DataFrame:
    return rows.select("user_id", "status", clock.iso_text(F.col("since")).alias("since"), clock.iso_text(F.col("till")).alias("till"))


def status_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """When each user's fetches were ok, degraded or offline."""
    log = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return _intervals(freshness.status_intervals(
        log, ["user_id"], "ts", F.col("event_type") != "error", STATUS_TTL, clock.moment(AS_OF)))


def stream_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from a stream of fetches that leaves a few spans per day."""
    good = F.col("event_type") != "error"
    stream = _streamed_table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")).filter(
        F.col("ts") <= clock.moment(AS_OF))
    kept = _kept(spark, stream, lambda rows: parts.status_parts(rows, ["user_id"], "ts", good, STATUS_TTL))
    return _intervals(freshness.status_of_spans(kept, ["user_id"], STATUS_TTL, clock.moment(AS_OF)))


QUERIES = {f.__name__: f for f in (
    fetch_log, landing_to_events, last_good_answer, stream_articles, stream_conflict, stream_reports, stream_timelines,
    feed_zone_table, stream_top_signals, stream_pressure, status_intervals, stream_status)}
