"""Every operator as a query over the given tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from signalgrid import dims, fixed_values as fv
from signalgrid.dims import SUBJECT_BOXES, THEATER_BOXES, Box, Keywords
from signalgrid.functions import clock, display, scoring, text
from signalgrid.operators import (
    arcs, arguments, freshness, heat, keyed, keywords, merge, pressure, ranking, timeline, zones,
)
from signalgrid.plans import payloads
from signalgrid.plans.bindings import (
    AS_OF, conflict_rows, document_items, event_points, geo_rows, nation_members,
    order_points, place, table, theater_signals,
)
from signalgrid.schemas import (
    ARTICLE_DOCUMENT, BOUNDARY_DOCUMENT, CONFLICT_DOCUMENT, GEO_DOCUMENT,
    REPORT_DOCUMENT, TABLES, TIMELINE_DOCUMENT,
)
from signalgrid.session import remove_at_exit, work_folder
from signalgrid.sources import boundaries, feeds, landing, sinks
from signalgrid.streaming import feeds as streams, ingest, parts, views

NTZ = "timestamp_ntz"
STATE_TTL = 6 * 3600
WORD_LISTS = (
    Keywords("A", ("der", "die")),
    Keywords("B", ("que", "de")),
    Keywords("C", ("with", "was")),
    Keywords("D", ("le", "la")),
)
ROUTES = (
    Keywords("middle-east", ("der", "la")),
    Keywords("eastern-europe", ("the", "que")),
    Keywords("global", ("der", "la", "the", "que")),
)
PHRASES = (Keywords("P", ("de la", "in the")), *WORD_LISTS)
SILENT = Box("southern-ocean", -60.0, -70.0, 0.0, -50.0, len(THEATER_BOXES))
PAGE = 50
KEY_BUCKETS = 8


def _six(name: str):
    return F.round(F.col(name), 6).alias(name)


# --- Pressure and severity ---------------------------------------------------

def _order_pressure(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    # Orders shrink to one row per customer and partition before the first shuffle,
    # whose partitioning the customer join then reuses.
    parts = pressure.share_parts(orders, ["o_custkey"], "o_totalprice")
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    located = parts.join(customer, F.col("o_custkey") == F.col("c_custkey")).withColumnRenamed(
        "c_nationkey", "nationkey")
    tallied = pressure.finish_share_tally(pressure.merge_share_parts(located, ["nationkey"]))
    return pressure.pressure_index(
        tallied, nation_members(spark, sf_dir), ["theater", "nationkey"])


def pressure_index(spark, sf_dir):
    return _order_pressure(spark, sf_dir).select(
        "theater", "code", "events", _six("score"), "threat")


def watchlist_report(spark, sf_dir):
    score = F.round(F.col("score"), 6)
    return _order_pressure(spark, sf_dir).select(
        "theater", "code", F.upper("code").alias("title"), "events",
        display.percent(score).alias("score_pct"),
        F.round(display.bar_width(F.col("score"), 4), 4).alias("bar"), "threat")


def severity_share(spark, sf_dir):
    points = pressure.add_share_severity(event_points(spark, sf_dir))
    return points.select("event_id", "count", _six("severity"))


def severity_log(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem")
    return rows.select(
        "l_orderkey", F.col("l_linenumber").cast("bigint").alias("l_linenumber"), "l_quantity",
        F.round(scoring.severity_by_fatalities(F.col("l_quantity")), 6).alias("severity"))


def threat_bands(spark, sf_dir):
    points = pressure.add_share_severity(event_points(spark, sf_dir))
    banded = points.withColumn("threat", scoring.threat_band(F.col("severity")))
    return banded.groupBy("threat").agg(
        F.count("*").alias("events"),
        F.round(F.min("severity"), 6).alias("low"), F.round(F.max("severity"), 6).alias("high"))


# --- Zones and grids ---------------------------------------------------------

def bbox_clip(spark, sf_dir):
    clipped = zones.clip_to_theaters(event_points(spark, sf_dir), THEATER_BOXES)
    return clipped.select("event_id", "theater", "lon", "lat")


def geofence(spark, sf_dir):
    found = zones.attribute_boxes(event_points(spark, sf_dir), SUBJECT_BOXES)
    return found.select("event_id", "lon", "lat", "code")


def geofence_bucketed(spark, sf_dir):
    found = zones.attribute_zone_table(
        event_points(spark, sf_dir), dims.boxes(spark, SUBJECT_BOXES), "event_id")
    return found.select("event_id", "lon", "lat", "code")


def supplier_areas(spark, sf_dir):
    """Suppliers as zones: a box around each one's place, its size by nation."""
    supplier = table(spark, sf_dir, "supplier")
    lon, lat = place(F.col("s_suppkey"))
    half = F.lit(0.25) + F.col("s_nationkey") / F.lit(8.0)
    return supplier.select(
        F.col("s_name").alias("code"), F.col("s_suppkey").alias("priority"),
        (lon - half).alias("west"), (lat - half).alias("south"),
        (lon + half).alias("east"), (lat + half).alias("north"))


def geofence_zone_table(spark, sf_dir):
    areas = supplier_areas(spark, sf_dir)
    found = zones.attribute_zone_table(event_points(spark, sf_dir), areas, "event_id")
    return found.select("event_id", "code")


def heat_grid(spark, sf_dir):
    return heat.heat_grid(event_points(spark, sf_dir), 1.0)


def heat_kernel(spark, sf_dir):
    return heat.heat_kernel(heat.heat_grid(event_points(spark, sf_dir), 1.0))


def heat_grid_dense(spark, sf_dir):
    grid = heat.heat_grid(event_points(spark, sf_dir), float(fv.GRATICULE_STEP))
    scaffold = heat.cell_scaffold(dims.dim_theater(spark), float(fv.GRATICULE_STEP))
    return heat.densify(grid, scaffold).select(
        "theater", "cell_x", "cell_y", "weight", "points")


# --- Sources, ranking and fallback -------------------------------------------

def source_union(spark, sf_dir):
    rows = merge.union_sources(conflict_rows(spark, sf_dir), geo_rows(spark, sf_dir))
    return rows.select("id", "source", "count", "nation", _six("severity"), "lon", "lat")


def top_signals(spark, sf_dir):
    best = ranking.top_k_per_group(
        theater_signals(spark, sf_dir), ["theater"], payloads.signal_order(),
        fv.SIGNAL_CAP, spread=["id"])
    return best.select("theater", "rank", "id", "source", "count", "nation", _six("severity"))


def strongest_signals(spark, sf_dir):
    rows = merge.union_sources(conflict_rows(spark, sf_dir), geo_rows(spark, sf_dir))
    best = ranking.top_k(rows, payloads.signal_order(), fv.SIGNAL_CAP)
    return best.select("id", "source", "count", "nation", _six("severity"))


def seed_fallback(spark, sf_dir):
    """All events, and one theater more whose box holds none of them."""
    watched = (*THEATER_BOXES, SILENT)
    rows = merge.with_fallback(
        zones.clip_to_theaters(geo_rows(spark, sf_dir), watched), merge.seed_signals(spark),
        dims.boxes(spark, watched).select(F.col("code").alias("theater")), "theater")
    return rows.select("theater", "id", "source", "nation", _six("severity"), "live")


# --- Arcs --------------------------------------------------------------------

def _hot(spark, sf_dir):
    points = pressure.add_share_severity(event_points(spark, sf_dir))
    placed = zones.clip_to_theaters(zones.attribute_boxes(points, SUBJECT_BOXES), THEATER_BOXES)
    return ranking.hottest(
        placed.filter(F.col("code").isNotNull()), ["theater", "code"],
        ["event_id", "lon", "lat"], [-F.col("event_id")])


def _arcs(spark, sf_dir):
    pairs = arcs.adversary_pairs(dims.dim_subject(spark), dims.theater_subject(spark))
    return arcs.tension_arcs(pairs, _hot(spark, sf_dir))


def hottest_per_subject(spark, sf_dir):
    return _hot(spark, sf_dir).select(
        "theater", "code", "event_id", "lon", "lat", _six("severity"))


def tension_arcs(spark, sf_dir):
    return _arcs(spark, sf_dir).select(
        "theater", "arc_id", "code", "adversary", "from_lon", "from_lat", "to_lon", "to_lat",
        "label", _six("intensity"))


def arc_rails(spark, sf_dir):
    return arcs.arc_rails(_arcs(spark, sf_dir)).select(
        "theater", "arc_id", "step", _six("lon"), _six("lat"))


# --- Texts and feeds ---------------------------------------------------------

def keyword_filter(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return keywords.select_mentions(docs, F.col("text"), ("der", "que")).select("doc_id", "lang")


def keyword_attribution(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return keywords.attribute_keywords(docs, F.col("text"), WORD_LISTS).select("doc_id", "code")


def keyword_dictionary(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return keywords.attribute_dictionary(
        docs, F.col("text"), "doc_id", dims.keyword_words(spark, PHRASES))


def url_domain(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    return pages.select("page_id", text.host_of(F.col("url")).alias("domain"))


def compact_ts(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", _spoiled_stamp().alias("raw"))
    stamp = clock.compact_timestamp(F.col("raw"))
    return orders.select(
        "o_orderkey",
        clock.iso_text(F.coalesce(stamp, clock.moment(AS_OF))).alias("seen"),
        stamp.isNotNull().alias("parse_ok"))


def _spoiled_stamp():
    """The order date in the forms that feeds deliver, good and bad ones."""
    kind = F.pmod("o_orderkey", F.lit(7))
    day = F.col("o_orderdate")
    return (
        F.when(kind == 0, F.date_format(day, "yyyyMMdd'T'HHmmss'Z'"))
        .when(kind == 1, F.date_format(day, "yyyyMMdd"))
        .when(kind == 2, F.date_format(day, "yyyyMMddHHmmss'99'"))
        .when(kind == 3, F.date_format(day, "yyyy'1345'"))
        .when(kind == 4, F.lit("x"))
        .when(kind == 5, F.date_format(day, "yyyy-MM-dd HH:mm:ss"))
    )


def _situation(spark, sf_dir):
    members = nation_members(spark, sf_dir)
    # No order beyond its customer's newest ones can be among its nation's newest, so
    # a customer with very many orders shrinks before the join, whose shuffle this is.
    newest = ranking.top_k_per_group(
        table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate"),
        ["o_custkey"], [F.desc("o_orderdate"), F.asc("o_orderkey")],
        fv.REPORT_CAP_PER_SUBJECT)
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    items = newest.join(customer, F.col("o_custkey") == F.col("c_custkey")).join(
        members.select("nationkey", F.col("code").alias("nation")),
        F.col("c_nationkey") == F.col("nationkey"))
    items = items.select(
        F.col("o_orderkey").alias("id"), F.col("o_orderkey").alias("pos"), "nation",
        F.col("o_orderdate").alias("seen"))
    return payloads.situation_items(items, members)


def situation_feed(spark, sf_dir):
    return _situation(spark, sf_dir).select(
        "theater", "rank", "id", "nation", clock.iso_text(F.col("seen")).alias("seen"))


def ticker_report(spark, sf_dir):
    items = ranking.top_k(
        document_items(spark, sf_dir), payloads.newest_first(), fv.TICKER_CAP)
    return items.select(
        "id", F.upper("domain").alias("domain"), display.short_title(F.col("title")).alias("title"),
        text.first_keyword(F.concat_ws(" ", "country", "title"), WORD_LISTS).alias("code"))


def event_dossier(spark, sf_dir):
    names = dims.dim_subject(spark).select(
        F.col("code").alias("nation"), F.col("name").alias("subject"))
    return geo_rows(spark, sf_dir).join(names, "nation", "left").select(
        "id", F.coalesce("subject", F.lit(fv.UNKNOWN_COUNTRY)).alias("subject"),
        F.col("count").alias("mentions"),
        F.round(display.bar_width(F.col("severity"), 5), 4).alias("bar"),
        display.coordinate(F.col("lat")).alias("lat"),
        display.coordinate(F.col("lon")).alias("lon"))


def subject_dossier(spark, sf_dir):
    """Pressure of every subject of every theater, with its name plate."""
    points = pressure.add_share_severity(event_points(spark, sf_dir))
    placed = zones.clip_to_theaters(zones.attribute_boxes(points, SUBJECT_BOXES), THEATER_BOXES)
    scored = pressure.pressure_index(
        pressure.tally(placed.filter(F.col("code").isNotNull()), ["theater", "code"]),
        dims.theater_subject(spark))
    plate = dims.dim_subject(spark).select(
        "code", "name", "callsign", F.upper("capital").alias("capital"))
    return scored.join(plate, "code").select(
        "theater", "code", "name", "callsign", "capital", "events", _six("score"),
        F.round(display.bar_width(F.col("score"), 4), 4).alias("bar"), "threat")


# --- Look-back and timelines -------------------------------------------------

def lookback(spark, sf_dir):
    ts = F.col("ts")
    rows = table(spark, sf_dir, "events").filter(
        clock.within_days(ts, AS_OF, fv.PULSE_LOOKBACK_DAYS, NTZ))
    return rows.select(
        "event_id", "event_type",
        clock.within_days(ts, AS_OF, fv.EVENT_LOOKBACK_DAYS, NTZ).alias("in_events"),
        clock.within_days(ts, AS_OF, fv.ARTICLE_LOOKBACK_DAYS, NTZ).alias("in_articles"))


def conflict_lookback(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").filter(
        clock.since_date(F.col("o_orderdate"), "2001-07-15", fv.CONFLICT_LOOKBACK_DAYS, NTZ)
        & (F.col("o_orderstatus") == "O"))
    return rows.select("o_orderkey", clock.iso_text(F.col("o_orderdate")).alias("day"))


def conflict_recent(spark, sf_dir):
    """Newest conflict records per subject inside the look-back, up to the cap."""
    recent = conflict_rows(spark, sf_dir).filter(
        clock.since_date(F.col("observed_at"), "2001-07-15", fv.CONFLICT_LOOKBACK_DAYS, NTZ)
        & F.col("nation").isNotNull())
    best = ranking.top_k_per_group(
        recent, ["nation"], [F.desc("observed_at"), F.asc("pos")], fv.CONFLICT_CAP,
        spread=["id"])
    return best.select(
        "nation", "rank", "id", "name", clock.iso_text(F.col("observed_at")).alias("day"))


def _tone_events(spark, sf_dir):
    return table(spark, sf_dir, "events").select(
        "event_id", "ts", "event_type", (F.lit(10.0) - F.col("value") / 10).alias("tone"))


def _daily(spark, sf_dir):
    return timeline.timeline(_tone_events(spark, sf_dir), "ts", "event_type", "tone")


def timeline_volume(spark, sf_dir):
    return _daily(spark, sf_dir).select(
        clock.iso_text(F.col("t")).alias("t"), "subject", "count", _six("volume"))


def timeline_tone(spark, sf_dir):
    return _daily(spark, sf_dir).select(
        clock.iso_text(F.col("t")).alias("t"), display.day_label(F.col("t")).alias("label"),
        "subject", _six("tone"))


def timeline_stats(spark, sf_dir):
    return timeline.series_stats(_daily(spark, sf_dir), ["subject"], "count")


def tone_now(spark, sf_dir):
    now = ranking.last_by_position(
        _tone_events(spark, sf_dir), ["event_type"], "event_id", "tone", "tone_now")
    return now.select("event_type", _six("tone_now"))


def tone_gauge(spark, sf_dir):
    tone = F.col("tone")
    return _tone_events(spark, sf_dir).select(
        "event_id", F.round(scoring.tone_level(tone), 6).alias("level"),
        F.round(scoring.tone_percent(tone), 6).alias("percent"),
        scoring.tone_band(tone).alias("band"))


# --- Freshness ---------------------------------------------------------------

def _fetch_log(spark, sf_dir):
    """Events as fetches per user: an error is a failure, the value a row count."""
    return event_points(spark, sf_dir).select(
        "user_id", "event_id", "ts", F.col("count").alias("n_rows"),
        (F.col("event_type") != "error").alias("ok"))


def fetch_freshness(spark, sf_dir):
    state = freshness.freshness(
        _fetch_log(spark, sf_dir), "user_id", "ts", F.col("ok"),
        clock.moment(AS_OF, NTZ), STATE_TTL)
    return state.select("user_id", clock.iso_text(F.col("last_ok")).alias("last_ok"), "fresh")


def last_known_good(spark, sf_dir):
    served = freshness.last_known_good(
        _fetch_log(spark, sf_dir), "user_id", "ts", F.col("ok"))
    return served.select("event_id", clock.iso_text(F.col("last_good")).alias("last_good"))


def feed_status(spark, sf_dir):
    state = freshness.feed_state(
        _fetch_log(spark, sf_dir), ["user_id"], "ts", F.col("ok"), "n_rows",
        clock.moment(AS_OF, NTZ), STATE_TTL, ties=["event_id"])
    return state.select(
        "user_id", clock.iso_text(F.col("last_ok")).alias("last_ok"), "rows_on_hand",
        "failures", "status")


def missing_keys(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    span = orders.agg(
        F.min("o_orderdate").cast("date").alias("first"),
        F.max("o_orderdate").cast("date").alias("last"))
    days = span.select(F.sequence("first", "last")).scalar()
    expected = table(spark, sf_dir, "nation").select("n_name", F.explode(days).alias("day"))
    # Orders shrink to a set of days per customer, never more than the calendar has.
    per_customer = orders.groupBy("o_custkey").agg(
        F.collect_set(F.col("o_orderdate").cast("date")).alias("days"))
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    arrived = per_customer.join(
        customer, F.col("o_custkey") == F.col("c_custkey")).join(
        nation, F.col("c_nationkey") == F.col("n_nationkey")).select(
        "n_name", F.explode("days").alias("day"))
    missing = freshness.missing_keys(expected, arrived, ["n_name", "day"])
    return missing.select("n_name", F.date_format("day", "yyyy-MM-dd").alias("day"))


# --- Keyed tables ------------------------------------------------------------

def _signed_up(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Each order signs its customer up; the BUILDING segment is on file already."""
    existing = table(spark, sf_dir, "customer").filter(
        F.col("c_mktsegment") == "BUILDING").select(F.col("c_custkey").alias("id"))
    role = F.when(F.col("o_orderpriority") == "1-URGENT", F.lit("admin")).when(
        F.col("o_orderpriority") == "2-HIGH", F.lit("analyst"))
    incoming = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("id"), "o_orderkey", role.alias("role"),
        F.when(F.col("o_orderstatus") != "P", F.col("o_orderdate")).alias("created_at"))
    return existing, keyed.apply_defaults(incoming, {
        "role": F.lit(fv.DEFAULT_ROLE), "created_at": clock.moment(AS_OF, NTZ)})


def insert_if_absent(spark, sf_dir):
    existing, ready = _signed_up(spark, sf_dir)
    added = keyed.insert_if_absent(existing, ready, "id", ["created_at", "o_orderkey"])
    return added.select(
        "id", "o_orderkey", "role", clock.iso_text(F.col("created_at")).alias("created_at"))


def insert_bucketed(spark, sf_dir):
    """The same into a table whose files are dealt by key; what was added is read back."""
    name = f"profiles_{uuid.uuid4().hex}"
    remove_at_exit(spark, f"{spark.conf.get('spark.sql.warehouse.dir')}/{name}")
    existing, ready = _signed_up(spark, sf_dir)
    on_file = existing.select("id", *[F.lit(None).cast(ready.schema[c].dataType).alias(c) for c in ready.columns[1:]])
    keyed.store_keyed(on_file, name, "id", KEY_BUCKETS)
    keyed.append_if_absent(spark, name, ready, "id", ["created_at", "o_orderkey"], KEY_BUCKETS)
    return spark.table(name).filter(F.col("o_orderkey").isNotNull()).select(
        "id", "o_orderkey", "role", clock.iso_text(F.col("created_at")).alias("created_at"))


def domain_check(spark, sf_dir):
    role = (
        F.when(F.col("c_mktsegment") == "BUILDING", F.lit("viewer"))
        .when(F.col("c_mktsegment") == "MACHINERY", F.lit("analyst"))
        .when(F.col("c_mktsegment") == "HOUSEHOLD", F.lit("admin"))
        .when(F.col("c_mktsegment") == "FURNITURE", F.lower("c_mktsegment")))
    rows = table(spark, sf_dir, "customer").select(
        "c_custkey", role.alias("role"),
        F.when(F.col("c_acctbal") >= 0, F.col("c_name")).alias("email"))
    checked = keyed.check_domain(rows, [
        ("email is null", F.col("email").isNotNull()),
        ("role is null", F.col("role").isNotNull()),
        ("role not allowed", F.col("role").isin(*fv.ROLES)),
    ])
    return checked.select("c_custkey", "role", "reason")


# --- Streams -----------------------------------------------------------------

def _event_stream(spark, sf_dir):
    # A pattern, because the table may be one file or a folder of files.
    stream = ingest.file_stream(spark, f"{sf_dir}/events.parque[t]", TABLES["events"])
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def stream_signals(spark, sf_dir):
    folder = work_folder(spark, "signals")
    remove_at_exit(spark, folder)
    polled = _event_stream(spark, sf_dir).select("event_id", "event_type", "value", "ts")
    ingest.start_unique(polled, ["event_id"], "ts", f"{folder}/table", f"{folder}/state").awaitTermination()
    return spark.read.parquet(f"{folder}/table/rows").select("event_id", "event_type", "value")


def stream_volume(spark, sf_dir):
    folder = work_folder(spark, "volume")
    remove_at_exit(spark, folder)
    parts.start_parts(
        _event_stream(spark, sf_dir), lambda rows: parts.volume_parts(rows, "ts", "event_type", "value"),
        f"{folder}/table", f"{folder}/state").awaitTermination()
    rows = parts.volume_now(parts.read_parts(spark, f"{folder}/table"))
    return rows.select(
        clock.iso_text(F.col("dt").cast("timestamp")).alias("t"), "subject", "count",
        F.round(F.col("tone_sum") / F.col("count"), 6).alias("mean"))


def stream_fetch_state(spark, sf_dir):
    folder = work_folder(spark, "fetches")
    remove_at_exit(spark, folder)
    state = views.fetch_state_stream(
        _event_stream(spark, sf_dir), "user_id", "ts", F.col("event_type") != "error")
    ingest.start_upsert(state, f"{folder}/table", f"{folder}/state").awaitTermination()
    rows = ingest.latest(spark, f"{folder}/table", ["user_id"])
    return rows.select(
        "user_id", clock.iso_text(F.col("last_ok")).alias("last_ok"), "failures")


# --- Landing documents -------------------------------------------------------

def _paged(df: DataFrame, key: str, entry, wrap) -> DataFrame:
    """Rows as JSON bodies of up to PAGE entries, like the pages of an upstream feed."""
    pages = df.select(
        F.floor(F.col(key) / PAGE).alias("origin"), F.struct(F.col(key).alias("k"), entry.alias("e"))
        .alias("row"))
    listed = pages.groupBy("origin").agg(F.sort_array(F.collect_list("row")).alias("rows"))
    entries = F.transform("rows", lambda r: r["e"])
    return listed.select("origin", F.to_json(F.struct(wrap(entries))).alias("body"))


def _documents(bodies: DataFrame, schema: str) -> DataFrame:
    return landing.good_documents(landing.parse_bodies(bodies, schema))


def _geo_bodies(spark, sf_dir):
    """Events as pages of density features, some without place, name or count."""
    points = event_points(spark, sf_dir)
    kind = F.col("event_type")
    both, one = F.array("lon", "lat"), F.array("lon")
    geometry = F.when(kind != "error", F.struct(
        F.lit("Point").alias("type"), F.when(kind == "signup", one).otherwise(both)
        .alias("coordinates")))
    properties = F.struct(
        F.when(kind != "view", kind).alias("name"),
        F.when(kind != "click", F.col("count")).alias("count"))
    feature = F.struct(geometry.alias("geometry"), properties.alias("properties"))
    return _paged(points, "event_id", feature, lambda e: e.alias("features"))


def geo_scan(spark, sf_dir):
    rows = feeds.geo_signals(_documents(_geo_bodies(spark, sf_dir), GEO_DOCUMENT))
    return rows.select("origin", "pos", "id", "name", "count", "nation", _six("severity"))


def stream_landing(spark, sf_dir):
    """Density pages and web pages arriving as files, one body per line."""
    pages = table(spark, sf_dir, "pages").select(
        F.regexp_replace("html", r"[\r\n]+", " ").alias("body"))
    rows, aside = streamed(spark, "geo", _geo_bodies(spark, sf_dir).select("body").unionByName(pages))
    good = rows.select(F.lit("signal").alias("part"), "name", "count", "nation", _six("severity"))
    aside = aside.select(F.lit("aside").alias("part"), F.col("reason").alias("name"))
    return good.unionByName(aside, allowMissingColumns=True)


def streamed(spark, feed: str, bodies: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Bodies written as landing files, fetched at AS_OF, and what the feed's stream makes of them."""
    folder = work_folder(spark, feed)
    remove_at_exit(spark, folder)
    told = ["at", *streams.FEEDS[feed].folders]
    lines = bodies.withColumn("at", F.lit(AS_OF)).select("body", *told)
    lines.write.partitionBy(*told).text(f"{folder}/files")
    arriving = streams.landing_stream(spark, feed, f"{folder}/files", per_file=False)
    streams.start_feed(arriving, feed, f"{folder}/table", f"{folder}/state").awaitTermination()
    return streams.read_feed(spark, f"{folder}/table", feed), streams.read_aside(spark, f"{folder}/table", feed)


def landing_ids(spark, sf_dir):
    """Signals and their distinct ids, from bodies that share lines' files and files' names."""
    folder = work_folder(spark, "bodies")
    remove_at_exit(spark, folder)
    halves = _geo_bodies(spark, sf_dir).select("body", F.pmod("origin", F.lit(2)).alias("half"))
    # Each task writes a file of the same name for either half.
    halves.write.partitionBy("half").text(folder)
    bodies = landing.read_bodies(spark, folder, per_file=False)
    rows = feeds.geo_signals(_documents(bodies, GEO_DOCUMENT))
    return rows.agg(F.count("*").alias("signals"), F.countDistinct("id").alias("ids"))


def conflict_bodies(spark, sf_dir, day="o_orderdate"):
    """Orders as pages of conflict records, some without place, toll or kind."""
    points = order_points(spark, sf_dir, "o_orderstatus", "o_orderpriority")
    low = F.col("o_orderpriority") == "5-LOW"
    record = F.struct(
        F.when(F.col("o_orderstatus") == "P", F.when(low, F.lit("abc")).otherwise(F.lit("")))
        .otherwise(F.col("lat").cast("string")).alias("latitude"),
        F.col("lon").cast("string").alias("longitude"),
        F.when(~low, F.lit("Battle")).alias("event_type"),
        F.when(F.col("o_orderpriority") == "1-URGENT", F.lit("Shelling")).alias("sub_event_type"),
        F.when(F.col("o_orderstatus") == "F", F.col("o_orderpriority")).alias("location"),
        F.when(low, F.lit("")).otherwise(F.col("fatalities").cast("string")).alias("fatalities"),
        F.date_format(day, "yyyy-MM-dd").alias("event_date"))
    return _paged(points, "o_orderkey", record, lambda e: e.alias("data"))


def conflict_scan(spark, sf_dir):
    bodies = conflict_bodies(spark, sf_dir).withColumn("asked", F.lit("Ukraine"))
    rows = feeds.conflict_signals(_documents(bodies, CONFLICT_DOCUMENT))
    return rows.select(
        "origin", "pos", "name", "count", "nation", _six("severity"),
        F.date_format("event_date", "yyyy-MM-dd").alias("event_date"))


def article_bodies(spark, sf_dir):
    """Web pages as pages of articles, some without title, time, host or country."""
    pages = table(spark, sf_dir, "pages")
    title = F.regexp_extract("html", "<title>([^<]*)</title>", 1)
    lang = F.regexp_extract("html", '<html lang="([a-z]*)"', 1)
    kind = F.pmod("page_id", F.lit(5))
    article = F.struct(
        F.col("url"), F.when(kind == 3, F.lit("")).otherwise(title).alias("title"),
        F.when(kind != 1, F.concat(F.lit("20240115T0930"), F.lpad(
            F.pmod("page_id", F.lit(60)).cast("string"), 2, "0"), F.lit("Z"))).alias("seendate"),
        F.when(kind == 2, F.lit("")).when(kind == 4, F.lit("wire.example")).alias("domain"),
        F.when(lang != "en", lang).alias("sourcecountry"))
    return _paged(pages, "page_id", article, lambda e: e.alias("articles"))


def article_scan(spark, sf_dir):
    bodies = article_bodies(spark, sf_dir)
    items = feeds.article_items(_documents(bodies, ARTICLE_DOCUMENT), AS_OF)
    return items.select(
        "origin", "pos", "title", "url", "domain", "country",
        clock.iso_text(F.col("seen")).alias("seen"), "seen_ok")


def report_bodies(spark, sf_dir):
    """Documents as pages of reports, some without source, time, url or country."""
    docs = table(spark, sf_dir, "documents")
    source = F.when(F.col("lang") == "fr", F.array().cast(
        "array<struct<shortname:string,name:string>>")).otherwise(
        F.array(F.struct(F.col("source").alias("shortname"), F.lit(None).cast("string").alias("name"))))
    fields = F.struct(F.struct(
        F.col("text").alias("title"),
        F.when(F.col("lang") != "es", F.concat(F.lit("https://r.example.org/"), "doc_id"))
        .alias("url"),
        source.alias("source"),
        F.struct(F.when(F.col("lang") != "de", F.lit("2024-01-15T09:30:00+00:00"))
                 .alias("created")).alias("date"),
        F.when(F.col("source") != "src1", F.array(F.struct(F.col("lang").alias("name"))))
        .alias("country")).alias("fields"))
    return _paged(docs, "doc_id", fields, lambda e: e.alias("data"))


def report_scan(spark, sf_dir):
    bodies = report_bodies(spark, sf_dir).select(
        "*", F.lit("Ukraine").alias("asked"), F.lit("UA").alias("nation"))
    items = feeds.report_items(_documents(bodies, REPORT_DOCUMENT), AS_OF)
    return items.select(
        "origin", "pos", "title", "url", "domain", "country", "seen_ok", "nation")


def timeline_bodies(spark, sf_dir):
    """A body per event type, with two series of which the first counts."""
    daily = _daily(spark, sf_dir)
    point = F.struct(F.date_format("t", "yyyyMMdd'T'HHmmss'Z'").alias("date"),
                     F.when(F.col("count") >= 2, F.col("tone")).alias("value"))
    series = daily.groupBy("subject").agg(F.sort_array(F.collect_list(point)).alias("data"))
    second = F.struct(F.slice("data", 1, 1).alias("data"))
    body = F.to_json(F.struct(F.array(F.struct("data"), second).alias("timeline")))
    return series.select(
        F.col("subject").alias("origin"), "subject", F.lit("tone").alias("metric"),
        body.alias("body"))


def timeline_scan(spark, sf_dir):
    bodies = timeline_bodies(spark, sf_dir)
    points = feeds.timeline_points(_documents(bodies, TIMELINE_DOCUMENT), AS_OF)
    return points.select(
        "subject", "pos", clock.iso_text(F.col("t")).alias("t"), F.round("v", 6).alias("v"))


def quarantine(spark, sf_dir):
    """Web pages and plain texts arriving where geo documents are expected."""
    good = event_points(spark, sf_dir).select(
        F.concat_ws("-", F.lit("event"), "event_id").alias("origin"),
        F.to_json(F.struct(F.array(F.struct(F.struct("count").alias("properties")))
                           .alias("features"))).alias("body"))
    pages = table(spark, sf_dir, "pages").select(
        F.concat_ws("-", F.lit("page"), "page_id").alias("origin"), F.col("html").alias("body"))
    docs = table(spark, sf_dir, "documents").select(
        F.concat_ws("-", F.lit("doc"), "doc_id").alias("origin"), F.col("text").alias("body"))
    bodies = merge.union_sources(good, pages, docs)
    aside = landing.quarantined(landing.parse_bodies(bodies, GEO_DOCUMENT))
    return aside.select("origin", "reason")


def boundary_subset(spark, sf_dir):
    """Suppliers as boundary features; the ids wanted are the nation keys."""
    supplier = table(spark, sf_dir, "supplier")
    ring = F.array(F.array(F.col("s_suppkey").cast("double"), F.lit(1.0)))
    feature = F.struct(
        F.col("s_suppkey").cast("string").alias("id"),
        F.struct(F.col("s_name").alias("name")).alias("properties"),
        F.struct(F.lit("LineString").alias("type"), ring.alias("coordinates")).alias("geometry"))
    bodies = _paged(supplier, "s_suppkey", feature, lambda e: e.alias("features"))
    wanted = table(spark, sf_dir, "nation").select(
        F.col("n_nationkey").cast("string").alias("id"), F.col("n_name").alias("code"))
    kept = boundaries.boundary_features(_documents(bodies, BOUNDARY_DOCUMENT), wanted)
    return kept.select(
        "code", "name", F.variant_get("geometry", "$.type", "string").alias("kind"),
        F.variant_get("geometry", "$.coordinates[0][0]", "double").alias("lon"))


def resolved_requests(spark, sf_dir):
    """Events as questions, with known, unknown and missing arguments."""
    theaters = F.array(*[F.lit(x) for x in ("middle-east", "eastern-europe", "global", "atlantis", None)])
    subjects = F.array(*[F.lit(x) for x in ("IR", "IL", "UA", "RU", "XX", "ir", None)])
    asked = table(spark, sf_dir, "events").select(
        "event_id", F.element_at(theaters, (F.pmod("event_id", F.lit(5)) + 1).cast("int")).alias("theater"),
        F.element_at(subjects, (F.pmod("event_id", F.lit(7)) + 1).cast("int")).alias("subject"))
    return arguments.resolve_requests(asked, "theater", "subject").select(
        "event_id", "theater_id", "theater_label", "subject_name", "refused")


# --- Answers -----------------------------------------------------------------

def _theater_status(spark, sf_dir, kind: str = "events", otherwise: str = "degraded"):
    """Fetches of theaters from three event types: fresh ones, old ones, and failures alone."""
    theater = F.try_element_at(
        F.create_map(*[F.lit(v) for v in (
            "click", "middle-east", "view", "eastern-europe", "purchase", "global")]),
        F.col("event_type"))
    at = F.when(F.col("event_type") == "click", _before_as_of(F.pmod("event_id", F.lit(40)))).otherwise(F.col("ts"))
    log = event_points(spark, sf_dir).select(
        theater.alias("theater"), "event_id", at.alias("ts"),
        F.col("count").alias("n_rows"), (F.col("event_type") != "purchase").alias("ok"))
    state = freshness.feed_state(
        log.filter(F.col("theater").isNotNull()), ["theater"], "ts", F.col("ok"), "n_rows", clock.moment(AS_OF, NTZ),
        fv.TTL_SECONDS[kind], ties=["event_id"], otherwise=otherwise)
    return dims.dim_theater(spark).select("theater").join(state.select("theater", "status"), "theater", "left")


def _before_as_of(seconds):
    return clock.moment(AS_OF, NTZ) - F.make_dt_interval(secs=seconds.cast("int"))


def _events_answer(spark, sf_dir):
    theaters = dims.dim_theater(spark)
    known = theater_signals(spark, sf_dir).filter(F.col("observed_at") <= clock.moment(AS_OF, NTZ))
    picture = payloads.events_picture(
        known, merge.seed_signals(spark), theaters)
    return payloads.events_payload(
        picture, theaters, dims.dim_subject(spark), dims.theater_subject(spark),
        _theater_status(spark, sf_dir), clock.moment(AS_OF, NTZ))


def answer_parts(answer: DataFrame) -> DataFrame:
    """One row per event, arc and subject of each theater's answer, exploded once."""
    def part(kind: str, column: str, key: str, value: str, word: str):
        return F.transform(F.coalesce(column, F.array()), lambda x, i: F.struct(
            F.lit(kind).alias("part"), i.cast("bigint").alias("pos"), x[key].alias("key"),
            F.round(x[value], 6).alias("value"), x[word].alias("word")))

    parts = F.concat(part("event", "events", "id", "severity", "nation"),
                     part("arc", "arcs", "arc_id", "intensity", "label"),
                     part("nation", "nations", "code", "score", "threat"))
    return answer.select(
        "theater", "status", clock.iso_text(F.col("updated_at")).alias("updated_at"), F.explode(parts).alias("p")
    ).select("theater", "status", "updated_at", "p.*")


def payload_events(spark, sf_dir):
    """The events answer, one row per event, arc and subject in it."""
    return answer_parts(_events_answer(spark, sf_dir))


def payload_sink(spark, sf_dir):
    """The events answer published as one JSON document per theater and read back."""
    folder = work_folder(spark, "payload")
    remove_at_exit(spark, folder)
    answer = _events_answer(spark, sf_dir)
    sinks.publish(answer, folder, "theater")
    back = sinks.read_published(spark, folder, answer.schema)
    return back.select(
        "theater", "status", F.size("events").cast("bigint").alias("events"),
        F.size("arcs").cast("bigint").alias("arcs"),
        F.size("nations").cast("bigint").alias("nations"),
        F.round(F.aggregate("events", F.lit(0.0), lambda t, e: t + e["severity"]), 6)
        .alias("severity_sum"))


def payload_feed(spark, sf_dir):
    """The feed answer, one row per item."""
    known = document_items(spark, sf_dir).filter(F.col("seen") <= clock.moment(AS_OF, NTZ))
    items = payloads.feed_items(known, ROUTES, WORD_LISTS)
    answer = payloads.items_payload(
        items, dims.dim_theater(spark), _theater_status(spark, sf_dir, "feed", "offline"),
        clock.moment(AS_OF, NTZ), fv.NOTE_FEED)
    return answer.select("theater", "status", F.posexplode("items").alias("pos", "i")).select(
        "theater", "status", F.col("pos").cast("bigint").alias("pos"), F.col("i.id").alias("id"),
        F.col("i.title").alias("title"), F.col("i.nation").alias("nation"),
        clock.iso_text(F.col("i.seen")).alias("seen"))


def payload_situation(spark, sf_dir):
    """The situation answer, one row per item; regions are theaters."""
    items = _situation(spark, sf_dir).select(
        "theater", "rank", "id", "nation", "seen",
        *[F.lit(None).cast("string").alias(c) for c in ("title", "url", "domain", "country")])
    regions = table(spark, sf_dir, "region").select("r_regionkey", F.col("r_name").alias("theater"))
    # Events are dealt to four regions: fresh, old, failing and empty fetches; a fifth has none.
    dealt = F.pmod("event_id", F.lit(4)).cast("int")
    log = event_points(spark, sf_dir).select(
        dealt.alias("r_regionkey"), "event_id", (dealt != 2).alias("ok"),
        _before_as_of(F.when(dealt == 1, 400).otherwise(0) + F.pmod("event_id", F.lit(250))).alias("at"),
        F.when(dealt == 3, F.lit(0)).otherwise(1 + F.abs("count")).alias("n_rows"))
    state = freshness.feed_state(
        log, ["r_regionkey"], "at", F.col("ok"), "n_rows", clock.moment(AS_OF, NTZ),
        fv.TTL_SECONDS["situation"], ties=["event_id"])
    status = regions.join(state, "r_regionkey", "left").select("theater", "status")
    answer = payloads.items_payload(
        items, regions, status, clock.moment(AS_OF, NTZ), fv.NOTE_SITUATION)
    return answer.select("theater", "status", F.posexplode("items").alias("pos", "i")).select(
        "theater", "status", F.col("pos").cast("bigint").alias("pos"), F.col("i.id").alias("id"),
        F.col("i.nation").alias("nation"))


def payload_pulse(spark, sf_dir):
    """The pulse answer for every event type, one row per point."""
    recent = _tone_events(spark, sf_dir).filter(
        clock.within_days(F.col("ts"), AS_OF, fv.PULSE_LOOKBACK_DAYS, NTZ))
    daily = timeline.timeline(recent, "ts", "event_type", "tone").withColumn(
        "pos", F.row_number().over(Window.partitionBy("subject").orderBy("t")))
    series = daily.select(
        "subject", "pos", "t",
        F.explode(F.create_map(F.lit("volume"), F.col("volume"), F.lit("tone"), F.col("tone")))
        .alias("metric", "v"))
    subjects = daily.select("subject").distinct()
    # Fetches of a subject: fresh ones, failures alone, and old ones.
    kind = F.col("event_type")
    at = F.when(kind == "click", _before_as_of(F.pmod("event_id", F.lit(100)))).otherwise(F.col("ts"))
    log = event_points(spark, sf_dir).select(
        kind.alias("subject"), "event_id", at.alias("ts"), F.col("count").alias("n_rows"),
        (kind != "error").alias("ok"))
    status = freshness.feed_state(
        log, ["subject"], "ts", F.col("ok"), "n_rows", clock.moment(AS_OF, NTZ),
        fv.TTL_SECONDS["pulse"], ties=["event_id"]).select("subject", "status")
    answer = payloads.pulse_payload(series, subjects, status, clock.moment(AS_OF, NTZ))
    parts = [
        answer.select("subject", "status", "tone_now", F.posexplode(metric).alias("pos", "p"))
        .select("subject", "status", _six("tone_now"), F.lit(metric).alias("metric"),
                F.col("pos").cast("bigint").alias("pos"),
                clock.iso_text(F.col("p.t")).alias("t"), F.round("p.v", 6).alias("v"))
        for metric in ("volume", "tone")
    ]
    return merge.union_sources(*parts)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        pressure_index, watchlist_report, severity_share, severity_log, threat_bands,
        bbox_clip, geofence, geofence_bucketed, geofence_zone_table,
        heat_grid, heat_kernel, heat_grid_dense,
        source_union, top_signals, strongest_signals, seed_fallback,
        hottest_per_subject, tension_arcs, arc_rails,
        keyword_filter, keyword_attribution, keyword_dictionary, url_domain, compact_ts,
        situation_feed, ticker_report, event_dossier, subject_dossier,
        lookback, conflict_lookback, conflict_recent, timeline_volume, timeline_tone, timeline_stats,
        tone_now, tone_gauge,
        fetch_freshness, last_known_good, feed_status, missing_keys,
        insert_if_absent, insert_bucketed, domain_check,
        stream_signals, stream_volume, stream_fetch_state, stream_landing,
        geo_scan, landing_ids, conflict_scan, article_scan, report_scan, timeline_scan,
        quarantine, boundary_subset, resolved_requests,
        payload_events, payload_sink, payload_feed, payload_situation, payload_pulse,
    )
}
