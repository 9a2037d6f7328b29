"""From raw landing bodies to the four answers."""

import json

import pytest
from pyspark.sql import functions as F

from signalgrid import dims, fixed_values as fv
from signalgrid.functions.clock import moment, within_days
from signalgrid.operators import zones
from signalgrid.plans import answers
from signalgrid.schemas import (
    ARTICLE_DOCUMENT, CONFLICT_DOCUMENT, GEO_DOCUMENT, REPORT_DOCUMENT, TIMELINE_DOCUMENT,
)
from signalgrid.session import local_table
from signalgrid.sources import feeds, landing

AS_OF = "2024-01-15 12:00:00"


def parsed(spark, schema, body, **extra):
    rows = local_table(spark, [("b", json.dumps(body))], "origin string, body string")
    docs = landing.good_documents(landing.parse_bodies(rows, schema))
    return docs.withColumns({k: F.lit(v) for k, v in extra.items()})


def fetch_log(spark, *rows):
    return local_table(spark, rows, "key string, at string, ok boolean, n_rows int").withColumn(
        "at", F.col("at").cast("timestamp"))


def signals(spark):
    """One geo document clipped to the theaters, one conflict document by membership."""
    geo = feeds.geo_signals(parsed(spark, GEO_DOCUMENT, {"features": [
        {"geometry": {"coordinates": [51.389, 35.6892]},
         "properties": {"name": "Tehran", "count": 64}},
        {"geometry": {"coordinates": [36.2304, 49.9935]},
         "properties": {"name": "Kharkiv", "count": 16}},
        {"geometry": {"coordinates": [2.35, 48.85]}, "properties": {"name": "far", "count": 100}},
    ]})).withColumn("source_rank", F.lit(1))
    conflict = feeds.conflict_signals(parsed(spark, CONFLICT_DOCUMENT, {"data": [
        {"latitude": "48.5957", "longitude": "38.0", "event_type": "Battles",
         "location": "Bakhmut", "fatalities": "12"},
    ]}, asked="Ukraine")).drop("event_date").withColumn("source_rank", F.lit(0))
    member = dims.theater_subject(spark).select("theater", F.col("code").alias("nation"))
    placed = zones.clip_to_theaters(geo, dims.THEATER_BOXES).unionByName(
        conflict.join(member, "nation"))
    return placed.withColumns({
        "subject_priority": F.lit(0), "observed_at": moment(AS_OF)})


def test_events_answer(spark):
    log = fetch_log(
        spark, ("events:global", "2024-01-15 11:59:30", True, 3),
        ("events:middle-east", "2024-01-15 11:00:00", True, 1),
        ("events:middle-east", "2024-01-15 11:59:59", False, 0))
    everything = answers.events(signals(spark), log, AS_OF, "global").first()
    assert everything.status == "ok"
    assert [(e.name, e.nation, e.severity) for e in everything.events] == [
        ("Battles — Bakhmut", "UA", 1.0), ("Tehran", "IR", 0.8), ("Kharkiv", "UA", 0.4)]
    scores = {n.code: (n.events, round(n.score, 6), n.threat) for n in everything.nations}
    assert scores == {
        "IR": (1, round(0.55 * 0.5 + 0.45 * 0.8, 6), "high"), "IL": (0, 0.0, "low"),
        "UA": (2, round(0.55 + 0.45 * 0.7, 6), "severe"), "RU": (0, 0.0, "low")}
    assert everything.note is None
    default = answers.events(signals(spark), log, AS_OF, "atlantis").first()
    assert (default.theater, default.status) == ("middle-east", "degraded")
    assert [e.name for e in default.events] == ["Tehran"]
    silent = answers.events(
        signals(spark).filter("theater <> 'eastern-europe'"), log, AS_OF, "eastern-europe").first()
    assert (silent.status, len(silent.events), silent.note) == ("degraded", 22, fv.NOTE_EVENTS)


def test_feed_answer(spark):
    docs = parsed(spark, ARTICLE_DOCUMENT, {"articles": [
        {"url": "https://a/1", "title": "Kremlin on Ukraine", "seendate": "20240115T090000Z"},
        {"url": "https://a/2", "title": "Russia talks", "seendate": "20240115T110000Z"},
        {"url": "https://a/3", "title": "Russia long ago", "seendate": "20240112T110000Z"},
        {"url": "https://a/4", "title": "Moscow alone", "seendate": "20240115T110000Z"},
    ]})
    log = fetch_log(spark, ("feed:eastern-europe", "2024-01-15 11:59:15", True, 2))
    items = feeds.article_items(docs, AS_OF)
    answer = answers.feed(items, log, AS_OF, "eastern-europe").first()
    assert answer.status == "ok"
    assert [(i.title, i.nation) for i in answer["items"]] == [
        ("Russia talks", "RU"), ("Kremlin on Ukraine", "UA")]
    stale = answers.feed(items, log, "2024-01-15 12:00:01", "eastern-europe").first()
    assert stale.status == "degraded"
    empty = answers.feed(items, log, AS_OF).first()
    assert (empty.theater, empty.status, empty["items"], empty.note) == (
        "middle-east", "offline", None, fv.NOTE_FEED)


def test_situation_answer(spark):
    fields = [{"fields": {"title": f"R{i}", "url": f"https://r/{i}",
                          "date": {"created": f"2024-01-{i + 1:02d}T00:00:00+00:00"}}}
              for i in range(20)]
    docs = parsed(spark, REPORT_DOCUMENT, {"data": fields}, asked="Iran", nation="IR")
    log = fetch_log(spark, ("situation:middle-east", "2024-01-15 11:58:00", True, 12))
    answer = answers.situation(feeds.report_items(docs, AS_OF), log, AS_OF).first()
    assert (answer.status, len(answer["items"])) == ("ok", fv.REPORT_CAP_PER_SUBJECT)
    # R15 to R19 are later than the moment asked for.
    assert [i.title for i in answer["items"]][:2] == ["R14", "R13"]


def test_pulse_answer(spark):
    points = [{"date": "20240114T000000Z", "value": 1.0}, {"date": "20240115T000000Z", "value": -4.0},
              {"date": "20231201T000000Z", "value": 9.0}]
    series = feeds.timeline_points(
        parsed(spark, TIMELINE_DOCUMENT, {"timeline": [{"data": points}]},
               subject="IR", metric="tone"), AS_OF)
    answer = answers.pulse(series, fetch_log(spark), AS_OF, "IR").first()
    assert (answer.status, answer.tone_now, answer.volume) == ("degraded", -4.0, None)
    assert [p.v for p in answer.tone] == [1.0, -4.0]
    with pytest.raises(ValueError):
        answers.pulse(series, fetch_log(spark), AS_OF, "XX")


def test_pulse_from_own_articles(spark):
    rows = local_table(
        spark, [("2024-01-14 05:00:00", "IR", 2.0), ("2024-01-14 06:00:00", "UA", 0.0),
                ("2024-01-15 01:00:00", "IR", -6.0), ("2024-01-15 02:00:00", None, 1.0),
                ("2023-12-01 00:00:00", "IR", 5.0)],
        "seen string, nation string, tone double").withColumn("seen", F.col("seen").cast("timestamp"))
    series = answers.subject_timeline(rows, AS_OF)
    log = fetch_log(spark, ("pulse:IR", "2024-01-15 11:59:00", True, 2))
    answer = answers.pulse(series, log, AS_OF, "IR").first()
    assert [p.v for p in answer.volume] == [0.5, 1.0]
    assert [p.v for p in answer.tone] == [2.0, -6.0]
    assert (answer.tone_now, answer.status) == (-6.0, "ok")


def test_lookback_bound_is_inclusive(spark):
    rows = local_table(spark, [("2024-01-14 12:00:00",), ("2024-01-14 11:59:59",)], "t string")
    kept = rows.filter(within_days(F.col("t").cast("timestamp"), AS_OF, 1))
    assert [r.t for r in kept.collect()] == ["2024-01-14 12:00:00"]
