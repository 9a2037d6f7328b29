import json

import pytest
from pyspark.sql import functions as F

from signalgrid import dims, fixed_values as fv
from signalgrid.dims import Keywords
from signalgrid.operators import merge
from signalgrid.plans import payloads
from signalgrid.session import local_table
from signalgrid.sources import sinks


def now():
    return F.lit("2024-01-30 00:00:00").cast("timestamp")


def live_signals(spark, theaters):
    """300 signals per theater, severities with many ties."""
    theater = F.explode(F.array(*[F.lit(t) for t in theaters]))
    return spark.range(300).select(
        F.concat(F.lit("x"), "id").alias("id"), F.lit(35.0).alias("lat"), F.lit(51.0).alias("lon"),
        F.lit("place").alias("name"), F.col("id").alias("count"), F.lit("IR").alias("nation"),
        (F.pmod("id", F.lit(10)) / 10).alias("severity"), F.lit("gdelt").alias("source"),
        F.lit(1).alias("source_rank"), F.lit(0).alias("subject_priority"), F.col("id").alias("pos"),
        now().alias("observed_at"), theater.alias("theater"))


def events_answer(spark, theaters):
    dim = dims.dim_theater(spark)
    picture = payloads.events_picture(
        live_signals(spark, theaters or ["global"]).filter(F.lit(bool(theaters))),
        merge.seed_signals(spark), dim)
    status = dim.select("theater", F.lit("ok").alias("status"))
    return payloads.events_payload(
        picture, dim, dims.dim_subject(spark), dims.theater_subject(spark), status, now())


def test_events_answer(spark):
    rows = {r.theater: r for r in events_answer(spark, ["middle-east"]).collect()}
    assert set(rows) == {t[0] for t in fv.THEATERS}
    live, seeded = rows["middle-east"], rows["global"]
    assert (live.status, live.note, len(live.events)) == ("ok", None, fv.SIGNAL_CAP)
    wanted = sorted(range(300), key=lambda i: (-(i % 10), i))[:fv.SIGNAL_CAP]
    assert [e.id for e in live.events] == [f"x{i}" for i in wanted]
    assert [(n.code, n.events) for n in live.nations] == [("IR", 250), ("IL", 0)]
    assert [a.arc_id for a in live.arcs] == ["arc-IR-IL", "arc-IL-IR"]
    assert live.arcs[1].intensity == fv.QUIET_ARC_INTENSITY
    assert (seeded.status, seeded.note) == ("degraded", fv.NOTE_EVENTS)
    assert [e.id for e in seeded.events] == [f"seed-{i}" for i in range(22)]
    assert {n.code: round(n.score, 6) for n in seeded.nations} == {
        "IR": 0.617, "IL": 0.574375, "UA": 0.8911, "RU": 0.37}


def test_events_answer_without_any_signal(spark):
    rows = events_answer(spark, []).collect()
    assert {(r.status, len(r.events)) for r in rows} == {("degraded", 22)}


def test_answers_are_written_per_theater(spark, tmp_path):
    path = str(tmp_path / "events")
    sinks.write_payload(events_answer(spark, ["global"]), path, "theater")
    files = list((tmp_path / "events" / "theater=global").glob("*.json"))
    body = json.loads("".join(f.read_text() for f in files))
    assert len(body["events"]) == fv.SIGNAL_CAP
    assert body["arcs"][0]["label"] == "Iran → Israel"


def articles(spark, n):
    return spark.range(n).select(
        F.concat(F.lit("a"), F.lpad(F.col("id").cast("string"), 4, "0")).alias("id"),
        F.when(F.col("id") % 4 == 0, "Talks in Russia").otherwise("Iran and Israel").alias("title"),
        F.lit("u").alias("url"), F.lit("d").alias("domain"), F.lit("—").alias("country"),
        F.timestamp_seconds(1706500000 + F.col("id")).alias("seen"), F.col("id").alias("pos"),
        F.lit(None).cast("string").alias("nation"))


def test_feed_answer(spark):
    dim = dims.dim_theater(spark)
    items = payloads.feed_items(articles(spark, 200))
    status = dim.select("theater", F.lit("degraded").alias("status"))
    answer = payloads.items_payload(items, dim, status, now(), fv.NOTE_FEED)
    rows = {r.theater: r for r in answer.collect()}
    assert {t: len(r["items"]) for t, r in rows.items()} == {
        "middle-east": 60, "eastern-europe": 50, "global": 60}
    assert [i.id for i in rows["middle-east"]["items"][:3]] == ["a0199", "a0198", "a0197"]
    assert {i.nation for i in rows["middle-east"]["items"]} == {"IR"}
    assert {i.nation for i in rows["eastern-europe"]["items"]} == {"RU"}
    assert {r.status for r in rows.values()} == {"degraded"}


def test_feed_answer_without_items(spark):
    dim = dims.dim_theater(spark)
    items = payloads.feed_items(articles(spark, 5), routes=[Keywords("global", ("nothing",))])
    status = dim.select("theater", F.lit("ok").alias("status"))
    rows = payloads.items_payload(items, dim, status, now(), fv.NOTE_FEED).collect()
    assert {(r.status, r["items"], r.note) for r in rows} == {("offline", None, fv.NOTE_FEED)}


def test_situation_caps(spark):
    reports = articles(spark, 200).drop("nation").withColumn(
        "nation", F.element_at(F.array(*[F.lit(c) for c in ("IR", "IR", "IR", "IL", "UA")]),
                               (F.substring("id", 2, 4).cast("int") % 5 + 1)))
    items = payloads.situation_items(reports, dims.theater_subject(spark))
    rows = items.collect()
    per_theater = {}
    for r in rows:
        per_theater.setdefault(r.theater, []).append(r)
    assert {t: len(v) for t, v in per_theater.items()} == {
        "middle-east": 24, "eastern-europe": 12, "global": 24}
    middle = per_theater["middle-east"]
    assert sum(r.nation == "IR" for r in middle) == sum(r.nation == "IL" for r in middle) == 12
    seen = [r.seen for r in sorted(per_theater["global"], key=lambda r: r.rank)]
    assert seen == sorted(seen, reverse=True)


def test_situation_ties_follow_subject_and_input_order(spark):
    reports = local_table(
        spark, [("z", 0, "IL"), ("y", 1, "IL"), ("b", 0, "IR"), ("a", 1, "IR")],
        "id string, pos int, nation string").withColumn("seen", now())
    items = payloads.situation_items(reports, dims.theater_subject(spark))
    rows = items.filter("theater = 'middle-east'").orderBy("rank").collect()
    assert [r.id for r in rows] == ["b", "a", "z", "y"]


def test_pulse_answer(spark):
    series = local_table(
        spark, [("IR", "volume", 1, 0.5), ("IR", "volume", 0, 0.25), ("IR", "tone", 1, -2.0),
                ("IR", "tone", 0, 7.0), ("IL", "volume", 0, 1.0)],
        "subject string, metric string, pos int, v double").withColumn("t", now())
    subjects = dims.dim_subject(spark).select(F.col("code").alias("subject"))
    status = local_table(spark, [("IR", "ok"), ("IL", "degraded")], "subject string, status string")
    rows = {r.subject: r for r in payloads.pulse_payload(series, subjects, status, now()).collect()}
    assert [p.v for p in rows["IR"].volume] == [0.25, 0.5]
    assert [p.v for p in rows["IR"].tone] == [7.0, -2.0]
    assert (rows["IR"].tone_now, rows["IR"].status) == (-2.0, "ok")
    assert (rows["IL"].tone_now, rows["IL"].status, rows["IL"].tone) == (0.0, "degraded", None)
    assert (rows["UA"].status, rows["UA"].note) == ("offline", fv.NOTE_PULSE)
