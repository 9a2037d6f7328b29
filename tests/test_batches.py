"""Bodies to committed batches to answers, with failures on the way."""

import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from signalgrid import fixed_values as fv
from signalgrid.operators.asof import as_of_time
from signalgrid.plans import answers, live
from signalgrid.session import local_table
from signalgrid.sources import batches
from signalgrid.sources.signals import SIGNAL, signal_parts

ASKED = "origin string, source string, key string, asked string, at string"


def stamp(df, *columns):
    return df.withColumns({c: F.col(c).cast("timestamp") for c in columns})


def asked(spark, *rows):
    return stamp(local_table(spark, rows, ASKED), "at")


def bodies(spark, **by_origin):
    rows = [(k, v if isinstance(v, str) or v is None else json.dumps(v)) for k, v in by_origin.items()]
    return local_table(spark, rows, "origin string, body string")


def geo(*counts, lon=51.4, lat=35.7):
    return {"features": [{"geometry": {"coordinates": [lon, lat]}, "properties": {"name": f"n{c}", "count": c}} for c in counts]}


def record(day, **more):
    return {"latitude": "48.6", "longitude": "38.0", "event_type": "Battle", "event_date": day, **more}


def fetch(spark, table, at, batch, theater="middle-east", body=None, **more):
    name = f"b{batch}"
    batches.land(signal_parts(asked(spark, (name, fv.SOURCE_GEO, theater, None, at)),
                              bodies(spark, **{name: body} if body is not None else {"other": "{}"})), table, batch)


@pytest.mark.parametrize("forward", [False, True])
@pytest.mark.parametrize("bucket", ["minute", "hour", "day"])
def test_as_of_equals_brute_force(spark, bucket, forward):
    pick = random.Random(11)
    when = lambda: f"2024-01-{pick.randrange(1, 4):02d} {pick.randrange(24):02d}:{pick.randrange(60):02d}:00"
    key = lambda: "hot" if pick.random() < 0.6 else pick.choice(["a", "b", "c", None])
    facts = [(key(), when() if pick.random() < 0.95 else None, 1) for _ in range(150)]
    asks = [(key(), when() if pick.random() < 0.95 else None, i) for i in range(300)] + [("never", "2024-01-01 00:00:00", 300)]
    asks += asks[:3] + [("a", facts[0][1], 301)]
    got = as_of_time(stamp(local_table(spark, asks, "key string, at string, i int"), "at"),
                     stamp(local_table(spark, facts, "key string, t string, at int"), "t"), ["key"], "at", "t", bucket, forward)
    assert got.columns == ["key", "at", "i", "found_at"]
    rows = got.collect()
    assert len(rows) == len(asks)
    wanted = {}
    for k, a, i in asks:
        good = [t for q, t, _ in facts if q == k and k is not None and t and a and (t >= a if forward else t <= a)]
        wanted[i] = (min if forward else max)(good, default=None)
    assert {r.i: r.found_at and str(r.found_at) for r in rows} == wanted


def test_the_last_good_answer_outlives_a_failed_fetch(spark, tmp_path):
    table = str(tmp_path / "t")
    fetch(spark, table, "2024-01-01 00:00:00", 0, body=geo(4, 9))
    fetch(spark, table, "2024-01-02 00:00:00", 1, body="<html>busy</html>")
    fetch(spark, table, "2024-01-03 00:00:00", 2)
    fetch(spark, table, "2024-01-04 00:00:00", 3, body=geo(7))
    asks = stamp(local_table(spark, [(fv.SOURCE_GEO, "middle-east", f"2024-01-{d:02d} 12:00:00") for d in range(1, 6)]
                             + [(fv.SOURCE_GEO, "middle-east", "2023-12-31 00:00:00"), (fv.SOURCE_GEO, "global", "2024-01-02 00:00:00")],
                             "source string, key string, as_of string"), "as_of")
    served = live.last_good_answer(
        asks, batches.fetch_log(spark, table), batches.part_of(spark, table, batches.ROW, SIGNAL)).collect()
    got = {}
    for r in served:
        got.setdefault(r.as_of.day, set()).add((r.last_good.day, r["count"]))
    assert got == {1: {(1, 4), (1, 9)}, 2: {(1, 4), (1, 9)}, 3: {(1, 4), (1, 9)}, 4: {(4, 7)}, 5: {(4, 7)}}
    log = {r.at.day: (r.ok, r.n_rows, r.reason) for r in batches.fetch_log(spark, table).collect()}
    assert log == {1: (True, 2, None), 2: (False, 0, "markup"), 3: (False, 0, "missing"), 4: (True, 1, None)}


def test_a_half_written_batch_is_not_there(spark, tmp_path, monkeypatch):
    table = str(tmp_path / "t")
    fetch(spark, table, "2024-01-01 00:00:00", 0, body=geo(4))

    def broken(*args):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(batches, "commit", broken)
        with pytest.raises(RuntimeError, match="lost"):
            fetch(spark, table, "2024-01-02 00:00:00", 1, body=geo(5, 6))
    assert batches.part_of(spark, table, batches.ROW, SIGNAL).count() == 3
    status, events = answer(spark, table, "2024-01-02 00:00:30")
    assert (status, events) == ("degraded", ["n4"])
    # Writing the batch again replaces what was left of it.
    fetch(spark, table, "2024-01-02 00:00:00", 1, body=geo(6))
    fetch(spark, table, "2024-01-02 00:00:00", 1, body=geo(6))
    assert answer(spark, table, "2024-01-02 00:00:30") == ("ok", ["n6"])
    assert answer(spark, table, "2024-01-02 00:01:01")[0] == "degraded"
    assert batches.part_of(spark, table, batches.ROW, SIGNAL).count() == 2


def answer(spark, table, as_of, theater="middle-east"):
    row = live.events_answers(spark, table, as_of, theater).first()
    return row.status, [e.name for e in row.events]


def test_unread_bodies_stop_the_commit(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(batches, "fetches", lambda parts: parts.limit(0).selectExpr("source", "key", "at", "0L AS n_bodies"))
    with pytest.raises(RuntimeError, match="0 of 1 bodies"):
        fetch(spark, str(tmp_path / "t"), "2024-01-01 00:00:00", 0, body=geo(4))


def test_one_parse_gives_signals_fetches_and_bad_bodies(spark, tmp_path):
    table = str(tmp_path / "t")
    at = "2024-01-15 00:00:00"
    rows = asked(spark, ("g", fv.SOURCE_GEO, "global", None, at), ("c", fv.SOURCE_CONFLICT, "UA", "Ukraine", at),
                 ("h", fv.SOURCE_GEO, "global", None, at), ("x", fv.SOURCE_CONFLICT, "IR", "Iran", at),
                 ("n", fv.SOURCE_CONFLICT, "IL", "Israel", at), ("e", fv.SOURCE_GEO, "middle-east", None, at))
    odd = geo(64)
    odd["features"] += [{"geometry": None}, {"geometry": {"coordinates": [1]}}, "text", 7, {"properties": {"count": 100}},
                        {"geometry": {"coordinates": [36.2, 50.0]}, "properties": {"count": "16"}}]
    conflict = {"data": [record("2024-01-14", fatalities="12", location="Bakhmut"), record("2024-01-14", latitude=""),
                         record("x", fatalities="many"), record("2024-01-13", longitude="NaN"), None]}
    got = batches.land(signal_parts(rows, bodies(spark, g=odd, c=conflict, h="{", x="", e={"data": []}, unasked=geo(1))), table, "one")
    assert got == {"bodies": 6, "good": 3, "set_aside": 2, "missing": 1, "rows": 4}
    log = {(r.source, r.key): (r.ok, r.n_bodies, r.n_rows, r.reason) for r in batches.fetch_log(spark, table).collect()}
    assert log == {("gdelt", "global"): (False, 2, 2, "malformed"), ("acled", "UA"): (True, 1, 2, None),
                   ("acled", "IR"): (False, 1, 0, "empty"), ("acled", "IL"): (False, 1, 0, "missing"),
                   ("gdelt", "middle-east"): (True, 1, 0, None)}
    signals = batches.part_of(spark, table, batches.ROW, SIGNAL).collect()
    assert {(r.source, r.name, r["count"], r.nation, round(r.severity, 3), r.pos) for r in signals} == {
        ("gdelt", "n64", 64, "IR", 0.8, 0), ("gdelt", "Unknown", 16, "UA", 0.4, 6),
        ("acled", "Battle — Bakhmut", 13, "UA", 1.0, 0), ("acled", "Battle — Ukraine", 1, "UA", 0.45, 2)}
    aside = batches.part_of(spark, table, batches.ASIDE, "origin string, body string, reason string").collect()
    assert {(r.origin, r.body, r.reason) for r in aside} == {("h", "{", "malformed"), ("x", "", "empty")}


def test_lookback_and_cap_before_the_merge(spark, tmp_path):
    table = str(tmp_path / "t")
    at = "2024-01-20 00:00:00"
    days = [dt.date(2024, 1, 20) - dt.timedelta(days=i) for i in range(18)]
    many = {"data": [record(str(d), fatalities=str(i)) for i, d in enumerate(days)]
            + [record("2024-01-21"), record(None)] + [record("2024-01-10", location=f"p{i}") for i in range(500)]}
    rows = asked(spark, ("c", fv.SOURCE_CONFLICT, "UA", "Ukraine", at), ("old", fv.SOURCE_GEO, "middle-east", None, "2024-01-18 12:00:00"),
                 ("mid", fv.SOURCE_GEO, "middle-east", None, "2024-01-19 18:00:00"), ("new", fv.SOURCE_GEO, "middle-east", None, at),
                 ("edge", fv.SOURCE_GEO, "middle-east", None, "2024-01-19 00:00:00"))
    batches.land(signal_parts(rows, bodies(spark, c=many, old=geo(1), edge=geo(4), mid=geo(2), new=geo(3, 9, lon=10.0))), table, 0)
    signals = live.live_signals(
        batches.part_of(spark, table, batches.ROW, SIGNAL), batches.fetch_log(spark, table), "2024-01-25 00:00:00")
    found = signals.collect()
    conflict = [r for r in found if r.source == fv.SOURCE_CONFLICT]
    assert len(conflict) == fv.CONFLICT_CAP
    named = {r.observed_at.date() for r in conflict if r.name == "Battle — Ukraine"}
    assert named == set(days[:11])  # older ones lie beyond the newest 400
    assert sorted(r.name for r in found if r.source == fv.SOURCE_GEO) == ["n2", "n3", "n9"]
    # Features of another place are not in the theater's answer.
    assert answer(spark, table, "2024-01-25 00:00:00") == ("degraded", ["n2"])
    assert answer(spark, table, "2024-01-19 00:00:59") == ("ok", ["n1", "n4"])


def test_silent_theaters_show_the_reference_hotspots(spark, tmp_path):
    table = str(tmp_path / "t")
    fetch(spark, table, "2024-01-01 00:00:00", 0, body="<html>")
    everything = {r.theater: r for r in live.events_answers(spark, table, "2024-01-02 00:00:00").collect()}
    assert set(everything) == {row[0] for row in fv.THEATERS}
    assert all(len(r.events) == len(fv.SEEDS) and r.status == "degraded" and r.note == fv.NOTE_EVENTS for r in everything.values())
    assert live.events_answers(spark, table, "2024-01-02 00:00:00", "atlantis").first().theater == fv.DEFAULT_THEATER


def test_an_empty_batch(spark, tmp_path):
    table = str(tmp_path / "t")
    counts = batches.land(signal_parts(asked(spark), bodies(spark)), table, 0)
    assert counts == {"bodies": 0, "good": 0, "set_aside": 0, "missing": 0, "rows": 0}
    assert batches.fetch_log(spark, table).count() == 0


def signal_table(spark, rows):
    made = stamp(local_table(spark, rows, "id string, source string, nation string, at string, severity double"), "at")
    return made.select("id", "source", "nation", F.col("at").alias("observed_at"), "severity", F.lit("global").alias("theater"),
                       F.lit(35.0).alias("lat"), F.lit(51.0).alias("lon"), F.col("id").alias("name"), F.lit(1).cast("bigint").alias("count"),
                       F.lit(0).alias("source_rank"), F.lit(0).alias("subject_priority"), F.lit(0).cast("bigint").alias("pos"))


def test_events_of_a_signal_table_have_look_backs_and_the_cap(spark):
    rows = [("g1", "gdelt", "IR", "2024-01-14 12:00:00", 0.9), ("g2", "gdelt", "IR", "2024-01-14 11:59:59", 0.8),
            ("g3", "gdelt", "IR", None, 0.7), ("g4", "gdelt", "IR", "2024-01-15 12:00:01", 0.95),
            ("c1", "acled", "UA", "2024-01-01 00:00:00", 0.6), ("c2", "acled", "UA", "2023-12-31 23:59:59", 0.99)]
    rows += [(f"d{i:03d}", "acled", "RU", f"2024-01-{1 + i // 60:02d} 00:00:{i % 60:02d}", 0.5) for i in range(430)]
    log = local_table(spark, [("x", None, True, 1)], "key string, at string, ok boolean, n_rows int").withColumn(
        "at", F.col("at").cast("timestamp"))
    answer = answers.events(signal_table(spark, rows), log, "2024-01-15 12:00:00", "global").first()
    assert [e.id for e in answer.events][:4] == ["g1", "g3", "c1", "d030"]
    assert {n.code: n.events for n in answer.nations} == {"IR": 2, "IL": 0, "UA": 1, "RU": fv.SIGNAL_CAP - 3}
