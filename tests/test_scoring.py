import math

import pytest
from pyspark.sql import functions as F

from signalgrid import dims
from signalgrid.functions import clock, display, scoring, text
from signalgrid.operators import merge, pressure, ranking, zones
from signalgrid.plans import payloads
from signalgrid.session import local_table


def column(spark, values, expression, ddl="double"):
    frame = local_table(spark, [(i, v) for i, v in enumerate(values)], f"i int, x {ddl}")
    return [r.y for r in frame.select("i", expression(F.col("x")).alias("y")).orderBy("i").collect()]


def test_severity_by_fatalities(spark):
    got = column(spark, [0.0, 1.0, 9.0, 12.0, -3.0], scoring.severity_by_fatalities)
    assert got == pytest.approx([0.45, 0.600515, 0.95, 1.0, 0.45], abs=1e-6)


def test_threat_band_edges(spark):
    got = column(spark, [0.92, 0.75, 0.55, 0.38, 0.2, 0.1999], scoring.threat_band)
    assert got == ["critical", "severe", "high", "elevated", "guarded", "low"]


def test_tone_gauge(spark):
    tones = [-12.0, -3.0, 1.0, 0.0]
    assert column(spark, tones, scoring.tone_level) == [-10.0, -3.0, 1.0, 0.0]
    assert column(spark, tones, scoring.tone_percent) == pytest.approx([0, 35, 55, 50])
    assert column(spark, tones, scoring.tone_band) == ["danger", "warning", "success", "warning"]


def test_share_severity_scales_by_rows_dropped_later(spark):
    rows = local_table(
        spark, [(1, 100.0, 200.0), (2, 25.0, 50.0), (3, 0.0, 50.0)],
        "id int, count double, lon double")
    scored = pressure.add_share_severity(rows).filter("lon < 180").orderBy("id").collect()
    assert [r.severity for r in scored] == [0.5, 0.0]


def test_peak_is_one_without_positive_counts(spark):
    rows = local_table(spark, [(0.0,), (-4.0,)], "count double")
    assert pressure.peak_count(rows).first().peak == 1.0
    assert pressure.peak_count(rows.limit(0)).first().peak == 1.0


def test_share_parts_equal_plain_tally(spark):
    rows = local_table(
        spark, [("a", 9.0), ("a", 4.0), ("b", 16.0), ("b", 0.0), ("c", -1.0)],
        "code string, count double")
    plain = pressure.tally(pressure.add_share_severity(rows), ["code"])
    fused = pressure.finish_share_tally(pressure.share_parts(rows, ["code"]))
    a = {r.code: (r.events, r.severity_sum) for r in plain.collect()}
    b = {r.code: (r.events, r.severity_sum) for r in fused.collect()}
    assert a.keys() == b.keys()
    for code in a:
        assert a[code][0] == b[code][0]
        assert a[code][1] == pytest.approx(b[code][1])


SEED_SCORES = {
    ("middle-east", "IR"): (5, 0.892, "severe"),
    ("middle-east", "IL"): (4, 0.794375, "severe"),
    ("eastern-europe", "UA"): (10, 0.8911, "severe"),
    ("eastern-europe", "RU"): (1, 0.37, "guarded"),
    ("global", "IR"): (5, 0.617, "high"),
    ("global", "IL"): (4, 0.574375, "high"),
    ("global", "UA"): (10, 0.8911, "severe"),
    ("global", "RU"): (1, 0.37, "guarded"),
}


def test_seed_attribution(spark):
    nation = {r.pos: r.nation for r in merge.seed_signals(spark).collect()}
    assert [p for p, n in sorted(nation.items()) if n == "IR"] == [0, 1, 2, 3, 10]
    assert [p for p, n in sorted(nation.items()) if n == "IL"] == [4, 5, 6, 7]
    assert [p for p, n in sorted(nation.items()) if n == "RU"] == [20]
    assert [p for p, n in sorted(nation.items()) if n is None] == [8, 9]


def test_seed_counts_are_rounded_weights(spark):
    rows = merge.seed_signals(spark).collect()
    assert all(r["count"] == round(r.severity * 100) for r in rows)


def test_seed_pressure(spark):
    coded = merge.seed_signals(spark).filter("nation IS NOT NULL").withColumnRenamed(
        "nation", "code")
    members = dims.theater_subject(spark)
    scores = pressure.pressure_index(pressure.tally(coded, ["code"]), members)
    got = {(r.theater, r.code): r for r in scores.collect()}
    assert set(got) == set(SEED_SCORES)
    for key, (events, score, threat) in SEED_SCORES.items():
        assert got[key].events == events
        assert got[key].score == pytest.approx(score, abs=1e-9)
        assert got[key].threat == threat


def test_silent_subjects_score_zero(spark):
    coded = merge.seed_signals(spark).limit(0).withColumnRenamed("nation", "code")
    rows = pressure.pressure_index(
        pressure.tally(coded, ["code"]), dims.theater_subject(spark)).collect()
    assert len(rows) == 8
    assert {(r.events, r.score, r.threat) for r in rows} == {(0, 0.0, "low")}


def test_stable_top_k_on_seeds(spark):
    best = ranking.top_k(merge.seed_signals(spark), payloads.signal_order(), 7)
    assert [r.pos for r in best.collect()] == [7, 0, 13, 14, 2, 4, 11]


def test_salted_top_k_equals_plain(spark):
    rows = spark.range(5000).select(
        F.col("id"), (F.col("id") % 3 == 0).cast("string").alias("g"),
        F.pmod(F.col("id") * 7919, F.lit(101)).alias("v"))
    order = [F.desc("v"), F.asc("id")]
    plain = ranking.top_k_per_group(rows, ["g"], order, 20)
    salted = ranking.top_k_per_group(rows, ["g"], order, 20, spread=["id"])
    assert sorted(map(tuple, plain.collect())) == sorted(map(tuple, salted.collect()))


def test_last_by_position_not_by_time(spark):
    rows = local_table(
        spark, [("a", 0, 5.0), ("a", 2, -1.5), ("a", 1, 9.0)], "s string, pos int, v double")
    assert ranking.last_by_position(rows, ["s"], "pos", "v", "now").first().now == -1.5


COMPACT = {
    "20240115T093000Z": "2024-01-15T09:30:00Z",
    "20240115": "2024-01-15T00:00:00Z",
    "2024011509300099": "2024-01-15T09:30:00Z",
    "20241345": None,
    "x": None,
}


def test_compact_timestamps(spark):
    got = column(
        spark, list(COMPACT), lambda c: clock.iso_text(clock.compact_timestamp(c)), "string")
    assert got == list(COMPACT.values())


def test_keyword_attribution_golden(spark):
    cases = [
        ("Israel", "Iran talks", "IR"), ("—", "Gaza aid", "IL"), ("—", "Tel Aviv port", "IL"),
        ("—", "Iranians protest", None), ("—", "KYIV", "UA"), ("—", "éiran", "IR"),
        ("—", "iran_x", None), ("", "putin", "RU"), ("—", "tel  aviv", None),
    ]
    frame = local_table(
        spark, [(i, *c) for i, c in enumerate(cases)],
        "i int, country string, title string, wanted string")
    hay = F.concat_ws(" ", "country", "title")
    rows = frame.withColumn("code", text.first_keyword(hay, dims.SUBJECT_KEYWORDS)).collect()
    assert [(r.title, r.code) for r in rows] == [(r.title, r.wanted) for r in rows]


def test_hosts(spark):
    got = column(
        spark, ["https://M.Example.net:81/en/25#top", "http://[bad", "nonsense"], text.host_of, "string")
    assert got == ["m.example.net", None, None]


def test_short_title(spark):
    exact, long = "a" * 90, "é" * 91
    got = column(spark, [exact, long], display.short_title, "string")
    assert got == [exact, "é" * 90 + "…"]


def test_bbox_edges_are_inside(spark):
    edges = [(33.0, 30.0), (64.0, 30.0), (40.0, 24.0), (40.0, 40.5), (32.9999, 30.0),
             (float("nan"), 30.0)]
    points = local_table(spark, edges, "lon double, lat double")
    rows = zones.clip_to_theaters(points, dims.THEATER_BOXES).filter(
        "theater = 'middle-east'").collect()
    assert {(r.lon, r.lat) for r in rows} == set(edges[:4])
    assert not any(math.isnan(r.lon) for r in rows)


def test_unknown_arguments():
    assert dims.resolve_theater("atlantis") == "middle-east"
    assert dims.resolve_theater(None) == "middle-east"
    assert dims.resolve_theater("global") == "global"
    with pytest.raises(ValueError):
        dims.resolve_subject("XX")
