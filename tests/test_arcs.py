import math

import pytest
from pyspark.sql import functions as F

from signalgrid import dims
from signalgrid.operators import arcs, merge, ranking
from signalgrid.session import local_table

ARC = "from_lon double, from_lat double, to_lon double, to_lat double"


def seed_arcs(spark, seeds=None):
    seeds = merge.seed_signals(spark) if seeds is None else seeds
    coded = seeds.filter("nation IS NOT NULL").withColumnRenamed("nation", "code")
    hot = ranking.hottest(
        coded.join(dims.theater_subject(spark).select("theater", "code"), "code"),
        ["theater", "code"], ["lon", "lat", "name"], [-F.col("pos")])
    pairs = arcs.adversary_pairs(dims.dim_subject(spark), dims.theater_subject(spark))
    return arcs.tension_arcs(pairs, hot)


def test_arcs_start_at_hottest_seed(spark):
    got = {(r.theater, r.code): r for r in seed_arcs(spark).collect()}
    assert len(got) == 8
    starts = {
        "IR": (51.389, 35.6892, 0.9, "IL"), "IL": (34.4668, 31.5017, 0.95, "IR"),
        "UA": (38.0, 48.5957, 0.9, "RU"), "RU": (37.6173, 55.7558, 0.7, "UA"),
    }
    for (_, code), row in got.items():
        lon, lat, intensity, adversary = starts[code]
        assert (row.from_lon, row.from_lat, row.intensity) == (lon, lat, intensity)
        assert row.adversary == adversary
        assert row.arc_id == f"arc-{code}-{adversary}"
        assert row.derived
    assert got["middle-east", "IR"].label == "Iran → Israel"


def test_quiet_subjects_start_at_their_capital(spark):
    rows = seed_arcs(spark, merge.seed_signals(spark).limit(0)).collect()
    assert len(rows) == 8
    assert {r.intensity for r in rows} == {0.4}
    assert {(r.from_lon, r.from_lat) for r in rows if r.code == "IR"} == {(51.389, 35.6892)}


def test_pairs_need_both_in_the_theater(spark):
    members = local_table(
        spark, [("t", "IR", 0), ("t", "UA", 1), ("t", "RU", 2)],
        "theater string, code string, position int")
    pairs = arcs.adversary_pairs(dims.dim_subject(spark), members).collect()
    assert sorted((r.code, r.adversary) for r in pairs) == [("RU", "UA"), ("UA", "RU")]


def test_great_circle(spark):
    one = local_table(spark, [(51.389, 35.6892, 35.2137, 31.7683)], ARC)
    path = {r.step: r for r in arcs.arc_rails(one).collect()}
    assert len(path) == 65
    assert (path[0].lon, path[0].lat) == (51.389, 35.6892)
    assert (path[64].lon, path[64].lat) == (35.2137, 31.7683)
    assert (path[32].lon, path[32].lat) == pytest.approx((43.1153, 33.9936), abs=1e-4)
    assert all(r.defined for r in path.values())


def test_default_density(spark):
    one = local_table(spark, [(0.0, 0.0, 90.0, 0.0)], ARC)
    path = {r.step: r for r in arcs.great_circle(one).collect()}
    assert len(path) == 49
    assert (path[24].lon, path[24].lat) == pytest.approx((45.0, 0.0))


def test_path_steps_are_even(spark):
    one = local_table(spark, [(10.0, -20.0, 100.0, 60.0)], ARC)
    path = sorted(arcs.arc_rails(one, steps=12).collect(), key=lambda r: r.step)

    def angle(a, b):
        la, pa, lb, pb = map(math.radians, (a.lon, a.lat, b.lon, b.lat))
        return math.acos(math.sin(pa) * math.sin(pb)
                         + math.cos(pa) * math.cos(pb) * math.cos(la - lb))

    hops = [angle(a, b) for a, b in zip(path, path[1:])]
    assert hops == pytest.approx([hops[0]] * 12)


def test_degenerate_paths(spark):
    same = local_table(spark, [(5.0, 6.0, 5.0, 6.0)], ARC)
    rows = arcs.arc_rails(same).collect()
    assert [(r.step, r.lon, r.lat) for r in rows] == [(0, 5.0, 6.0), (1, 5.0, 6.0)]
    opposite = local_table(spark, [(0.0, 0.0, 180.0, 0.0)], ARC)
    path = sorted(arcs.arc_rails(opposite, steps=4).collect(), key=lambda r: r.step)
    assert [r.lon for r in path] == [0.0, None, None, None, 180.0]
    assert not any(r.defined for r in path)
