import json
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from signalgrid import dims, fixed_values as fv
from signalgrid.dims import Box
from signalgrid.operators import heat, zones
from signalgrid.plans.bindings import event_points
from signalgrid.schemas import CONFLICT_DOCUMENT, GEO_DOCUMENT
from signalgrid.session import local_table
from signalgrid.sources import batches, feeds, landing
from signalgrid.sources.signals import signal_parts


def random_points(spark, n=4000):
    return spark.range(n).select(
        "id", (F.rand(1) * 60 - 10).alias("lon"), (F.rand(2) * 50).alias("lat"))


def random_zones(spark, n=300):
    side = F.pow(F.lit(2.0), F.rand(5) * 10 - 5)
    return spark.range(n).select(
        F.concat(F.lit("z"), "id").alias("code"), F.col("id").alias("priority"),
        (F.rand(3) * 50 - 10).alias("west"), (F.rand(4) * 40).alias("south"), side.alias("side"),
    ).select(
        "code", "priority", "west", "south",
        (F.col("west") + F.col("side")).alias("east"),
        (F.col("south") + F.col("side") / 2).alias("north"))


def brute_force(points, boxes):
    wanted = {}
    for p in points:
        held = [z for z in boxes if z.west <= p.lon <= z.east and z.south <= p.lat <= z.north]
        wanted[p.id] = min(held, key=lambda z: z.priority).code if held else None
    return wanted


@pytest.mark.parametrize("cells", [1_000_000, 3_000, 0])
@pytest.mark.parametrize("broadcast_zones", [50_000, 0])
def test_zone_table_equals_brute_force(spark, monkeypatch, broadcast_zones, cells):
    monkeypatch.setattr(zones, "LEAST_CELLS", cells)
    monkeypatch.setattr(zones, "CELLS_PER_ZONE", 5)
    monkeypatch.setattr(zones, "SHARED_SPAN", 2)
    points, table = random_points(spark), random_zones(spark)
    wanted = brute_force(points.collect(), table.collect())
    found = zones.attribute_zone_table(points, table, "id", broadcast_zones=broadcast_zones)
    got = {r.id: r.code for r in found.collect()}
    assert got == wanted
    assert len(set(got.values())) > 50


@pytest.mark.parametrize("broadcast_zones", [50_000, 0])
@pytest.mark.parametrize("busy", [20, 1_000_000])
def test_zone_table_needs_no_key(spark, monkeypatch, broadcast_zones, busy):
    monkeypatch.setattr(zones, "BUSY_POINTS", busy, raising=False)
    points, table = random_points(spark), random_zones(spark)
    odd = spark.range(3).select(  # off the globe, not a number, and without a place
        (F.col("id") + 4000).alias("id"),
        F.element_at(F.array(F.lit(1e9), F.lit(float("nan")), F.lit(None).cast("double")),
                     (F.col("id") + 1).cast("int")).alias("lon"), F.lit(1.0).alias("lat"))
    wanted = {**brute_force(points.collect(), table.collect()), 4000: None, 4001: None, 4002: None}
    keyed = points.union(odd).withColumn("key", F.when(F.col("id") % 2 == 0, F.col("id") % 10))
    found = zones.attribute_zone_table(keyed, table, "key", broadcast_zones=broadcast_zones)
    rows = found.collect()
    assert len(rows) == len(wanted) and {r.id: r.code for r in rows} == wanted


def test_all_matches_equal_brute_force(spark):
    points, table = random_points(spark, 800), random_zones(spark, 120)
    boxes = table.collect()
    wanted = sorted(
        (p.id, z.code) for p in points.collect() for z in boxes
        if z.west <= p.lon <= z.east and z.south <= p.lat <= z.north)
    got = sorted((r.id, r.zone) for r in zones.match_zone_table(points, table).collect())
    assert got == wanted


def test_cell_edges_and_point_zones(spark):
    table = local_table(
        spark,
        [("wide", 3, 0.0, 0.0, 45.0, 45.0), ("edge", 2, 22.5, 0.0, 45.0, 22.5),
         ("dot", 1, 22.5, 22.5, 22.5, 22.5)],
        "code string, priority int, west double, south double, east double, north double")
    points = local_table(
        spark, [(1, 22.5, 22.5), (2, 22.5, 22.4), (3, 45.0, 45.0), (4, 0.0, 0.0),
                (5, 45.0, 22.5), (6, 45.1, 1.0)], "id int, lon double, lat double")
    got = {r.id: r.code for r in zones.attribute_zone_table(points, table, "id").collect()}
    assert got == {1: "dot", 2: "edge", 3: "wide", 4: "wide", 5: "edge", 6: None}


def test_forms_agree_on_events(spark, sf_dir):
    points = event_points(spark, sf_dir).select("event_id", "lon", "lat")
    inline = zones.attribute_boxes(points, dims.SUBJECT_BOXES)
    table = dims.boxes(spark, dims.SUBJECT_BOXES)
    for limit in (50_000, 0):
        other = zones.attribute_zone_table(points, table, "event_id", broadcast_zones=limit)
        assert inline.exceptAll(other).count() == 0
        assert other.exceptAll(inline).count() == 0


def test_boxes_turned_inside_out_hold_nothing(spark):
    table = local_table(
        spark, [("turned", 0, 170.0, -10.0, -170.0, 10.0), ("null", 1, None, 0.0, 1.0, 1.0),
                ("good", 2, 0.0, 0.0, 5.0, 5.0)],
        "code string, priority int, west double, south double, east double, north double")
    points = local_table(spark, [(1, 175.0, 0.0), (2, 1.0, 1.0)], "id int, lon double, lat double")
    got = {r.id: r.code for r in zones.attribute_zone_table(points, table, "id").collect()}
    assert got == {1: None, 2: "good"}
    assert [r.zone for r in zones.match_zone_table(points, table).collect()] == ["good"]


def test_open_ended_boxes(spark):
    inf = float("inf")
    table = local_table(
        spark, [("rest", 9, -inf, -inf, inf, inf), ("east", 1, 30.0, -90.0, inf, 90.0)],
        "code string, priority int, west double, south double, east double, north double")
    points = local_table(
        spark, [(1, -179.9, -89.0), (2, 30.0, 0.0), (3, 180.0, 90.0), (4, 29.99, 10.0)],
        "id int, lon double, lat double")
    for limit in (10, 0):
        found = zones.attribute_zone_table(points, table, "id", broadcast_zones=limit)
        assert {r.id: r.code for r in found.collect()} == {
            1: "rest", 2: "east", 3: "east", 4: "rest"}


def test_empty_zone_table(spark):
    points, table = random_points(spark, 10), random_zones(spark, 5).limit(0)
    assert {r.code for r in zones.attribute_zone_table(points, table, "id").collect()} == {None}
    assert zones.match_zone_table(points, table).count() == 0


def test_too_many_inline_boxes(spark):
    boxes = [dims.Box(str(i), 0, 0, 1, 1, i) for i in range(zones.INLINE_BOXES + 1)]
    with pytest.raises(ValueError):
        zones.attribute_boxes(random_points(spark, 1), boxes)


def test_kernel_keeps_the_total(spark):
    points = local_table(
        spark, [(10.5, 20.5, 8), (10.2, 20.9, 8), (13.0, 20.0, 16)],
        "lon double, lat double, count bigint")
    grid = heat.heat_grid(points, 1.0)
    assert {(r.cell_x, r.cell_y, r.weight, r.points) for r in grid.collect()} == {
        (10, 20, 16, 2), (13, 20, 16, 1)}
    spread = {(r.cell_x, r.cell_y): r.density for r in heat.heat_kernel(grid).collect()}
    assert sum(spread.values()) == 32
    assert (spread[10, 20], spread[11, 20], spread[11, 21]) == (4.0, 2.0, 1.0)


def test_graticule(spark):
    lines = heat.graticule(dims.dim_theater(spark), 5).filter("theater = 'middle-east'").collect()
    assert sorted(r["at"] for r in lines if r.kind == "parallel") == [25, 30, 35, 40]
    assert sorted(r["at"] for r in lines if r.kind == "meridian") == [35, 40, 45, 50, 55, 60]
    assert {(r.low, r.high) for r in lines if r.kind == "parallel"} == {(33.0, 64.0)}


def test_graticule_without_a_line(spark):
    box = local_table(
        spark, [("t", 1.0, 1.0, 2.0, 2.0)],
        "theater string, west double, south double, east double, north double")
    assert heat.graticule(box, 5).count() == 0


def test_dense_grid_covers_every_clipped_point(spark, sf_dir):
    points = event_points(spark, sf_dir)
    clipped = zones.clip_to_theaters(points, dims.THEATER_BOXES).groupBy("theater").count()
    dense = heat.densify(
        heat.heat_grid(points, 5.0), heat.cell_scaffold(dims.dim_theater(spark), 5.0))
    sums = {r.theater: r.points for r in dense.groupBy("theater").agg(
        F.sum("points").alias("points")).collect()}
    for row in clipped.collect():
        assert sums[row.theater] >= row["count"]


def test_many_zones_in_one_cell(spark):
    """100,000 zones in 0.02 degrees: the lists stay short and the answer is that of all zones."""
    rng = np.random.default_rng(5)
    n, side = 100_000, 0.02
    west, south = 10.0 + rng.random(n) * side, 20.0 + rng.random(n) * side
    size = rng.choice([1e-6, 2e-5, 1e-4], n)
    frame = spark.createDataFrame(pd.DataFrame({
        "code": [f"z{i}" for i in range(n)], "priority": rng.permutation(n).astype(np.int32), "west": west, "south": south,
        "east": west + size, "north": south + size}))
    grid = zones._measure(frame)
    levels, cells = zones._gridded(frame, grid)
    before = cells.groupBy(*zones.CELL).count().agg(F.max("count")).first()[0]
    tree, deep = zones.split_crowded(zones.contenders(cells), levels)
    longest = tree.filter(F.col("level") < zones.DEEPEST_LEVEL).groupBy(*zones.CELL).count().agg(F.max("count")).first()[0]
    assert before > 1_000 and longest <= zones.LONGEST_LIST and len(deep) > 3
    lon, lat = 10.0 + rng.random(3000) * side * 1.1, 20.0 + rng.random(3000) * side * 1.1
    points = spark.createDataFrame(pd.DataFrame({"id": range(3000), "lon": lon, "lat": lat}))
    rows = frame.toPandas()
    wanted = {}
    for i in range(3000):
        held = rows[(rows.west <= lon[i]) & (lon[i] <= rows.east) & (rows.south <= lat[i]) & (lat[i] <= rows.north)]
        wanted[i] = held.loc[held.priority.idxmin()].code if len(held) else None
    assert sum(v is not None for v in wanted.values()) > 500
    for few in (200_000, 10):
        got = zones.attribute_zone_table(points, frame, "id", broadcast_zones=few).collect()
        assert {r.id: r.code for r in got} == wanted


def test_zones_that_all_hold_a_place_are_cut_by_the_best(spark):
    boxes = [(f"z{i}", 5.0 - i * 1e-4, 5.0 - i * 1e-4, 6.0 + i * 1e-4, 6.0 + i * 1e-4, i) for i in range(500)]
    table = local_table(spark, boxes, "code string, west double, south double, east double, north double, priority int")
    places = local_table(spark, [(1, 5.5, 5.5), (2, 4.97005, 5.5), (3, 5.0, 5.0), (4, 7.0, 5.0)], "id int, lon double, lat double")
    got = {r.id: r.code for r in zones.attribute_zone_table(places, table, "id").collect()}
    assert got == {1: "z0", 2: "z300", 3: "z0", 4: None}


def test_feeds_take_a_table_of_zones(spark):
    rng = random.Random(8)
    areas = [(f"z{i}", float(w), float(s), w + rng.uniform(0, 9), s + rng.uniform(0, 9), rng.randrange(20) * 100 + i)
             for i, (w, s) in enumerate((rng.uniform(-20, 20), rng.uniform(-20, 20)) for _ in range(90))]
    areas.append(("odd", 5.0, 5.0, -5.0, 9.0, -1))
    table = spark.createDataFrame(areas, "code string, west double, south double, east double, north double, priority int")
    boxes = [Box(*area) for area in areas]
    places = [(rng.uniform(-25, 25), rng.uniform(-25, 25)) for _ in range(200)] + [(None, 1.0), (5.0, 5.0)]

    def first(lon, lat):
        held = [(p, c) for c, w, s, e, n, p in areas if w <= lon <= e and s <= lat <= n]
        return min(held)[1] if held else None

    wanted = [first(*p) for p in places if None not in p]
    geo = json.dumps({"features": [{"geometry": {"coordinates": p}, "properties": {}} for p in places]})
    conflict = json.dumps({"data": [{"longitude": None if x is None else str(x), "latitude": str(y)} for x, y in places]})
    bodies = spark.createDataFrame([("g", geo), ("c", conflict)], "origin string, body string")
    asked = spark.createDataFrame(
        [("g", fv.SOURCE_GEO, "global"), ("c", fv.SOURCE_CONFLICT, "UA"), ("lost", fv.SOURCE_GEO, "global")],
        "origin string, source string, key string").withColumn("asked", F.lit("x")).withColumn("at", F.current_timestamp())

    def documents(origin, schema):
        return landing.good_documents(landing.parse_bodies(bodies.filter(F.col("origin") == origin), schema))

    for held in (table, boxes):
        got = feeds.geo_signals(documents("g", GEO_DOCUMENT), held).orderBy("pos").collect()
        assert [r.nation for r in got] == wanted
        got = feeds.conflict_signals(documents("c", CONFLICT_DOCUMENT).withColumn("asked", F.lit("x")), held)
        assert [r.nation for r in got.orderBy("pos").collect()] == wanted
        made = signal_parts(asked, bodies, held)
        rows = made.filter(F.col(batches.PART) == batches.ROW).orderBy("source", "pos").collect()
        assert [r.nation for r in rows] == wanted * 2
        heads = made.filter(F.col(batches.PART) == batches.FETCH).collect()
        assert sorted((r.origin, r.reason, r.nation) for r in heads) == [("c", None, None), ("g", None, None), ("lost", "missing", None)]
    none = feeds.geo_signals(documents("g", GEO_DOCUMENT), table.limit(0))
    assert {r.nation for r in none.collect()} == {None}
