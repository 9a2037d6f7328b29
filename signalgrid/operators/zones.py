"""Attribution of points to bounding boxes.

Three forms with the same answer, chosen by how many boxes there are:

* a handful of boxes become one expression over the row (no join, no shuffle);
* a box table of checked size becomes broadcast candidate lists per grid cell,
  so each point is looked up once per grid level and is never shuffled;
* a larger box table has the same lists, joined by a shuffle on the cell, with the
  points of busy cells spread over tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from signalgrid.dims import Box, boxes
from signalgrid.functions.geometry import boxes_holding, cell, first_box, inside
from signalgrid.session import local_table, written

INLINE_BOXES = 64
BROADCAST_ZONES = 20_000
LEAST_CELLS = 20_000
CELLS_PER_ZONE = 32
SHARED_SPAN = 4  # in powers of two: zones down to a quarter of a shared cell
WORLD = 360.0
FINEST_LEVEL = 14
CELLS_PER_EXTENT = 2  # in powers of two: a zone is at most four cells wide
LONGEST_LIST = 64  # a cell with more zones is split, down to cells of some ten metres
DEEPEST_LEVEL = 22
BROADCAST_BYTES = 64 << 20
CELL = ["level", "cell_x", "cell_y"]
BUSY_POINTS = 1_000_000  # a cell with more points is split over SALTS tasks
BUSY_CELLS = 1_000
SALTS = 32


def clip_to_theaters(points: DataFrame, theaters: Sequence[Box]) -> DataFrame:
    """One row per point and theater whose box holds it; others are dropped."""
    if len(theaters) > INLINE_BOXES:
        raise ValueError(f"more than {INLINE_BOXES} boxes: use match_zone_table")
    return points.withColumn("theater", F.explode(boxes_holding(theaters)))


def attribute_boxes(points: DataFrame, boxes: Sequence[Box], out: str = "code") -> DataFrame:
    """Add the code of the first box, by priority, that holds each point."""
    if len(boxes) > INLINE_BOXES:
        raise ValueError(f"more than {INLINE_BOXES} boxes: use attribute_zone_table")
    return points.withColumn(out, first_box(boxes))


def attribute_zones(points: DataFrame, zones: Sequence[Box] | DataFrame, out: str = "code") -> DataFrame:
    """Attribution by a list of boxes or a table of zones of any size; a long list becomes a table."""
    if not isinstance(zones, DataFrame) and len(zones) <= INLINE_BOXES:
        return attribute_boxes(points, zones, out)
    table = zones if isinstance(zones, DataFrame) else boxes(points.sparkSession, zones)
    return attribute_zone_table(points, table, out=out)


def zone_cells(
    zones: DataFrame, level: Column | None = None, within: tuple[str, str] | None = None
) -> DataFrame:
    """One row per zone and grid cell it touches; ``full`` if it covers the cell.

    ``within`` names columns with a cell of the level above; only its quarters count then.

    Without ``level`` each zone uses the grid level that fits its size, so it
    touches a bounded number of cells whatever that size is.
    """
    size = F.col("cell_size")

    def span(low: str, high: str, parent: str | None):
        first, last = cell(_edge(low), size), cell(_edge(high), size)
        if parent:
            first, last = F.greatest(first, 2 * F.col(parent)), F.least(last, 2 * F.col(parent) + 1)
        # A zone that only touches its cell's far edge can lie in none of the quarters.
        return F.explode(F.when(first <= last, F.sequence(first, last)))

    # A hair of slack, so that rounding at a cell's edge cannot make a cell look covered.
    slack = size * 1e-9
    full = (
        (F.col("west") <= F.col("cell_x") * size - slack)
        & (F.col("east") >= (F.col("cell_x") + 1) * size + slack)
        & (F.col("south") <= F.col("cell_y") * size - slack)
        & (F.col("north") >= (F.col("cell_y") + 1) * size + slack)
    )
    return (
        zones.withColumn("level", _level() if level is None else level)
        .withColumn("cell_size", F.lit(WORLD) / F.pow(F.lit(2.0), F.col("level")))
        .withColumn("cell_x", span("west", "east", within and within[0]))
        .withColumn("cell_y", span("south", "north", within and within[1]))
        .withColumn("full", full)
        .drop("cell_size")
    )


def contenders(cells: DataFrame) -> DataFrame:
    """Zone cells that can still be a first match.

    A zone that covers a whole cell wins there over every zone of worse priority,
    so those are dropped; this keeps crowded cells short without changing results.
    """
    cutoff = cells.filter("full").groupBy(*CELL).agg(F.min("priority").alias("cutoff"))
    kept = cells.join(cutoff, CELL, "left")
    return kept.filter(
        F.col("cutoff").isNull() | (F.col("priority") <= F.col("cutoff"))
    ).drop("cutoff", "full")


def split_crowded(
    cells: DataFrame, levels: Sequence[int], longest: int = LONGEST_LIST
) -> tuple[DataFrame, list[int]]:
    """Split cells until their lists are short: an adaptive quad-tree as a table.

    A cell with more than ``longest`` zones gives way to its four quarters, each with the zones that touch
    it and can still be first there; quarters that are still crowded are split in turn. So dense places
    have small cells and others keep large ones. A list stays long only where more zones meet in one
    cell of the deepest level. Returns the cells and the levels they lie on.
    """
    done, levels = None, list(levels)
    while True:
        crowded = cells.filter(F.col("level") < DEEPEST_LEVEL).groupBy(*CELL).count().filter(
            F.col("count") > longest).select(*CELL)
        found = sorted(r["level"] for r in crowded.select("level").distinct().collect())
        if not found:
            return (cells if done is None else done.unionByName(cells)), levels
        # Each round works on the crowded cells of the one before alone.
        stay = cells.join(crowded, CELL, "left_anti")
        done = stay if done is None else done.unionByName(stay)
        cells = written(contenders(_quarters(cells.join(crowded, CELL, "left_semi"))), "cells")
        levels = sorted({*levels, *(level + 1 for level in found)})


def _quarters(cells: DataFrame) -> DataFrame:
    """Zone cells of the next level inside the given ones."""
    parents = cells.withColumnsRenamed({"cell_x": "_x", "cell_y": "_y"})
    finer = zone_cells(parents.withColumn("level", F.col("level") + 1), F.col("level"), ("_x", "_y"))
    return finer.drop("_x", "_y")


def _bytes(cells: DataFrame) -> int:
    """About how large the cells' lists are when they are broadcast."""
    return cells.agg(F.sum(F.lit(64) + F.length("code"))).first()[0] or 0


def attribute_zone_table(
    points: DataFrame,
    zones: DataFrame,
    key: str | None = None,
    out: str = "code",
    broadcast_zones: int = BROADCAST_ZONES,
) -> DataFrame:
    """First-match attribution against a table of zones of any size.

    ``zones`` has code, priority, west, south, east and north. ``key`` only helps to
    spread equal places over tasks; it may be null or shared without a change of result.
    """
    zones = _proper(zones)
    grid = _measure(zones)
    if not grid.zones:
        return points.withColumn(out, F.lit(None).cast("string"))
    levels, cells = _gridded(zones, grid)
    cells, levels = split_crowded(contenders(cells), levels)
    if grid.zones <= broadcast_zones and _bytes(cells) <= BROADCAST_BYTES:
        return _by_candidate_lists(points, cells, levels, out)
    busy = _busy_cells(points, levels)
    spread = F.xxhash64(*([key] if key else []), "lon", "lat")
    return _by_candidate_lists(points, cells, levels, out, busy, spread)


def match_zone_table(points: DataFrame, zones: DataFrame) -> DataFrame:
    """One row per point and zone that holds it, with the zone's code as ``zone``."""
    zones = _proper(zones)
    grid = _measure(zones)
    if not grid.zones:
        return points.withColumn("zone", F.lit(None).cast("string")).limit(0)
    levels, cells = _gridded(zones, grid)
    return _pairs(points, cells.drop("full"), levels).drop("priority")


def _proper(zones: DataFrame) -> DataFrame:
    """Boxes that can hold a point; one turned inside out never does."""
    return zones.filter(
        (F.col("west") <= F.col("east")) & (F.col("south") <= F.col("north")))


def _edge(name: str):
    """A box edge kept on the globe, so that an open-ended box has a size."""
    return F.greatest(F.lit(-WORLD), F.least(F.lit(WORLD), F.col(name)))


def _level():
    extent = F.greatest(_edge("east") - _edge("west"), _edge("north") - _edge("south"))
    fitting = F.when(extent > 0, F.floor(F.log2(F.lit(WORLD) / extent)) + CELLS_PER_EXTENT)
    return F.greatest(F.lit(0), F.least(
        F.lit(FINEST_LEVEL), F.coalesce(fitting, F.lit(FINEST_LEVEL)))).cast("int")


def _measure(zones: DataFrame):
    """One row: grid levels in use, number of zones, and their summed size."""
    width, height = _edge("east") - _edge("west"), _edge("north") - _edge("south")
    return zones.select(
        _level().alias("level"), (width * height).alias("area"), (width + height).alias("rim")
    ).agg(
        F.sort_array(F.collect_set("level")).alias("levels"),
        F.count("*").alias("zones"), F.sum("area").alias("area"), F.sum("rim").alias("rim"),
    ).first()


def _gridded(zones: DataFrame, grid) -> tuple[list[int], DataFrame]:
    """Levels to look up and the zone cells on them.

    One shared level serves all zones that are not much smaller than its cells: the
    finest level on which the zones touch few enough cells.  Much smaller zones keep
    the level that fits them, so they do not crowd a cell.
    """
    budget = LEAST_CELLS + CELLS_PER_ZONE * grid.zones
    shared = 0
    for level in range(grid.levels[-1] + 1):
        size = WORLD / 2**level
        if grid.area / size**2 + 2 * grid.rim / size + 4 * grid.zones <= budget:
            shared = level
    levels = sorted({
        shared if level <= shared + SHARED_SPAN else level for level in grid.levels})
    level = F.when(_level() <= shared + SHARED_SPAN, F.lit(shared)).otherwise(_level())
    return levels, zone_cells(zones, level)


def _cell_key(level, cell_x, cell_y):
    """One number per level and cell; NULL off the globe."""
    half = 1 << 23
    on_globe = F.abs(cell_x).between(0, half - 1) & F.abs(cell_y).between(0, half - 1)
    return F.when(on_globe, (level * (2 * half) + cell_x + half) * (2 * half) + cell_y + half)


def _point_key(level: int):
    size = WORLD / 2**level
    return _cell_key(F.lit(level).cast("bigint"), cell(F.col("lon"), size), cell(F.col("lat"), size))


def _zone_key():
    return _cell_key(F.col("level").cast("bigint"), F.col("cell_x"), F.col("cell_y"))


def _busy_cells(points: DataFrame, levels: list[int]) -> DataFrame:
    """Keys of the cells with more than BUSY_POINTS points, the BUSY_CELLS fullest at most.

    Collected, so that points and zones are spread by the same list.
    """
    keys = points.select(F.explode(F.array(*[_point_key(level) for level in levels])).alias("_key"))
    full = keys.filter(F.col("_key").isNotNull()).groupBy("_key").count().filter(
        F.col("count") > BUSY_POINTS)
    rows = full.orderBy(F.desc("count"), "_key").limit(BUSY_CELLS).collect()
    return local_table(points.sparkSession, [(r["_key"], True) for r in rows], "_key bigint, _busy boolean")


def _by_candidate_lists(points, cells, levels, out, busy=None, spread=None):
    """Look each point's cells up in the cells' zones, level by level, in one left join each.

    Without ``busy`` the lists are broadcast.  With it they are shuffled; points of busy
    cells, and of none, go by ``spread`` to one of SALTS copies of the list.
    """
    zone = F.struct("priority", "code", "west", "south", "east", "north")
    # The same side serves every level, so it is computed and broadcast or shuffled once.
    side = cells.groupBy(_zone_key().alias("_key")).agg(
        F.sort_array(F.collect_list(zone)).alias("_zones"))
    if busy is None:
        side, on = F.broadcast(side), ["_key"]
    else:
        busy, on = F.broadcast(busy), ["_key", "_salt"]
        copies = F.when(F.col("_busy"), F.lit(SALTS)).otherwise(F.lit(1))
        side = side.join(busy, "_key", "left").withColumn(
            "_salt", F.explode(F.sequence(F.lit(0), copies - 1))).drop("_busy")
    first = F.try_element_at(F.filter("_zones", lambda z: inside(
        F.col("lon"), F.col("lat"), z["west"], z["south"], z["east"], z["north"])), F.lit(1))
    match = F.when(first.isNotNull(), F.struct(
        first["priority"].alias("priority"), first["code"].alias("code")))
    columns, matches = points.columns, []
    for level in levels:
        name = f"_match_{level}"
        points = points.withColumn("_key", _point_key(level))
        if busy is not None:
            apart = F.coalesce("_busy", F.col("_key").isNull())
            points = points.join(busy, "_key", "left").withColumn(
                "_salt", F.when(apart, F.pmod(spread, F.lit(SALTS)).cast("int")).otherwise(F.lit(0)))
        points = points.join(side, on, "left").withColumn(name, match)
        points = points.select(*columns, *matches, name)
        matches.append(name)
    best = F.array_min(F.array(*matches))
    return points.select(*columns, best["code"].alias(out))


def _pairs(points, cells, levels):
    """Points and the zones that hold them, joined once per level on the cell."""
    side = cells.select(
        _zone_key().alias("_key"), "priority", F.col("code").alias("zone"),
        F.col("west").alias("_w"), F.col("south").alias("_s"),
        F.col("east").alias("_e"), F.col("north").alias("_n"))
    holding = inside(F.col("lon"), F.col("lat"), F.col("_w"), F.col("_s"), F.col("_e"), F.col("_n"))
    keys = F.array(*[_point_key(level) for level in levels])
    return (
        points.withColumn("_key", F.explode(keys)).join(side, "_key").filter(holding)
        .drop("_key", "_w", "_s", "_e", "_n")
    )
