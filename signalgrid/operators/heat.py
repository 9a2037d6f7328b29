"""Density grids over points."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from signalgrid.functions.geometry import cell

KERNEL = ((1, 2, 1), (2, 4, 2), (1, 2, 1))


def heat_grid(points: DataFrame, size: float) -> DataFrame:
    """Summed weight and number of points per grid cell."""
    return points.groupBy(
        cell(F.col("lon"), size).alias("cell_x"), cell(F.col("lat"), size).alias("cell_y")
    ).agg(F.sum("count").alias("weight"), F.count("*").alias("points"))


def heat_kernel(grid: DataFrame, kernel: Sequence[Sequence[int]] = KERNEL) -> DataFrame:
    """Spread each cell over its neighbours by an integer kernel.

    Works on the grid, not on the points, so the expansion is bounded by cells.
    """
    reach = len(kernel) // 2
    total = sum(map(sum, kernel))
    shares = F.array(*[
        F.struct(F.lit(dx - reach).alias("dx"), F.lit(dy - reach).alias("dy"),
                 F.lit(share).alias("share"))
        for dy, row in enumerate(kernel) for dx, share in enumerate(row)
    ])
    spread = grid.select("cell_x", "cell_y", "weight", F.explode(shares).alias("k"))
    return spread.groupBy(
        (F.col("cell_x") + F.col("k.dx")).alias("cell_x"),
        (F.col("cell_y") + F.col("k.dy")).alias("cell_y"),
    ).agg((F.sum(F.col("weight") * F.col("k.share")) / total).alias("density"))


def cell_scaffold(theaters: DataFrame, size: float) -> DataFrame:
    """Every grid cell that a theater's box touches."""
    return (
        theaters.withColumn("cell_x", F.explode(F.sequence(
            cell(F.col("west"), size), cell(F.col("east"), size))))
        .withColumn("cell_y", F.explode(F.sequence(
            cell(F.col("south"), size), cell(F.col("north"), size))))
        .select("theater", "cell_x", "cell_y")
    )


def densify(grid: DataFrame, scaffold: DataFrame) -> DataFrame:
    """Zero-filled grid over the scaffold."""
    return scaffold.join(grid, ["cell_x", "cell_y"], "left").fillna(0, ["weight", "points"])


def graticule(theaters: DataFrame, step: int) -> DataFrame:
    """Parallels and meridians at multiples of ``step`` inside each theater's box."""
    def lines(low: str, high: str):
        first = (F.ceil(F.col(low) / step) * step).cast("bigint")
        last = F.floor(F.col(high)).cast("bigint")
        return F.when(first <= last, F.sequence(first, last, F.lit(step).cast("bigint")))

    parallels = theaters.select(
        "theater", F.lit("parallel").alias("kind"), F.explode(lines("south", "north")).alias("at"),
        F.col("west").alias("low"), F.col("east").alias("high"),
    )
    meridians = theaters.select(
        "theater", F.lit("meridian").alias("kind"), F.explode(lines("west", "east")).alias("at"),
        F.col("south").alias("low"), F.col("north").alias("high"),
    )
    return parallels.unionByName(meridians)
