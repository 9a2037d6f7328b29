"""Tension arcs between subjects and their great-circle paths."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from signalgrid import fixed_values as fv
from signalgrid.functions.display import arrow_label
from signalgrid.functions.geometry import unit_vector

SAME_POINT = 1e-6


def adversary_pairs(subjects: DataFrame, members: DataFrame) -> DataFrame:
    """Subject and adversary per theater, where both belong to the theater."""
    own = members.join(subjects, "code").select(
        "theater", "position", "code", "name", "capital_lon", "capital_lat", "adversary"
    )
    other = subjects.select(
        F.col("code").alias("adversary"), F.col("name").alias("adversary_name"),
        F.col("capital_lon").alias("to_lon"), F.col("capital_lat").alias("to_lat"),
    )
    belongs = members.select("theater", F.col("code").alias("adversary"))
    return own.join(other, "adversary").join(belongs, ["theater", "adversary"], "left_semi")


def tension_arcs(pairs: DataFrame, hot: DataFrame) -> DataFrame:
    """One arc per pair: from the subject's hottest signal, or its capital if quiet.

    ``hot`` has theater, code, lon, lat and severity, one row per theater and code.
    """
    start = hot.select(
        "theater", "code", F.col("lon").alias("hot_lon"), F.col("lat").alias("hot_lat"),
        "severity",
    )
    return pairs.join(start, ["theater", "code"], "left").select(
        "theater", "position",
        F.concat_ws("-", F.lit("arc"), "code", "adversary").alias("arc_id"),
        "code", "adversary",
        F.coalesce("hot_lon", "capital_lon").alias("from_lon"),
        F.coalesce("hot_lat", "capital_lat").alias("from_lat"),
        "to_lon", "to_lat",
        arrow_label(F.col("name"), F.col("adversary_name")).alias("label"),
        F.coalesce("severity", F.lit(fv.QUIET_ARC_INTENSITY)).alias("intensity"),
        F.lit(True).alias("derived"),
    )


def arc_rails(arcs: DataFrame, steps: int = fv.RAIL_POINTS) -> DataFrame:
    """Paths of tension arcs, at the density a map draws them."""
    return great_circle(arcs, steps)


def great_circle(arcs: DataFrame, steps: int = fv.ARC_POINTS) -> DataFrame:
    """Points along the great circle of each row, ends included.

    Ends that coincide give just the two ends.  Opposite points of the globe have
    no single path: their inner points are NULL and ``defined`` is false.
    """
    a = unit_vector(F.col("from_lon"), F.col("from_lat"))
    b = unit_vector(F.col("to_lon"), F.col("to_lat"))
    named = arcs.select(
        "*",
        *[v.alias(f"_a{i}") for i, v in enumerate(a)],
        *[v.alias(f"_b{i}") for i, v in enumerate(b)],
    )
    dot = sum((F.col(f"_a{i}") * F.col(f"_b{i}") for i in range(1, 3)),
              F.col("_a0") * F.col("_b0"))
    omega = F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), dot)))
    apart = F.col("_omega") >= SAME_POINT
    last = F.when(apart, F.lit(steps)).otherwise(F.lit(1))
    points = (
        named.withColumn("_omega", omega)
        .withColumn("_last", last)
        .withColumn("step", F.explode(F.sequence(F.lit(0), F.col("_last"))))
    )
    t = F.col("step") / F.col("_last")
    sine = F.sin("_omega")
    defined = ~apart | (sine > SAME_POINT)
    weight_a = F.sin((1 - t) * F.col("_omega")) / sine
    weight_b = F.sin(t * F.col("_omega")) / sine
    x, y, z = (weight_a * F.col(f"_a{i}") + weight_b * F.col(f"_b{i}") for i in range(3))
    height = F.least(F.lit(1.0), F.greatest(F.lit(-1.0), z))

    def coordinate(name: str, curve):
        start, end = F.col(f"from_{name}"), F.col(f"to_{name}")
        return (
            F.when(F.col("step") == 0, start)
            .when(F.col("step") == F.col("_last"), end)
            .when(defined, curve)
        )

    return points.select(
        *arcs.columns, F.col("step").cast("bigint").alias("step"),
        coordinate("lon", F.degrees(F.atan2(y, x))).alias("lon"),
        coordinate("lat", F.degrees(F.asin(height))).alias("lat"),
        defined.alias("defined"),
    )
