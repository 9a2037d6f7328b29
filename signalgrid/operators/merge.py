"""Concatenation of sources and fallback rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window, functions as F

from signalgrid import fixed_values as fv
from signalgrid.dims import SUBJECT_BOXES
from signalgrid.functions.geometry import first_box
from signalgrid.session import local_table


def union_sources(*sources: DataFrame) -> DataFrame:
    """All rows of all sources; nothing is merged or removed."""
    return reduce(DataFrame.unionByName, sources)


def seed_signals(spark) -> DataFrame:
    """Reference hotspots as canonical signals, attributed like any other point."""
    rows = [(f"seed-{i}", *row, i) for i, row in enumerate(fv.SEEDS)]
    seeds = local_table(
        spark, rows, "id string, name string, lat double, lon double, severity double, pos int"
    )
    return seeds.select(
        "id", "lat", "lon", "name",
        F.round(F.col("severity") * 100).cast("bigint").alias("count"),
        first_box(SUBJECT_BOXES).alias("nation"),
        "severity",
        F.lit(fv.SOURCE_SEED).alias("source"),
        F.lit(2).alias("source_rank"),
        F.lit(0).alias("subject_priority"),
        F.col("pos").cast("bigint").alias("pos"),
    )


def with_fallback(live: DataFrame, fallback: DataFrame, groups: DataFrame, key: str) -> DataFrame:
    """Live rows, plus all fallback rows for every group that has no live row."""
    silent = groups.select(key).join(live.select(key).distinct(), key, "left_anti")
    return _tagged(live, _filler(fallback, silent, key))


def with_fallback_capped(
    live: DataFrame, fallback: DataFrame, groups: DataFrame, key: str
) -> DataFrame:
    """The same for live rows that are capped per group, reading them only once."""
    both = _tagged(live, _filler(fallback, groups, key))
    any_live = F.max("live").over(Window.partitionBy(key))
    return both.withColumn("_any", any_live).filter(F.col("live") == F.col("_any")).drop("_any")


def _filler(fallback: DataFrame, groups: DataFrame, key: str) -> DataFrame:
    """All fallback rows, a short fixed list, for each group."""
    listed = fallback.agg(F.collect_list(F.struct(*fallback.columns))).scalar()
    return groups.select(key, F.explode(listed).alias("row")).select(key, "row.*")


def _tagged(live: DataFrame, filler: DataFrame) -> DataFrame:
    return live.withColumn("live", F.lit(True)).unionByName(
        filler.withColumn("live", F.lit(False)), allowMissingColumns=True
    )
