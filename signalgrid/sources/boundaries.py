"""Boundary features: keep the wanted ones and rename them by code."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def boundary_features(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """Features whose id is wanted, as code, name and geometry.

    ``wanted`` maps id to code.
    """
    features = docs.select(F.explode("doc.features").alias("f")).select(
        F.col("f.id").alias("id"), F.col("f.properties.name").alias("name"),
        F.col("f.geometry").alias("geometry"),
    )
    return features.join(wanted, "id").select("code", "name", "geometry")


def _feature():
    return F.struct(
        F.lit("Feature").alias("type"),
        F.struct("code", "name").alias("properties"),
        "geometry",
    )


def feature_json(features: DataFrame) -> DataFrame:
    """One JSON feature per row, ready for a line-delimited sink."""
    return features.select(F.to_json(_feature()).alias("value"))


def feature_collection(features: DataFrame) -> DataFrame:
    """All features as one document; meant for the few boundaries of a dashboard."""
    document = F.struct(
        F.lit("FeatureCollection").alias("type"),
        F.collect_list(_feature()).alias("features"),
    )
    return features.agg(F.to_json(document).alias("value"))
