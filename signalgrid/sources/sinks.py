"""Sinks for tables and nested payloads."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from signalgrid.session import file_names, move_file, remove_folder, subfolders, text_of, write_text


def write_payload(payload: DataFrame, path: str, key: str, fmt: str = "json") -> None:
    """One nested document per key, in a folder per key."""
    payload.write.mode("overwrite").partitionBy(key).format(fmt).save(path)


def write_landing(
    signals: DataFrame, path: str, *partitions: str, stamp: str | None = None
) -> None:
    """Append canonical rows as Parquet, in folders that later reads can skip.

    ``stamp`` names a time column; its day ``dt`` becomes the last folder level.
    """
    if stamp:
        signals = signals.withColumn("dt", F.col(stamp).cast("date"))
        partitions = (*partitions, "dt")
    signals.write.mode("append").partitionBy(*partitions).parquet(path)


def publish(payload: DataFrame, path: str, key: str, fmt: str = "json") -> int:
    """Write one nested document per key as a new version, and make it the current one.

    The version is written aside, in a folder of its own. Then a manifest that names it is put in
    place by one rename to a number not taken yet. Readers follow the newest manifest, so a failed or
    unfinished rewrite is never seen, and no reader finds a folder half replaced. Returns the number.
    """
    spark = payload.sparkSession
    version = uuid.uuid4().hex
    write_payload(payload, f"{path}/versions/{version}", key, fmt)
    draft = f"{path}/drafts/{version}"
    write_text(spark, draft, version)
    number = 1 + max(_numbers(spark, path), default=0)
    while not move_file(spark, draft, f"{path}/manifests/{number:012d}"):
        number += 1  # another writer was first
    return number


def read_published(spark: SparkSession, path: str, schema, fmt: str = "json", number: int | None = None) -> DataFrame:
    """The current version, or that of an older manifest."""
    numbers = _numbers(spark, path)
    if not numbers:
        raise ValueError(f"nothing is published in {path}")
    version = text_of(spark, f"{path}/manifests/{number or max(numbers):012d}")
    return spark.read.schema(schema).format(fmt).load(f"{path}/versions/{version}")


def prune_versions(spark: SparkSession, path: str, keep: int = 2) -> list[str]:
    """Remove versions that none of the last ``keep`` manifests names, also those of failed rewrites.

    Run it while nothing is being published; readers of versions that stay are not disturbed.
    """
    numbers = sorted(_numbers(spark, path))
    named = {text_of(spark, f"{path}/manifests/{n:012d}") for n in numbers[-keep:]}
    gone = [v for v in subfolders(spark, f"{path}/versions") if v not in named]
    for n in numbers[:-keep]:
        remove_folder(spark, f"{path}/manifests/{n:012d}")
    for version in gone:
        remove_folder(spark, f"{path}/versions/{version}")
    return gone


def _numbers(spark: SparkSession, path: str) -> list[int]:
    return [int(n) for n in file_names(spark, f"{path}/manifests") if n.isdigit()]
