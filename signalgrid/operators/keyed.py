"""Keyed tables: insert-if-absent, defaults and domain checks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def apply_defaults(df: DataFrame, defaults: Mapping[str, Column]) -> DataFrame:
    """Replace NULL by the column's default."""
    return df.withColumns(
        {name: F.coalesce(F.col(name), value) for name, value in defaults.items()}
    )


def insert_if_absent(
    existing: DataFrame, incoming: DataFrame, key: str, order: Sequence[str]
) -> DataFrame:
    """Rows to append: the first row per new key; rows without a key are never appended.

    Copies of a key collapse to one row per partition before the shuffle, and the
    lookup of existing keys reuses that shuffle's partitioning.  It is an outer join
    because Spark would move an anti-join ahead of the grouping, where a key with
    very many copies would still be whole.
    """
    first = incoming.filter(F.col(key).isNotNull()).groupBy(key).agg(
        F.min_by(F.struct(*incoming.columns), F.struct(*order)).alias("row")
    )
    known = existing.select(key, F.lit(True).alias("_known"))
    return first.join(known, key, "left").filter(F.col("_known").isNull()).select("row.*")


def store_keyed(rows: DataFrame, table: str, key: str, buckets: int, mode: str = "error") -> None:
    """Write or append to a keyed table whose files are dealt by the key.

    Each task writes one file at most, as rows are dealt before; ``table`` is a table of the catalog.
    """
    dealt = rows.repartition(buckets, key)
    dealt.write.format("parquet").bucketBy(buckets, key).sortBy(key).mode(mode).saveAsTable(table)


def append_if_absent(
    spark: SparkSession, table: str, incoming: DataFrame, key: str, order: Sequence[str], buckets: int
) -> None:
    """Insert rows with new keys into a table of ``store_keyed``.

    The keys on file lie in their buckets already, so only what comes in is shuffled, to the same buckets.
    """
    new = insert_if_absent(spark.table(table), incoming, key, order)
    store_keyed(new.select(spark.table(table).columns), table, key, buckets, "append")


def check_domain(df: DataFrame, rules: Sequence[tuple[str, Column]]) -> DataFrame:
    """Add ``reason``: the first broken rule, NULL for accepted rows.

    Each rule is a name and a condition that must hold; unknown counts as broken.
    """
    broken = [
        F.when(~F.coalesce(test, F.lit(False)), F.lit(name)) for name, test in rules
    ]
    return df.withColumn("reason", F.coalesce(*broken))


def split_by_reason(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Accepted rows and rejected rows of a checked table."""
    accepted = df.filter(F.col("reason").isNull()).drop("reason")
    return accepted, df.filter(F.col("reason").isNotNull())
