"""The given tables seen as signals, feeds and logs.

The tables carry no coordinates, so each key maps to a fixed point of the world;
every row of a table takes part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from signalgrid import fixed_values as fv
from signalgrid.dims import SUBJECT_BOXES, THEATER_BOXES, theater_subject
from signalgrid.functions.geometry import first_box
from signalgrid.functions.scoring import severity_by_fatalities
from signalgrid.operators.merge import union_sources
from signalgrid.operators.pressure import add_share_severity
from signalgrid.operators.zones import clip_to_theaters
from signalgrid.schemas import TABLES

AS_OF = "2024-01-30 00:00:00"
SEEN_MINUTES = 45 * 24 * 60


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(TABLES[name]).parquet(f"{sf_dir}/{name}.parquet")


def place(key: Column) -> tuple[Column, Column]:
    """Longitude and latitude of a key, spread over the widest theater."""
    # The key is reduced first, so that the product cannot overflow.
    lon = F.lit(21.0) + F.pmod(F.pmod(key, F.lit(4900)) * 7919, F.lit(4900)) / F.lit(100.0)
    lat = F.lit(24.0) + F.pmod(F.pmod(key, F.lit(4650)) * 104729, F.lit(4650)) / F.lit(100.0)
    return lon, lat


def event_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_columns(table(spark, sf_dir, "events"))


def event_columns(events: DataFrame) -> DataFrame:
    lon, lat = place(F.col("event_id"))
    return events.select(
        "event_id", "ts", "user_id", "event_type", "value",
        F.col("value").cast("bigint").alias("count"), lon.alias("lon"), lat.alias("lat"),
    )


def order_points(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """Orders as conflict records; the toll grows with the price."""
    return order_columns(table(spark, sf_dir, "orders"), *columns)


def order_columns(orders: DataFrame, *columns: str) -> DataFrame:
    lon, lat = place(F.col("o_orderkey"))
    toll = F.floor(F.col("o_totalprice") / 100000)
    return orders.select(
        "o_orderkey", "o_orderdate", toll.alias("fatalities"),
        lon.alias("lon"), lat.alias("lat"), *columns,
    )


def nation_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as subjects of the theater that is their region."""
    nation = table(spark, sf_dir, "nation")
    region = table(spark, sf_dir, "region")
    return nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(
        F.col("r_name").alias("theater"), F.col("n_name").alias("code"),
        F.col("n_nationkey").alias("nationkey"), F.col("n_nationkey").alias("position"),
    )


def geo_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as density signals, scaled by the whole table's largest count."""
    return geo_columns(add_share_severity(event_points(spark, sf_dir)), F.col("severity"))


def geo_columns(points: DataFrame, severity: Column) -> DataFrame:
    return points.select(
        F.concat_ws("-", F.lit("gd"), "event_id").alias("id"), "lat", "lon",
        F.col("event_type").alias("name"), "count",
        first_box(SUBJECT_BOXES).alias("nation"),
        severity.alias("severity"), F.lit(fv.SOURCE_GEO).alias("source"), F.lit(1).alias("source_rank"),
        F.lit(0).alias("subject_priority"), F.col("event_id").alias("pos"),
        F.col("ts").alias("observed_at"),
    )


def conflict_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as conflict signals."""
    return conflict_columns(order_points(spark, sf_dir))


def conflict_columns(points: DataFrame) -> DataFrame:
    nation = first_box(SUBJECT_BOXES)
    priority = F.coalesce(*[
        F.when(F.col("nation") == b.code, F.lit(b.priority)) for b in SUBJECT_BOXES
    ], F.lit(len(SUBJECT_BOXES)))
    return points.withColumn("nation", nation).select(
        F.concat_ws("-", F.lit("acled"), "o_orderkey").alias("id"), "lat", "lon",
        F.concat_ws(" — ", F.lit(fv.UNKNOWN_EVENT), "nation").alias("name"),
        (1 + F.col("fatalities")).alias("count"), "nation",
        severity_by_fatalities(F.col("fatalities")).alias("severity"),
        F.lit(fv.SOURCE_CONFLICT).alias("source"), F.lit(0).alias("source_rank"),
        priority.alias("subject_priority"), F.col("o_orderkey").alias("pos"),
        F.col("o_orderdate").alias("observed_at"),
    )


def theater_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both sources per theater: density rows by box, conflict rows by membership."""
    geo = clip_to_theaters(geo_rows(spark, sf_dir), THEATER_BOXES)
    member = theater_subject(spark).select("theater", F.col("code").alias("nation"))
    conflict = conflict_rows(spark, sf_dir).join(member, "nation")
    return union_sources(geo, conflict.select(*geo.columns))


def document_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as feed items, seen over 45 days whatever the table's size; a part is later than AS_OF."""
    docs = table(spark, sf_dir, "documents")
    return docs.select(
        F.lpad(F.col("doc_id").cast("string"), 12, "0").alias("id"), F.col("doc_id").alias("pos"),
        F.col("text").alias("title"),
        F.concat(F.lit("https://"), "source", F.lit(".example.org/"), "doc_id").alias("url"),
        F.col("source").alias("domain"), F.col("lang").alias("country"),
        (F.lit("2024-01-01").cast("timestamp_ntz")
         + F.expr("INTERVAL '1' MINUTE") * F.pmod("doc_id", F.lit(SEEN_MINUTES))).alias("seen"),
        F.lit(None).cast("string").alias("nation"),
    )
