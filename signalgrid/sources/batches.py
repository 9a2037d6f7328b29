"""A table of batches whose rows count only once their batch is committed.

Below a table's folder, ``rows/batch=<id>`` holds what a batch brought and ``log/batch=<id>`` the
fetches it answers: one small file, written last and put in place by one rename. A batch without it is
half-written; readers never see its rows, and writing it again replaces it. The log is the fetch
log: batch, source, key, at, ok, n_rows and reason.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F

LOG = "source string, key string, at timestamp, ok boolean, n_bodies bigint, n_rows bigint, reason string"
PART = "part"
FETCH, ROW, ASIDE = "fetch", "row", "aside"


def write_rows(parts: DataFrame, table: str, batch: int | str) -> dict[str, int]:
    """Write what a batch brought, in one pass, and return what was counted on the way.

    ``parts`` has a column ``part`` that says what a row is: a fetch, a row or a body set aside. Each kind
    is a folder, so that readers of one never open the others.
    """
    counted = Observation()
    kind = F.col(PART)
    observed = parts.observe(
        counted, F.count_if(kind == FETCH).alias("bodies"),
        F.count_if((kind == FETCH) & F.col("reason").isNull()).alias("good"),
        F.count_if(kind == ASIDE).alias("set_aside"),
        F.count_if((kind == FETCH) & (F.col("reason") == "missing")).alias("missing"),
        F.count_if(kind == ROW).alias("rows"))
    observed.write.mode("overwrite").partitionBy(PART).parquet(f"{table}/rows/batch={batch}")
    return counted.get


def commit(spark: SparkSession, table: str, batch: int | str, log: DataFrame) -> None:
    """Make a batch count. ``log`` has a row per fetch, far fewer than rows."""
    log.coalesce(1).write.mode("overwrite").parquet(f"{table}/log/batch={batch}")


def fetches(parts: DataFrame) -> DataFrame:
    """Fetch log of a batch: a fetch of several bodies is good if all of them are."""
    body = parts.filter(F.col(PART) == FETCH)
    good = F.col("reason").isNull()
    return body.groupBy("source", "key", "at").agg(
        F.every(good).alias("ok"), F.count("*").alias("n_bodies"),
        F.sum(F.when(good, F.col("n_rows")).otherwise(F.lit(0))).cast("bigint").alias("n_rows"),
        F.min("reason").alias("reason"))


def land(parts: DataFrame, table: str, batch: int | str) -> dict[str, int]:
    """Write a batch and commit it; the counts must agree with what can be read back."""
    spark = parts.sparkSession
    counts = write_rows(parts, table, batch)
    path = f"{table}/rows/batch={batch}"
    if counts["bodies"]:
        schema = f"{PART} string, source string, key string, at timestamp, reason string, n_rows bigint"
        read = spark.read.schema(schema).parquet(path)
        log = fetches(read)
    else:
        log = spark.createDataFrame([], LOG)
    told = log.agg(F.sum("n_bodies")).first()[0] or 0
    if told != counts["bodies"]:
        raise RuntimeError(f"batch {batch}: {told} of {counts['bodies']} bodies can be read back")
    commit(spark, table, batch, log)
    return counts


def fetch_log(spark: SparkSession, table: str) -> DataFrame:
    """Fetches of all committed batches."""
    return spark.read.schema(f"{LOG}, batch string").parquet(f"{table}/log")


def part_of(spark: SparkSession, table: str, part: str, schema: str) -> DataFrame:
    """Rows of one kind, of all batches; join the log on ``batch`` to see committed ones only."""
    rows = spark.read.schema(f"{schema}, batch string, {PART} string").parquet(f"{table}/rows")
    return rows.filter(F.col(PART) == part).drop(PART)
