"""Incremental ingest with Structured Streaming.

All queries keep their state and progress under a checkpoint folder, so a lost
executor or a restarted driver picks up where the last batch ended.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from signalgrid.session import path_exists
from signalgrid.sources.landing import folder_value, good_documents, origin_of, parse_bodies, quarantined


def file_stream(
    spark: SparkSession,
    path: str,
    schema,
    fmt: str = "parquet",
    glob: str | None = None,
    files_per_trigger: int | None = None,
) -> DataFrame:
    """New files below ``path`` as a stream, with a fixed schema."""
    reader = spark.readStream.format(fmt).schema(schema)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.load(path)


def body_stream(
    spark: SparkSession, path: str, per_file: bool = True, files_per_trigger: int | None = None,
    folders: Sequence[str] = (),
) -> DataFrame:
    """New landing files as a stream of bodies: one per file, or one per line.

    ``folders`` names columns that the files' paths hold as ``name=value``.
    """
    # Folder names are read from paths, so layouts may differ below one folder.
    reader = spark.readStream.option("recursiveFileLookup", "true")
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    text = reader.schema("value string").text(path, wholetext=per_file)
    return text.select(origin_of(per_file).alias("origin"), F.col("value").alias("body"),
                       *[folder_value(name).alias(name) for name in folders])


def start_landing(
    bodies: DataFrame,
    schema: str,
    normalise: Callable[[DataFrame], DataFrame],
    out: str,
    aside: str,
    checkpoint: str,
    every: str | None = None,
) -> StreamingQuery:
    """Turn landing bodies into canonical rows, setting bad bodies aside.

    ``normalise`` is one of the feed functions. A bad body costs itself only. Each
    batch owns a folder in both tables, so writing a batch again replaces it.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        parsed = parse_bodies(batch, schema).persist()
        try:
            rows = normalise(good_documents(parsed))
            rows.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")
            quarantined(parsed).write.mode("overwrite").parquet(f"{aside}/batch={batch_id}")
        finally:
            parsed.unpersist()

    return (
        bodies.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
        .trigger(**_trigger(every)).start()
    )


def unique_within(
    stream: DataFrame,
    keys: Sequence[str],
    stamp: str,
    delay: str,
    spread: Column | None = None,
    salts: int = 32,
) -> DataFrame:
    """Drop repeats of records that overlapping polls fetch again.

    ``delay`` is how late a record may come; state older than that is released.
    ``spread`` differs between copies of one record, such as the file they came
    in.  With it, copies first meet in ``salts`` tasks per record and only their
    survivors in one, so a record repeated very often does not fill one task.
    """
    marked = stream.withWatermark(stamp, delay)
    if spread is not None:
        salt = F.pmod(F.xxhash64(spread), F.lit(salts))
        marked = marked.withColumn("_salt", salt).dropDuplicatesWithinWatermark(
            [*keys, "_salt"]).drop("_salt")
    return marked.dropDuplicatesWithinWatermark(list(keys))


def start_unique(
    stream: DataFrame, keys: Sequence[str], stamp: str, table: str, checkpoint: str,
    overlap_days: int = 1, every: str | None = None,
) -> StreamingQuery:
    """Append records that are not on file yet, in folders by day, keeping no state at all.

    Repeats inside a batch collapse before the shuffle; what is left is looked up among the table's rows
    of the same days only, so the cost follows the days that polls overlap and not the length of the
    history. A record keeps its ``stamp`` when it is fetched again; one without a stamp has the day NULL.
    Records without a key are all kept. No record is dropped for being late: one more than ``overlap_days``
    before the newest day on file is written like any other and counted as late.

    Each batch leaves a row (batch, came, added, late) in ``<table>/polls``; ``polls`` reads them.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        day = F.col(stamp).cast("date")
        whole = batch.withColumn("dt", day).persist()
        try:
            no_key = F.lit(False)
            for key in keys:
                no_key = no_key | F.col(key).isNull()
            new = whole.filter(~no_key).dropDuplicates(list(keys))
            newest = None
            if path_exists(spark, f"{table}/rows"):
                history = spark.read.parquet(f"{table}/rows").filter(F.col("batch") != batch_id)
                newest = history.agg(F.max("dt")).first()[0]
                # The batch's days, as many as there are folders to open.
                days = [r.dt for r in new.select("dt").distinct().collect()]
                shared = F.col("dt").isin([d for d in days if d is not None])
                known = history.filter(shared | F.col("dt").isNull() if None in days else shared).select(*keys, "dt")
                same = [new[key] == known[key] for key in keys] + [new["dt"].eqNullSafe(known["dt"])]
                new = new.join(known, same, "left_anti")
            rows = new.unionByName(whole.filter(no_key)).withColumn("batch", F.lit(batch_id))
            replace_folders(rows, f"{table}/rows", "dt", "batch")
            written = spark.read.schema(rows.schema).parquet(f"{table}/rows").filter(F.col("batch") == batch_id)
            late = F.lit(False) if newest is None else F.col("dt") < F.date_sub(F.lit(newest), overlap_days)
            counts = written.agg(F.count("*").alias("added"), F.count_if(late).alias("late"))
            counts.select(F.lit(whole.count()).cast("bigint").alias("came"), "added", "late").write.mode("overwrite").parquet(
                f"{table}/polls/batch={batch_id}")
        finally:
            whole.unpersist()

    return (
        stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
        .trigger(**_trigger(every)).start()
    )


def polls(spark: SparkSession, table: str) -> DataFrame:
    """What each batch of ``start_unique`` brought."""
    return spark.read.schema("came bigint, added bigint, late bigint, batch bigint").parquet(f"{table}/polls")


def replace_folders(rows: DataFrame, path: str, *partitions: str) -> None:
    """Write rows into folders by value, replacing the folders that are written to and no other."""
    # Few files a folder, and several for a day that holds much of the rows.
    rows.hint("rebalance", partitions[0]).write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic").partitionBy(*partitions).parquet(path)


def start_append(
    stream: DataFrame, out: str, checkpoint: str, every: str | None = None
) -> StreamingQuery:
    """Append a stream to a Parquet table, each row once.

    Without ``every`` the query takes what is there and stops.
    """
    return (
        stream.writeStream.format("parquet").outputMode("append")
        .option("path", out).option("checkpointLocation", checkpoint)
        .trigger(**_trigger(every)).start()
    )


def start_upsert(
    stream: DataFrame, out: str, checkpoint: str, every: str | None = None
) -> StreamingQuery:
    """Keep versions of changed rows; ``latest`` reads the newest of each key.

    Each batch owns one folder, so writing a batch again replaces it.
    """
    return (
        stream.writeStream.outputMode("update")
        .foreachBatch(_write_version(out)).option("checkpointLocation", checkpoint)
        .trigger(**_trigger(every)).start()
    )


def latest(spark: SparkSession, out: str, keys: Sequence[str]) -> DataFrame:
    """Newest version of every key of an upserted table."""
    versions = spark.read.parquet(out)
    values = [c for c in versions.columns if c not in (*keys, "version")]
    newest = versions.groupBy(*keys).agg(
        F.max_by(F.struct(*values), "version").alias("row")
    )
    return newest.select(*keys, "row.*")


def compact(spark: SparkSession, out: str, keys: Sequence[str], target: str) -> None:
    """Write the newest version of every key to a new table of one version.

    Readers move to ``target`` once it is complete; run it while no query upserts.
    """
    latest(spark, out, keys).write.mode("overwrite").parquet(f"{target}/version=0")


def _write_version(out: str) -> Callable[[DataFrame, int], None]:
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/version={batch_id}")

    return write


def _trigger(every: str | None) -> dict:
    return {"processingTime": every} if every else {"availableNow": True}
