"""What several operators share: written tables, runs of sorted rows, connected components."""

from __future__ import annotations

import ctypes
import functools
import gc
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from signalgrid.session import remove_at_exit, work_folder

FIT_ROWS = 500_000
BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def lean(task: Callable) -> Callable:
    """Have a task's Python worker, which lives on, return its free memory to the system at the end."""
    @functools.wraps(task)
    def run(batches):
        try:
            yield from task(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except (OSError, AttributeError):
                pass  # another C library than glibc

    return run


def modest_batches(spark: SparkSession) -> None:
    """Send whole texts to Python workers some thousand rows at a time.

    Spark's default of 10,000 rows makes batches of tens of megabytes, held several times over by the
    executor and its worker. A session with another setting keeps it.
    """
    if spark.conf.get(BATCH_ROWS) == "10000":
        spark.conf.set(BATCH_ROWS, "2000")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, purpose: str) -> DataFrame:
    """Write to the shared folder and read back, so that nothing is worked out twice."""
    folder = work_folder(df.sparkSession, purpose)
    remove_at_exit(df.sparkSession, folder)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def with_once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """A further column whose value is worked out once a row.

    It leaves a generator; a plain column would be worked out anew in every filter on it that the
    optimizer moves to the scan.
    """
    return df.select("*", F.explode(F.array(value)).alias(name))


def broadcast_if_small(df: DataFrame, rows: int = FIT_ROWS) -> DataFrame:
    """Hint a broadcast only after counting; a larger table is joined by a shuffle."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def local_path(folder: str) -> str:
    """The path of a mounted shared folder; other stores go through ``file_system``."""
    return folder.removeprefix("file://").removeprefix("file:") if "://" not in folder or folder.startswith("file:") else folder


def file_system(folder: str):
    """The store of a shared folder as tasks see it, and the path in it."""
    from pyarrow import fs

    path = local_path(folder)
    return (fs.LocalFileSystem(), path) if path.startswith("/") else fs.FileSystem.from_uri(path)


def crc32_of(column: str | Column) -> Column:
    return F.crc32(F.col(column).cast("string") if isinstance(column, str) else column)


def ascii_lower(text: str | Column) -> Column:
    """Lower-case A to Z for word matching; null is empty.

    ``lower`` differs from that in words of plain letters only where it makes a plain letter
    out of another one: the Kelvin sign and the dotted capital I, which are kept apart.
    """
    text = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    odd = text.contains("K") | text.contains("İ")
    apart = F.replace(F.replace(text, F.lit("K"), F.lit("ĸ")), F.lit("İ"), F.lit("ı"))
    return F.lower(F.when(odd, apart).otherwise(text))


def runs(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Rows of equal keys together, from batches that are sorted by them; one run at a time."""
    held: list[pa.Table] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        part = pa.Table.from_batches([batch])
        new = np.zeros(part.num_rows, bool)
        for key in keys:
            column = part[key].combine_chunks()
            if part.num_rows > 1:
                new[1:] |= np.asarray(pc.not_equal(column[1:], column[:-1]))
        cuts = [0, *np.flatnonzero(new).tolist(), part.num_rows]
        joins = bool(held) and all(held[-1][key][-1].as_py() == part[key][0].as_py() for key in keys)
        for i, (a, b) in enumerate(zip(cuts, cuts[1:])):
            if held and not (i == 0 and joins):
                yield pa.concat_tables(held)
                held = []
            held.append(part.slice(a, b - a))
    if held:
        yield pa.concat_tables(held)


def by_runs(df: DataFrame, keys: list[str], work: Callable[[pa.Table], pa.RecordBatch | None],
            schema: str, order: list[str] | None = None) -> DataFrame:
    """Bring rows of equal keys together and call ``work`` on each group; keys hold no nulls.

    The caller bounds the size of a group. Groups of a task are read in sorted order, so only
    one is in memory, and small groups cost no call of Spark's own.
    """
    @lean
    def task(batches):
        for run in runs(batches, keys):
            out = work(run)
            if out is not None and out.num_rows:
                yield out

    together = df.repartition(*keys).sortWithinPartitions(*keys, *(order or []))
    return together.mapInArrow(task, schema)


def components(edges: DataFrame) -> DataFrame:
    """Connected components of links (a, b): a row (id, component) for each end of a link.

    ``component`` is the smallest id reachable. Each round hooks every node to its smallest
    neighbour, follows the hooks to their ends by doubling, and renames the links, so links
    within a component go. Only partial minima meet at a busy node. Rows with a null end or
    equal ends count for nothing.
    """
    def normal(a: Column, b: Column) -> list[Column]:
        return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]

    live = stored(edges.select(*normal(F.col("a").cast("long"), F.col("b").cast("long")))
                  .where("a < b").distinct(), "links")
    everyone = live.select(F.col("a").alias("id")).union(live.select("b")).distinct()
    named: DataFrame | None = None
    while not live.isEmpty():
        hook = stored(live.groupBy(F.col("b").alias("id")).agg(F.min("a").alias("to")), "hooks")
        while True:
            above = hook.select(F.col("id").alias("to"), F.col("to").alias("above"))
            further = stored(hook.join(above, "to", "left").select(
                "id", F.coalesce("above", "to").alias("to"), F.col("above").isNotNull().alias("moved")), "hooks")
            hook = further.select("id", "to")
            if further.where("moved").isEmpty():
                break
        named = hook if named is None else stored(_renamed(named, hook, "to").unionByName(hook), "names")
        live = stored(_renamed(_renamed(live, hook, "a"), hook, "b").select(
            *normal(F.col("a"), F.col("b"))).where("a < b").distinct(), "links")
    if named is None:
        return everyone.select("id", F.col("id").alias("component"))
    return everyone.join(named, "id", "left").select("id", F.coalesce("to", "id").alias("component"))


def _renamed(df: DataFrame, names: DataFrame, column: str) -> DataFrame:
    other = names.select(F.col("id").alias(column), F.col("to").alias("_to"))
    return df.join(other, column, "left").withColumn(column, F.coalesce("_to", column)).drop("_to")
