"""Session helpers: a sensible default session, small local tables, work folders."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, types as T

# A side of a join is hinted for broadcast only below this many rows; every
# caller also has a shuffle form for larger sides.
BROADCAST_ROWS = 200_000


def build_session(app: str = "signalgrid", master: str | None = None, **conf) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        # Stream state on local disk, so it may outgrow executor memory.
        "spark.sql.streaming.stateStore.providerClass":
            "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
        **{k: str(v) for k, v in conf.items()},
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def local_table(spark: SparkSession, rows: Sequence[tuple], ddl: str) -> DataFrame:
    """Turn configuration rows into a table whose size the optimizer knows.

    Going through Arrow gives a local relation with exact statistics, so Spark
    itself decides on a broadcast join; a list of Python rows would not.
    """
    schema = T.StructType.fromDDL(ddl)
    columns = list(zip(*rows)) if rows else [[] for _ in schema.fields]
    arrow = pa.table(
        [pa.array(list(c), type=_arrow_type(f)) for c, f in zip(columns, schema)],
        names=schema.names,
    )
    return spark.createDataFrame(arrow, schema=schema)


def _arrow_type(field: T.StructField) -> pa.DataType:
    kinds = {
        "string": pa.string(), "double": pa.float64(), "int": pa.int32(),
        "bigint": pa.int64(), "boolean": pa.bool_(),
    }
    return kinds[field.dataType.simpleString()]


def fits_broadcast(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """Check a dimension's size; reads at most ``rows`` + 1 rows of it."""
    return df.limit(rows + 1).count() <= rows


def work_folder(spark: SparkSession, purpose: str) -> str:
    """A new folder below the shared folder that the cluster names; it goes when the session ends.

    A local session without that setting uses its warehouse folder; a cluster must name one.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and spark.sparkContext.master.startswith("local"):
        base = spark.conf.get("spark.sql.warehouse.dir", None)
    if not base:
        raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
    return f"{base.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def _file_system(spark: SparkSession, folder: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def path_exists(spark: SparkSession, folder: str) -> bool:
    """Whether a folder is there, in whatever store it lies."""
    system, path = _file_system(spark, folder)
    return system.exists(path)


def subfolders(spark: SparkSession, folder: str) -> list[str]:
    """Names of the folders in a folder; none if it is not there."""
    system, path = _file_system(spark, folder)
    if not system.exists(path):
        return []
    return [s.getPath().getName() for s in system.listStatus(path) if s.isDirectory()]


def file_names(spark: SparkSession, folder: str) -> list[str]:
    """Names of the files in a folder; none if it is not there."""
    system, path = _file_system(spark, folder)
    if not system.exists(path):
        return []
    return [s.getPath().getName() for s in system.listStatus(path) if s.isFile()]


def write_text(spark: SparkSession, file: str, text: str) -> None:
    """Write a short file."""
    system, path = _file_system(spark, file)
    out = system.create(path, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def text_of(spark: SparkSession, file: str) -> str:
    """What a short file holds."""
    return "\n".join(r.value for r in spark.read.text(file).collect())


def move_file(spark: SparkSession, file: str, target: str) -> bool:
    """Put a file in place by one rename; False if something is there already."""
    system, path = _file_system(spark, file)
    to = _file_system(spark, target)[1]
    system.mkdirs(to.getParent())
    return not system.exists(to) and system.rename(path, to)


def remove_folder(spark: SparkSession, folder: str) -> None:
    system, path = _file_system(spark, folder)
    system.delete(path, True)


def remove_at_exit(spark: SparkSession, folder: str) -> None:
    """Have the folder's own file system remove it when the session's JVM ends."""
    system, path = _file_system(spark, folder)
    system.deleteOnExit(path)


def written(df: DataFrame, purpose: str) -> DataFrame:
    """Write a frame that several results share and read it back.

    All of them then see the same rows, whatever happens to the inputs or to an
    executor in between, and later joins know its size.
    """
    path = work_folder(df.sparkSession, purpose)
    df.write.parquet(path)
    remove_at_exit(df.sparkSession, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
