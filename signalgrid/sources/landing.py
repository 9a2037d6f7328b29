"""Landing bodies: raw answers of upstream feeds, kept as text until parsed.

A landing table has ``origin`` (file or fetch key) and ``body``; other columns,
such as the subject asked for, pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from signalgrid.schemas import CORRUPT


def read_bodies(spark: SparkSession, path: str, per_file: bool = True) -> DataFrame:
    """Bodies from text files: one per file, or one per line.

    A zero-byte file has no row; find it with ``missing_keys`` over a manifest.
    """
    text = spark.read.text(path, wholetext=per_file)
    return text.select(origin_of(per_file).alias("origin"), F.col("value").alias("body"))


def origin_of(per_file: bool) -> Column:
    """Where a body came from: its file's whole path, and for one of many lines its digest too."""
    # Streams and tables write a mounted file's path with one slash and with three.
    path = F.regexp_replace(F.col("_metadata.file_path"), "^file:/+", "file:///")
    return path if per_file else F.concat_ws("#", path, F.sha2("value", 256))


def folder_value(name: str) -> Column:
    """What a file's path says in a folder ``name=value``, NULL without one or with Spark's name for NULL."""
    path = F.col("_metadata.file_path")
    found = F.regexp_extract(path, f"/{name}=([^/]+)/", 1)
    # Folder names escape signs twice: once as a name, once as a path. A plus sign is no blank here.
    value = F.try_url_decode(F.replace(F.try_url_decode(F.replace(found, F.lit("+"), F.lit("%2B"))), F.lit("+"), F.lit("%2B")))
    return F.when((found != "") & (value != "__HIVE_DEFAULT_PARTITION__"), value)


def parse_bodies(bodies: DataFrame, schema: str) -> DataFrame:
    """Add the parsed ``doc`` and the ``reason`` to set a body aside (NULL if good).

    The body is read as the one entry of a list, so a second document or other text behind
    the first makes it malformed instead of going unseen.
    """
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}
    listed = F.concat(F.lit('{"doc":['), F.col("body"), F.lit("]}"))
    docs = F.from_json(listed, f"doc array<struct<{schema}>>, {CORRUPT} string", options)
    whole = (F.size("_parsed.doc") == 1) & F.col(f"_parsed.{CORRUPT}").isNull()
    doc = F.get("_parsed.doc", F.lit(0))
    reason = (
        F.when(~F.coalesce(F.col("body").rlike(r"\S"), F.lit(False)), F.lit("empty"))
        .when(F.col("body").rlike(r"^\s*<"), F.lit("markup"))
        .when(~F.coalesce(whole, F.lit(False)) | F.col("doc").isNull(), F.lit("malformed"))
    )
    # Exploding a one-element array keeps the parse in one place: a later filter on
    # its result would otherwise be pushed below it and parse every body again.
    parsed = bodies.select("*", F.explode(F.array(docs)).alias("_parsed"))
    return parsed.withColumn("doc", doc).withColumn("reason", reason).drop("_parsed")


def good_documents(parsed: DataFrame) -> DataFrame:
    return parsed.filter(F.col("reason").isNull()).drop("body", "reason")


def quarantined(parsed: DataFrame) -> DataFrame:
    """Bodies set aside; all others go on without them."""
    return parsed.filter(F.col("reason").isNotNull()).drop("doc")
