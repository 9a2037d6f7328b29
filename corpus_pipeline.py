"""From raw documents to packed training sequences; each stage works on what the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from signalgrid.llm import decontaminate, minhash_dedup, packing, quality
from signalgrid.llm.common import broadcast_if_small, stored, table


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; it learns from those that are labelled.

    Null and empty texts have the score of the model's offset, all one alike; repeated rows are kept or
    dropped together. Without labels every document is kept. An empty table gives an empty one.
    """
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    carried = docs.select("doc_id", "text", *([F.struct(*others).alias("_carried")] if others else []))
    scored = quality.classify(carried, table(spark, sf_dir, "labels")).where("predicted = 1")
    back = {c: F.col("_carried").getField(c).alias(c) for c in others}
    return scored.select([back.get(c, F.col(c)) for c in docs.columns])


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that with the smallest doc_id.

    Documents without words or doc_id are in no group and stay, and rows that share an id stay together.
    """
    found = minhash_dedup.near_duplicates(docs).where("doc_id IS NOT NULL AND NOT kept")
    gone = stored(found.select("doc_id").distinct(), "gone")
    return docs.join(broadcast_if_small(gone), "doc_id", "left_anti").select(docs.columns)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item.

    Null and empty texts hold none and stay; repeated rows stay or go together. A row is known by its
    doc_id and a hash of its text. Without items, or without documents, nothing goes.
    """
    found = decontaminate.contaminated(docs, table(spark, sf_dir, "benchmark"))
    gone = stored(found.select("doc_id", "text_key").distinct(), "gone")
    # Whole rows travel as one column, so none of their names can clash.
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").cast("long").alias("doc_id"),
                       F.xxhash64(F.col("doc_id").cast("long"), "text").alias("text_key"))
    gone = broadcast_if_small(gone)
    same = (rows["text_key"] == gone["text_key"]) & rows["doc_id"].eqNullSafe(gone["doc_id"])
    return rows.join(gone, same, "left_anti").select("row.*")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of sequences of at most 2,048 ids.

    Null and empty texts have an end id alone; each repeated row has pieces of its own. An empty table
    gives no pieces.
    """
    return packing.packed(docs)


STAGES = [
    ("quality", keep_good),
    ("near_duplicates", drop_near_copies),
    ("decontamination", drop_leaks),
    ("packing", pack),
]

# SQL can neither fit the classifier nor run the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each result is written and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
