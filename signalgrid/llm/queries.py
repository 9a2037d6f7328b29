"""The operators as queries over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from signalgrid.llm import (
    chat, curriculum, decontaminate, embedding_dedup, fill_in_middle, language_model, license_scan, minhash_dedup,
    packing, quality, spelling, token_counts, warc,
)
from signalgrid.llm.common import table


def op1_embedding_dedup(spark, sf_dir):
    return embedding_dedup.vector_links(table(spark, sf_dir, "embeddings"))


def op2_quality_classifier(spark, sf_dir):
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = quality.classify(documents, table(spark, sf_dir, "labels"), keep_text=False)
    return scored.select("doc_id", "held_out", "score", "predicted")


def op3_chat_formatting(spark, sf_dir):
    said = "</s>[INST] ok [/INST]"
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], rows.schema)
    return chat.read_back(chat.format_turns(rows.unionByName(more))).select(
        "conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")


def op4_token_counts(spark, sf_dir):
    return token_counts.token_counts(table(spark, sf_dir, "documents"))


def op5_warc(spark, sf_dir):
    index = warc.write_archives(table(spark, sf_dir, "pages"))
    return warc.read_records(index, payloads=False).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_minhash_dedup(spark, sf_dir):
    return minhash_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op7_packing(spark, sf_dir):
    return packing.packed(table(spark, sf_dir, "documents"))


def op8_decontamination(spark, sf_dir):
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_license_scan(spark, sf_dir):
    return license_scan.license_scan(table(spark, sf_dir, "documents"))


def op10_language_model(spark, sf_dir):
    return language_model.scored(table(spark, sf_dir, "documents"), least=1)


def op11_source_mixing(spark, sf_dir):
    mix = curriculum.mixed(table(spark, sf_dir, "documents"))
    first, again = (F.get(F.col("copies"), F.lit(i))["position"] for i in (0, 1))
    rows = mix.select("doc_id", "source", "size", "source_size", "target", "taken",
                      first.alias("position"), again.alias("position_again"))
    order = [F.asc_nulls_last("position"), "source", "doc_id"]
    return rows.repartitionByRange(*order).sortWithinPartitions(*order)


def op12_fill_in_middle(spark, sf_dir):
    made = fill_in_middle.fill_in_middle(table(spark, sf_dir, "documents"))
    return made.select(
        "doc_id", "n", "form", F.col("prefix_units").alias("prefix_chars"), F.col("middle_units").alias("middle_chars"),
        F.sha2("output", 256).alias("output_sha256"),
        F.sha2(fill_in_middle.restored("output", "form"), 256).alias("restored_sha256"))


def op13_spelling_variants(spark, sf_dir):
    return spelling.spelling_variants(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (
    op1_embedding_dedup, op2_quality_classifier, op3_chat_formatting, op4_token_counts, op5_warc,
    op6_minhash_dedup, op7_packing, op8_decontamination, op9_license_scan, op10_language_model,
    op11_source_mixing, op12_fill_in_middle, op13_spelling_variants)}
