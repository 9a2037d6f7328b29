"""License scan by diagonal voting of word runs, in built-in functions alone."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from signalgrid.llm.common import ascii_lower, with_once
from signalgrid.session import local_table

BETWEEN_WORDS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
GRAM = 4
PHRASE_GRAM = 2  # phrases are looked up by their first two words
AROUND = 4
NEAR_DIAGONALS = 3
LEAST_COVERAGE = 0.5

# Phrases that count wherever their words stand in a row, and their labels.
PHRASES = {
    "mit license": "mit",
    "apache license": "apache",
    "general public license": "gpl",
}
# Public license texts and notices, and the label of a text that holds most of one.
TEXTS = {
    "mit-text": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and
        associated documentation files (the "Software"), to deal in the Software without restriction, including without
        limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the
        Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
        The above copyright notice and this permission notice shall be included in all copies or substantial portions
        of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING
        BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN
        NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN
        AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR
        OTHER DEALINGS IN THE SOFTWARE.""",
    "isc-text": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee
        is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
        THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING
        ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL,
        DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR
        PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION
        WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "bsd-text": """Redistribution and use in source and binary forms, with or without modification, are permitted
        provided that the following conditions are met: Redistributions of source code must retain the above copyright
        notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the
        above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other
        materials provided with the distribution.""",
    "apache-notice": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except
        in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0
        Unless required by applicable law or agreed to in writing, software distributed under the License is distributed
        on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for
        the specific language governing permissions and limitations under the License.""",
    "gpl-notice": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU
        General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your
        option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY
        WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU
        General Public License for more details.""",
    "mit-mention": "Released under the MIT License",
    "apache-mention": "Licensed under the Apache License, Version 2.0",
    "gpl-mention": "Licensed under the GNU General Public License",
    "cc-mention": "Licensed under CC BY-NC 4.0",
}


def words_of(text: str | Column) -> Column:
    """Words of a whole text in order; A-Z are lower-cased, null is empty."""
    return F.array_remove(F.split(ascii_lower(text), BETWEEN_WORDS), "")


def with_words(documents: DataFrame, *columns: Column) -> DataFrame:
    """The columns and ``words`` of ``text``, one row for each document; each text is cut once."""
    return with_once(documents.select(*columns, "text"), "words", words_of("text")).drop("text")


def templates() -> list[tuple[str, bool, list[str]]]:
    """Rows (label, whether a phrase, words)."""
    rows = [(label, True, words) for words, label in PHRASES.items()] + [(label, False, text) for label, text in TEXTS.items()]
    return [(label, base, re.findall("[0-9a-z]+", text.lower())) for label, base, text in rows]


def _grams(spark: SparkSession) -> DataFrame:
    """One row per phrase and per place of a longer template: the words there and around, and their hash."""
    rows = []
    for label, base, words in templates():
        if base and not PHRASE_GRAM <= len(words) <= GRAM or not base and len(words) < GRAM:
            raise ValueError(f"a phrase has {PHRASE_GRAM} to {GRAM} words, a text at least {GRAM}: {label}")
        # No word of a text is empty, so places outside the template equal none.
        padded = [""] * AROUND + (words[:1] if base else words) + [""] * (AROUND + GRAM)
        for q in range(1 if base else len(words) - GRAM + 1):
            run = (words[q:q + GRAM] + [None] * GRAM)[:GRAM]
            rows.append((label, base, len(words), q, *run, " ".join(padded[q:q + 2 * AROUND + GRAM])))
    grams = local_table(
        spark, rows, "label string, base boolean, size int, place int, t0 string, t1 string, t2 string, t3 string, around string")
    return grams.withColumn("around", F.split("around", " ")).withColumn("hash", F.when(F.col("base"), F.xxhash64("t0", "t1")).otherwise(F.xxhash64("t0", "t1", "t2", "t3")))


def license_scan(documents: DataFrame) -> DataFrame:
    """Per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    The hash of each four neighbouring words of a text is looked up among those of the templates (a table
    of fixed size), and their words are compared. A match at word p of the text and place q of a template
    votes for the diagonal p - q. Around each vote, up to four words to either side, the words of the
    text are compared with the template's on that diagonal. Diagonals within 3 of each other are one
    span. It counts if half of the template's places, each counted once, have their word on one of its
    diagonals, and if it is not longer than twice the template. A phrase is looked up by its first two
    words and stands where the others follow. The score is the largest share of places, 1 for a phrase
    and 0 for no finding.

    Null text is empty. Rows are reported one by one; equal rows have equal results. A null
    doc_id is kept. Other columns are ignored.
    """
    rows = with_words(documents, F.col("doc_id").cast("long"), F.xxhash64("text").alias("key"))

    def word(ahead: int) -> Column:
        return F.get("words", F.col("p") + ahead)

    # The words travel as they are up to the comparison, inside one stage; no row keeps them after it.
    places = rows.where(F.size("words") >= PHRASE_GRAM).select("doc_id", "key", "words", F.posexplode("words").alias("p", "w0"))
    runs = places.select("*", *(word(i).alias(f"w{i}") for i in range(1, GRAM)))
    hashes = F.array(F.xxhash64("w0", "w1"), F.when(F.col("w3").isNotNull(), F.xxhash64("w0", "w1", "w2", "w3")))
    equal = (F.col("w0") == F.col("t0")) & (F.col("w1") == F.col("t1"))
    for i in range(2, GRAM):
        equal &= F.col(f"t{i}").isNull() | (F.col(f"w{i}") == F.col(f"t{i}"))
    votes = runs.select("*", F.explode(hashes).alias("hash")).join(
        F.broadcast(_grams(documents.sparkSession)), "hash").where(F.coalesce(equal, F.lit(False)))
    begin = F.greatest(F.col("p") - AROUND, F.lit(0))
    reach = 2 * AROUND + GRAM
    cut = begin - F.col("p") + AROUND  # a text's first words have fewer before them
    beside = F.posexplode(F.arrays_zip(
        F.expr(f"slice(words, greatest(p - {AROUND}, 0) + 1, {reach})").alias("said"),
        F.expr(f"slice(around, greatest(p - {AROUND}, 0) - p + {AROUND + 1}, {reach})").alias("due")))
    compared = votes.select(
        "doc_id", "key", "label", "base", "size", (F.col("p") - F.col("place")).alias("diagonal"),
        (F.col("place") - AROUND + cut).alias("from"), beside.alias("i", "pair"))
    # Equal rows find the same; a place counts once.
    found = compared.where(F.col("pair.said") == F.col("pair.due")).select(
        "doc_id", "key", "label", "base", "size", "diagonal", (F.col("from") + F.col("i")).alias("place")).distinct()
    order = Window.partitionBy("doc_id", "key", "label", "base", "size").orderBy("diagonal")
    step = F.col("diagonal") - F.lag("diagonal").over(order)
    apart = F.coalesce(step > F.when(F.col("base"), F.lit(0)).otherwise(F.lit(NEAR_DIAGONALS)), F.lit(True))
    span = ["doc_id", "key", "label", "base", "size", "span"]
    at = F.col("diagonal") + F.col("place")
    spans = (found.withColumn("new", apart.cast("int")).withColumn("span", F.sum("new").over(order))
             .groupBy(*span, "place").agg(F.min(at).alias("first"), F.max(at).alias("last"))
             .groupBy(*span).agg(F.count("*").alias("n"), F.min("first").alias("at"), F.max("last").alias("last")))
    share = F.when(F.col("base"), F.lit(1.0)).otherwise(F.col("n") / F.col("size"))
    held = F.col("base") | ((F.col("n") >= LEAST_COVERAGE * F.col("size")) & (F.col("last") - F.col("at") + 1 <= 2 * F.col("size")))
    texts = spans.where(held).groupBy(F.col("doc_id").alias("_doc_id"), "key").agg(
        F.count_if("base").alias("n_base"),
        F.min(F.when(F.col("base"), F.col("at"))).cast("long").alias("first_word"),
        F.max(F.when(F.col("base"), F.col("at"))).cast("long").alias("last_word"),
        F.array_join(F.sort_array(F.collect_set(F.when(F.col("base"), F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.sort_array(F.collect_set("label")), ",").alias("labels"), F.max(share).alias("score"))
    whole = rows.select("doc_id", "key", F.size("words").cast("long").alias("n_words"))
    same = whole["doc_id"].eqNullSafe(texts["_doc_id"]) & (whole["key"] == texts["key"])
    return whole.join(texts, same, "left").select(
        "doc_id", "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"), "first_word", "last_word",
        F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"))
