"""Keyword selection and attribution of texts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from signalgrid.dims import Keywords
from signalgrid.functions.text import (
    first_keyword, lists_mentioned, mentions, spaced_words,
)
from signalgrid.session import fits_broadcast


def select_mentions(df: DataFrame, text: Column, words: Sequence[str]) -> DataFrame:
    """Rows whose text mentions any of the words."""
    return df.filter(mentions(text, words))


def route_by_mention(
    df: DataFrame, text: Column, lists: Sequence[Keywords], out: str
) -> DataFrame:
    """One row per text and list it mentions."""
    return df.withColumn(out, F.explode(lists_mentioned(text, lists)))


def attribute_keywords(
    df: DataFrame, text: Column, lists: Sequence[Keywords], out: str = "code"
) -> DataFrame:
    """Add the code of the first list mentioned; one pass over each text, no join."""
    return df.withColumn(out, first_keyword(text, lists))


def dictionary_trie(dictionary: DataFrame) -> DataFrame:
    """All beginnings of a dictionary's entries, cut at blanks.

    A row per beginning (prefix), with the best priority of the entry that it is, if any, and whether some
    entry goes on behind it.
    """
    words = F.split("word", " ")
    steps = dictionary.filter(F.col("word").isNotNull()).select(
        "priority", "word", F.explode(F.sequence(F.lit(1), F.size(words))).alias("depth"), words.alias("words"))
    cut = steps.withColumn("prefix", F.array_join(F.slice("words", F.lit(1), F.col("depth")), " "))
    ends = F.col("prefix") == F.col("word")
    return cut.groupBy("prefix").agg(F.min(F.when(ends, F.col("priority"))).alias("priority"), F.max(~ends).alias("deeper"))


def attribute_dictionary(
    df: DataFrame, text: Column, key: str, dictionary: DataFrame, out: str = "code"
) -> DataFrame:
    """Code per key for a large dictionary of words and phrases, null without a hit.

    The dictionary becomes a trie of word sequences, as a table. Each word of a text is looked up once
    as the beginning of an entry; only where entries go on is the next word looked up too, and so on.
    So the cost grows neither with the number of entries nor with that of phrases with a
    common beginning. The hits of a text combine within its own partition before the shuffle on ``key``.
    Texts of one key count as one. ``dictionary`` has code, priority and word (lower-case ASCII words,
    one space between them); each code has its own priority.
    """
    trie = dictionary_trie(dictionary)
    small = fits_broadcast(trie)
    depth = trie.agg(F.max(F.size(F.split("prefix", " ")))).first()[0] or 1
    side = F.broadcast(trie) if small else trie
    # Within a stage the words of a text are only pointed at; for a shuffle each row takes what may follow it.
    cut = df.select(key, spaced_words(text).alias("words"))
    placed = cut.select(key, "words", F.posexplode("words").alias("at", "word"))
    if not small:
        placed = placed.withColumn("words", F.slice("words", F.col("at") + 1, F.lit(depth))).withColumn("at", F.lit(0))
    # Lower-cased after cutting, so that no accented letter turns into an ASCII one.
    node = placed.withColumn("prefix", F.lower(F.rtrim("word"))).join(side, "prefix").withColumn("best", F.col("priority"))
    for step in range(1, depth):
        # A word that one space parts from the next keeps it.
        following = F.get(F.col("words"), F.col("at") + step)
        goes_on = F.col("deeper") & F.get(F.col("words"), F.col("at") + (step - 1)).endswith(" ")
        longer = F.when(goes_on, F.concat("prefix", F.lit(" "), F.lower(F.rtrim(following))))
        node = node.select(key, "words", "at", "best", longer.alias("prefix")).join(side, "prefix", "left")
        node = node.withColumn("best", F.least("best", "priority"))
    # A number per text hashes well; its code is looked up once the hits are combined.
    best = node.select(key, "best").unionByName(df.select(key, F.lit(None).cast("int").alias("best")))
    best = best.groupBy(key).agg(F.min("best").alias("priority"))
    codes = dictionary.select("priority", F.col("code").alias(out)).distinct()
    return best.join(codes, "priority", "left").select(key, out)
