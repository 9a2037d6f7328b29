"""Benchmark decontamination by SimHash of item-sized windows, in built-in functions alone."""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, functions as F

from signalgrid.llm.common import broadcast_if_small, stored, with_once
from signalgrid.llm.license_scan import with_words

SHINGLE = 5
LEAST = 0.75
BLOCKS, BLOCK_BITS, BLOCK_RADIUS = 4, 16, 3
RADIUS = BLOCKS * (BLOCK_RADIUS + 1) - 1


def _shingles(words: Column, size: int) -> Column:
    """Hashes of all runs of ``size`` words of an array that has as many."""
    return F.transform(F.sequence(F.lit(1), F.size(words) - size + 1), lambda i: F.xxhash64(F.slice(words, i, size)))


def _fingerprints(rows: DataFrame, keys: list[str]) -> DataFrame:
    """SimHash of each row's ``words`` array: a bit is set if most words' hashes have it set.

    Two counters of 32 bits share a sum, so a row takes 32 sums, made inside the row.
    """
    hashed = rows.select(*keys, F.transform("words", lambda word: F.xxhash64(word)).alias("hashes"))
    none = F.struct(*(F.lit(0).cast("long").alias(f"s{b}") for b in range(32)))
    counted = with_once(hashed, "sums", F.aggregate("hashes", none, lambda sums, h: F.struct(*(
        (sums[f"s{b}"] + F.shiftrightunsigned(h, b).bitwiseAND(F.lit(0x100000001))).alias(f"s{b}") for b in range(32)))))
    bits = F.lit(0).cast("long")
    for b in range(32):
        s = F.col(f"sums.s{b}")
        for half, place in ((s.bitwiseAND(F.lit(0xFFFFFFFF)), b), (F.shiftrightunsigned(s, 32), b + 32)):
            bits = bits.bitwiseOR(F.shiftleft(F.when(half * 2 > F.size("hashes"), F.lit(1)).otherwise(F.lit(0)).cast("long"), place))
    return counted.select(*keys, bits.alias("fp"))


def _block(fp: str, j: Column) -> Column:
    return F.expr(f"cast(shiftrightunsigned({fp}, cast(j * {BLOCK_BITS} as int)) & {(1 << BLOCK_BITS) - 1} as int)")


def _masks() -> list[int]:
    """All ways to change at most 3 of a block's 16 bits."""
    return [sum(1 << b for b in picked) for r in range(BLOCK_RADIUS + 1) for picked in combinations(range(BLOCK_BITS), r)]


def contaminated(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Rows (doc_id, item_id, similarity, start_word, n_words, text_key) of items that documents hold.

    An item of L words is held if a window of L words (the whole text, if shorter) has a weighted
    similarity of at least 0.75 with it: over runs of five words, or the whole item if shorter,
    the sum of smaller counts by the sum of larger ones. Words are runs of letters and digits,
    A-Z lower-cased, so case and signs do not hide an item. The best window is reported, the
    first of equal ones.

    1. Only windows that could be that similar are looked at: 0.75 needs 3/7 of both sides' runs to
       be common, so windows with fewer runs known from items of their size are out. This loses none.
    2. The windows' and the items' words get 64-bit SimHash fingerprints. Those within 15 bits differ
       by at most 3 in one of 4 blocks of 16 bits; the items are filed under all values that
       near to each of their blocks, which finds every such pair.
    3. Pairs within 15 bits are verified by their exact similarity.

    A window just at 0.75 may lie further than 15 bits away, most often if both ends of the item are
    rewritten: the README has the shares. Near copies lie within 8.
    Null or wordless texts and items match nothing. Repeated rows of a document or item give
    their row once; null ids are kept. ``text_key`` is xxhash64(doc_id, text), which tells apart
    documents that share an id. Other columns are ignored.
    """
    items = stored(with_words(benchmark, F.col("item_id").cast("long")).where(
        F.size("words") > 0).withColumn("item", F.xxhash64("item_id", "words")).dropDuplicates(["item"]).select(
        "item", "item_id", "words", F.size("words").alias("size"),
        F.least(F.lit(SHINGLE), F.size("words")).alias("k")), "items")
    texts = documents.select(F.col("doc_id").cast("long"), F.xxhash64("doc_id", "text").alias("key"), "text")
    rows = with_words(texts, F.col("key"))
    kinds = sorted(r["k"] for r in items.select("k").distinct().collect())  # at most 1 to 5
    parts = [_item_shingles(items, k) for k in kinds]
    found = None
    for k, own in zip(kinds, parts):
        more = _windows(rows, own, k)
        found = more if found is None else found.union(more)
    if found is None:
        return documents.sparkSession.createDataFrame(
            [], "doc_id long, item_id long, similarity double, start_word long, n_words long, text_key long")
    windows = stored(found, "windows")
    # Of a text only the words from its first window to its last one travel further.
    reach = windows.groupBy("key").agg(F.min("start").alias("first"), F.max(F.col("start") + F.col("width")).alias("end"))
    asked = texts.join(broadcast_if_small(stored(reach, "keys")), "key")
    cut = with_words(asked, F.col("doc_id"), F.col("key"), F.col("first"), F.col("end")).select(
        "doc_id", "key", "first", F.expr("slice(words, first + 1, end - first)").alias("words"))
    texts = stored(cut.dropDuplicates(["key"]), "texts")
    near = stored(_near(windows, texts, items), "near")
    return _verified(near, texts, items, parts)


def _item_shingles(items: DataFrame, k: int) -> DataFrame:
    """Rows (item, size, h, n): how often an item of shingle size k holds each shingle."""
    return items.where(F.col("k") == k).select("item", "size", F.explode(_shingles(F.col("words"), k)).alias("h")).groupBy(
        "item", "size", "h").agg(F.count("*").alias("n"))


def _windows(rows: DataFrame, own: DataFrame, k: int) -> DataFrame:
    """Rows (key, size, start, width, k): windows with enough shingles of items of their size."""
    known = broadcast_if_small(stored(own.select("h", "size").distinct(), "shingles"))
    # A place's run is hashed as it is met, so a text has no array of hashes beside its words.
    run = F.xxhash64("word", *(F.get("words", F.col("p") + i) for i in range(1, k)))
    placed = rows.select("key", F.size("words").alias("total"), "words", F.posexplode("words").alias("p", "word")).where(
        F.col("p") <= F.col("total") - k).select("key", "total", "p", run.alias("h"))
    anchors = placed.join(known, "h").groupBy("key", "size", "total").agg(F.sort_array(F.collect_set("p")).alias("ps"))
    # A window has ``runs`` shingles and needs ``most`` of them in common with ``size - k + 1`` of the item.
    sized = anchors.withColumn("width", F.least("size", "total")).withColumn("runs", F.col("width") - k + 1).withColumn(
        "need", F.ceil((F.col("runs") + F.col("size") - k + 1) * 3 / F.lit(7.0) - F.lit(1e-9)).cast("int")).where(
        "size(ps) >= need")
    # Starts with anchors i to i + need - 1 inside; ranges in order, without what the one before held.
    spans = sized.select("*", F.expr(
        "transform(filter(sequence(1, size(ps)), i -> i <= size(ps) - need + 1), i -> named_struct("
        "'low', greatest(0, try_element_at(ps, i + need - 1) - runs + 1, coalesce(try_element_at(ps, if(i > 1, i - 1, null)) + 1, 0)), "
        "'high', least(try_element_at(ps, i), total - width)))").alias("spans"))
    return spans.select("key", "size", "width", F.explode("spans").alias("span")).where("span.low <= span.high").select(
        "key", "size", F.explode(F.sequence("span.low", "span.high")).alias("start"), "width", F.lit(k).alias("k")).distinct()


def _near(windows: DataFrame, texts: DataFrame, items: DataFrame) -> DataFrame:
    """Pairs (key, start, width, k, item) of fingerprints within the radius."""
    said = windows.join(texts.select("key", "first", "words"), "key").select(
        "key", "size", "start", "width", "k", F.expr("slice(words, start - first + 1, width)").alias("words"))
    prints = _fingerprints(said, ["key", "size", "start", "width", "k"])
    own = _fingerprints(items, ["item", "size"])
    blocks = F.explode(F.sequence(F.lit(0), F.lit(BLOCKS - 1))).alias("j")
    filed = own.select("*", blocks).withColumn("mask", F.explode(F.lit(_masks()))).select(
        "item", "size", F.col("fp").alias("item_fp"), "j", _block("fp", F.col("j")).bitwiseXOR(F.col("mask")).alias("block"))
    filed = broadcast_if_small(stored(filed, "filed"))
    asked = prints.select("*", blocks).withColumn("block", _block("fp", F.col("j")))
    return asked.join(filed, ["size", "j", "block"]).where(
        F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp"))) <= RADIUS).select(
        "key", "start", "width", "k", "item").distinct()


def _verified(near: DataFrame, texts: DataFrame, items: DataFrame, parts: list[DataFrame]) -> DataFrame:
    """The best window of each text and item by exact similarity; a pair is compared inside its row."""
    own = reduce(DataFrame.union, parts).groupBy("item").agg(
        F.collect_list("h").alias("due"), F.collect_list(F.when(F.col("n") > 1, F.struct("h", "n"))).alias("repeated"))
    windows = near.select("key", "start", "width", "item").join(texts, "key").select(
        "doc_id", "key", "start", "width", "item", F.expr("slice(words, start - first + 1, width)").alias("window"))
    pairs = windows.join(items.select("item", "item_id", "size", "k").join(own, "item"), "item")
    said = with_once(pairs, "said", F.expr("transform(sequence(1, width - k + 1), i -> xxhash64(slice(window, i, k)))"))
    # A run counts once for both sides, and as often again as the side with fewer of it has it further.
    counted = with_once(said, "common", F.expr(
        "aggregate(repeated, size(array_intersect(said, due)), "
        "(c, r) -> c + greatest(0, cast(least(r.n, size(said) - size(array_remove(said, r.h))) as int) - 1))"))
    every = F.col("width") - F.col("k") + 1 + F.col("size") - F.col("k") + 1
    full = counted.withColumn("similarity", F.col("common") / (every - F.col("common"))).where(F.col("similarity") >= LEAST)
    best = full.groupBy("doc_id", "key", "item_id").agg(F.max(F.struct(
        "similarity", (-F.col("start")).alias("at"), "width")).alias("best"))
    return best.select("doc_id", "item_id", "best.similarity", (-F.col("best.at")).cast("long").alias("start_word"),
                       F.col("best.width").cast("long").alias("n_words"), F.col("key").alias("text_key"))
