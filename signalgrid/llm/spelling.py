"""Grouping of spelling variants: one edit apart, found by scans of sorted word lists."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from signalgrid.llm.common import broadcast_if_small, lean, stored

LEAST_LENGTH, LEAST_COUNT = 7, 2
DROP_EVERY = 31
FORM_FACTOR = 10
# Letters that a run consists of; only A to Z are lower-cased.
LETTERS = r"A-Za-zÀ-ÿ"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
# Words of a group, and cells of a block, that a task holds at once. A larger group is split by
# where the edit lies, so no pair is lost; a group whose place is known holds a word per letter.
GROUP_WORDS, GROUP_CELLS = 4096, 2_000_000
SMALLEST_LIMIT = 256
BLOCK_CELLS = 500_000

KEYS = ["length", "low", "high", "head", "tail"]
LINKS = "word string, n_near long, near_n long, near string"


def vocabulary(documents: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT,
               drop_every: int = DROP_EVERY) -> DataFrame:
    """Words (word, n) of at least that length and count, with some letters dropped.

    If crc32 of ``doc_id:run`` is h and ``drop_every`` divides h, the letter h % length of the run goes.
    Shorter runs cannot become words, as letters are only dropped.
    """
    runs = documents.select(F.coalesce(F.col("doc_id").cast("long").cast("string"), F.lit("")).alias("id"), F.explode(
        F.regexp_extract_all("text", F.lit(f"([{LETTERS}]{{{least_length},}})"), F.lit(1))).alias("run"))
    lower = F.when(F.col("run").rlike("[A-Z]"), F.translate("run", UPPER, UPPER.lower())).otherwise(F.col("run"))
    drawn = runs.select(F.col("id"), lower.alias("run"))
    drawn = drawn.select("run", F.crc32(F.concat("id", F.lit(":"), "run")).alias("h"))
    at = (F.col("h") % F.char_length("run")).cast("int")
    shorter = F.concat(F.substr("run", F.lit(1), at), F.substr(F.col("run"), at + 2))
    word = F.when(F.col("h") % drop_every == 0, shorter).otherwise(F.col("run"))
    words = drawn.select(word.alias("word")).where(F.char_length("word") >= least_length)
    return words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_count)


def _windows(words: DataFrame) -> DataFrame:
    """Each word with both halves in which an edit may lie, for pairs whose longer word has ``length`` letters."""
    size = F.char_length("word")
    cases = F.array(*[F.struct(length.alias("length"), low.cast("int").alias("low"), high.cast("int").alias("high"))
                      for length in (size, size + 1)
                      for half in ((length / 2).cast("int"),)
                      for low, high in ((F.lit(0), half), (half, length))])
    return _keyed(words.select("word", "n", F.explode(cases).alias("case")).select("word", "n", "case.*"))


def _keyed(rows: DataFrame) -> DataFrame:
    """Letters before and after the window, which near words share, and those in it."""
    word, after = F.col("word"), F.col("length") - F.col("high")
    size = F.char_length("word")
    return rows.select(
        "length", "low", "high", F.substr(word, F.lit(1), F.col("low")).alias("head"),
        F.substr(word, size - after + 1).alias("tail"),
        F.substr(word, F.col("low") + 1, size - after - F.col("low")).alias("middle"), "word", "n")


def _halved(rows: DataFrame) -> DataFrame:
    half = ((F.col("low") + F.col("high")) / 2).cast("int")
    cases = F.array(F.struct(F.col("low").alias("low"), half.alias("high")), F.struct(half.alias("low"), F.col("high").alias("high")))
    cut = rows.select("word", "n", "length", F.explode(cases).alias("case"))
    return _keyed(cut.select("word", "n", "length", "case.*"))


def _letters(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts in a row, and where each begins."""
    at = np.zeros(len(texts) + 1, np.int64)
    np.cumsum(pc.utf8_length(texts).to_numpy(zero_copy_only=False), out=at[1:])
    return np.frombuffer("".join(texts.to_pylist()).encode("utf-32-le"), np.uint32), at


def near_in_groups(group: np.ndarray, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Ordered pairs (i, j) of one group that are exactly one edit apart.

    Rows are sorted by group and text, and differ. A list is scanned for all its texts at once, one
    letter deeper at a time: texts with a common prefix are neighbours, and the edit matrix's row for
    that prefix, three cells wide, is worked out once for all of them. A range whose row is beyond one edit
    everywhere is left out with all that it holds.
    """
    rows = len(group)
    letters, at = _letters(texts)
    size = np.diff(at)
    letters = np.append(letters, np.uint32(0))
    opens = np.ones(rows, bool)
    opens[1:] = group[1:] != group[:-1]
    # Nodes of one depth are ranges of rows with a common prefix; first a range is a whole group.
    starts = np.append(np.flatnonzero(opens), rows)
    query = np.arange(rows)
    low, high = starts[np.cumsum(opens) - 1], starts[np.cumsum(opens)]
    keep = high - low > 1
    query, low, high = query[keep], low[keep], high[keep]
    two = np.uint8(2)
    # Cells of the row at columns depth - 1, depth and depth + 1.
    cells = np.empty((len(query), 3), np.uint8)
    cells[:] = (2, 0, 1)
    cells[size[query] < 1, 2] = two
    found_i, found_j = [], []
    depth = 0
    while len(query):
        # The first row of a range ends here if the prefix is all of it.
        ends = size[low] == depth
        k = size[query] - depth + 1
        hit = ends & (k >= 0) & (k <= 2)
        hit[hit] = cells[hit, k[hit]] == 1
        found_i.append(query[hit])
        found_j.append(low[hit])
        low = low + ends
        keep = low < high
        query, low, high, cells = query[keep], low[keep], high[keep], cells[keep]
        if not len(query):
            break
        # Next letters: a range falls apart where the letter at this depth changes.
        letter = np.where(size > depth, letters[np.minimum(at[:-1] + depth, len(letters) - 1)], 0)
        opens[1:] |= letter[1:] != letter[:-1]
        node = np.cumsum(opens) - 1
        starts = np.append(np.flatnonzero(opens), rows)
        children = node[high - 1] - node[low] + 1
        parent = np.repeat(np.arange(len(query)), children)
        child = np.arange(len(parent)) - np.repeat(np.cumsum(children) - children, children) + node[low][parent]
        query, cells = query[parent], cells[parent]
        low, high = np.maximum(starts[child], low[parent]), np.minimum(starts[child + 1], high[parent])
        # One row further: letters of the query at columns depth, depth + 1 and depth + 2, from 1.
        own, mine = letter[low], at[query]
        length = size[query]

        def differs(j: int) -> np.ndarray:
            inside = (j >= 0) & (j < length)
            return ~(inside & (letters[np.where(inside, mine + j, 0)] == own))

        left = np.minimum(cells[:, 0] + differs(depth - 1), cells[:, 1] + 1)
        same = np.minimum(np.minimum(cells[:, 1] + differs(depth), cells[:, 2] + 1), left + 1)
        right = np.minimum(cells[:, 2] + differs(depth + 1), same + 1)
        depth += 1
        cells = np.minimum(np.stack((left, same, right), 1), two).astype(np.uint8)
        for k in range(3):
            beyond = (length < depth - 1 + k) | (depth - 1 + k < 0)
            cells[beyond, k] = two
        keep = cells.min(1) <= 1
        query, low, high, cells = query[keep], low[keep], high[keep], cells[keep]
    return np.concatenate(found_i or [query]), np.concatenate(found_j or [query])


def _shared(a: str, b: str) -> int:
    for i, (x, y) in enumerate(zip(a, b)):
        if x != y:
            return i
    return min(len(a), len(b))


def links_of(block: pa.Table, group: np.ndarray) -> pa.RecordBatch | None:
    """Per word of a block of whole groups: its near words there, their number and the best one."""
    a, b = near_in_groups(group, block["middle"].combine_chunks())
    if not len(a):
        return None
    length = block["length"].to_numpy()
    size = pc.utf8_length(block["word"]).to_numpy()
    low, high = block["low"].to_numpy(), block["high"].to_numpy()
    longest = np.maximum(size[a], size[b]) == length[a]
    a, b = a[longest], b[longest]
    words = block["word"].to_pylist()
    # A pair belongs to the window in which its words first differ.
    first = np.fromiter((_shared(words[i], words[j]) for i, j in zip(a.tolist(), b.tolist())), np.int64, len(a))
    mine = (first >= low[a]) & (first < high[a])
    a, b = a[mine], b[mine]
    if not len(a):
        return None
    n = block["n"].to_numpy()
    rank = np.empty(len(words), np.int64)
    rank[pc.sort_indices(block["word"]).to_numpy()] = np.arange(len(words))
    order = np.lexsort((rank[b], -n[b], a))
    a, b = a[order], b[order]
    new = np.flatnonzero(np.r_[True, a[1:] != a[:-1]])
    return pa.record_batch([
        block["word"].combine_chunks().take(pa.array(a[new])), pa.array(np.diff(np.r_[new, len(a)])),
        pa.array(n[b[new]]), block["word"].combine_chunks().take(pa.array(b[new])),
    ], ["word", "n_near", "near_n", "near"])


def _blocks(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Blocks of whole groups of one length, from rows sorted by the keys."""
    held: list[pa.Table] = []
    cells = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(pa.Table.from_batches([batch]))
        cells += pc.sum(pc.utf8_length(batch["word"])).as_py()
        if cells >= BLOCK_CELLS:
            rows = pa.concat_tables(held)
            new = _begins(rows)
            last = int(np.flatnonzero(new)[-1])
            if last:
                yield from _by_length(rows.slice(0, last), new[:last])
            held = [rows.slice(last)]
            cells = pc.sum(pc.utf8_length(held[0]["word"])).as_py()
    if held:
        rows = pa.concat_tables(held)
        yield from _by_length(rows, _begins(rows))


def _begins(rows: pa.Table) -> np.ndarray:
    new = np.ones(rows.num_rows, bool)
    new[1:] = False
    for key in KEYS:
        column = rows[key].combine_chunks()
        new[1:] |= np.asarray(pc.not_equal(column[1:], column[:-1]))
    return new


def _by_length(rows: pa.Table, new: np.ndarray) -> Iterator[tuple[pa.Table, np.ndarray]]:
    length = rows["length"].to_numpy()
    cuts = [0, *(np.flatnonzero(length[1:] != length[:-1]) + 1).tolist(), rows.num_rows]
    group = np.cumsum(new)
    for a, b in zip(cuts, cuts[1:]):
        yield rows.slice(a, b - a), group[a:b]


def near_words(words: DataFrame, group_words: int = GROUP_WORDS) -> DataFrame:
    """Words (word, n_near, near_n, near) that have near words, with partial counts and best ones.

    Near words are equal up to and after one place. So each word goes to the groups of words that
    agree with it outside the first half, and outside the second half, of a word of its length or
    one more. A group is a sorted list, and is scanned for the pairs in it. Groups of too many words are
    split again by the half of the half, until the place is known; nothing is capped. A word has one row
    a group at most.
    """
    @lean
    def task(batches):
        for block, group in _blocks(batches):
            out = links_of(block, group)
            if out is not None:
                yield out

    rows, found = _windows(words), None
    limit = F.greatest(F.lit(min(group_words, SMALLEST_LIMIT)), F.least(F.lit(group_words), F.lit(GROUP_CELLS) / F.col("length")))
    while True:
        splits = rows.where("high - low > 1").groupBy(*KEYS).count().where(F.col("count") > limit).select(*KEYS)
        busy = stored(splits, "busy")
        done = busy.isEmpty()
        now = rows if done else rows.join(broadcast_if_small(busy), KEYS, "left_anti")
        sorted_ = now.select(*KEYS, "middle", "word", "n").repartition(*KEYS).sortWithinPartitions(*KEYS, "middle")
        links = sorted_.mapInArrow(task, LINKS)
        found = links if found is None else found.unionByName(links)
        if done:
            return found
        rows = stored(_halved(rows.join(broadcast_if_small(busy), KEYS, "left_semi")), "halves")


def roots(forms: DataFrame) -> DataFrame:
    """Follow forms (word, form) to their ends, twice as far each round: rows (word, root).

    Counts grow by a factor with each form, so chains are short and without circles.
    """
    step = stored(forms.select("word", F.col("form").alias("root")), "forms")
    while True:
        above = step.select(F.col("word").alias("root"), F.col("root").alias("above"))
        further = stored(step.join(above, "root", "left").select(
            "word", F.coalesce("above", "root").alias("root"), F.col("above").isNotNull().alias("moved")), "forms")
        step = further.select("word", "root")
        if further.where("moved").isEmpty():
            return step


def spelling_variants(documents: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT,
                      drop_every: int = DROP_EVERY, factor: int = FORM_FACTOR, group_words: int = GROUP_WORDS) -> DataFrame:
    """Per word: word, n, n_near, form, form_n, root.

    Near words differ by exactly one inserted, deleted or replaced letter. A word's form is the most
    frequent near word, the first by code points among equals, if it is at least ``factor`` times as
    frequent. The root is where forms lead.

    Null texts have no words; a null doc_id counts as an empty one. Repeated rows count each time. Empty
    tables give no rows; other columns are ignored.
    """
    words = stored(vocabulary(documents, least_length, least_count, drop_every), "words")
    links = near_words(words, group_words)
    rows = words.select("word", "n", F.lit(0).cast("long").alias("n_near"), F.lit(None).cast("long").alias("near_n"),
                        F.lit(None).cast("string").alias("near")).unionByName(
        links.select("word", F.lit(None).cast("long").alias("n"), "n_near", "near_n", "near"))
    best = F.min(F.when(F.col("near").isNotNull(), F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("near"))))
    words = rows.groupBy("word").agg(F.max("n").alias("n"), F.sum("n_near").alias("n_near"), best.alias("best"))
    chosen = -F.col("best.less") >= factor * F.col("n")
    words = stored(words.select("word", "n", "n_near", F.when(chosen, F.col("best.near")).alias("form"),
                                F.when(chosen, -F.col("best.less")).alias("form_n")), "near")
    ends = roots(words.where("form IS NOT NULL"))
    led = words.where("form IS NOT NULL").join(ends, "word")
    alone = words.where("form IS NULL").withColumn("root", F.col("word"))
    return led.unionByName(alone).select("word", "form", "root", "n", "n_near", "form_n")
