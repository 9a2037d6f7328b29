"""Bigram language model as an Elias-Fano trie in mapped files of the shared folder."""

from __future__ import annotations

import functools
import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from signalgrid.llm.common import by_runs, crc32_of, file_system, lean, local_path
from signalgrid.llm.elias_fano import Sequence, encode
from signalgrid.llm.words import U, blocks
from signalgrid.session import remove_at_exit, work_folder

DISCOUNT = 0.75
LEAST_COUNT = 2
PAIRS_A_SHARD = 2_000_000
TOKENS_AT_ONCE = 1_000_000
STEP = 1 / 4_096
# Word keys are cut to 62 bits, the most that a coded sequence holds with its sums.
KEY_BITS = 62
END = U(0x0E4D)  # the key of the end token; a word's key equals it once in 2**62


@dataclass(frozen=True)
class Model:
    """Where a trie lies and its totals: all a task needs to open it.

    ``words`` and ``pairs`` name the files of the levels' shards; words are sharded by the top bits
    of their key, pairs by their first word's number. ``firsts`` are the numbers of the shards'
    first words.
    """

    folder: str
    words: tuple[str, ...]
    firsts: tuple[int, ...]
    pairs: tuple[str, ...]
    tokens: int
    vocabulary: int
    documents: int

    @property
    def begin(self) -> int:
        """The number of the begin mark, a context that is no word."""
        return self.vocabulary


def _mapped(folder: str, name: str) -> np.ndarray:
    path = local_path(f"{folder}/{name}")
    if path.startswith("/"):
        return np.memmap(path, U, "r")
    store, path = file_system(f"{folder}/{name}")
    with store.open_input_file(path) as source:  # a store that cannot be mapped
        return np.frombuffer(source.read(), U)


def _write(folder: str, parts: list[np.ndarray]) -> str:
    """A new file of the shared folder; one whose task fails is in no model."""
    store, path = file_system(folder)
    store.create_dir(path, recursive=True)
    name = f"{uuid.uuid4().hex}.ef"
    with store.open_output_stream(f"{path}/{name}", compression=None) as out:
        for part in parts:
            out.write(part.astype(U, copy=False).tobytes())
    return name


def _quantised(x: np.ndarray) -> np.ndarray:
    """Values of at least 0 in steps of 1/4096, four to a word."""
    steps = np.minimum(np.rint(x / STEP), 65_535).astype(np.uint16)
    out = np.zeros(-(-len(steps) // 4) * 4, np.uint16)
    out[:len(steps)] = steps
    return out.view(U)


class WordLevel:
    """Keys in order, and the running sum of their training counts."""

    def __init__(self, words: np.ndarray):
        self.keys = Sequence(words)
        self.sums = Sequence(words[self.keys.size:])

    def counts(self, i: np.ndarray) -> np.ndarray:
        return (self.sums.at(i + 1) - self.sums.at(i)).astype(np.int64)


class PairLevel:
    """Contexts in order, pointers to their successors, and the successors in one sequence.

    Within a context successors are stored relative to the last value of the context before,
    which makes the whole sequence monotone.
    """

    def __init__(self, words: np.ndarray):
        at, parts = 0, []
        for _ in range(3):
            parts.append(Sequence(words[at:]))
            at += parts[-1].size
        self.contexts, self.pointers, self.successors = parts
        quarter = -(-self.contexts.n // 4)
        self.back = words[at:at + quarter].view(np.uint16)
        self.gain = words[at + quarter:].view(np.uint16)

    def look(self, context: np.ndarray, word: np.ndarray) -> np.ndarray:
        """log10 of what each pair adds to the probability of its word alone."""
        out = np.zeros(len(context))
        at, known = self.contexts.successor(context)
        if not known.any():
            return out
        at, word = at[known], word[known]
        first, last = (self.pointers.at(at + k).astype(np.int64) for k in (0, 1))
        base = np.where(first > 0, self.successors.at(np.maximum(first - 1, 0)), U(0))
        place, hit = self.successors.successor(base + word.astype(U), first, last)
        value = -self.back[at].astype(np.float64)
        value[hit] += self.gain[place[hit]]
        out[known] = value * STEP
        return out


class Reader:
    """The levels of a model in one Python worker; files are mapped when first needed."""

    def __init__(self, model: Model):
        self.model = model
        self.levels = [WordLevel(_mapped(model.folder, f)) for f in model.words]
        self.firsts = np.array(model.firsts, np.int64)
        self.shift = U(KEY_BITS - max(0, (len(model.words) - 1).bit_length()))
        self.pair_levels: dict[int, PairLevel] = {}

    def words(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers and training counts of sorted keys; -1 and 0 for unknown ones."""
        number, count = np.full(len(keys), -1, np.int64), np.zeros(len(keys), np.int64)
        cuts = np.searchsorted(keys >> self.shift, np.arange(len(self.levels) + 1, dtype=U))
        for k, level in enumerate(self.levels):
            a, b = cuts[k], cuts[k + 1]
            if a < b and level.keys.n:
                at, hit = level.keys.successor(keys[a:b])
                number[a:b][hit] = at[hit] + self.firsts[k]
                count[a:b][hit] = level.counts(at[hit])
        return number, count

    def counts(self, numbers: np.ndarray) -> np.ndarray:
        """Training counts by number; that of the begin mark is the number of documents."""
        out = np.full(len(numbers), self.model.documents, np.int64)
        shard = np.searchsorted(self.firsts, numbers, "right") - 1
        shard[numbers >= self.model.vocabulary] = -1
        for k in np.unique(shard[shard >= 0]):
            own = shard == k
            out[own] = self.levels[k].counts(numbers[own] - self.firsts[k])
        return out

    def log_word(self, counts: np.ndarray) -> np.ndarray:
        return np.log10((counts + 1) / (self.model.tokens + self.model.vocabulary + 1))

    def log_pairs(self, context: np.ndarray, word: np.ndarray) -> np.ndarray:
        out = np.zeros(len(context))
        n = len(self.model.pairs)
        if not n:
            return out
        shard = np.where(context >= 0, context % n, n).astype(np.uint32)
        order = np.argsort(shard, kind="stable")
        cuts = np.searchsorted(shard[order], np.arange(n + 1))
        for k in range(n):
            own = order[cuts[k]:cuts[k + 1]]
            if len(own) and self.model.pairs[k]:
                if k not in self.pair_levels:
                    self.pair_levels[k] = PairLevel(_mapped(self.model.folder, self.model.pairs[k]))
                out[own] = self.pair_levels[k].look(context[own] // n, np.maximum(word[own], 0))
                # An unknown word takes the context's share alone, as a word that never follows does.
                odd = own[word[own] < 0]
                if len(odd):
                    out[odd] = self.pair_levels[k].look(context[odd] // n, np.full(len(odd), self.model.vocabulary))
        return out


@functools.lru_cache(maxsize=2)
def reader(model: Model) -> Reader:
    return Reader(model)


def token_blocks(texts: pa.Array, most: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Rows first to last, their tokens with an end each, and where each document begins."""
    for block in blocks(texts, most=most):
        n = block.last - block.first
        starts = block.starts + np.arange(n + 1)
        tokens = np.full(starts[-1], END)
        inner = np.ones(len(tokens), bool)
        inner[starts[1:] - 1] = False
        tokens[inner] = block.keys >> U(64 - KEY_BITS)
        yield block.first, block.last, tokens, starts


def _rows(folders: list[int], blobs: list[list[np.ndarray]], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(folders, pa.int32()), *(pa.array([b.tobytes() for b in c], pa.binary()) for c in blobs)], names=names)


def _gathered(shard: np.ndarray, keys: np.ndarray, counts: np.ndarray, most: int) -> Iterator[pa.RecordBatch]:
    """Sorted keys with counts as one row for each shard (and each ``most`` keys of it)."""
    order = np.argsort(shard, kind="stable")
    shard, keys, counts = shard[order], keys[order], counts[order]
    out = []
    cuts = np.flatnonzero(np.diff(shard)) + 1
    for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(keys)]):
        for i in range(a, b, most):
            j = min(i + most, b)
            out.append((int(shard[a]), keys[i:j], counts[i:j].astype(np.uint32)))
    if len(keys):
        ids, k, c = zip(*out)
        yield _rows(list(ids), [list(k), list(c)], ["shard", "keys", "counts"])


def _summed(run: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    keys = np.concatenate([np.frombuffer(x.as_py(), U) for x in run["keys"]])
    counts = np.concatenate([np.frombuffer(x.as_py(), np.uint32) for x in run["counts"]])
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    return keys[first], np.add.reduceat(counts[order].astype(np.int64), first)


GATHERED = "shard int, keys binary, counts binary"


def train(texts: DataFrame, discount: float = DISCOUNT, least: int = LEAST_COUNT) -> Model:
    """Fit on the ``text`` column of all rows.

    A word's probability is (c + 1) / (N + V + 1). A pair seen at least ``least`` times adds
    (c(vw) - discount) / c(v); the context's remaining share goes to the words as they are
    alone. So probabilities of a context sum to one, unknown words counting as one word.

    Tasks count their own tokens, then tokens pairs, and send a sorted array to each shard; a shard
    adds them up and writes its files. Word counts are exact. The driver sees one row a shard.
    """
    spark = texts.sparkSession
    folder = work_folder(spark, "model")
    remove_at_exit(spark, folder)
    rows = texts.select("text")
    shards = 1 << max(0, (max(1, rows.rdd.getNumPartitions()) - 1).bit_length())
    shift = U(KEY_BITS - (shards - 1).bit_length())

    @lean
    def count_words(batches):
        held, size = [], 0

        def flush():
            keys, counts = np.unique(np.concatenate(held), return_counts=True)
            yield from _gathered((keys >> shift).astype(np.int32), keys, counts, TOKENS_AT_ONCE)

        for batch in batches:
            for _, _, tokens, _ in token_blocks(batch["text"], 4 * TOKENS_AT_ONCE):
                held.append(tokens)
                size += len(tokens)
                if size >= TOKENS_AT_ONCE:
                    yield from flush()
                    held, size = [], 0
        if held:
            yield from flush()

    def build_words(run):
        keys, counts = _summed(run)
        name = _write(folder, [encode(keys), encode(np.r_[0, np.cumsum(counts)])])
        return pa.RecordBatch.from_pydict({
            "shard": pa.array([run["shard"][0].as_py()], pa.int32()), "file": [name],
            "n": pa.array([len(keys)], pa.int64()), "total": pa.array([int(counts.sum())], pa.int64())})

    built = {r["shard"]: r for r in by_runs(
        rows.mapInArrow(count_words, GATHERED), ["shard"], build_words,
        "shard int, file string, n long, total long").collect()}
    missing = [k for k in range(shards) if k not in built]
    nothing = np.zeros(0, U)
    empty = _write(folder, [encode(nothing), encode(np.zeros(1, U))]) if missing else ""
    files = tuple(built[k]["file"] if k in built else empty for k in range(shards))
    sizes = [built[k]["n"] if k in built else 0 for k in range(shards)]
    tokens = sum(r["total"] for r in built.values())
    firsts = tuple(int(x) for x in np.cumsum([0, *sizes[:-1]]))
    documents = rows.count()
    level = Model(folder, files, firsts, (), tokens, sum(sizes), documents)
    if level.vocabulary >= 1 << 32:
        raise ValueError("pairs hold word numbers of 32 bits")
    parts = max(1, math.ceil(tokens / PAIRS_A_SHARD))

    @lean
    def count_pairs(batches):
        own = reader(level)
        held, size = [], 0

        def flush():
            pairs, counts = np.unique(np.concatenate(held), return_counts=True)
            context = pairs >> U(32)
            yield from _gathered((context % U(parts)).astype(np.int32), pairs, counts, TOKENS_AT_ONCE)

        for batch in batches:
            for _, _, keys, starts in token_blocks(batch["text"], 4 * TOKENS_AT_ONCE):
                word, context = _numbered(own, keys, starts)[:2]
                held.append(context.astype(U) << U(32) | word.astype(U))
                size += len(keys)
                if size >= TOKENS_AT_ONCE:
                    yield from flush()
                    held, size = [], 0
        if held:
            yield from flush()

    def build_pairs(run):
        pairs, counts = _summed(run)
        kept = counts >= least
        pairs, counts = pairs[kept], counts[kept]
        name = ""
        if len(pairs):
            name = _write(folder, _pair_files(reader(level), pairs, counts, parts, discount))
        return pa.RecordBatch.from_pydict({"shard": pa.array([run["shard"][0].as_py()], pa.int32()), "file": [name]})

    second = {r["shard"]: r["file"] for r in by_runs(
        rows.mapInArrow(count_pairs, GATHERED), ["shard"], build_pairs, "shard int, file string").collect()}
    return Model(folder, files, firsts, tuple(second.get(k, "") for k in range(parts)), tokens, sum(sizes), documents)


def _pair_files(own: Reader, pairs: np.ndarray, counts: np.ndarray, parts: int, discount: float) -> list[np.ndarray]:
    """The second level's sequences and quantised logs for the sorted pairs of a shard."""
    context, word = pairs >> U(32), pairs & U(0xFFFFFFFF)
    first = np.flatnonzero(np.r_[True, context[1:] != context[:-1]])
    pointers = np.r_[first, len(pairs)]
    total = own.counts(context[first].astype(np.int64)).astype(np.float64)
    size = np.diff(pointers)
    share = (counts - discount) / np.repeat(total, size)
    back = np.maximum(1 - np.add.reduceat(share, first), 1e-9)
    alone = 10 ** own.log_word(own.counts(word.astype(np.int64)))
    gain = np.log10(1 + share / (np.repeat(back, size) * alone))
    # Each context's successors begin at the last value of the one before.
    tops = np.r_[U(0), np.cumsum(word[pointers[1:] - 1])[:-1]].astype(U)
    return [encode(context[first] // U(parts)), encode(pointers), encode(word + np.repeat(tops, size)),
            _quantised(-np.log10(back)), _quantised(gain)]


def _numbered(own: Reader, keys: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each token's number, that of its context, and its training count."""
    order = np.argsort(keys)
    ordered = keys[order]
    new = np.r_[True, ordered[1:] != ordered[:-1]][:len(keys)]
    number, count = own.words(ordered[new])
    place = np.empty(len(keys), np.int64)
    place[order] = np.cumsum(new) - 1
    word, count = number[place], count[place]
    context = np.r_[np.int64(-1), word[:-1]][:len(keys)]
    context[starts[:-1]] = own.model.begin
    return word, context, count


SCORES = "n_tokens long, n_known long, train_tokens long, base_score double, score double"


def score(documents: DataFrame, model: Model) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score and score of each text; no shuffle.

    Tokens are the words and one end. The base is the sum of their add-one logs; the score adds
    what the pairs change. Tasks look words and pairs up in the mapped files.
    """
    rows = documents.select(F.col("doc_id").cast("long"), "text")

    @lean
    def task(batches):
        own = reader(model)
        for batch in batches:
            for first, last, keys, starts in token_blocks(batch["text"], 4 * TOKENS_AT_ONCE):
                word, context, count = _numbered(own, keys, starts)
                alone, pair = own.log_word(count), own.log_pairs(context, word)
                base = np.add.reduceat(alone, starts[:-1])
                n = last - first
                yield pa.RecordBatch.from_arrays(
                    [batch["doc_id"].slice(first, n), pa.array(np.diff(starts).astype(np.int64)),
                     pa.array(np.add.reduceat((count > 0).astype(np.int64), starts[:-1])),
                     pa.array(np.full(n, model.tokens, np.int64)), pa.array(base),
                     pa.array(base + np.add.reduceat(pair, starts[:-1]))],
                    names=["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return rows.mapInArrow(task, "doc_id long, " + SCORES)


def scored(documents: DataFrame, least: int = LEAST_COUNT) -> DataFrame:
    """Train on the documents whose crc32(doc_id) mod 7 is not 2 and score all whole texts.

    Pairs seen at least ``least`` times are in the model; 1 keeps all.

    Null text is empty and has the end token alone; a null doc_id is not held out; repeated rows
    count and are scored one by one; other columns are ignored. Without training rows
    every log is that of one, 0.
    """
    out = F.coalesce(F.pmod(crc32_of("doc_id"), F.lit(7)) == 2, F.lit(False))
    model = train(documents.where(~out), least=least)
    return score(documents, model).select("doc_id", out.alias("held_out"), *(c.split()[0] for c in SCORES.split(", ")))
