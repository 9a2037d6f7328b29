"""Near-duplicate texts by banded MinHash, odd sketches and an exact check on whole shingle sets."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from signalgrid.llm.common import broadcast_if_small, by_runs, components, lean, modest_batches, stored
from signalgrid.llm.words import BASE, U, blocks, mix, shingles

WORDS = 5
PERCENT = 75
ROWS, BANDS = 5, 50
BITS = 1_024
# Pairs that the sketch puts below this similarity are not checked: five deviations under 0.75.
LEAST_ESTIMATE = 0.58
BLOCK = 2_048
BLOCK_SHINGLES = 2_000_000
PAIRS_AT_ONCE = 4_096
TEXTS_A_RUN = 64
SHINGLES_AT_ONCE = 512
ROWS_AT_ONCE = 256

_RNG = np.random.default_rng(91)
_FACTORS = _RNG.integers(0, 2**32, ROWS * BANDS, dtype=np.uint64).astype(np.uint32) | np.uint32(1)
_SHIFTS = _RNG.integers(0, 2**32, ROWS * BANDS, dtype=np.uint64).astype(np.uint32)
_SAMPLE = np.arange(ROWS * BANDS, dtype=np.uint64) << U(32)

SKETCH = "doc_id long, n_shingles long, class binary, bands array<long>, sketch array<long>"


def minhash(keys: np.ndarray) -> np.ndarray:
    """The smallest value of each of 250 hash functions over a set of shingle keys."""
    low = np.full(len(_FACTORS), 0xFFFFFFFF, np.uint32)
    x = (keys >> U(32)).astype(np.uint32)
    for i in range(0, len(x), SHINGLES_AT_ONCE):
        hashed = _FACTORS[:, None] * x[i:i + SHINGLES_AT_ONCE]
        hashed += _SHIFTS[:, None]
        np.minimum(low, hashed.min(axis=1), out=low)
    return low


def odd_sketches(samples: np.ndarray) -> np.ndarray:
    """Parity bitmaps of rows of MinHash samples: each (function, value) flips one of 1,024 bits."""
    out = np.zeros((len(samples), BITS // 64), U)
    for i in range(0, len(samples), ROWS_AT_ONCE):
        part = samples[i:i + ROWS_AT_ONCE]
        n = len(part)
        bit = (mix(part.astype(U) + _SAMPLE) % U(BITS)).astype(np.int64) + np.arange(n)[:, None] * BITS
        odd = np.bincount(bit.ravel(), minlength=n * BITS).reshape(n, BITS) & 1
        out[i:i + n] = np.packbits(odd.astype(np.uint8), axis=1, bitorder="little").view(U)
    return out


def most_differing(least: float = LEAST_ESTIMATE) -> int:
    """The largest number of differing bits whose estimate still reaches ``least``.

    Two sketches differ in d bits when about -n/2 ln(1 - 2d/n) samples differ on either side,
    and that is 2k(1 - J) of k samples each.
    """
    return math.floor(BITS / 2 * (1 - math.exp(-2 * 2 * ROWS * BANDS * (1 - least) / BITS)))


def sketches(documents: DataFrame) -> DataFrame:
    """For each document the size and digest of its shingle set, its band keys and odd sketch."""
    modest_batches(documents.sparkSession)
    rows = documents.select(F.col("doc_id").cast("long"), "text")
    kinds = (pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64()))

    @lean
    def task(batches):
        for batch in batches:
            for block in blocks(batch["text"]):
                sizes, digests, samples = [], [], np.zeros((block.last - block.first, ROWS * BANDS), np.uint32)
                for i, keys in block.documents():
                    own = np.unique(shingles(keys, WORDS))
                    sizes.append(len(own))
                    digests.append(hashlib.blake2b(own.tobytes(), digest_size=16).digest() if len(own) else None)
                    samples[i - block.first] = minhash(own)
                keys = np.arange(BANDS, dtype=U) + U(1)
                keys = np.broadcast_to(keys, (len(samples), BANDS))
                for r in range(ROWS):
                    keys = mix(keys * BASE + samples[:, r::ROWS])
                full = np.array(sizes, bool)
                made = [pa.ListArray.from_arrays(
                    pa.array(np.arange(len(full) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.view(np.int64).ravel()))
                    for x in (np.ascontiguousarray(keys), odd_sketches(samples))]
                empty = pa.array([None] * len(full), pa.list_(pa.int64()))
                made = [pa.compute.if_else(pa.array(full), x, empty) for x in made]
                yield pa.RecordBatch.from_arrays(
                    [batch["doc_id"].slice(block.first, len(full)), pa.array(sizes, kinds[1]),
                     pa.array(digests, kinds[2]), *made],
                    names=["doc_id", "n_shingles", "class", "bands", "sketch"])

    return rows.mapInArrow(task, SKETCH)


def _alike(a: str, b: str) -> Column:
    """Whether sizes and sketches of two joined rows allow the similarity."""
    differing = F.aggregate(
        F.zip_with(f"{a}sketch", f"{b}sketch", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    low, high = F.least(f"{a}n", f"{b}n"), F.greatest(f"{a}n", f"{b}n")
    return (low * 100 >= high * PERCENT) & (differing <= most_differing())


def _plausible(pairs: DataFrame, reps: DataFrame) -> DataFrame:
    for side in ("a", "b"):
        own = reps.select(F.col("rep").alias(side), F.col("n").alias(f"{side}_n"), F.col("sketch").alias(f"{side}_sketch"))
        pairs = pairs.join(own, side)
    return pairs.where(_alike("a_", "b_")).select("a", "b")


def _confirmed(pairs: DataFrame, documents: DataFrame) -> DataFrame:
    """The pairs (a, b) whose whole shingle sets are similar enough; texts of an ``a`` come in runs."""
    many = pairs.groupBy("a").agg(F.ceil(F.count("*") / TEXTS_A_RUN).alias("runs"))
    dealt = pairs.join(many, "a").select(
        "a", F.pmod(F.xxhash64("b"), F.col("runs")).alias("run"), F.col("b").alias("doc_id"), F.lit(1).alias("side"))
    heads = dealt.select("a", "run", F.col("a").alias("doc_id"), F.lit(0).alias("side")).distinct()
    asked = dealt.union(heads)
    wanted = broadcast_if_small(stored(asked.select("doc_id").distinct(), "wanted"))
    texts = documents.select(F.col("doc_id").cast("long"), "text").join(wanted, "doc_id", "left_semi")
    full = asked.join(texts, "doc_id")

    def work(run: pa.Table) -> pa.RecordBatch | None:
        side, ids = run["side"].to_pylist(), run["doc_id"].to_pylist()
        sets = [np.unique(shingles(keys, WORDS)) for block in blocks(run["text"]) for _, keys in block.documents()]
        heads = [s for s, k in zip(sets, side) if k == 0]
        found = set()
        for s, k, i in zip(sets, side, ids):
            if k == 1 and any(_similar(h, s) for h in heads):
                found.add(i)
        a = run["a"][0].as_py()
        return pa.RecordBatch.from_pydict(
            {"a": pa.array([a] * len(found), pa.int64()), "b": pa.array(sorted(found), pa.int64())})

    return by_runs(full, ["a", "run"], work, "a long, b long")


def _similar(a: np.ndarray, b: np.ndarray) -> bool:
    if min(len(a), len(b)) * 100 < max(len(a), len(b)) * PERCENT:
        return False
    both = np.concatenate((a, b))
    both.sort()
    common = int((both[1:] == both[:-1]).sum())
    return common * 100 >= (len(a) + len(b) - common) * PERCENT


class _Group:
    """Members of one bucket, in the order of a run, and which pairs of them may be similar."""

    def __init__(self, run: pa.Table):
        self.rep, self.hub, self.part, self.n, self.own = (
            run[c].to_numpy() for c in ("rep", "hub", "component", "n", "own"))
        wide = (run[c].combine_chunks().flatten().to_numpy().reshape(run.num_rows, -1) for c in ("sketch", "bands"))
        self.bits, self.bands = (x.view(U) for x in wide)
        self.key = run["key"][0].as_py()
        self.across = run["i"][0].as_py() != run["j"][0].as_py()

    def near(self, x: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows behind x that x may be similar to, with the number of differing bits.

        A pair belongs to the first bucket that it shares, so that it is looked at once. Pairs with the hub
        were checked before, pairs of one component are connected already.
        """
        y = np.arange(x + 1, len(self.rep))
        if self.rep[x] == self.hub[x]:
            return y[:0], y[:0]
        ok = (self.part[y] != self.part[x]) & (self.rep[y] != self.hub[y])
        ok &= np.minimum(self.n[y], self.n[x]) * 100 >= np.maximum(self.n[y], self.n[x]) * PERCENT
        if self.across:
            ok &= self.own[y] != self.own[x]
        y = y[ok]
        differing = np.bitwise_count(self.bits[y] ^ self.bits[x]).sum(axis=1, dtype=np.int64)
        close = differing <= most_differing()
        y, differing = y[close], differing[close]
        first = (self.bands[y] == self.bands[x]).argmax(axis=1) if len(y) else y
        mine = self.bands[x][first].view(np.int64) == self.key
        return y[mine], differing[mine]


_MEMBER = "key long, i int, j int, own int, rep long, hub long, component long, n long, sketch array<long>, bands array<long>"


def _involved(mixed: DataFrame) -> DataFrame:
    """Members of buckets, in groups of two blocks, that may be similar to one of another component.

    ``mixed`` has key, rep, hub, component, n, sketch and bands. Blocks hold about 2,048 rows or
    2,000,000 shingles.
    """
    size = mixed.groupBy("key").agg(F.greatest(
        F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
    own = mixed.join(size, "key").withColumn("own", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    dealt = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "rep", "hub",
        "component", "n", "sketch", "bands")

    def work(run: pa.Table) -> pa.RecordBatch | None:
        if run.num_rows < 2:
            return None
        group, seen = _Group(run), np.zeros(run.num_rows, bool)
        for x in range(run.num_rows - 1):
            y, _ = group.near(x)
            if len(y):
                seen[x] = seen[y] = True
        if not seen.any():
            return None
        return run.filter(pa.array(seen)).select([c.split()[0] for c in _MEMBER.split(", ")]).combine_chunks().to_batches()[0]

    return by_runs(dealt, ["key", "i", "j"], work, _MEMBER)


def _joined(involved: DataFrame, documents: DataFrame) -> DataFrame:
    """Links (a, b) that connect the components of each group that whole shingle sets connect.

    All sets of a group are at hand, so pairs are checked where they stand, nearest first. A pair whose ends
    the links before it connect needs no check, and a refused one leaves nothing behind: a group of m
    rows gives m - 1 links at most, however many of its pairs are nearly similar.
    """
    wanted = broadcast_if_small(stored(involved.select(F.col("rep").alias("doc_id")).distinct(), "wanted"))
    texts = documents.select(F.col("doc_id").cast("long").alias("rep"), "text").join(
        wanted.withColumnRenamed("doc_id", "rep"), "rep", "left_semi")

    def work(run: pa.Table) -> pa.RecordBatch | None:
        group = _Group(run)
        sets = [np.unique(shingles(keys, WORDS)) for block in blocks(run["text"]) for _, keys in block.documents()]
        pairs = [(np.full(len(y), x), y, d) for x in range(run.num_rows - 1) for y, d in [group.near(x)] if len(y)]
        if not pairs:
            return None
        x, y, differing = (np.concatenate(c) for c in zip(*pairs))
        order = np.argsort(differing, kind="stable")
        x, y = x[order], y[order]
        names, part = np.unique(group.part, return_inverse=True)
        root, links = np.arange(len(names)), []
        at, step = 0, PAIRS_AT_ONCE
        while at < len(x):
            a, b = x[at:at + step], y[at:at + step]
            at, step = at + step, 2 * step
            apart = root[part[a]] != root[part[b]]
            a, b = a[apart], b[apart]
            for head in np.unique(a):
                for other in b[a == head]:
                    old, new = root[part[other]], root[part[head]]
                    if old != new and _similar(sets[head], sets[other]):
                        links.append((group.rep[head], group.rep[other]))
                        root[root == old] = new
        if not links:
            return None
        a, b = np.array(links).T
        return pa.RecordBatch.from_pydict({"a": np.minimum(a, b), "b": np.maximum(a, b)})

    return by_runs(involved.join(texts, "rep"), ["key", "i", "j"], work, "a long, b long")


def near_duplicates(documents: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable by links) and kept.

    A document's set holds its runs of five words (words end at ASCII white space, A-Z are
    lower-cased), or its whole sequence if shorter. Sets with 100 * common >= 75 * all are linked.
    50 bands of 5 MinHash values miss a pair at 0.75 with probability (1 - 0.75**5)**50,
    1.3e-6, and nearer ones far less often; every link is confirmed on whole sets.

    Equal sets are one class, known by its smallest doc_id, and only classes are compared. In each
    bucket all members are first checked against one hub, the member with the most
    company over all its buckets. Then members of a bucket that still lie in different components
    are compared by sketch in blocks, and blocks with plausible pairs are given the whole sets, which
    connect what belongs together. No plausible pair is passed over unless its ends are connected already.

    Null or empty text has an empty set and links with nothing, as has a null doc_id, whose
    component is null. Rows that repeat a doc_id are one node with the links of each. Other
    columns are ignored.
    """
    known = stored(sketches(documents), "sketches")
    able = known.where("doc_id IS NOT NULL AND n_shingles > 0")
    classes = stored(able.groupBy("class").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies")), "classes")
    reps = stored(able.join(classes, "class").where("doc_id = rep").dropDuplicates(["class"]).select(
        "rep", F.col("n_shingles").alias("n"), "bands", "sketch"), "reps")
    links = _links(reps, documents)
    parts = components(links)
    found = classes.join(parts, F.col("rep") == F.col("id"), "left").where("copies > 1 OR id IS NOT NULL").select(
        "class", F.coalesce("component", "rep").alias("component"))
    own = F.when(F.col("doc_id").isNotNull(), F.col("class")).alias("class")
    return known.select("doc_id", "n_shingles", own).join(found, "class", "left").select(
        "doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"),
        F.coalesce(F.coalesce("component", "doc_id") == F.col("doc_id"), F.lit(False)).alias("kept"))


def _links(reps: DataFrame, documents: DataFrame) -> DataFrame:
    """Enough links (a, b) between classes to connect all that are connected."""
    placed = reps.select("rep", F.explode("bands").alias("key"))
    busy = placed.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    members = stored(placed.join(busy, "key"), "members")
    company = members.groupBy("rep").agg(F.sum("size").alias("company"))
    hubs = members.join(company, "rep").groupBy("key").agg(
        F.max_by("rep", F.struct("company", -F.col("rep"))).alias("hub"))
    members = stored(members.join(hubs, "key"), "members")
    first = members.where("rep <> hub").select(F.col("hub").alias("a"), F.col("rep").alias("b")).distinct()
    asked = stored(_plausible(first, reps), "pairs")
    links = stored(_confirmed(asked, documents), "links")
    parts = components(links)
    named = members.where("size > 2").join(parts, F.col("rep") == F.col("id"), "left").select(
        "key", "rep", "hub", F.coalesce("component", "rep").alias("component"))
    mixed = named.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high")
    mixed = named.join(mixed.select("key"), "key").join(reps.select("rep", "n", "sketch", "bands"), "rep")
    involved = stored(_involved(mixed), "involved")
    return links.union(stored(_joined(involved, documents), "links"))
