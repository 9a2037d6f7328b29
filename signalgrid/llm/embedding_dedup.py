"""Near-duplicate vectors by Euclidean p-stable hashing and an exact cosine check."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from signalgrid.llm.common import by_runs, components, lean, stored
from signalgrid.llm.words import mix

COSINE = 0.98
TABLES = 64
WIDTH = 2.0
PROJECTIONS = 18
BLOCK = 1_024
SEED = 20_240_117


def vector_links(vectors: DataFrame, id_column: str = "vec_id", vector: str = "embedding",
                 label: str = "label", cosine: float = COSINE, tables: int = TABLES,
                 projections: int = PROJECTIONS, width: float = WIDTH,
                 block: int = BLOCK) -> DataFrame:
    """Links and components of vectors whose labels are equal and whose cosine is high enough.

    Each of ``tables`` hash tables cuts ``projections`` random Gaussian projections of the
    normalised vector into steps of ``width``. Two vectors at cosine 0.98 are 0.2 apart and
    share a step with probability 0.92, so all tables miss them with probability
    (1 - 0.92**18)**64, below 1e-7; unrelated vectors share one of 64 buckets once in 6,000.
    Vectors of a bucket are compared by their cosine in double precision, in blocks of about
    ``block``, a pair of blocks to a group, so a busy bucket is spread over many tasks. A pair
    counts in the first table that holds it.

    Equal vectors of a label are one class, compared once, and weigh in with their number.
    Returns id, n_links (other vectors linked directly), component_id (smallest id reachable,
    itself included) and kept. Vectors that are null, empty, zero or hold null or non-finite
    components, and rows with a null label, link with nothing. Vectors of different length
    are never compared. A repeated id is a row of its own in the result, linked like any other;
    a null id links with nothing and has a null component. Other columns are ignored.
    """
    rows = vectors.select(
        F.col(id_column).cast("long").alias("vec_id"), F.col(label).cast("string").alias("label"),
        F.col(vector).cast("array<double>").alias("v"))
    rows = stored(rows.select("vec_id", F.when(F.col("vec_id").isNotNull() & _usable(), F.sha2(
        F.concat_ws("/", "label", F.transform("v", lambda x: (x + F.lit(0.0)).cast("string"))), 256)).alias("class"),
        "label", "v"), "vectors")
    # A class is known by its smallest id; all its rows hold the same vector.
    members = rows.where("class IS NOT NULL").groupBy("class").agg(
        F.min("vec_id").alias("rep"), F.count("*").alias("n"))
    members = stored(members, "classes")
    first = (rows.where("class IS NOT NULL").select("vec_id", "class", "label", "v")
             .join(members.select("class", "n", F.col("rep").alias("vec_id")), ["class", "vec_id"])
             .dropDuplicates(["class"]))
    hashed = stored(_hashed(first, tables, projections, width), "signatures")
    found = stored(_compared(hashed, cosine, tables, block), "pairs")
    partners = found.groupBy("rep").agg(F.sum("others").alias("others"))
    joined = components(found.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    known = (members.join(partners, "rep", "left").join(joined, F.col("rep") == F.col("id"), "left")
             .select("class", (F.col("n") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"),
                     F.coalesce("component", "rep").alias("component_id")))
    return rows.select("vec_id", "class").join(known, "class", "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component_id", "vec_id").alias("component_id"),
        F.coalesce(F.coalesce("component_id", "vec_id") == F.col("vec_id"), F.lit(False)).alias("kept"))


def _usable():
    """Whether label and vector are there, and the vector has a length and finite components."""
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.col("label").isNotNull() & F.col("v").isNotNull() & finite & F.exists("v", lambda x: x != 0)


def _normalised(v: pa.Array, dim: int) -> np.ndarray:
    x = v.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # so that squares neither overflow nor vanish
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _hashed(first: DataFrame, tables: int, projections: int, width: float) -> DataFrame:
    """Adds ``buckets``: the vector's bucket in each table."""
    @lean
    def task(batches):
        drawn: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            lengths = np.asarray(pa.compute.list_value_length(batch["v"]))
            for dim in np.unique(lengths).tolist():
                part = batch.filter(pa.array(lengths == dim))
                if dim not in drawn:
                    rng = np.random.default_rng(SEED + dim)
                    drawn[dim] = rng.standard_normal((dim, tables * projections)), rng.random(tables * projections) * width
                lines, shift = drawn[dim]
                for i in range(0, part.num_rows, 4_096):
                    few = part.slice(i, 4_096)
                    steps = np.floor((_normalised(few["v"], dim) @ lines + shift) / width).astype(np.int64).view(np.uint64)
                    steps = steps.reshape(few.num_rows, tables, projections)
                    key = np.full(steps.shape[:2], dim, np.uint64)
                    for k in range(projections):
                        key = mix(key * np.uint64(31) + steps[:, :, k])
                    flat = pa.array(key.view(np.int64).ravel())
                    at = pa.array(np.arange(few.num_rows + 1, dtype=np.int32) * tables)
                    yield pa.RecordBatch.from_arrays(
                        [few["vec_id"], few["n"], few["label"], few["v"], pa.ListArray.from_arrays(at, flat)],
                        names=["rep", "n", "label", "v", "buckets"])

    return first.select("vec_id", "n", "label", "v").mapInArrow(
        task, "rep long, n long, label string, v array<double>, buckets array<long>")


def _compared(hashed: DataFrame, cosine: float, tables: int, block: int) -> DataFrame:
    """For each class with links in a group of blocks: its partners' rows, and a class it is joined to."""
    held = hashed.select("rep", "label", F.posexplode("buckets").alias("t", "bucket"))
    busy = (held.groupBy("label", "t", "bucket").agg(F.count("*").alias("size")).where("size > 1")
            .withColumn("blocks", F.ceil(F.col("size") / block).cast("int")))
    placed = held.join(busy, ["label", "t", "bucket"]).withColumn(
        "own", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    # A pair of blocks (i, j), i <= j, is a group; a row goes to all pairs with its own block.
    dealt = placed.select(
        "rep", "label", "t", "bucket", "own",
        F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")).select(
        "rep", "t", "own", F.xxhash64("label", "t", "bucket").alias("bucket"),
        F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    full = dealt.join(hashed.drop("label"), "rep")

    def work(run: pa.Table) -> pa.RecordBatch | None:
        return _compare_run(run, cosine)

    return by_runs(full, ["bucket", "t", "i", "j"], work, "rep long, others long, root long")


def _compare_run(run: pa.Table, cosine: float) -> pa.RecordBatch | None:
    if run.num_rows < 2:
        return None
    t, i, j = (run[c][0].as_py() for c in ("t", "i", "j"))
    dims = np.asarray(pa.compute.list_value_length(run["v"]))
    run = run.filter(pa.array(dims == dims[0]))  # a bucket's key holds the dimension
    ids, n, own = (run[c].to_numpy() for c in ("rep", "n", "own"))
    x = _normalised(run["v"].combine_chunks(), int(dims[0]))
    buckets = run["buckets"].combine_chunks().flatten().to_numpy().reshape(len(ids), -1)
    near = x @ x.T >= cosine
    near &= ~np.eye(len(ids), dtype=bool)
    if i != j:
        near &= own[:, None] != own[None, :]
    a, b = np.nonzero(np.triu(near))
    # A pair belongs to the first table in which it meets.
    earlier = np.zeros(len(a), bool)
    for k in range(t):
        earlier |= buckets[a, k] == buckets[b, k]
    a, b = a[~earlier], b[~earlier]
    if not len(a):
        return None
    others = np.bincount(a, n[b], len(ids)) + np.bincount(b, n[a], len(ids))
    root = np.arange(len(ids))
    while True:  # smallest id of each connected part, by position in sorted ids
        before = root.copy()
        np.minimum.at(root, a, root[b])
        np.minimum.at(root, b, root[a])
        root = root[root]
        if (root == before).all():
            break
    linked = others > 0
    return pa.RecordBatch.from_arrays(
        [pa.array(ids[linked]), pa.array(others[linked].astype(np.int64)), pa.array(ids[root[linked]])],
        names=["rep", "others", "root"])
