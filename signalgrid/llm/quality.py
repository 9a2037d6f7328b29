"""Quality classifier: naive Bayes support vectors over n-gram indicators."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from signalgrid.llm.common import crc32_of, lean, modest_batches
from signalgrid.llm.words import BASE, BLOCK_BYTES, U, buffers, mix, row_ranges, span_keys, word_spans

PER_CLASS = 6_000
EPOCHS = 10
COST = 0.02

# Feature numbers: byte pairs as they are, byte triples hashed, word-shape n-grams hashed.
PAIRS, TRIPLES, SHAPES = 1 << 16, 1 << 17, 1 << 16
SIZE = PAIRS + TRIPLES + SHAPES
SHARES = 7

_KIND = np.zeros(256, np.uint8)  # 0 other, 1 lower, 2 upper, 3 digit, 4 beyond ASCII
_KIND[ord("a"):ord("z") + 1] = 1
_KIND[ord("A"):ord("Z") + 1] = 2
_KIND[ord("0"):ord("9") + 1] = 3
_KIND[0x80:] = 4


def features(texts: pa.Array) -> Iterator[np.ndarray]:
    """For each text in order the numbers of the features it shows, each once; none for empty text.

    A feature is the presence of a byte pair or triple, or of one, two or three word shapes in a
    row together with a lower bound of their share in the text (at least 1, 1/2, 1/4 ... 1/64 of
    the words, or any). A shape is the kinds of a word's first, second and last characters,
    that last character if it is a sign, the length class, and whether the word repeats
    the one before it or the one before that.
    """
    data, at = buffers(texts)
    writer = np.zeros(SIZE, np.int32)
    for first, last in row_ranges(at):
        low = int(at[first])
        raw, cuts = data[low:int(at[last])], at[first:last + 1] - low
        pairs, triples = _byte_grams(raw[:BLOCK_BYTES])
        begins, ends = word_spans(raw, cuts)
        shapes = _shapes(raw, begins, ends)
        words = np.searchsorted(begins, cuts)
        for i in range(last - first):
            a, b = int(cuts[i]), int(cuts[i + 1])
            grams = pairs[a:max(b - 1, a)], triples[a:max(b - 2, a)]
            if b - a > BLOCK_BYTES:  # a text of its own run
                grams = [_stretches(raw)]
            found = np.concatenate((*grams, _shape_grams(shapes[words[i]:words[i + 1]])), dtype=np.int64)
            order = np.arange(len(found), dtype=np.int32)
            writer[found] = order  # the last to write a number is the one that counts
            yield found[writer[found] == order]


def _byte_grams(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    wide = raw.astype(np.uint32)
    pairs = wide[:-1] << np.uint32(8) | wide[1:]
    triples = (pairs[:-1] << np.uint32(8) | wide[2:]) * np.uint32(0x9E3779B1) >> np.uint32(15)
    return pairs, triples + np.uint32(PAIRS)


def _stretches(raw: np.ndarray) -> np.ndarray:
    """The different grams of a long text, a stretch at a time."""
    seen = np.zeros(PAIRS + TRIPLES, bool)
    for a in range(0, len(raw), BLOCK_BYTES):
        for grams in _byte_grams(raw[a:a + BLOCK_BYTES + 2]):
            seen[grams] = True
    return np.flatnonzero(seen)


def _shapes(raw: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    if not len(begins):
        return np.zeros(0, U)
    kinds, size = _KIND[raw], ends - begins
    head, tail = kinds[begins], raw[ends - 1]
    second = np.where(size > 1, kinds[np.minimum(begins + 1, ends - 1)], 5)
    sign = np.where(_KIND[tail] == 0, tail, 0)
    keys = span_keys(raw, begins, ends)
    again = np.zeros(len(keys), U)
    again[1:] |= keys[1:] == keys[:-1]
    again[2:] |= (keys[2:] == keys[:-2]).astype(U) << U(1)
    parts = (head, second, _KIND[tail], sign, np.minimum(size // 4, 7), again)
    out = np.full(len(keys), U(17))
    for part in parts:
        out = out * U(257) + part.astype(U)
    return out


def _shape_grams(shapes: np.ndarray) -> np.ndarray:
    if not len(shapes):
        return np.zeros(0, np.int64)
    found, shares, key = [], [], np.zeros(len(shapes), U)
    for n in range(min(3, len(shapes))):
        key = mix(key[:len(shapes) - n] * BASE + shapes[n:])
        gram, count = np.unique(key, return_counts=True)
        found.append(gram)
        shares.append(count / len(key))
    gram = np.concatenate(found)
    share = np.minimum(np.floor(-np.log2(np.concatenate(shares))), SHARES).astype(np.int64)
    levels = SHARES + 1 - share  # a share of 1/2 is also one of at least 1/4
    rise = np.arange(levels.sum()) - np.repeat(np.cumsum(levels) - levels, levels)
    level = (np.repeat(share, levels) + rise).astype(U)
    return (mix(np.repeat(gram, levels) * BASE + level) % U(SHAPES)).astype(np.int64) + PAIRS + TRIPLES


def fit(rows: list[np.ndarray], labels: np.ndarray, share: float, cost: float = COST,
        epochs: int = EPOCHS) -> np.ndarray:
    """Weights of all features, the last one being the offset.

    Each indicator is scaled by its log-count ratio between the classes; a linear hinge-loss
    model is then fitted by dual coordinate descent. ``share`` is the part of label 1
    among all labelled rows; the cost of an error of either class follows it.
    """
    sign = np.where(labels == 1, 1.0, -1.0)
    if len(set(sign.tolist())) < 2:
        out = np.zeros(SIZE + 1)
        out[-1] = sign[0] if len(sign) else 0.0
        return out
    counts = np.ones((2, SIZE))
    for x, s in zip(rows, sign):
        counts[int(s > 0), x] += 1
    ratio = np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())
    ones = (sign > 0).mean()
    most = cost * np.where(sign > 0, share / ones, (1 - share) / (1 - ones))
    diagonal = np.array([float((ratio[x] ** 2).sum()) + 1.0 for x in rows])
    weights, offset, dual = np.zeros(SIZE), 0.0, np.zeros(len(rows))
    rng = np.random.default_rng(1)
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            x = rows[i]
            r = ratio[x]
            slope = sign[i] * (float(weights[x] @ r) + offset) - 1.0
            moved = min(max(dual[i] - slope / diagonal[i], 0.0), most[i])
            step = (moved - dual[i]) * sign[i]
            if step:
                weights[x] += step * r
                offset += step
                dual[i] = moved
    return np.append(weights * ratio, offset)


def model(documents: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> np.ndarray:
    """Fit on at most ``per_class`` labelled documents of each class, outside the held-out third.

    The sample is the smallest ``xxhash64`` values of doc_id, so it does not hang on the order
    or place of rows. Of rows that share a doc_id one text is learned from, so that repeated rows cannot
    make the sample larger. Class shares come from all labels.
    """
    modest_batches(documents.sparkSession)
    usable = labels.select("doc_id", "quality").where(
        F.col("quality").isin(0, 1) & (F.pmod(crc32_of("doc_id"), F.lit(3)) != 1))
    sizes = {r["quality"]: r["n"] for r in usable.groupBy("quality").agg(F.count("*").alias("n")).collect()}
    share = sizes.get(1, 0) / max(1, sum(sizes.values()))
    picked = [usable.where(F.col("quality") == q).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
              for q in (0, 1)]
    chosen = F.broadcast(picked[0].union(picked[1]))
    texts = documents.select("doc_id", "text").join(chosen, "doc_id", "left_semi").groupBy("doc_id").agg(
        F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))
    sample = texts.join(chosen, "doc_id")

    @lean
    def numbers(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], batch["quality"].cast(pa.int32()),
                 pa.array([x.astype(np.int32) for x in features(batch["text"])], pa.list_(pa.int32()))],
                names=["doc_id", "quality", "x"])

    @lean
    def train(batches):
        ids, y, x = [], [], []
        for batch in batches:
            ids += batch["doc_id"].to_pylist()
            y += batch["quality"].to_pylist()
            at, flat = batch["x"].offsets.to_numpy(), batch["x"].values.to_numpy().copy()
            x += [flat[a:b] for a, b in zip(at[:-1], at[1:])]
        order = sorted(range(len(ids)), key=lambda i: (ids[i], y[i], len(x[i])))
        out = fit([x[i] for i in order], np.array([y[i] for i in order]), share)
        yield pa.RecordBatch.from_arrays([pa.array([out.tobytes()])], names=["weights"])

    fitted = (sample.mapInArrow(numbers, "doc_id long, quality int, x array<int>")
              .repartition(1).mapInArrow(train, "weights binary").collect())
    return np.frombuffer(fitted[0]["weights"]) if fitted else np.zeros(SIZE + 1)


def score(documents: DataFrame, weights: np.ndarray, keep_text: bool = True) -> DataFrame:
    """Adds score and predicted to any frame with a text column, without a shuffle."""
    modest_batches(documents.sparkSession)
    held = documents.sparkSession.sparkContext.broadcast(weights)
    plain = documents.drop("score", "predicted")
    names = [c for c in plain.columns if keep_text or c != "text"]

    @lean
    def task(batches):
        w = held.value
        for batch in batches:
            margin = np.array([float(w[x].sum()) for x in features(batch["text"])]) + w[-1]
            good = 1.0 / (1.0 + np.exp(-np.clip(margin, -30, 30)))
            yield pa.RecordBatch.from_arrays(
                [*(batch[c] for c in names), pa.array(good), pa.array((good >= 0.5).astype(np.int32))],
                names=[*names, "score", "predicted"])

    schema = T.StructType([*plain.select(names).schema, T.StructField("score", T.DoubleType()),
                           T.StructField("predicted", T.IntegerType())])
    return plain.mapInArrow(task, schema)


def classify(documents: DataFrame, labels: DataFrame, per_class: int = PER_CLASS,
             keep_text: bool = True) -> DataFrame:
    """Score every document's whole text; adds held_out, score and predicted.

    ``labels`` has doc_id and quality; rows with other values than 0 and 1, or without a
    document, are left out, and a document labelled twice counts twice. The score is the
    logistic function of the model's margin. Null text is empty and has the offset's score;
    without any label all scores are one half. A null doc_id is not held out. Repeated rows
    are scored one by one. Columns named score, predicted or held_out are replaced; others
    stay. Inputs of the score are the text's n-grams alone.
    """
    out = score(documents, model(documents, labels, per_class), keep_text)
    return out.withColumn(
        "held_out", F.coalesce(F.pmod(crc32_of("doc_id"), F.lit(3)) == 1, F.lit(False)))
