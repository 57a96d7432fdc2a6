"""Operator 4: quality classifier on learned subword embeddings."""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernel

BUCKETS = 1 << 16
DIMENSIONS = 8
TRAIN_PER_CLASS = 1_500
EPOCHS = 6
#: Each kind's average counts this many features of no weight, so short texts stay near the prior.
CALM = 30
GRAMS = (3, 4, 5)


def _features(data: np.ndarray, offsets: np.ndarray):
    """Buckets kind by kind, with the place where each document's begin: words, whether a word repeats the one
    before it, and n-grams of the characters of each word with a mark at both ends; case is kept. Bucket -1 is none."""
    starts, ends, first = kernel.words(data, offsets)
    h = kernel.span_hashes(data, starts, ends)
    yield (h % np.uint64(BUCKETS)).astype(np.int32), first
    again = np.zeros(len(h), np.uint64)
    again[1:] = h[1:] == h[:-1]
    again[first[:-1][first[:-1] < len(h)]] = 2
    yield (kernel.mix(again + np.uint64(11)) % np.uint64(BUCKETS)).astype(np.int32), first
    chars, bounds = kernel.code_points(data, offsets)
    # A space on either side marks a word's end; no n-gram has one inside or reaches into another document.
    blank = (chars == 32) | ((chars >= 9) & (chars <= 13))
    wide = np.where(blank, 0, chars).astype(np.uint64) + np.uint64(1)
    edge = np.zeros(len(chars) + 1, bool)
    edge[bounds] = True
    for n in GRAMS:
        if len(chars) < n:
            continue
        m = len(chars) - n + 1
        h, inside = wide[:m].copy(), np.ones(m, bool)
        for k in range(1, n):
            h = h * np.uint64(0x100000001B3) + wide[k : m + k]
            inside &= ~edge[k : m + k]
            if k < n - 1:
                inside &= ~blank[k : m + k]
        bucket = (kernel.mix(h + np.uint64(n * 0x9E3779B97F4A7C15 % (1 << 64))) % np.uint64(BUCKETS)).astype(np.int32)
        bucket[~inside] = -1
        yield bucket, np.minimum(bounds, m)


def _shares(text: str) -> tuple[np.ndarray, np.ndarray]:
    """A text's buckets, and the weight of each in its average."""
    data = np.frombuffer(text.encode(), np.uint8)
    ids, share = [np.empty(0, np.int32)], [np.empty(0, np.float32)]
    for found, _ in _features(data, np.array([0, len(data)])):
        kind, counts = np.unique(found[found >= 0], return_counts=True)
        ids.append(kind)
        share.append((counts / (counts.sum() + CALM)).astype(np.float32))
    ids, where = np.unique(np.concatenate(ids), return_inverse=True)
    return ids, np.bincount(where, weights=np.concatenate(share), minlength=len(ids)).astype(np.float32)


def _train(docs: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, epochs: int, seed: int = 7) -> dict:
    """Embeddings, their average and a softmax, fitted by stochastic gradient descent."""
    rng = np.random.default_rng(seed)
    table = rng.uniform(-1 / DIMENSIONS, 1 / DIMENSIONS, (BUCKETS, DIMENSIONS)).astype(np.float32)
    out = np.zeros((DIMENSIONS, 2), np.float32)
    bias = np.zeros(2, np.float32)
    steps, at = max(1, epochs * len(docs)), 0
    for _ in range(epochs):
        for i in rng.permutation(len(docs)):
            ids, share = docs[i]
            rate = 0.1 * (1 - at / steps)
            at += 1
            mean = share @ table[ids]
            z = mean @ out + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[labels[i]] -= 1
            back = out @ p
            out -= rate * np.outer(mean, p)
            bias -= rate * p
            # Most shares are tiny, so rows learn at a higher rate, up to a bound.
            table[ids] -= (rate * 2) * np.minimum(share * 20, 1)[:, None] * back[None, :]
    # The score needs of a row only its part along the difference of the classes.
    return {"weights": (table @ (out[:, 1] - out[:, 0])).astype(np.float32), "bias": float(bias[1] - bias[0])}


def learn(docs: DataFrame, labels: DataFrame, label: str = "quality", per_class: int = TRAIN_PER_CLASS, epochs: int = EPOCHS, id_col: str = "doc_id", text_col: str = "text") -> dict:
    """Trains on a bounded sample: at most ``per_class`` labelled rows of each class, chosen by a hash of the id.

    One task trains with numpy; only the model comes back. The classes are sampled
    alike, so the log odds of all labels are added to the bias. Without two classes
    the model gives every text the share of ones among the labels (0.5 without labels).
    """
    spark = docs.sparkSession
    rows = labels.where(F.col(label).isin(0, 1) & F.col(id_col).isNotNull()).select(id_col, F.col(label).cast("int").alias("y"))
    order = [F.xxhash64(F.lit(4), F.col(id_col)), F.col(id_col)]
    sample = rows.where("y = 0").orderBy(*order).limit(per_class).unionByName(rows.where("y = 1").orderBy(*order).limit(per_class))
    texts = docs.join(F.broadcast(sample), id_col).select(F.col(id_col).cast("string").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), "y")

    def run(batches):
        # A text is held as its features, at most BUCKETS of them, however long it is.
        got = sorted(((i.as_py(), y.as_py(), _shares(t.as_py())) for b in batches for i, t, y in zip(*b.columns, strict=True)), key=lambda r: r[:2])
        y = np.array([r[1] for r in got], np.int64)
        if len(got) == 0 or y.min() == y.max():
            share = float(np.clip(y.mean(), 0.01, 0.99)) if len(got) else 0.5
            model = {"weights": np.zeros(BUCKETS, np.float32), "bias": float(np.log(share / (1 - share)))}
        else:
            model = _train([r[2] for r in got], y, epochs)
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], ["model"])

    got = texts.repartition(1).mapInArrow(run, "model binary").collect()
    model = pickle.loads(bytes(got[0]["model"])) if got else {"weights": np.zeros(BUCKETS, np.float32), "bias": 0.0}
    sizes = {r["y"]: r["count"] for r in rows.groupBy("y").count().collect()}
    if len(sizes) == 2:
        model["bias"] += float(np.log(sizes[1] / sizes[0]) - np.log(min(sizes[1], per_class) / min(sizes[0], per_class)))
    return model


def score_quality(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score): the probability of label 1 for each whole text.

    A document is the sum of the averages of the vectors of its words, of marks that
    tell a word repeated at once from another, and of the 3- to 5-grams of its words'
    characters (case kept), all hashed to 65,536 rows; softmax of a linear layer gives the score. Null and empty texts have no features and get
    the score of the bias alone. Every row gives one row; other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = dict(docs.dtypes)[id_col]

    def run(batches):
        weights, bias = np.append(shared.value["weights"], np.float32(0)), shared.value["bias"]
        for batch in batches:
            data, offsets = kernel.buffers(batch.column(1))
            out = np.zeros(batch.num_rows)
            for a, b in kernel.chunks(offsets):
                total = np.zeros(b - a)
                for bucket, first in _features(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]):
                    sums = np.concatenate(([0.0], np.cumsum(weights[bucket], dtype=np.float64)))
                    held = np.concatenate(([0], np.cumsum(bucket >= 0)))
                    total += (sums[first[1:]] - sums[first[:-1]]) / (held[first[1:]] - held[first[:-1]] + CALM)
                out[a:b] = total
            score = 1 / (1 + np.exp(-np.clip(out + bias, -50, 50)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score)], [id_col, "score"])

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, f"`{id_col}` {kind}, score double")
