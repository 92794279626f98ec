"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

A document is the set of hash buckets of its words, word pairs and pairs that skip one word, over its whole text. The
online learner keeps a rate per coordinate and L1 sparsity leaves few weights, which travel to every task as two arrays.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import staging, text
from .quality import held_out

BITS = 20
#: Bounds of the training sample: labelled documents of each class, and buckets of all together, held by the driver.
SAMPLE_DOCS, SAMPLE_BUCKETS = 4000, 8_000_000
THRESHOLD = 0.5
_SEEDS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)


def buckets(buf: np.ndarray, offsets: np.ndarray, bits: int = BITS, wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets (those that ``wanted`` marks) of all documents, one after another, and the ``n + 1`` offsets."""
    low = text.LOWER[buf]
    s, e, per_doc = text.spans(low, offsets, text.ALNUM)
    h = text.SpanHash(low)(s, e)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(per_doc))
    found, of = [text.mix(h ^ _SEEDS[0])], [doc]
    for gap in (1, 2):
        same = doc[gap:] == doc[:-gap]
        found.append(text.mix(h[:-gap][same] * _SEEDS[gap] + text.mix(h[gap:][same] ^ np.uint64(gap))))
        of.append(doc[gap:][same])
    bucket, owner = np.concatenate(found) >> np.uint64(64 - bits), np.concatenate(of)
    if wanted is not None:
        held = wanted[bucket]
        bucket, owner = bucket[held], owner[held]
    key = np.unique((owner.astype(np.uint64) << np.uint64(bits)) | bucket)
    of_key = (key >> np.uint64(bits)).astype(np.int64)
    return (key & np.uint64((1 << bits) - 1)).astype(np.int64), np.searchsorted(of_key, np.arange(len(offsets)))


class Ftrl:
    """FTRL-proximal over binary features (McMahan et al., 2013): ``z`` and ``n`` per coordinate, weights on demand."""

    def __init__(self, bits: int = BITS, alpha: float = 1.0, beta: float = 1.0, l1: float = 6.0, l2: float = 0.1):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros(1 << bits), np.zeros(1 << bits)
        self.bias_z = self.bias_n = 0.0

    def weights(self, at: np.ndarray) -> np.ndarray:
        z = self.z[at]
        return np.where(np.abs(z) <= self.l1, 0.0, (np.sign(z) * self.l1 - z) / ((self.beta + np.sqrt(self.n[at])) / self.alpha + self.l2))

    def bias(self) -> float:
        return -self.bias_z / ((self.beta + np.sqrt(self.bias_n)) / self.alpha)

    def learn(self, at: np.ndarray, label: float) -> None:
        w, b = self.weights(at), self.bias()
        g = float(1 / (1 + np.exp(-np.clip(w.sum() + b, -35, 35)))) - label
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[at] = n + g * g
        self.bias_z += g - (np.sqrt(self.bias_n + g * g) - np.sqrt(self.bias_n)) / self.alpha * b
        self.bias_n += g * g

    def compact(self) -> tuple[np.ndarray, np.ndarray, float]:
        """Buckets with a weight, their weights, and the bias."""
        at = np.flatnonzero(np.abs(self.z) > self.l1)
        return at.astype(np.uint32), self.weights(at).astype(np.float32), self.bias()


#: A fitted model: buckets, weights, bias and number of bits; ``None`` where there were no labels.
Model = tuple[np.ndarray, np.ndarray, float, int] | None


def fit(found: list[np.ndarray], labels: list[float], bits: int = BITS, epochs: int = 4, seed: int = 3, **options) -> Model:
    """FTRL over the documents in fixed random orders."""
    if not labels:
        return None
    learner, r = Ftrl(bits, **options), np.random.default_rng(seed)
    for _ in range(epochs):
        for k in r.permutation(len(labels)):
            learner.learn(found[k], labels[k])
    return (*learner.compact(), bits)


def train(spark: SparkSession, docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          label_col: str = "toxic", sample_docs: int = SAMPLE_DOCS, sample_buckets: int = SAMPLE_BUCKETS, bits: int = BITS, **options) -> Model:
    """Weights learned from labelled documents outside the held-out fold.

    Of the labelled identifiers of each class the ``sample_docs`` with the smallest hash are used, so scores suppose that
    both classes are as frequent as in that sample; a document whose buckets would bring the sample over
    ``sample_buckets`` is left out. The driver's memory therefore does not grow with the table. Several labels of a
    document count as the largest; null labels and identifiers are left out.
    """
    rows = labels.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{label_col}`").cast("double").alias("_label"))
    rows = rows.where(F.col("_id").isNotNull() & F.col("_label").isNotNull() & ~held_out("_id"))
    rows = rows.groupBy("_id").agg(F.max(F.col("_label") > 0).cast("double").alias("_label"))
    of_class = [rows.where(F.col("_label") == k).orderBy(F.xxhash64("_id"), "_id").limit(sample_docs) for k in (1.0, 0.0)]
    chosen = of_class[0].unionByName(of_class[1])
    staging.batches(spark)
    texts = docs.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text_col}`").cast("string").alias("_text"))
    picked = texts.join(F.broadcast(chosen), "_id")  # at most 2 * sample_docs rows of two numbers

    def run(batches):
        for batch in batches:
            buf, offsets = text.flat(batch.column("_text"))
            for i, j in text.pieces(offsets):
                at, ends = buckets(buf[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i], bits)
                at = at.astype("<u4")
                yield pa.RecordBatch.from_arrays([
                    batch.column("_id").slice(i, j - i), batch.column("_label").slice(i, j - i),
                    pa.array([at[a:b].tobytes() for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())], pa.binary())],
                    names=["_id", "_label", "_at"])

    kind = dict(texts.dtypes)["_id"]
    found, labels_of, total = [], [], 0
    bags = staging.stage(spark, picked.mapInArrow(run, f"_id {kind}, _label double, _at binary"))
    for r in bags.orderBy(F.xxhash64("_id"), "_id", "_at").toLocalIterator():
        at = np.frombuffer(r["_at"], "<u4")
        if total + len(at) > sample_buckets:
            continue
        total += len(at)
        found.append(at)
        labels_of.append(r["_label"])
    return fit(found, labels_of, bits, **options)


def predict(at: np.ndarray, ends: np.ndarray, table: np.ndarray, bias: float) -> np.ndarray:
    sums = np.concatenate(([0.0], np.cumsum(table[at], dtype=np.float64)))
    return 1 / (1 + np.exp(-np.clip(sums[ends[1:]] - sums[ends[:-1]] + bias, -35, 35)))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``id, held_out, score, predicted`` and the number of distinct weighted buckets, for every row of ``docs``.

    A null or empty text has no buckets and scores as the bias alone. Without a model (no labels) every score is 0.
    Identifiers are no input; a null identifier is not held out. Other columns are not read.
    """
    rows = docs.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text_col}`").cast("string").alias("_text"))
    # sparse weights: at most 2**bits pairs of four bytes
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        weights = shared.value
        bits = weights[3] if weights else BITS
        table = np.zeros(1 << bits, np.float32)
        if weights:
            table[weights[0]] = weights[1]
        wanted = table != 0
        for batch in batches:
            buf, offsets = text.flat(batch.column("_text"))
            for i, j in text.pieces(offsets):
                at, ends = buckets(buf[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i], bits, wanted)
                y = predict(at, ends, table, weights[2]) if weights else np.zeros(j - i)
                yield pa.RecordBatch.from_arrays([
                    batch.column("_id").slice(i, j - i), pa.array(y), pa.array(np.diff(ends).astype(np.int64))],
                    names=["_id", "score", "n_weighted"])

    staging.batches(docs.sparkSession)
    kind = dict(rows.dtypes)["_id"]
    out = rows.mapInArrow(run, f"_id {kind}, score double, n_weighted long")
    return out.select(F.col("_id").alias(id_col), held_out("_id").alias("held_out"), "score",
                      (F.col("score") >= threshold).cast("int").alias("predicted"), "n_weighted")
