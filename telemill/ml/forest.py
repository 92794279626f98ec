"""Random forests grown a level at a time: tasks count labels by node, feature and bin, splits are chosen tree by tree.

Spark ML's forest updates the counts of all trees row by row, so at depth nearly every update misses the processor's
cache. Here a task goes through a block of rows tree by tree, whose counts stay in the cache. The method is the same:
bins from a bounded sample, a Poisson bootstrap per tree, a random subset of features per node, Gini gain, and leaves
that vote with their weighted shares of labels.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml.classification import RandomForestClassifier
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf


@dataclass(frozen=True)
class Settings:
    trees: int = 100
    depth: int = 10
    bins: int = 32
    seed: int = 42


def settings_of(estimator) -> Settings | None:
    """Those of a forest that this module can grow: anything but what ``random_forest`` in ``train`` sets is left to Spark."""
    if not isinstance(estimator, RandomForestClassifier) or estimator.getMaxDepth() > DEEPEST or estimator.getMaxBins() > 256:
        return None
    own = {p.name for p in estimator.params if estimator.isSet(p)}
    if own - {"labelCol", "featuresCol", "weightCol", "numTrees", "maxDepth", "maxBins", "seed", "cacheNodeIds", "checkpointInterval"}:
        return None
    return Settings(estimator.getNumTrees(), estimator.getMaxDepth(), estimator.getMaxBins(), estimator.getSeed() % 2 ** 63)


#: Rows counted together, rows that one task counts at most (a third more where blocks are uneven), MB of counts that a
#: task holds at once, and the deepest trees, as nodes are numbered as in a heap.
BLOCK, ROWS_PER_TASK, COUNTS_MB, DEEPEST = 131_072, 4_000_000, 256, 12

#: How often a row is drawn, by 16 random bits: Poisson with mean 1.
DRAWS = np.searchsorted(np.cumsum([math.exp(-1) / math.factorial(i) for i in range(9)]), (np.arange(65_536) + 0.5) / 65_536).astype(np.uint8)


def cuts_of(values: np.ndarray, bins: int) -> np.ndarray:
    """At most ``bins - 1`` cuts, midway between distinct values: all of them, or about equally many rows apart."""
    values, counts = np.unique(values[~np.isnan(values)], return_counts=True)
    between = np.arange(len(values) - 1)
    if len(between) >= bins:
        upto = np.cumsum(counts)[:-1]
        between = np.unique(np.abs(upto[None, :] - counts.sum() * np.arange(1, bins)[:, None] / bins).argmin(axis=1))
    low, high = values[between], values[between + 1]
    # a cut as far out as the higher value would not tell the two apart
    return np.where((low + high) / 2 < high, (low + high) / 2, low)


def subset_size(settings: Settings, features: int) -> int:
    """Features that a node may be split by: a root of them, in a single tree all."""
    return features if settings.trees == 1 else math.ceil(math.sqrt(features))


def subsets(settings: Settings, tree: int, level: int, nodes: int, features: int) -> np.ndarray:
    """The features that each node of a level may be split by: nodes by subset."""
    drawn = np.random.default_rng([settings.seed, tree, level]).random((nodes, features))
    return np.sort(drawn.argsort(axis=1)[:, :subset_size(settings, features)], axis=1)


class Trees:
    """Growing trees, one after another: by heap position, the feature and bin of the split and the shares of labels."""

    def __init__(self, trees: int, depth: int, labels: int):
        self.depth = depth
        self.feature = np.zeros((trees, 2 << depth), dtype=np.intp)
        self.bin = np.full((trees, 2 << depth), 255, dtype=np.uint8)
        self.weights = np.zeros((trees, 2 << depth, labels))
        self.live = [np.array([1])] * trees  # positions that may be split on this level

    def split(self, tree: int, level: int, chosen: np.ndarray) -> None:
        """Take over what was chosen for the live nodes: feature (-1: none), bin, weights of labels left and right."""
        labels = self.weights.shape[2]
        at, left, right = self.live[tree], chosen[:, 2:2 + labels], chosen[:, 2 + labels:]
        if level == 0:
            self.weights[tree, 1] = (left + right)[0]
        cut = chosen[:, 0] >= 0
        at, left, right = at[cut], left[cut], right[cut]
        self.feature[tree, at], self.bin[tree, at] = chosen[cut, 0], chosen[cut, 1]
        self.weights[tree, 2 * at], self.weights[tree, 2 * at + 1] = left, right
        children, weights = np.concatenate([2 * at, 2 * at + 1]), np.concatenate([left, right])
        self.live[tree] = np.sort(children[(weights > 0).sum(axis=1) > 1])

    def shares(self) -> np.ndarray:
        """Shares of labels at the deepest positions; a leaf further up hands its own down."""
        w = self.weights
        for level in range(self.depth):
            at = np.arange(1 << level, 2 << level)
            leaf = self.bin[:, at] == 255
            for child in (2 * at, 2 * at + 1):
                w[:, child] = np.where(leaf[:, :, None], w[:, at], w[:, child])
        w = w[:, 1 << self.depth:]
        return w / np.maximum(w.sum(axis=2, keepdims=True), 1e-300)


def walked(feature: np.ndarray, cut: np.ndarray, flat: np.ndarray, base: np.ndarray, level: int) -> np.ndarray:
    """Heap positions that rows reach in one tree after ``level`` steps; a row goes left up to the cut, else right."""
    at, f = np.ones(len(base), dtype=np.intp), np.empty(len(base), dtype=np.intp)
    value, limit = np.empty(len(base), dtype=flat.dtype), np.empty(len(base), dtype=cut.dtype)
    for _ in range(level):
        np.take(feature, at, out=f, mode="clip")
        f += base
        np.take(flat, f, out=value, mode="clip")
        np.take(cut, at, out=limit, mode="clip")
        at += at
        at += ~(value <= limit)
    return at


def binned(train: DataFrame, features: Sequence[str], weight: Column, cuts: list[np.ndarray]) -> DataFrame:
    """Rows as blocks: bins row by row, labels and weights, each as bytes."""
    names = list(features)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, done, waiting, n = TaskContext.get().partitionId() << 32, 0, [], 0

        def block() -> pa.RecordBatch:
            parts = [np.concatenate(p) for p in zip(*waiting)]
            return pa.RecordBatch.from_pydict({"block": [first + done], **{c: pa.array([p.tobytes()], pa.binary()) for c, p in zip(("bins", "labels", "weights"), parts)}})

        for batch in batches:
            x = np.empty((batch.num_rows, len(names)), dtype=np.uint8)
            for j, c in enumerate(cuts):
                x[:, j] = np.searchsorted(c, batch.column(j).to_numpy(zero_copy_only=False))
            y, w = (batch.column(len(names) + i).to_numpy(zero_copy_only=False) for i in range(2))
            waiting.append((x, y.astype(np.uint8), w))
            n += batch.num_rows
            if n >= BLOCK:
                yield block()
                done, waiting, n = done + 1, [], 0
        if n:
            yield block()

    rows = train.select(*[F.col(c).cast("double").alias(c) for c in names], F.col("target").cast("int").alias("_y"), weight.alias("_w"))
    return rows.mapInArrow(blocks, "block long, bins binary, labels binary, weights binary")


def counted(blocks: DataFrame, shared, level: int, group: Sequence[int], features: int, labels: int, settings: Settings) -> DataFrame:
    """Weights by node, feature of its subset, label and bin: a row per task and tree."""
    bins, undrawn = settings.bins, int(np.searchsorted(DRAWS, 1))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (splits, cuts, lives), looked, sums = shared.value, {}, {}
        for t in group:
            slots = np.full(1 << level, -1, dtype=np.intp)
            slots[lives[t] - (1 << level)] = np.arange(len(lives[t]))
            looked[t] = slots, np.ascontiguousarray(subsets(settings, t, level, len(lives[t]), features).T)
            sums[t] = np.zeros((subset_size(settings, features), len(lives[t]) * labels * bins))
        for batch in batches:
            for row in range(batch.num_rows):
                block = batch.column(0)[row].as_py()
                x, y, w = (np.frombuffer(batch.column(i)[row].as_buffer(), kind) for i, kind in ((1, np.uint8), (2, np.uint8), (3, np.float64)))
                y = y.astype(np.intp) * bins
                for t, (slots, subset) in looked.items():
                    drawn = np.random.default_rng([settings.seed, t, block]).integers(0, 65_536, len(y), dtype=np.uint16)
                    picked = np.flatnonzero(drawn >= undrawn)
                    base = picked * features
                    slot = slots.take(walked(splits[t], cuts[t], x, base, level) - (1 << level))
                    alive = slot >= 0
                    if not alive.all():
                        slot, picked, base = slot[alive], picked[alive], base[alive]
                    weights = w.take(picked) * DRAWS.take(drawn.take(picked))
                    key = slot * (labels * bins)
                    key += y.take(picked)
                    at, value = np.empty_like(slot), np.empty(len(slot), dtype=np.uint8)
                    for j, feature in enumerate(subset):
                        np.take(feature, slot, out=at, mode="clip")
                        at += base
                        np.take(x, at, out=value, mode="clip")
                        np.add(key, value, out=at)
                        sums[t][j] += np.bincount(at, weights, sums[t].shape[1])
        for t in list(sums):
            yield pa.RecordBatch.from_pydict({"tree": pa.array([t], pa.int32()), "counts": pa.array([sums.pop(t).tobytes()], pa.binary())})

    return blocks.mapInArrow(count, "tree int, counts binary")


def chosen(counts: DataFrame, level: int, features: int, labels: int, settings: Settings) -> DataFrame:
    """The split of highest Gini gain at each live node of a tree."""
    def choose(table: pa.Table) -> pa.Table:
        tree, many = table.column("tree")[0].as_py(), subset_size(settings, features)
        total = 0.0
        for one in table.column("counts"):
            total = total + np.frombuffer(one.as_buffer())
        total = total.reshape(many, -1, labels, settings.bins)
        splits = best_splits(total, subsets(settings, tree, level, total.shape[1], features))
        return pa.table({"tree": pa.array([tree], pa.int32()), "splits": pa.array([splits.tobytes()], pa.binary())})

    return counts.groupBy("tree").applyInArrow(choose, "tree int, splits binary")


def best_splits(counts: np.ndarray, subset: np.ndarray) -> np.ndarray:
    """Per node: feature or -1, last bin that goes left, weights of labels left and right.

    ``counts`` are weights by place in the subset, node, label and bin; of equal gains the first counts.
    """
    left = counts.cumsum(axis=3)
    whole = left[..., -1:]
    left = left[..., :-1]
    right = whole - left

    def purity(w):  # weight times the sum of squared shares
        n = w.sum(axis=2)
        return (w * w).sum(axis=2) / np.where(n > 0, n, 1.0), n

    (l, nl), (r, nr), (w, n) = purity(left), purity(right), purity(whole)
    gain = np.where((nl > 0) & (nr > 0), (l + r - w) / np.where(n > 0, n, 1.0), -1.0)
    by_node = gain.transpose(1, 0, 2).reshape(gain.shape[1], -1)
    best, node = by_node.argmax(axis=1), np.arange(gain.shape[1])
    place, at = np.divmod(best, gain.shape[2])
    feature = np.where(by_node[node, best] > 1e-12, subset[node, place], -1)
    return np.column_stack([feature, at, left[place, node, :, at], right[place, node, :, at]])


class Forest:
    """Fitted trees over raw values."""

    def __init__(self, trees: Trees, cuts: list[np.ndarray], features: Sequence[str]):
        self.features, self.depth, self.feature = list(features), trees.depth, trees.feature
        table = np.full((len(cuts), 256), np.inf)
        for j, c in enumerate(cuts):
            table[j, :len(c)] = c
        self.cut, self.positive = table[trees.feature, trees.bin], np.ascontiguousarray(trees.shares()[..., 1])

    def score(self, df: DataFrame) -> DataFrame:
        """Add ``leak_score``: the mean over trees of the share of label 1 in the leaf that a row reaches."""
        shared = df.sparkSession.sparkContext.broadcast((self.feature, self.cut, self.positive, self.depth))

        @pandas_udf("double")
        def probability(*cols: pd.Series) -> pd.Series:
            feature, cut, positive, depth = shared.value
            x = np.column_stack([c.to_numpy(dtype=float) for c in cols])
            flat, base, total = x.ravel(), np.arange(len(x)) * x.shape[1], np.zeros(len(x))
            for t in range(len(feature)):
                total += positive[t].take(walked(feature[t], cut[t], flat, base, depth) - (1 << depth))
            return pd.Series(total / len(feature))

        return df.withColumn("leak_score", probability(*[F.col(c).cast("double") for c in self.features]))


def fit(train: DataFrame, features: Sequence[str], weight: str | None, settings: Settings) -> Forest:
    """Grow all trees over rows with ``target`` 0, 1, ...; a job per level and group of trees whose counts fit in a task.

    Weights are rounded to a small power of two, so that their sums are exact and the order of tasks does not matter.
    """
    spark = train.sparkSession
    target, w = F.col("target"), (F.col(weight) if weight else F.lit(1.0)).cast("double")
    right = (target >= 0) & (target == F.floor(target)) & (target < 100) & (w >= 0) & (w < math.inf)
    n, bad, top, most = train.agg(F.count(F.lit(1)), F.count_if(~F.coalesce(right, F.lit(False))), F.max("target"), F.max(w)).first()
    if not n or bad:
        raise ValueError(f"a forest needs rows with labels 0, 1, ... and weights of at least 0: {n} rows, {bad} without")
    labels = max(2, int(top) + 1)
    step = 2.0 ** (math.frexp(most)[1] - 50 + n.bit_length())
    need = max(settings.bins ** 2, 10_000)  # rows that cuts are taken from
    sample = train.select(*[F.col(c).cast("double").alias(c) for c in features])
    if n > need:
        sample = sample.sample(need / n, settings.seed)
    sample = sample.toPandas().to_numpy(dtype=float)
    cuts = [cuts_of(sample[:, j], settings.bins) for j in range(len(features))]

    kept = binned(train, features, F.rint(w / step) * step, cuts).persist()
    try:
        blocks = kept.coalesce(max(spark.sparkContext.defaultParallelism, -(-n // ROWS_PER_TASK)))
        trees = Trees(settings.trees, settings.depth, labels)
        for level in range(settings.depth):
            live = [t for t in range(settings.trees) if len(trees.live[t])]
            size = max(map(len, trees.live)) * labels * settings.bins * subset_size(settings, len(features)) * 8
            many = max(1, COUNTS_MB * 1_000_000 // max(size, 1))
            shared, found = spark.sparkContext.broadcast((trees.feature, trees.bin, trees.live)), []
            for group in (live[i:i + many] for i in range(0, len(live), many)):
                counts = counted(blocks, shared, level, group, len(features), labels, settings)
                found += chosen(counts, level, len(features), labels, settings).collect()
            for row in found:
                trees.split(row["tree"], level, np.frombuffer(row["splits"]).reshape(-1, 2 + 2 * labels))
            shared.destroy()
        return Forest(trees, cuts, features)
    finally:
        kept.unpersist()
