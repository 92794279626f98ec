"""Isolation forest: trees built in parallel from small hash samples, rows scored in Arrow batches."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.window import Window

from ..functions import sigmoid
from ..operators.quantiles import exact_quantiles


@dataclass(frozen=True)
class Settings:
    trees: int = 300
    sample: int = 256
    seed: int = 42
    threshold: float = 0.5


def mean_path(n: float) -> float:
    """Average path length of an unsuccessful search among ``n`` points."""
    if n <= 1:
        return 0.0
    return 1.0 if n <= 2 else 2.0 * (math.log(n - 1.0) + 0.5772156649) - 2.0 * (n - 1.0) / n


def grow(x: np.ndarray, rng: np.random.Generator, depth_limit: int) -> list[tuple]:
    """One tree as rows ``(feature, cut, left, right, length)``; leaves have feature -1."""
    nodes: list[tuple] = []
    todo = [(x, 0, None, 0)]
    while todo:
        part, depth, parent, side = todo.pop()
        at = len(nodes)
        if parent is not None:
            nodes[parent][2 + side] = at
        spread = np.flatnonzero(part.max(axis=0) > part.min(axis=0)) if len(part) else np.array([], dtype=int)
        if depth >= depth_limit or len(part) <= 1 or not len(spread):
            nodes.append([-1, 0.0, -1, -1, depth + mean_path(len(part))])
            continue
        f = int(rng.choice(spread))
        cut = float(rng.uniform(part[:, f].min(), part[:, f].max()))
        low = part[:, f] < cut
        nodes.append([f, cut, -1, -1, 0.0])
        todo += [(part[~low], depth + 1, at, 1), (part[low], depth + 1, at, 0)]
    return nodes


#: Rows that walk all trees together: a matrix of rows by trees stays in the processor's cache.
ROWS_AT_A_TIME = 256


def flattened(trees: list) -> tuple:
    """All trees in one set of arrays: roots, feature, cut, next node (not below and below the cut), length, depth.

    A leaf leads to itself, so that every row takes the same number of steps in every tree.
    """
    roots = np.cumsum([0] + [len(t) for t in trees[:-1]]).astype(np.int32)
    feature, cut, left, right, length = (np.concatenate([np.asarray([n[i] for n in t], dtype=float) for t in trees]) for i in range(5))
    base = np.repeat(roots, [len(t) for t in trees])
    own, leaf = np.arange(len(feature)), feature < 0
    after = np.stack([np.where(leaf, own, right + base), np.where(leaf, own, left + base)], axis=1).ravel().astype(np.int32)
    depth, reached = 0, roots
    while not leaf[reached].all():
        reached = np.unique(after.reshape(-1, 2)[reached])
        depth += 1
    return roots, np.where(leaf, 0, feature).astype(np.int32), cut, after, length, depth


class Forest:
    """Fitted forest with the scaling and the centre of normal scores."""

    def __init__(self, trees: list, features: Sequence[str], centre: dict, spread: dict, sample: int):
        self.trees, self.features = trees, list(features)
        self.centre, self.spread, self.sample = centre, spread, sample
        self.score_centre, self.score_scale = 0.0, 1.0

    def with_samples(self, df: DataFrame, out: str = "sample_score") -> DataFrame:
        """Add the sample score; lower means more anomalous."""
        shared = df.sparkSession.sparkContext.broadcast(flattened(self.trees))  # at most trees x 2 x sample nodes
        norm = mean_path(self.sample) * len(self.trees)

        @pandas_udf("double")
        def path_score(*cols: pd.Series) -> pd.Series:
            roots, feature, cut, after, length, depth = shared.value
            x = np.column_stack([c.to_numpy(dtype=float) for c in cols])
            total = np.empty(len(x))
            for i in range(0, len(x), ROWS_AT_A_TIME):
                flat = x[i:i + ROWS_AT_A_TIME].ravel()
                row = np.arange(0, len(flat), x.shape[1], dtype=np.int32)[:, None]
                at = np.broadcast_to(roots, (len(row), len(roots)))
                for _ in range(depth):
                    low = flat[row + feature[at]] < cut[at]
                    at = after[2 * at + low]
                total[i:i + len(row)] = length[at].sum(axis=1)
            return pd.Series(-np.power(2.0, -total / norm))

        scaled = [(F.coalesce(F.col(c).cast("double"), F.lit(0.0)) - self.centre[c]) / self.spread[c] for c in self.features]
        return df.withColumn(out, path_score(*scaled))

    def score(self, df: DataFrame) -> DataFrame:
        """Add ``leak_score``: sigmoid of how far a row's score lies below the centre of normal ones."""
        scored = self.with_samples(df, "_sample")
        return scored.withColumn("leak_score", sigmoid((self.score_centre - F.col("_sample")) / self.score_scale)).drop("_sample")


def fit(
    df: DataFrame, features: Sequence[str], settings: Settings = Settings(), label: str | None = "target",
    key: Sequence[str] | None = None,
) -> Forest:
    """Fit on normal rows (all rows where there is no label or no normal row).

    ``key`` identifies a row, so that rows with equal readings are drawn independently; all columns by default.

    Rows reach a tree by hash: a first hash thins the table to a few times what all trees need, a second
    deals the rest out, and each tree takes its first ``sample`` rows by a third. Nothing but that thinned
    sample is shuffled.
    """
    names = list(features)
    x = {c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in names}
    moments = [m for c in names for m in (F.avg(x[c]).alias(f"m_{c}"), F.stddev_pop(x[c]).alias(f"s_{c}"))]
    normal = df.where(F.col(label) == 0) if label and label in df.columns else df
    stats = normal.agg(F.count(F.lit(1)).alias("n"), *moments).first()
    if not stats["n"]:
        normal = df
        stats = df.agg(F.count(F.lit(1)).alias("n"), *moments).first()
    centre = {c: stats[f"m_{c}"] for c in names}
    spread = {c: stats[f"s_{c}"] or 1.0 for c in names}
    need = settings.trees * settings.sample
    share = min(1.0, 4.0 * need / max(stats["n"], 1))
    copies = max(1, math.ceil(need / max(stats["n"], 1)))

    hashed = F.xxhash64(*(key or df.columns), F.lit(settings.seed))
    thin = normal.select(*[((x[c] - centre[c]) / spread[c]).alias(c) for c in names], hashed.alias("_h"))
    if share < 1.0:
        thin = thin.where(F.pmod("_h", F.lit(1_000_000)) < int(share * 1_000_000) + 1)
    # a small table lends its rows to several trees
    dealt = thin.withColumn("_copy", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))
    dealt = dealt.withColumn("_tree", F.pmod(F.xxhash64("_h", "_copy", F.lit(1)), F.lit(settings.trees)).cast("int"))
    w = Window.partitionBy("_tree").orderBy(F.xxhash64("_h", "_copy", F.lit(2)), "_h", "_copy")
    sample = dealt.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= settings.sample).drop("_k", "_h", "_copy")
    depth = math.ceil(math.log2(max(settings.sample, 2)))
    seed = settings.seed

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        tree = int(pdf["_tree"].iloc[0])
        rows = pdf[names].to_numpy(dtype=float)
        rows = rows[np.lexsort(rows.T)]  # order of arrival must not matter
        nodes = grow(rows, np.random.default_rng([seed, tree]), depth)
        return pd.DataFrame({"tree": [tree], "nodes": [[[float(v) for v in n] for n in nodes]]})

    built = sample.groupBy("_tree").applyInPandas(build, "tree int, nodes array<array<double>>").orderBy("tree").collect()
    trees = [[(int(f), cut, int(lo), int(hi), length) for f, cut, lo, hi, length in row["nodes"]] for row in built]
    forest = Forest(trees, names, centre, spread, settings.sample)
    scored = forest.with_samples(normal, "_sample").select("_sample").persist()
    try:
        forest.score_centre = float(exact_quantiles(scored, [], "_sample", {"m": 0.5}).first()["m"] or 0.0)
        deviation = scored.agg(F.stddev_pop("_sample")).first()[0]
    finally:
        scored.unpersist()
    forest.score_scale = float(deviation) if deviation and deviation > 1e-6 else 1.0
    return forest
