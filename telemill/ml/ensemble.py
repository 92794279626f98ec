"""Turning raw model outputs into probabilities, and weighted ensembles over the long score table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import clip, sigmoid
from ..operators.keys import join_keys


def from_decision(value: Column) -> Column:
    """Probability from a decision value."""
    return sigmoid(value)


def from_decisions(values: Column, index: int = 1) -> Column:
    """Softmax over an array of decision values, one class picked."""
    top = F.array_max(values)
    exps = F.transform(values, lambda v: F.exp(v - top))
    total = F.aggregate(exps, F.lit(0.0), lambda a, v: a + v)
    return exps[index] / total


def from_samples(df: DataFrame, raw: str, out: str, keys: Sequence[str] = ()) -> DataFrame:
    """Anomaly score from sample scores (lower means odder), scaled to [0, 1] over the whole table per key."""
    bounds = F.struct(F.min(-F.col(raw)).alias("lo"), F.max(-F.col(raw)).alias("hi")).alias("_b")
    df = join_keys(df, df.groupBy(*keys).agg(bounds), keys)
    lo, hi = F.col("_b.lo"), F.col("_b.hi")
    return df.withColumn(out, F.when(hi > lo, (-F.col(raw) - lo) / (hi - lo)).otherwise(0.0)).drop("_b")


def from_labels(value: Column) -> Column:
    """Probability from a hard label."""
    return clip(value.cast("double"), 0.0, 1.0)


def outlier_label(value: Column) -> Column:
    """-1 (outlier) becomes 1, 1 becomes 0."""
    return F.when(value == -1, 1).otherwise(0)


def anomaly_probability(value: Column, centre: Column, scale: Column) -> Column:
    """How far below the centre of normal scores a sample score lies, as a probability."""
    return sigmoid((centre - value) / F.when(scale > 1e-6, scale).otherwise(1.0))


def member_weights(metrics: DataFrame) -> DataFrame:
    """Weights ``0.7 AUC + 0.3 F1`` (at least 0) scaled to sum to 1; equal where they sum to 0."""
    value = F.greatest(0.7 * F.coalesce("roc_auc", F.lit(0.0)) + 0.3 * F.coalesce("f1", F.lit(0.0)), F.lit(0.0))
    scored = metrics.select("model_name", value.alias("_v"))
    total = scored.agg(F.struct(F.sum("_v").alias("v"), F.count(F.lit(1)).alias("n"))).scalar()
    scored = scored.withColumn("_t", total)
    share = F.when(F.col("_t.v") > 0, F.col("_v") / F.col("_t.v")).otherwise(1.0 / F.col("_t.n"))
    return scored.select("model_name", share.alias("weight"))


def combine(scores: DataFrame, weights: DataFrame, keys: Sequence[str], threshold: float = 0.5) -> DataFrame:
    """Weighted mean score per row key (models as rows), clipped to [0, 1], and its class.

    The weight table has one row per model.
    """
    joined = scores.join(F.broadcast(weights), "model_name")
    plain, total = F.avg("leak_score"), F.sum("weight")
    mean = F.when(total > 0, F.sum(F.col("weight") * F.col("leak_score")) / total).otherwise(plain)
    out = joined.groupBy(*keys).agg(clip(mean, 0.0, 1.0).alias("leak_score"))
    return out.withColumn("predicted", (F.col("leak_score") >= threshold).cast("int"))


def first_available(*scores: Column) -> Column:
    """Primary score, else the next, else 0."""
    return F.coalesce(*scores, F.lit(0.0))
