"""Classifier training, cross-validation and batch scoring with Spark ML."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterable, Iterator, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LinearSVC, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark import cloudpickle, inheritable_thread_target
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.metrics import CV_KEYS, binary_metrics, fold_sizes, fold_summary
from ..operators.sampling import group_folds
from . import forest, iforest
from .ensemble import from_decision, from_decisions, from_labels, from_samples, member_weights

Builder = Callable[[Sequence[str], str | None], Pipeline]


def _stages(features: Sequence[str], estimator, scale: bool) -> Pipeline:
    assembler = VectorAssembler(inputCols=list(features), outputCol="raw_features" if scale else "features", handleInvalid="keep")
    steps = [assembler]
    if scale:
        steps.append(StandardScaler(inputCol="raw_features", outputCol="features", withMean=True, withStd=True))
    return Pipeline(stages=[*steps, estimator])


def _weighted(estimator, weight: str | None):
    return estimator.setWeightCol(weight) if weight else estimator


def logistic(max_iter: int = 100, scale: bool = True) -> Builder:
    return lambda features, weight: _stages(features, _weighted(LogisticRegression(labelCol="target", maxIter=max_iter), weight), scale)


def linear_svm(max_iter: int = 100) -> Builder:
    """A model that offers decision values but no probability."""
    return lambda features, weight: _stages(features, _weighted(LinearSVC(labelCol="target", maxIter=max_iter), weight), True)


def random_forest(trees: int = 100, depth: int = 10, seed: int = 42) -> Builder:
    """A forest that keeps each row's node in every tree, so that a pass does not walk all trees from their roots again."""
    return lambda features, weight: _stages(
        features, _weighted(RandomForestClassifier(labelCol="target", numTrees=trees, maxDepth=depth, seed=seed,
                                                   cacheNodeIds=True, checkpointInterval=-1), weight), False)


def boosted(rounds: int = 50, depth: int = 5, step: float = 0.1, sample: float = 0.8, seed: int = 42) -> Builder:
    return lambda features, weight: _stages(
        features, _weighted(GBTClassifier(labelCol="target", maxIter=rounds, maxDepth=depth, stepSize=step, subsamplingRate=sample, seed=seed), weight), False)


def balanced_weights(df: DataFrame, out: str = "weight", label: str = "target") -> DataFrame:
    """Weight each row by ``n / (2 n_class)``, so that both classes count the same."""
    sizes = df.agg(F.struct(F.count(F.lit(1)).alias("n"), F.greatest(F.sum(label), F.lit(1)).alias("p"))).scalar()
    df = df.withColumn("_sizes", sizes)
    n, p = F.col("_sizes.n"), F.col("_sizes.p")
    weight = n / (2.0 * F.when(F.col(label) == 1, p).otherwise(F.greatest(n - p, F.lit(1))))
    return df.withColumn(out, weight).drop("_sizes")


def positive_weights(df: DataFrame, base: str | None = None, out: str = "weight", label: str = "target") -> DataFrame:
    """Weight positives by negatives per positive, on top of a row weight if there is one."""
    sizes = df.agg(F.struct(F.count(F.lit(1)).alias("n"), F.greatest(F.sum(label), F.lit(1)).alias("p"))).scalar()
    row = F.col(base) if base else F.lit(1.0)
    df = df.withColumn("_sizes", sizes)
    factor = F.greatest(F.col("_sizes.n") - F.col("_sizes.p"), F.lit(1)) / F.col("_sizes.p")
    return df.withColumn(out, row * F.when(F.col(label) == 1, factor).otherwise(1.0)).drop("_sizes")


class Majority:
    """Baseline: the most frequent label for every row."""

    def __init__(self, label: int):
        self.label = label

    @classmethod
    def fit(cls, df: DataFrame) -> Majority:
        return cls(int(df.agg(F.mode("target")).first()[0]))

    def score(self, df: DataFrame) -> DataFrame:
        return df.withColumn("leak_score", F.lit(float(self.label)))


def leak_score(df: DataFrame) -> Column:
    return vector_to_array("probability")[1]


def score(model, df: DataFrame, features: Sequence[str] | None = None) -> DataFrame:
    """Add ``leak_score`` from what the model offers, in this order: a probability, decision values (softmax over more than
    two), a hard label, a way to score a frame, sample scores of which the lowest are the oddest.

    Feature columns the frame lacks count as 0, as in training on a subset.
    """
    if features is not None:
        df = df.withColumns({c: F.lit(0.0) for c in features if c not in df.columns})
    if isinstance(model, PipelineModel):
        names = df.columns
        out = model.transform(df)
        if "probability" in out.columns:
            value = leak_score(df)
        elif "rawPrediction" in out.columns:
            raw = vector_to_array("rawPrediction")
            value = F.when(F.size(raw) > 2, from_decisions(raw)).otherwise(from_decision(raw[1]))
        else:
            value = from_labels(F.col("prediction"))
        return out.select(*names, value.alias("leak_score"))
    if hasattr(model, "score"):
        return model.score(df)
    return from_samples(model.with_samples(df, "_raw"), "_raw", "leak_score").drop("_raw")


NO_WAY = "no way to score"


def scores_or_reasons(models: Mapping[str, object], df: DataFrame, ids: Sequence[str], features: Sequence[str]) -> DataFrame:
    """All models over one scan: ``ids, model_name, leak_score, reason``, one row per input row and model.

    Models that work on frames add a column each to the same plan. Models with ``predict`` (a pandas frame of the
    features gives scores) share one broadcast registry and one pass over Arrow batches; where one of them fails on a
    batch, the rows of that batch have no score from it but a reason. A model that cannot be planned on this frame, or
    offers nothing to score by, has a reason on every row. No job runs before the result is asked for.
    """
    values: dict[str, Column] = {}
    batch = {n: m for n, m in models.items() if not _frames(m) and hasattr(m, "predict")}
    frame = df.withColumns({c: F.lit(0.0) for c in features if c not in df.columns})
    if "leak_score" not in ids:
        frame = frame.drop("leak_score")
    for i, (name, model) in enumerate(models.items()):
        why = NO_WAY
        if _frames(model):
            try:
                frame = score(model, frame).withColumnRenamed("leak_score", f"_score{i}")
                values[name] = F.struct(F.col(f"_score{i}").cast("double").alias("leak_score"), F.lit(None).cast("string").alias("reason"))
                continue
            except Exception as error:
                why = str(error).splitlines()[0]
        if name not in batch:
            values[name] = F.struct(F.lit(None).cast("double").alias("leak_score"), F.lit(why).alias("reason"))
    if batch:
        frame = frame.withColumn("_batch", _predictions(frame.sparkSession, batch, list(features))(F.struct(*[F.col(c).cast("double") for c in features])))
        values |= {n: F.struct(F.col(f"_batch.s{i}").alias("leak_score"), F.col(f"_batch.r{i}").alias("reason")) for i, n in enumerate(batch)}
    long = F.explode(F.array(*[F.struct(F.lit(n).alias("model_name"), values[n].alias("v")) for n in models]))
    out = frame.select(*ids, long.alias("_m"))
    return out.select(*ids, "_m.model_name", "_m.v.leak_score", "_m.v.reason")


def _frames(model) -> bool:
    return isinstance(model, PipelineModel) or hasattr(model, "score") or hasattr(model, "with_samples")


def _predictions(spark: SparkSession, models: Mapping[str, object], features: list[str]):
    """A pandas UDF from a struct of features to a score and a reason per model."""
    shared = spark.sparkContext.broadcast(cloudpickle.dumps(list(models.values())))
    kind = ", ".join(f"s{i} double, r{i} string" for i in range(len(models)))

    @F.pandas_udf(kind)
    def predicted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        registry = pickle.loads(shared.value)
        for rows in batches:
            rows.columns = features
            out = {}
            for i, model in enumerate(registry):
                try:
                    scores, reason = np.asarray(model.predict(rows.copy()), dtype=float), None
                    if scores.shape != (len(rows),):
                        raise ValueError(f"{len(rows)} rows but scores of shape {scores.shape}")
                except Exception as error:
                    scores, reason = np.full(len(rows), np.nan), str(error) or type(error).__name__
                out[f"s{i}"] = pd.Series(scores, dtype="Float64").mask(np.isnan(scores))
                out[f"r{i}"] = pd.Series([reason] * len(rows), dtype=object)
            yield pd.DataFrame(out)

    return predicted


def score_all(models: Mapping[str, object], df: DataFrame, ids: Sequence[str], features: Sequence[str]) -> DataFrame:
    """Long score table of every model, as ``scores_or_reasons`` gives it; what has a reason instead of a score is left out."""
    if not any(_frames(m) or hasattr(m, "predict") for m in models.values()):
        raise ValueError("no model supports scoring")
    return scores_or_reasons(models, df, ids, features).where(F.col("reason").isNull()).drop("reason")


def fit(builder, train: DataFrame, features: Sequence[str], weight: str | None):
    """Fit a Spark ML builder, the isolation forest, or the majority baseline; forests are grown by ``ml.forest``."""
    if builder == "majority":
        return Majority.fit(train)
    if isinstance(builder, iforest.Settings):
        return iforest.fit(train, features, builder)
    pipeline = builder(features, weight)
    if settings := forest.settings_of(pipeline.getStages()[-1]):
        return forest.fit(train, features, weight, settings)
    return pipeline.fit(train)


def cross_validate(
    df: DataFrame, builders: Mapping[str, object], features: Sequence[str], fold: str = "fold", weight: str | None = None, k: int = 5,
) -> DataFrame:
    """Metrics per model and fold.

    The columns that fits read are kept once, in as many partitions as there are rows for, and fits of all models and
    folds run side by side: each is a chain of small jobs, whose gaps the others fill. Every job is distributed.
    """
    data = kept_for_fits(df.select(fold, "target", *([weight] if weight else []), *features))
    try:
        return folds_and_models(data, builders, features, fold, weight, k)[0]
    finally:
        data.unpersist()


def folds_and_models(
    data: DataFrame, builders: Mapping[str, object], features: Sequence[str], fold: str, weight: str | None, k: int, whole: bool = False,
) -> tuple[DataFrame, dict[str, object]]:
    """Metrics per model and fold over rows kept for fits, and with ``whole`` each model fitted on all of them."""
    def run(task: tuple[int | None, str]):
        i, name = task
        model = fit(builders[name], data if i is None else data.where(F.col(fold) != i), features, weight)
        if i is None:
            return model
        return score(model, data.where(F.col(fold) == i), features).select(F.lit(name).alias("model_name"), fold, "target", "leak_score")

    # the slowest family first, so that no long fit is left to the end
    order = [(i, name) for name in reversed(list(builders)) for i in [*([None] if whole else []), *range(k)]]
    done = dict(zip(order, side_by_side(data, run, order)))
    scored = reduce(DataFrame.unionByName, [out for (i, _), out in done.items() if i is not None])
    return measured(scored, ["model_name", fold]), {name: model for (i, name), model in done.items() if i is None}


#: Fits that run at the same time at most, rows that make a partition worth a task in the many small jobs of a fit, and
#: how many times as many a task takes where there are more partitions than cores.
SIDE_BY_SIDE, ROWS_PER_TASK, BEYOND_CORES = 16, 100_000, 5


def kept_for_fits(df: DataFrame) -> DataFrame:
    """The frame persisted for many passes, in no more partitions than its rows are worth.

    Every task of a forest's pass sends on the counts of all nodes, and every task of an iteration costs its start, so
    once each core has a partition, further rows make partitions larger before they make more of them.
    """
    data = df.persist()
    parts = fit_partitions(data.count(), df.sparkSession.sparkContext.defaultParallelism)
    if parts >= data.rdd.getNumPartitions():
        return data
    fewer = data.coalesce(parts).persist()
    fewer.count()
    data.unpersist()
    return fewer


def fit_partitions(rows: int, cores: int) -> int:
    return max(1, min(cores, -(-rows // ROWS_PER_TASK)), -(-rows // (BEYOND_CORES * ROWS_PER_TASK)))


def side_by_side(data: DataFrame, run: Callable, tasks: Iterable) -> list:
    """Results of ``run`` for all tasks in order, each in a scheduler pool of its own.

    As many run at the same time as leave no core idle: one fit of a large table fills all cores, and what several keep
    in memory at once would be pushed to disk.
    """
    spark = data.sparkSession
    free = -(-2 * spark.sparkContext.defaultParallelism // data.rdd.getNumPartitions())

    def pooled(task):
        spark.sparkContext.setLocalProperty("spark.scheduler.pool", f"telemill-{abs(hash(task)) % SIDE_BY_SIDE}")
        return run(task)

    with ThreadPoolExecutor(max(1, min(SIDE_BY_SIDE, free))) as pool:
        return list(pool.map(inheritable_thread_target(spark)(pooled), tasks))


def measured(scored: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Metric bundle of a score table, which is kept while it is measured so that models run once.

    The result has one row per key, i.e. per model and fold.
    """
    scored = scored.persist()
    try:
        out = binary_metrics(scored, "leak_score", "target", keys)
        return measured_once(out)
    finally:
        scored.unpersist()


def measured_once(one: DataFrame) -> DataFrame:
    """A table of few rows computed now, so that what it came from can be let go."""
    return one.sparkSession.createDataFrame(one.collect(), one.schema)


def cv_summary(folds: DataFrame) -> DataFrame:
    return fold_summary(folds, ["model_name"], CV_KEYS)


def train_all(
    df: DataFrame, builders: Mapping[str, object], features: Sequence[str], group: str, weight: str | None = None, k: int = 5,
) -> dict:
    """Full training job: group folds, cross-validation, refit on all rows, ensemble weights.

    ``df`` carries features, ``target`` and ``group``; it is cached once for all fits.
    """
    data = kept_for_fits(group_folds(df, group, k).select(group, "fold", "target", *([weight] if weight else []), *features))
    try:
        folds, models = folds_and_models(data, builders, features, "fold", weight, k, whole=True)
        summary = cv_summary(folds)
        metrics = summary.select("model_name", F.col("roc_auc_cv_mean").alias("roc_auc"), F.col("f1_cv_mean").alias("f1"))
        return {"models": models, "summary": measured_once(summary),
                "weights": df.sparkSession.createDataFrame(member_weights(metrics).collect(), "model_name string, weight double"),
                "fold_sizes": measured_once(fold_sizes(data, "fold", group))}
    finally:
        data.unpersist()


def benchmark(train: DataFrame, test: DataFrame, features: Sequence[str], trees: int = 100) -> DataFrame:
    """Baseline comparison on one split: majority, logistic, forest, and isolation forest where one class dominates.

    Fewer than 100 rows are not worth comparing: nothing is fitted and the result is empty. A table without a ``target``
    column gets the isolation forest alone, whatever its size, measured against labels of 0.
    """
    if "target" not in train.columns:
        model = iforest.fit(train, features, iforest.Settings(trees=100), label=None)
        scored = score(model, test.withColumn("target", F.lit(0)), features)
        return measured(scored.select(F.lit("isolation_forest").alias("model_name"), "target", "leak_score"), ["model_name"])
    sizes = train.unionByName(test).agg(F.count(F.lit(1)).alias("n"), F.avg("target").alias("rate")).first()
    if sizes["n"] < 100:
        return measured(Majority(0).score(test.limit(0)).select(F.lit("majority").alias("model_name"), "target", "leak_score"), ["model_name"])
    builders: dict[str, object] = {"majority": "majority", "logistic_regression": logistic(), "random_forest": random_forest(trees)}
    rate = sizes["rate"] or 0.0
    if max(rate, 1.0 - rate) > 0.95:
        builders["isolation_forest"] = iforest.Settings(trees=100)
    weighted = kept_for_fits(balanced_weights(train).select("target", "weight", *features))

    def run(name: str) -> DataFrame:
        model = fit(builders[name], weighted, features, "weight")
        return score(model, test, features).select(F.lit(name).alias("model_name"), "target", "leak_score")

    try:
        return measured(reduce(DataFrame.unionByName, side_by_side(weighted, run, list(builders))), ["model_name"])
    finally:
        weighted.unpersist()


def transfer(models: Mapping[str, object], domain: DataFrame, features: Sequence[str], fold: str = "fold") -> DataFrame:
    """Fixed models on a new domain: metrics per fold and, as fold -1, over all rows."""
    rows = domain.withColumns({c: F.coalesce(F.col(c) if c in domain.columns else F.lit(0.0), F.lit(0.0)) for c in features})
    scored = score_all(models, rows, [fold, "target"], features)
    # each row counts in its fold and in all of them
    both = scored.withColumn(fold, F.explode(F.array(F.col(fold), F.lit(-1))))
    return measured(both, ["model_name", fold])


__all__ = ["benchmark", "boosted", "cross_validate", "cv_summary", "fit", "linear_svm", "logistic", "random_forest", "score",
           "score_all", "scores_or_reasons", "train_all", "transfer"]
