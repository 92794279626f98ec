"""Scores and metrics as the registered queries return them; the audit queries beside them are compared with SQL."""

from pyspark.sql import functions as F

from queries import QUERIES, models
from telemill.ml import train as tr
from telemill.operators import features as ft
from telemill.operators.metrics import binary_metrics

BUNDLE = ["accuracy", "precision", "recall", "f1", "roc_auc"]


def test_all_features_are_fitted():
    assert set(models.FEATURES) == {"pressure", "flow_rate", *ft.FEATURES} and len(models.FEATURES) == 33


def test_batch_scores_are_returned(spark, data):
    out = QUERIES["batch_leak_scores"](spark, data).cache()
    assert out.columns == ["seq", "segment_id", "target", "model_name", "leak_score"]
    auc = {r.model_name: r.roc_auc for r in binary_metrics(out, "leak_score", "target", ["model_name"]).collect()}
    # a fitted model ranks the rows it was fitted on better than chance; constant or inverted scores would not
    assert auc["majority"] == 0.5 and auc["logistic"] > 0.55
    spread = {r.model_name: r.d for r in out.groupBy("model_name").agg(F.countDistinct("leak_score").alias("d")).collect()}
    assert spread["majority"] == 1 and spread["logistic"] > 100 and spread["svm"] > 100
    out.unpersist()


def test_isolation_scores_are_returned(spark, data):
    out = QUERIES["isolation_forest_leak_scores"](spark, data)
    assert out.columns == ["seq", "target", "leak_score"]
    low, high, n = out.agg(F.min("leak_score"), F.max("leak_score"), F.countDistinct("leak_score")).first()
    assert 0 <= low < 0.3 and 0.7 < high <= 1 and n > 100


def test_transfer_metrics_are_returned(spark, data):
    out = QUERIES["transfer_fold_metrics"](spark, data)
    assert {"model_name", "fold", *BUNDLE} <= set(out.columns)
    assert sorted(r.fold for r in out.collect()) == [-1, 0, 1, 2, 3, 4]


def test_settings_are_the_defaults(monkeypatch, spark, data):
    """What reaches the training job and cross-validation, caught before any fit."""
    caught = {}
    monkeypatch.setattr(tr, "train_all", lambda df, builders, features, *a, k: caught.update(job=(builders, features, k)))
    monkeypatch.setattr(tr, "cross_validate", lambda df, builders, features, weight, k: caught.update(cv=(builders, features, k)))
    monkeypatch.setattr(tr, "benchmark", lambda train, test, features, trees=100: caught.update(bench=({}, features, trees)))
    models.trained(spark, data, 5)
    QUERIES["cross_validated_metrics"](spark, data)
    QUERIES["benchmark_metrics"](spark, data)
    assert caught["bench"][1:] == (models.FEATURES, 100)
    for name in ("job", "cv"):
        builders, features, k = caught[name]
        assert features == models.FEATURES and k == 5
        forest = builders["forest"](features, None).getStages()[-1]
        assert (forest.getNumTrees(), forest.getMaxDepth()) == (100, 10)
    boosted = caught["cv"][0]["boosted"](models.FEATURES, None).getStages()[-1]
    assert (boosted.getMaxIter(), boosted.getMaxDepth()) == (50, 5)


def test_benchmark_without_labels(spark):
    points = spark.range(300).select("id", F.randn(1).alias("x"), F.randn(2).alias("y"))
    out = tr.benchmark(points.where("id < 240"), points.where("id >= 240"), ["x", "y"]).collect()
    assert [r.model_name for r in out] == ["isolation_forest"]
    assert out[0].tn + out[0].fp == 60 and out[0].fn + out[0].tp == 0
