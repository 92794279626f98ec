import numpy as np
import pytest
from pyspark.sql import functions as F

from telemill.ml import iforest
from telemill.ml import train as tr
from telemill.operators.metrics import roc_auc
from telemill.operators.sampling import group_folds

FEATURES = ["x", "y"]


@pytest.fixture(scope="module")
def points(spark):
    """Two overlapping clouds in 40 groups; positives lie further out."""
    df = spark.range(1200).select(
        F.col("id"), (F.col("id") % 40).alias("g"), F.randn(1).alias("a"), F.randn(2).alias("b"))
    df = df.withColumn("target", (F.col("g") % 4 == 0).cast("int"))
    return df.select("id", "g", "target", (F.col("a") + 3 * F.col("target")).alias("x"), (F.col("b") - 2 * F.col("target")).alias("y")).cache()


def test_cross_validation(points):
    folds = group_folds(points, "g", 3)
    out = tr.cross_validate(folds, {"logistic": tr.logistic(30), "forest": tr.random_forest(5, 4), "boosted": tr.boosted(3, 3), "majority": "majority"}, FEATURES, k=3)
    got = {(r.model_name, r.fold): r for r in out.collect()}
    assert len(got) == 12
    for (name, _), r in got.items():
        assert r.roc_auc == 0.5 if name == "majority" else r.roc_auc > 0.9
        assert 340 <= r.tn + r.fp + r.fn + r.tp <= 460
    summary = {r.model_name: r for r in tr.cv_summary(out).collect()}
    assert summary["logistic"].roc_auc_cv_mean > 0.9 and summary["logistic"].roc_auc_cv_std < 0.1


def test_isolation_forest_finds_the_outlying_class(points):
    settings = iforest.Settings(trees=30, sample=64)
    model = iforest.fit(points, FEATURES, settings, key=["id"])
    assert len(model.trees) == 30
    scored = model.score(points)
    auc = roc_auc(scored, "leak_score", "target").first().roc_auc
    assert auc > 0.85  # higher means more anomalous
    normal = np.array([r.leak_score for r in scored.where("target = 0").collect()])
    assert abs(np.median(normal) - 0.5) < 0.01
    again = iforest.fit(points.repartition(3), FEATURES, settings, key=["id"])
    assert [[n[0] for n in t] for t in again.trees] == [[n[0] for n in t] for t in model.trees]


def test_isolation_forest_on_few_rows_and_without_normals(points):
    few = points.where("id < 20")
    assert iforest.fit(few, FEATURES, iforest.Settings(trees=5, sample=16)).score(few).count() == 20
    only = points.where("target = 1")
    assert iforest.fit(only, FEATURES, iforest.Settings(trees=5, sample=16)).score(only).count() == only.count()


def test_training_job_and_scoring(points):
    job = tr.train_all(points, {"logistic": tr.logistic(20), "forest": tr.random_forest(5, 3)}, FEATURES, "g", k=3)
    weights = {r.model_name: r.weight for r in job["weights"].collect()}
    assert abs(sum(weights.values()) - 1) < 1e-9 and len(weights) == 2
    sizes = job["fold_sizes"].first()
    assert (sizes.avg_train_rows, sizes.avg_test_rows, sizes.avg_test_scenarios) == (800, 400, 13)
    long = tr.score_all({**job["models"], "nothing": object()}, points.drop("y"), ["id"], FEATURES)
    assert {r.model_name for r in long.select("model_name").distinct().collect()} == {"logistic", "forest"}
    assert long.agg(F.min("leak_score"), F.max("leak_score")).first()[1] <= 1.0


def test_benchmark(points):
    out = tr.benchmark(points.where("g < 30"), points.where("g >= 30"), FEATURES, trees=5)
    assert {r.model_name for r in out.collect()} == {"majority", "logistic_regression", "random_forest"}
    rare = points.where((F.col("target") == 0) | (F.col("id") < 60))
    out = tr.benchmark(rare.where("g < 30"), rare.where("g >= 30"), FEATURES, trees=5)
    assert "isolation_forest" in {r.model_name for r in out.collect()}
    assert tr.benchmark(points.where("id < 40"), points.where("id between 40 and 60"), FEATURES, trees=2).count() == 0


def test_weights(points):
    total = {r.target: r.w for r in tr.balanced_weights(points).groupBy("target").agg(F.sum("weight").alias("w")).collect()}
    assert abs(total[0] - total[1]) < 1e-6
    total = {r.target: r.w for r in tr.positive_weights(points).groupBy("target").agg(F.sum("weight").alias("w")).collect()}
    assert abs(total[0] - total[1]) < 1e-6


def test_transfer(points):
    model = tr.fit(tr.logistic(20), points, FEATURES, None)
    out = tr.transfer({"logistic": model}, group_folds(points, "g", 3), FEATURES)
    assert sorted(r.fold for r in out.collect()) == [-1, 0, 1, 2]


class Odd:
    """Offers sample scores alone."""

    def with_samples(self, df, out):
        return df.withColumn(out, -F.abs("x"))


class Unplannable:
    def score(self, df):
        return df.withColumn("leak_score", F.col("no_such_column"))


def steady(limit):
    class Steady:
        def predict(self, rows):
            if rows["x"].max() > limit:
                raise ValueError("out of range")
            return rows["x"] * 0 + len(rows.columns)

    return Steady()


def test_all_models_over_one_scan_with_reasons(spark, points):
    three = points.withColumn("target", F.pmod("id", F.lit(3)).cast("int"))
    models = {"logistic": tr.fit(tr.logistic(20), points, FEATURES, None), "classes": tr.fit(tr.logistic(20), three, FEATURES, None),
              "odd": Odd(), "plan": Unplannable(), "none": object(), "fine": steady(1e9), "partly": steady(2.0)}
    df = points.drop("y").repartition(40)
    out = tr.scores_or_reasons(models, df, ["id"], FEATURES).cache()
    assert out.count() == 1200 * len(models)
    by = {r["model_name"]: r for r in out.groupBy("model_name").agg(F.count("leak_score").alias("n"), F.count("reason").alias("w"), F.first("reason", True).alias("why"),
                                                                    F.min("leak_score").alias("lo"), F.max("leak_score").alias("hi")).collect()}
    for name in ("logistic", "classes", "odd", "fine"):
        assert (by[name]["n"], by[name]["w"]) == (1200, 0)
    assert (by["odd"]["lo"], by["odd"]["hi"]) == (0.0, 1.0) and by["fine"]["hi"] == 2.0
    assert by["none"]["why"] == tr.NO_WAY and by["none"]["w"] == by["plan"]["w"] == 1200 and "no_such_column" in by["plan"]["why"]
    assert by["partly"]["n"] + by["partly"]["w"] == 1200 and by["partly"]["w"] > 0 and by["partly"]["why"] == "out of range"
    assert out.where("leak_score IS NULL AND reason IS NULL OR leak_score IS NOT NULL AND reason IS NOT NULL").isEmpty()
    kept = tr.score_all(models, df, ["id"], FEATURES)
    assert {r[0] for r in kept.select("model_name").distinct().collect()} >= {"logistic", "classes", "odd", "fine"}
    with pytest.raises(ValueError):
        tr.score_all({"none": object()}, df, ["id"], FEATURES)


def test_forest_walks_as_tree_by_tree(points):
    forest = iforest.fit(points, FEATURES, iforest.Settings(trees=20, sample=64))
    got = {r["id"]: r["s"] for r in forest.with_samples(points, "s").select("id", "s").collect()}
    norm = iforest.mean_path(64) * 20
    for r in points.limit(100).collect():
        x = [(r[c] - forest.centre[c]) / forest.spread[c] for c in FEATURES]
        total = 0.0
        for tree in forest.trees:
            node = tree[0]
            while node[0] >= 0:
                node = tree[node[2] if x[node[0]] < node[1] else node[3]]
            total += node[4]
        assert abs(got[r["id"]] + 2.0 ** (-total / norm)) < 1e-12
    normal = forest.with_samples(points.where("target = 0"), "s").toPandas()["s"]
    assert abs(forest.score_centre - normal.median()) < 1e-12


def test_a_forest_keeps_the_nodes_of_rows_and_grows_the_same_trees(points):
    pipeline = tr.random_forest(4, 5)(FEATURES, None)
    forest = pipeline.getStages()[-1]
    assert forest.getCacheNodeIds() and forest.getCheckpointInterval() == -1
    trees = [m.stages[-1].toDebugString.split("\n", 1)[1] for m in (pipeline.fit(points), pipeline.copy({forest.cacheNodeIds: False}).fit(points))]
    assert trees[0] == trees[1]


def test_partitions_of_fits_follow_cores_first():
    rows = [0, 50_000, 100_001, 1_000_000, 4_000_000, 36_000_000]
    assert [tr.fit_partitions(n, 12) for n in rows] == [1, 1, 2, 10, 12, 72]  # a partition per 100,000 rows before: 360
