"""Forests grown from counts per block: same splits as by hand, same forest however it is counted, as good as Spark's."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from telemill.ml import forest
from telemill.ml import train as tr
from telemill.operators.metrics import roc_auc

FEATURES = ["x", "y", "z"]


@pytest.fixture(scope="module")
def points(spark):
    df = spark.range(3000, numPartitions=6).select("id", F.randn(1).alias("x"), F.randn(2).alias("y"), (F.col("id") % 3).cast("double").alias("z"))
    label = (F.col("x") * F.col("y") > 0.3) | (F.col("z") == 2)
    return df.select("id", *FEATURES, label.cast("int").alias("target"), (1.0 + F.col("id") % 5 / 3.0).alias("w")).cache()


def test_the_best_split_is_the_one_found_by_hand():
    rng = np.random.default_rng(1)
    counts = rng.integers(0, 6, (2, 3, 2, 4)).astype(float)  # two features, three nodes, two labels, four bins
    subset = np.array([[0, 4], [1, 2], [3, 5]])

    def gini(w):
        return 1 - ((w / w.sum()) ** 2).sum()

    for node, row in enumerate(forest.best_splits(counts, subset)):
        gains = {}
        for place in range(2):
            c = counts[place, node]
            for at in range(3):
                left, right = c[:, :at + 1].sum(axis=1), c[:, at + 1:].sum(axis=1)
                if left.sum() and right.sum():
                    gains[place, at] = gini(c.sum(axis=1)) - (left.sum() * gini(left) + right.sum() * gini(right)) / c.sum()
        place, at = max(gains, key=gains.get)
        assert (row[0], row[1]) == (subset[node, place], at)
        assert np.allclose(row[2:4], counts[place, node, :, :at + 1].sum(axis=1)) and np.allclose(row[2:].sum(), counts[place, node].sum())
    pure = np.zeros((1, 1, 2, 4))
    pure[0, 0, 1] = 3
    assert forest.best_splits(pure, np.array([[0]]))[0, 0] == -1


def test_cuts():
    assert forest.cuts_of(np.array([0.0, 1.0, 1.0, np.nan, 4.0]), 32).tolist() == [0.5, 2.5]
    assert forest.cuts_of(np.array([7.0, 7.0]), 32).tolist() == [] == forest.cuts_of(np.array([np.nan]), 32).tolist()
    cuts = forest.cuts_of(np.arange(1000.0), 32)
    assert len(cuts) == 31 and set(np.diff(np.searchsorted(np.arange(1000.0), cuts))) <= {31, 32}


def test_fits_grow_the_same_forest_however_rows_are_counted(points, monkeypatch):
    fitted = [tr.fit(tr.random_forest(8, 5), points, FEATURES, "w")]
    assert isinstance(fitted[0], forest.Forest)  # Spark's forest before: 391 s a fold over 4.8 million rows
    monkeypatch.setattr(forest, "COUNTS_MB", 0)  # a job per tree
    monkeypatch.setattr(forest, "ROWS_PER_TASK", 500)
    fitted.append(tr.fit(tr.random_forest(8, 5), points, FEATURES, "w"))
    for name in ("feature", "cut", "positive"):
        assert np.array_equal(getattr(fitted[0], name), getattr(fitted[1], name))
    assert len({tuple(t) for t in fitted[0].positive}) == 8


def test_as_good_as_the_forest_of_spark(points):
    train, test = points.where("id % 4 > 0"), points.where("id % 4 = 0")
    build = tr.random_forest(20, 6)
    auc = [roc_auc(tr.score(m, test, FEATURES), "leak_score", "target").first().roc_auc for m in (tr.fit(build, train, FEATURES, "w"), build(FEATURES, "w").fit(train))]
    assert auc[0] > 0.95 and abs(auc[0] - auc[1]) < 0.02


def test_scores_walk_the_trees(points):
    model = tr.fit(tr.random_forest(3, 4), points, FEATURES, None)
    holes = points.withColumn("y", F.when(F.col("id") % 7 > 0, F.col("y")))
    for r in tr.score(model, holes, FEATURES).limit(200).collect():
        total, x = 0.0, [np.nan if r[c] is None else r[c] for c in FEATURES]
        for t in range(3):
            at = 1
            for _ in range(4):
                at = 2 * at + (not x[model.feature[t][at]] <= model.cut[t][at])
            total += model.positive[t][at - 16]
        assert abs(r.leak_score - total / 3) < 1e-12


def test_odd_labels_weights_and_columns(spark, points):
    one = tr.fit(tr.random_forest(3, 4), points.where("target = 1"), FEATURES, None)
    assert {r[0] for r in one.score(points).select("leak_score").distinct().collect()} == {1.0}
    three = points.withColumn("target", F.when(F.col("z") == 2, 2).otherwise(F.col("target")))
    scored = tr.score(tr.fit(tr.random_forest(5, 4), three, FEATURES, None), three, FEATURES)
    assert scored.where("z = 2").agg(F.avg("leak_score")).first()[0] < 0.1
    weightless = points.withColumn("w", F.when(F.col("target") == 1, 0.0).otherwise(2.0))
    assert {r[0] for r in tr.fit(tr.random_forest(3, 4), weightless, FEATURES, "w").score(points).select("leak_score").distinct().collect()} == {0.0}
    for wrong in (points.withColumn("target", F.lit(None).cast("int")), points.withColumn("target", F.lit(0.5)), points.limit(0)):
        with pytest.raises(ValueError):
            tr.fit(tr.random_forest(2, 2), wrong, FEATURES, None)
    with pytest.raises(ValueError):
        tr.fit(tr.random_forest(2, 2), points.withColumn("w", F.lit(-1.0)), FEATURES, "w")
    missing = tr.score_all({"forest": one}, points.drop("x"), ["id"], FEATURES)
    assert missing.count() == 3000


def test_what_it_cannot_grow_is_left_to_spark():
    deep = tr.random_forest(2, forest.DEEPEST + 1)(FEATURES, None).getStages()[-1]
    entropy = tr.random_forest(2, 2)(FEATURES, None).getStages()[-1].setImpurity("entropy")
    assert forest.settings_of(deep) is None is forest.settings_of(entropy)
    assert forest.settings_of(tr.random_forest()(FEATURES, "w").getStages()[-1]) == forest.Settings(100, 10, 32, 42)
