import random

from pyspark.sql import functions as F

from telemill.ml import ensemble as en
from telemill.operators import metrics as mt
from telemill.operators.series import Series
from telemill.plans import evaluate as ev

from .conftest import close, rows


def brute_auc(pairs):
    pos, neg = [s for s, y in pairs if y == 1], [s for s, y in pairs if y == 0]
    if not pos or not neg:
        return None
    return sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))


def test_auc_with_ties(spark):
    rng = random.Random(1)
    data = [(k, rng.randint(0, 9) / 10, rng.randint(0, 1)) for k in "ab" for _ in range(60)] + [("c", 0.5, 1), ("c", 0.1, 1)]
    df = spark.createDataFrame(data, "k string, s double, y int")
    got = rows(mt.roc_auc(df, "s", "y", ["k"]))
    close(got[:2], [(k, brute_auc([(s, y) for kk, s, y in data if kk == k])) for k in "ab"])
    assert got[2] == ("c", None)
    close(rows(mt.roc_auc(df, "s", "y")), [(brute_auc([d[1:] for d in data]),)])


def test_metrics_ignore_other_labels_and_zero_division(spark):
    df = spark.createDataFrame([(0.9, 2), (0.1, 1), (0.2, 0)], "s double, y int")
    r = mt.binary_metrics(df, "s", "y").first()
    assert (r.precision, r.recall, r.f1, r.accuracy, r.roc_auc) == (0.0, 0.0, 0.0, 0.5, 0.0)
    assert (r.tn, r.fp, r.fn, r.tp) == (1, 0, 1, 0)


def test_fold_summary_uses_population_deviation(spark):
    df = spark.createDataFrame([("m", 0.8, 0.9), ("m", 0.9, 0.8)], "model_name string, roc_auc double, f1 double")
    assert rows(mt.fold_summary(df, ["model_name"], ["roc_auc", "f1"])) == [("m", 0.85, 0.05, 0.85, 0.05)]


SCHEMA = "model_name string, run_id string, scenario_key string, step_index long, target int, leak_severity double, leak_score double"


def test_detection_counts_missed_runs(spark):
    data = [("m", "r1", "slow_seep", i, int(i >= 2), 0.5, s) for i, s in enumerate([0.9, 0.1, 0.1, 0.1, 0.8])]
    data += [("m", "r2", "slow_seep", i, 1, 0.5, 0.1) for i in range(3)] + [("m", "r3", "slow_seep", 0, 0, 0.0, 0.9)]
    out = ev.detection(ev.with_threshold(spark.createDataFrame(data, SCHEMA), 0.5))
    assert rows(out) == [("m", 2.0, 0.5)]


def test_stability_and_sensitivity(spark):
    data = [("m", "r", "micro_leak", i, 1, 0.9, s) for i, s in enumerate([0.9, 0.1, 0.9, 0.9])] + [("m", "n", "steady_state", 0, 0, 0.0, 0.9)]
    df = ev.with_threshold(spark.createDataFrame(data, SCHEMA), 0.5)
    series = Series(("model_name", "run_id"), ("step_index",))
    assert rows(ev.alert_stability(df, series)) == [("m", 0.5)]
    assert rows(ev.micro_sensitivity(df)) == [("m", 0.75)]  # no faint leak rows: micro-leak scenarios count
    table = ev.metric_table(df, series).first()
    assert table.fpr_steady_state == 1.0 and table.fpr_demand_shock is None and table.delay is None


def test_calibration_bounds(spark):
    low = spark.createDataFrame([("m", "r", "slow_seep", 0, 1, 0.1, 0.9)], SCHEMA)
    assert rows(ev.calibrate(low)) == [("m", 0.02)]
    high = spark.createDataFrame([("m", "r", k, i, 0, 0.0, 1.0) for k in ("steady_state", "demand_shock") for i in range(5)], SCHEMA)
    assert rows(ev.calibrate(high)) == [("m", 0.85)]


def test_leaderboard_puts_unknown_delay_last(spark):
    df = spark.createDataFrame([("a", 0.1, None), ("b", 0.1, 2.0), ("c", 0.0, None)], "model_name string, fpr_steady_state double, delay double")
    assert [r["model_name"] for r in ev.leaderboard(df).orderBy("rank").collect()] == ["c", "b", "a"]


def test_compare_runs_marks_best_once_per_path(spark):
    schema = f"path string, run_label string, best_model string, models {ev.SUMMARY_MODELS}"
    one = ("p1", "r1", None, {"x": (0.8, 0.9, 0.7, None), "y": (0.9, 0.8, None, 0.6)})
    two = ("p2", "r2", "x", {"x": (0.5, 0.5, 0.5, None), "y": (0.6, 0.5, 0.5, None)})
    out = ev.compare_runs(spark.createDataFrame([one, one, two], schema))
    got = [(r.run_label, r.model, r.f1, r.is_best_model) for r in out.collect()]
    assert got == [("r1", "y", 0.6, True), ("r1", "x", 0.7, False), ("r2", "y", 0.5, False), ("r2", "x", 0.5, True)]


def test_weighted_ensemble(spark):
    scores = spark.createDataFrame([(i, m, s) for i in range(3) for m, s in (("a", 0.2), ("b", 0.8))], "i int, model_name string, leak_score double")
    weights = spark.createDataFrame([("a", 1.0), ("b", 3.0)], "model_name string, weight double")
    close(rows(en.combine(scores, weights, ["i"])), [(i, 0.65, 1) for i in range(3)])
    zero = spark.createDataFrame([("a", 0.0), ("b", 0.0)], "model_name string, weight double")
    close(rows(en.combine(scores, zero, ["i"])), [(i, 0.5, 1) for i in range(3)])
    flat = spark.createDataFrame([("a", 0.0, 0.0), ("b", None, -1.0)], "model_name string, roc_auc double, f1 double")
    assert rows(en.member_weights(flat)) == [("a", 0.5), ("b", 0.5)]


def test_score_ladder(spark):
    df = spark.createDataFrame([(0, -1.0), (1, 1.0), (2, -1.0)], "i int, v double")
    assert [r[0] for r in df.orderBy("i").select(en.outlier_label(F.col("v"))).collect()] == [1, 0, 1]
    assert [r[0] for r in df.orderBy("i").select(en.from_labels(F.col("v"))).collect()] == [0.0, 1.0, 0.0]
    flat = en.from_samples(df.withColumn("v", F.lit(3.0)), "v", "p")
    assert {r["p"] for r in flat.collect()} == {0.0}
    p = df.select(en.from_decisions(F.array("v", F.lit(0.5)), 0).alias("a"), en.from_decisions(F.array("v", F.lit(0.5)), 1).alias("b"))
    assert all(abs(r.a + r.b - 1) < 1e-12 for r in p.collect())
