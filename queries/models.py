"""Training, scoring and ensembles.

Scores and metrics of fitted models come from queries without SQL; beside each stands an audit query, whose keys, counts,
label sums and bounds SQL can state.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from telemill.functions import r6
from telemill.ml import ensemble as en
from telemill.ml import iforest
from telemill.ml import train as tr
from telemill.operators import features as ft
from telemill.operators.sampling import group_folds, stratified_split
from telemill.operators.series import time_series
from telemill.plans.validation import validation_report
from telemill.sources import views

from .evaluation import bundle_sql
from .registry import SCORES, SHIPMENTS, TELEMETRY, query, r
from .runs import with_context

FEATURES = ["pressure", "flow_rate", *ft.FEATURES]


def featured(spark, folder):
    t = views.telemetry(spark, folder)
    out = ft.build_features(t, time_series(t, ["segment_id"]), ft.FEATURES, tick="tick")
    return out.select("seq", "segment_id", "target", "leak_severity", *FEATURES)


@query("majority_baseline", "M4", f"WITH {TELEMETRY} SELECT seq, CAST(CASE WHEN (SELECT mode(target) FROM telemetry) = 1 THEN 1.0 ELSE 0.0 END AS DOUBLE) AS leak_score FROM telemetry")
def majority_baseline(spark, folder):
    t = views.telemetry(spark, folder)
    return tr.Majority.fit(t).score(t).select("seq", "leak_score")


@query("score_ladder", "M7 M11", f"""
WITH {TELEMETRY}, x AS (SELECT seq, pressure / 50.0 - 1.0 AS d, CASE WHEN seq % 5 = 0 THEN -1 ELSE 1 END AS lab, flow_rate AS s FROM telemetry)
SELECT seq, {r('1.0 / (1.0 + exp(-d))', 'from_decision')}, {r('exp(d / 2) / (exp(-d) + exp(d / 2))', 'from_softmax')},
       {r('((-s) - (SELECT min(-s) FROM x)) / ((SELECT max(-s) FROM x) - (SELECT min(-s) FROM x))', 'from_samples')},
       CAST(greatest(least(s - 50.0, 1.0), 0.0) AS DOUBLE) AS from_label, CASE WHEN lab = -1 THEN 1 ELSE 0 END AS outlier FROM x""")
def score_ladder(spark, folder):
    t = views.telemetry(spark, folder)
    d, lab = F.col("pressure") / 50.0 - 1.0, F.when(F.col("seq") % 5 == 0, -1).otherwise(1)
    t = en.from_samples(t, "flow_rate", "from_samples")
    return t.select("seq", r6(en.from_decision(d)).alias("from_decision"), r6(en.from_decisions(F.array(-d, d / 2))).alias("from_softmax"),
                    r6("from_samples").alias("from_samples"), en.from_labels(F.col("flow_rate") - 50.0).alias("from_label"), en.outlier_label(lab).alias("outlier"))


@query("anomaly_probability", "M6", f"""
WITH {TELEMETRY}, st AS (SELECT median(-pressure) AS m, stddev_pop(-pressure) AS s FROM telemetry WHERE target = 0)
SELECT seq, {r('1.0 / (1.0 + exp(-((m + pressure) / CASE WHEN s > 1e-6 THEN s ELSE 1.0 END)))', 'leak_score')} FROM telemetry, st""")
def anomaly_probability(spark, folder):
    from telemill.operators.quantiles import exact_quantiles

    t = views.telemetry(spark, folder).withColumn("sample", -F.col("pressure"))
    normal = t.where(F.col("target") == 0)
    t = t.withColumns({"m": exact_quantiles(normal, [], "sample", {"m": 0.5}).scalar(), "s": normal.agg(F.stddev_pop("sample")).scalar()})
    return t.select("seq", r6(en.anomaly_probability(F.col("sample"), F.col("m"), F.col("s"))).alias("leak_score"))


_WEIGHTS = "wt AS (SELECT model_name, greatest(0.7 * roc_auc + 0.3 * f1, 0) / sum(greatest(0.7 * roc_auc + 0.3 * f1, 0)) OVER () AS weight FROM bundle)"


@query("ensemble_scores", "M8", f"""
WITH {SCORES}, {bundle_sql('scores', 'model_name')}, {_WEIGHTS}, e AS (SELECT seq, sum(weight * leak_score) / sum(weight) AS s FROM scores JOIN wt USING (model_name) GROUP BY seq)
SELECT seq, {r('greatest(least(s, 1), 0)', 'leak_score')}, CASE WHEN s >= 0.5 THEN 1 ELSE 0 END AS predicted FROM e""")
def ensemble_scores(spark, folder):
    from telemill.operators.metrics import binary_metrics

    s = views.scores(spark, folder)
    weights = en.member_weights(binary_metrics(s, "leak_score", "target", ["model_name"]))
    out = en.combine(s, weights, ["seq"])
    return out.select("seq", r6("leak_score").alias("leak_score"), "predicted")


@query("fallback_scores", "M12", f"""
WITH {TELEMETRY} SELECT seq, {r('coalesce(CASE WHEN seq % 2 = 0 THEN pressure / 200 END, CASE WHEN seq % 3 = 0 THEN flow_rate / 100 END, 0.0)', 'leak_score')} FROM telemetry""")
def fallback_scores(spark, folder):
    t = views.telemetry(spark, folder)
    first = F.when(F.col("seq") % 2 == 0, F.col("pressure") / 200)
    second = F.when(F.col("seq") % 3 == 0, F.col("flow_rate") / 100)
    return t.select("seq", r6(en.first_available(first, second)).alias("leak_score"))


def bounded(*columns: str):
    """Whether all of these columns lie between 0 and 1."""
    out = F.lit(True)
    for c in columns:
        out = out & F.coalesce(F.col(c).between(0.0, 1.0), F.lit(False))
    return out


BUNDLE = ("accuracy", "precision", "recall", "f1", "roc_auc")


def audited(metrics, keys):
    """Rows and positives behind each metric bundle, and whether its measures lie in their bounds."""
    return metrics.select(*keys, (F.col("tn") + F.col("fp") + F.col("fn") + F.col("tp")).alias("n"), (F.col("fn") + F.col("tp")).alias("positives"), bounded(*BUNDLE).alias("bounded"))


_FITTED: dict[tuple, object] = {}


def once(spark, *key, make):
    """What ``make`` gives for these tables, fitted once in a session: queries that look at one fit share it."""
    key = (spark.sparkContext.applicationId, *key)
    if key not in _FITTED:
        _FITTED[key] = make()
    return _FITTED[key]


def cross_validated(spark, folder, k: int):
    """Metric bundle per model and fold."""
    return once(spark, "folds", folder, k, make=lambda: fit_folds(spark, folder, k))


def fit_folds(spark, folder, k: int):
    df = group_folds(tr.positive_weights(featured(spark, folder)), "segment_id", k)
    builders = {"logistic": tr.logistic(), "forest": tr.random_forest(), "boosted": tr.boosted()}
    return tr.cross_validate(df, builders, FEATURES, weight="weight", k=k)


@query("cross_validated_metrics", "M1 M2 M3 M9")
def cross_validated_metrics(spark, folder):
    return cross_validated(spark, folder, 5)


@query("cross_validated_means", "M9 A15")
def cross_validated_means(spark, folder):
    return tr.cv_summary(cross_validated(spark, folder, 5))


@query("cross_validated_models", "M1 M2 M3 M9", f"""
WITH {TELEMETRY} SELECT m AS model_name, count(*) AS n, CAST(sum(target) AS BIGINT) AS positives, CAST(3 AS BIGINT) AS folds, true AS bounded
FROM telemetry, (VALUES ('logistic'), ('forest'), ('boosted')) v(m) GROUP BY m""")
def cross_validated_models(spark, folder):
    out = audited(cross_validated(spark, folder, 3), ["model_name", "fold"])
    return out.groupBy("model_name").agg(F.sum("n").alias("n"), F.sum("positives").alias("positives"), F.countDistinct("fold").alias("folds"), F.bool_and("bounded").alias("bounded"))


def isolated(spark, folder):
    df = featured(spark, folder).persist()
    out = iforest.fit(df, FEATURES, iforest.Settings(), key=["seq"]).score(df)
    df.unpersist()
    return out


@query("isolation_forest_leak_scores", "M5 M6")
def isolation_forest_leak_scores(spark, folder):
    return isolated(spark, folder).select("seq", "target", "leak_score")


@query("isolation_forest_scores", "M5 M6", f"WITH {TELEMETRY} SELECT seq, target, true AS bounded, true AS varied FROM telemetry")
def isolation_forest_scores(spark, folder):
    scored = isolated(spark, folder)
    spread = scored.agg((F.stddev_pop("leak_score") > 0.001)).scalar()
    return scored.select("seq", "target", bounded("leak_score").alias("bounded"), spread.alias("varied"))


@query("benchmark_metrics", "M14 M4")
def benchmark_metrics(spark, folder):
    parts = tr.kept_for_fits(stratified_split(featured(spark, folder), ["seq"], "target", {"test": 0.2, "train": 0.0}).select("part", "target", *FEATURES))
    out = tr.benchmark(parts.where(F.col("part") == "train"), parts.where(F.col("part") == "test"), FEATURES)
    parts.unpersist()
    return out


@query("benchmark_models", "M14 M4", f"""
WITH {TELEMETRY}, t AS (SELECT target, CAST(ceil(count(*) * 0.2) AS BIGINT) AS n FROM telemetry GROUP BY target)
SELECT m AS model_name, CAST(sum(n) AS BIGINT) AS n, CAST(sum(n) FILTER (target = 1) AS BIGINT) AS positives, true AS bounded
FROM t, (VALUES ('majority'), ('logistic_regression'), ('random_forest')) v(m) GROUP BY m""")
def benchmark_models(spark, folder):
    return audited(benchmark_metrics(spark, folder), ["model_name"])


def trained(spark, folder, k: int) -> dict:
    df = featured(spark, folder).withColumn("weight", tr_weight())
    return tr.train_all(df, {"logistic": tr.logistic(), "forest": tr.random_forest()}, FEATURES, "segment_id", "weight", k=k)


@query("training_job_summary", "M15 M8 X8")
def training_job_summary(spark, folder):
    job = trained(spark, folder, 5)
    sizes = job["fold_sizes"].select(F.struct("*")).scalar()
    return job["summary"].join(job["weights"], "model_name").withColumn("_s", sizes).select("*", "_s.*").drop("_s")


@query("training_job", "M15 M8 X8", f"""
WITH {TELEMETRY}, n AS (SELECT count(*) AS r, count(DISTINCT segment_id) AS g FROM telemetry)
SELECT m AS model_name, true AS bounded, true AS weighs, CAST(round(r * 2 / 3.0) AS BIGINT) AS avg_train_rows, CAST(round(r / 3.0) AS BIGINT) AS avg_test_rows
FROM n, (VALUES ('logistic'), ('forest')) v(m)""")
def training_job(spark, folder):
    job = trained(spark, folder, 3)
    total = job["weights"].agg(F.abs(F.sum("weight") - 1) < 1e-9).scalar()
    sizes = job["fold_sizes"].select(F.struct("avg_train_rows", "avg_test_rows")).scalar()
    out = job["summary"].join(job["weights"], "model_name").withColumn("_s", sizes)
    means = [f"{c}_cv_{k}" for c in BUNDLE for k in ("mean", "std")]
    return out.select("model_name", bounded(*means).alias("bounded"), (bounded("weight") & total).alias("weighs"), "_s.avg_train_rows", "_s.avg_test_rows")


def tr_weight():
    from telemill.functions import severity_weight

    return severity_weight(F.col("target"), F.col("leak_severity"))


@query("batch_leak_scores", "M10")
def batch_leak_scores(spark, folder):
    df = tr.kept_for_fits(featured(spark, folder).select("seq", "segment_id", "target", *FEATURES))
    builders = {"logistic": tr.logistic(), "svm": tr.linear_svm()}
    fitted = tr.side_by_side(df, lambda name: tr.fit(builders[name], df, FEATURES, None), list(builders))
    models = {**dict(zip(builders, fitted)), "majority": tr.Majority.fit(df), "unsupported": object(), "broken": broken_on(lambda rows: True)}
    out = tr.score_all(models, df, ["seq", "segment_id", "target"], FEATURES)
    df.unpersist()
    return out


@query("batch_scores", "M10", f"""
WITH {TELEMETRY} SELECT m AS model_name, seq, segment_id, target, true AS bounded, CASE WHEN m = 'majority' THEN CAST((SELECT mode(target) FROM telemetry) AS DOUBLE) END AS constant
FROM telemetry, (VALUES ('logistic'), ('majority'), ('svm')) v(m)""")
def batch_scores(spark, folder):
    out = batch_leak_scores(spark, folder)
    constant = F.when(F.col("model_name") == "majority", F.col("leak_score"))
    return out.select("model_name", "seq", "segment_id", "target", bounded("leak_score").alias("bounded"), constant.alias("constant"))


def broken_on(rule):
    """A model on pandas batches that fails where the rule says so: batch scoring gives a reason there."""
    class Broken:
        def predict(self, rows):
            if rule(rows):
                raise ValueError("no model behind this")
            return 1 / (1 + (rows["pressure"] / 100.0) ** 2)

    return Broken()


@query("scoring_reasons", "M10", f"""
WITH {TELEMETRY} SELECT 'steady' AS model_name, seq, {r('1.0 / (1.0 + (pressure / 100.0) * (pressure / 100.0))', 'leak_score')}, NULL AS reason FROM telemetry
UNION ALL SELECT 'broken', seq, NULL, 'no model behind this' FROM telemetry
UNION ALL SELECT 'unsupported', seq, NULL, 'no way to score' FROM telemetry
UNION ALL SELECT 'majority', seq, CAST((SELECT mode(target) FROM telemetry) AS DOUBLE), NULL FROM telemetry""")
def scoring_reasons(spark, folder):
    """Every model on every row in one pass, with a score or the reason why there is none."""
    t = views.telemetry(spark, folder)
    models = {"steady": broken_on(lambda rows: False), "broken": broken_on(lambda rows: True), "unsupported": object(), "majority": tr.Majority.fit(t)}
    out = tr.scores_or_reasons(models, t, ["seq"], ["pressure", "flow_rate"])
    return out.select("model_name", "seq", r6("leak_score").alias("leak_score"), "reason")


@query("transfer_fold_metrics", "M13")
def transfer_fold_metrics(spark, folder):
    """Metric bundle per fold of the new domain; fold -1 is all of it."""
    source = tr.kept_for_fits(featured(spark, folder).select("target", *FEATURES))
    models = {"logistic": tr.fit(tr.logistic(), source, FEATURES, None)}
    source.unpersist()
    s = views.shipments(spark, folder)
    # folds follow from segments and labels, so they are dealt before the features are there
    s = group_folds(s, "segment_id", 5)
    target = ft.build_features(s, time_series(s, ["segment_id"], tiebreak=views.SHIPMENT_ORDER), ft.FEATURES)
    return tr.transfer(models, target, FEATURES)


@query("transfer_metrics", "M13", f"""
WITH {SHIPMENTS} SELECT 'logistic' AS model_name, whole, count(*) AS n, CAST(sum(target) AS BIGINT) AS positives, CAST(CASE WHEN whole THEN 1 ELSE 5 END AS BIGINT) AS folds, true AS bounded
FROM shipments, (VALUES (true), (false)) v(whole) GROUP BY whole""")
def transfer_metrics(spark, folder):
    out = audited(transfer_fold_metrics(spark, folder), ["model_name", "fold"])
    return out.groupBy("model_name", (F.col("fold") == -1).alias("whole")).agg(
        F.sum("n").alias("n"), F.sum("positives").alias("positives"), F.countDistinct("fold").alias("folds"), F.bool_and("bounded").alias("bounded"))


def validated(spark, folder, k: int):
    t = with_context(views.telemetry(spark, folder)).withColumn("history_id", F.col("segment_id").cast("string"))
    return validation_report(t, time_series(t, ["segment_id"]), k=k)


@query("validation_measures", "V12")
def validation_measures(spark, folder):
    return validated(spark, folder, 5)


@query("validation_report", "V12", f"""
WITH {TELEMETRY}, h AS (SELECT segment_id, epoch(max(timestamp) - min(timestamp)) / 3600.0 AS hours FROM telemetry GROUP BY segment_id)
SELECT (SELECT count(*) FROM telemetry) AS rows, count(*) AS segment_count, {r('max(hours)', 'max_history_hours')}, {r('median(hours)', 'median_history_hours')}, true AS bounded FROM h""")
def validation_report_row(spark, folder):
    out = validated(spark, folder, 3)
    return out.select("rows", "segment_count", r6("max_history_hours").alias("max_history_hours"), r6("median_history_hours").alias("median_history_hours"),
                      bounded("raw_sensor_auc", "dynamics_auc", "stale_sensor_rate", "missing_value_rate", "leak_disturbance_overlap").alias("bounded"))


RULE = "pressure > 0.5 * flow_rate + 20"


def ruled(df):
    """Readings labelled by a rule that a model can learn from two signals, in five folds of whole segments."""
    df = df.where("pressure IS NOT NULL AND flow_rate IS NOT NULL")
    return group_folds(df.withColumn("target", F.expr(f"CAST({RULE} AS INT)")), "segment_id", 5)


def ruled_tables(spark, folder):
    t = views.telemetry(spark, folder).select("seq", "segment_id", "pressure", "flow_rate")
    s = views.shipments(spark, folder).select(F.xxhash64(*views.SHIPMENT_ORDER).alias("seq"), "segment_id",
                                              (5 * F.col("pressure")).alias("pressure"), "flow_rate")
    return ruled(t), ruled(s)


SIGNALS = ["pressure", "flow_rate"]


def auc_floor(metrics, stage: str, floors: dict[str, float]):
    """Per model the rows and positives behind its metrics, and whether it ranks better than its floor and a constant would."""
    floor = F.element_at(F.create_map(*[F.lit(v) for pair in floors.items() for v in pair]), F.col("model_name"))
    size = F.sum(F.col("tn") + F.col("fp") + F.col("fn") + F.col("tp"))
    return metrics.groupBy("model_name").agg(
        size.alias("n"), F.sum(F.col("fn") + F.col("tp")).alias("positives"),
        (F.min("roc_auc") > F.first(floor)).alias("learned")).select(F.lit(stage).alias("stage"), "*")


FLOORS = dict.fromkeys(("logistic", "forest", "boosted", "svm", "logistic_regression", "random_forest"), 0.9) | {"majority": 0.5}
_RULED = f"t AS (SELECT CAST({RULE} AS INTEGER) AS y FROM telemetry WHERE pressure IS NOT NULL AND flow_rate IS NOT NULL)"


@query("rule_learned", "M1 M2 M3 M9", f"""
WITH {TELEMETRY}, {_RULED}
SELECT 'cross validation' AS stage, m AS model_name, count(*) AS n, CAST(sum(y) AS BIGINT) AS positives, true AS learned
FROM t, (VALUES ('logistic'), ('forest'), ('boosted')) v(m) GROUP BY m""")
def rule_learned(spark, folder):
    """Cross-validation on a label that follows from the signals: a constant or inverted model is not ``learned``."""
    builders = {"logistic": tr.logistic(), "forest": tr.random_forest(10, 4), "boosted": tr.boosted(5, 3)}
    return auc_floor(tr.cross_validate(ruled_tables(spark, folder)[0], builders, SIGNALS), "cross validation", FLOORS)


@query("rule_carried_over", "M10 M13", f"""
WITH {TELEMETRY}, {SHIPMENTS}, {_RULED},
s AS (SELECT CAST({RULE.replace('pressure', '5 * pressure')} AS INTEGER) AS y FROM shipments WHERE pressure IS NOT NULL AND flow_rate IS NOT NULL)
SELECT 'transfer' AS stage, m AS model_name, count(*) AS n, CAST(sum(y) AS BIGINT) AS positives, true AS learned FROM s, (VALUES ('logistic'), ('svm')) v(m) GROUP BY m
UNION ALL SELECT 'batch', m, count(*), CAST(sum(y) AS BIGINT), true FROM t, (VALUES ('logistic'), ('svm')) v(m) GROUP BY m""")
def rule_carried_over(spark, folder):
    """Models of that label score their own table and, per fold, another one."""
    telemetry, shipments = ruled_tables(spark, folder)
    telemetry = tr.kept_for_fits(telemetry)
    models = {"logistic": tr.fit(tr.logistic(), telemetry, SIGNALS, None), "svm": tr.fit(tr.linear_svm(20), telemetry, SIGNALS, None)}
    batch = tr.measured(tr.score_all(models, telemetry, ["target"], SIGNALS), ["model_name"])
    moved = tr.transfer(models, shipments, SIGNALS).where("fold >= 0")
    telemetry.unpersist()
    return auc_floor(batch, "batch", FLOORS).union(auc_floor(moved, "transfer", FLOORS))


@query("rule_compared", "M14", f"""
WITH {TELEMETRY}, {_RULED}, h AS (SELECT y, CAST(ceil(count(*) * 0.2) AS BIGINT) AS n FROM t GROUP BY y)
SELECT 'benchmark' AS stage, m AS model_name, CAST(sum(n) AS BIGINT) AS n, CAST(sum(n) FILTER (y = 1) AS BIGINT) AS positives, m <> 'majority' AS learned
FROM h, (VALUES ('majority'), ('logistic_regression'), ('random_forest')) v(m) GROUP BY m""")
def rule_compared(spark, folder):
    """The baseline comparison on that label: models rank above the majority baseline."""
    telemetry = ruled_tables(spark, folder)[0].drop("fold")
    parts = tr.kept_for_fits(stratified_split(telemetry, ["seq"], "target", {"test": 0.2, "train": 0.0}).select("part", "target", *SIGNALS))
    out = tr.benchmark(parts.where("part = 'train'"), parts.where("part = 'test'"), SIGNALS, trees=10)
    parts.unpersist()
    return auc_floor(out, "benchmark", FLOORS)
