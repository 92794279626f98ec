"""Operational evaluation of score tables: one aggregate plan for all models, no loops.

A score table is long: ``run_id, scenario_key, segment_id, seq, target, leak_severity, model_name, leak_score, step_index``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators.alerts import AlertPolicy, apply_policy
from ..operators.quantiles import exact_quantiles
from ..operators.series import Series, scan

DEFAULT_THRESHOLD = 0.5
MODEL, RUN = "model_name", "run_id"


def with_threshold(scores: DataFrame, thresholds: DataFrame | float) -> DataFrame:
    """Attach the threshold of each model; models without one use the default."""
    if isinstance(thresholds, float):
        return scores.withColumn("threshold", F.lit(thresholds))
    # one row per model
    joined = scores.join(F.broadcast(thresholds.select(MODEL, F.col("threshold").alias("_thr"))), MODEL, "left")
    return joined.withColumn("threshold", F.coalesce("_thr", F.lit(DEFAULT_THRESHOLD))).drop("_thr")


def _hit() -> Column:
    return F.col("leak_score") >= F.col("threshold")


def false_positive_rates(scores: DataFrame) -> DataFrame:
    """Share of normal rows at or above the threshold, per model and scenario."""
    normal = scores.where(F.col("target") == 0)
    return normal.groupBy(MODEL, "scenario_key").agg(F.avg(_hit().cast("double")).alias("fpr"))


def detection(scores: DataFrame, scenario: str = "slow_seep") -> DataFrame:
    """Average delay in steps of detected runs and share of leak runs detected, per model."""
    rows = scores.where(F.col("scenario_key") == scenario)
    onset = rows.where(F.col("target") == 1).groupBy(MODEL, RUN).agg(F.min("step_index").alias("_onset"))
    after = (F.col("step_index") >= F.col("_onset")) & _hit()
    runs = rows.join(onset, [MODEL, RUN]).groupBy(MODEL, RUN).agg(
        F.min("_onset").alias("_onset"), F.min(F.when(after, F.col("step_index"))).alias("_found"))
    return runs.groupBy(MODEL).agg(
        F.avg(F.col("_found") - F.col("_onset")).alias("delay"),
        F.avg(F.col("_found").isNotNull().cast("double")).alias("detection_rate"))


def micro_sensitivity(scores: DataFrame) -> DataFrame:
    """Recall on faint leaks (severity below 0.3); on micro-leak scenarios where there are none."""
    leak = F.col("target") == 1
    hit = _hit().cast("double")
    return scores.groupBy(MODEL).agg(F.coalesce(
        F.avg(F.when(leak & (F.col("leak_severity") < 0.3), hit)),
        F.avg(F.when(leak & (F.col("scenario_key") == "micro_leak"), hit)),
    ).alias("sensitivity"))


def toggle_rates(flagged: DataFrame, series: Series, flag: Column) -> DataFrame:
    """Alert changes per row in each leak run, averaged per model."""
    rows = scan(flagged.withColumn("_on", flag.cast("int")), series, previous={"_was": F.col("_on")})
    runs = rows.groupBy(*series.keys).agg(
        F.max("target").alias("_leak"), F.sum(F.abs(F.col("_on") - F.coalesce("_was", F.col("_on")))).alias("_flips"),
        F.count(F.lit(1)).alias("_n"))
    return runs.where(F.col("_leak") == 1).groupBy(MODEL).agg(F.avg(F.col("_flips") / F.col("_n")).alias("toggle_rate"))


def alert_stability(scores: DataFrame, series: Series) -> DataFrame:
    return toggle_rates(scores, series, _hit())


def policy_stability(scores: DataFrame, series: Series, policy: AlertPolicy = AlertPolicy()) -> DataFrame:
    """Toggle rate of the raw threshold next to that of the alert policy."""
    raw = alert_stability(scores, series).withColumnRenamed("toggle_rate", "raw_toggle_rate")
    fired = apply_policy(scores, series, policy, threshold="threshold")
    smooth = toggle_rates(fired, series, F.col("model_alert")).withColumnRenamed("toggle_rate", "policy_toggle_rate")
    return raw.join(smooth, MODEL)


def calibrate(scores: DataFrame, target_fpr: float = 0.05) -> DataFrame:
    """Threshold per model: a margin above the blended noise ceilings of calm and shocked operation."""
    noise = scores.where(F.col("scenario_key").isin("steady_state", "demand_shock"))
    ceilings = exact_quantiles(noise, [MODEL, "scenario_key"], "leak_score", {"steady": 1.0 - target_fpr, "shock": 0.9})
    models = scores.select(MODEL).distinct()
    per = ceilings.groupBy(MODEL).agg(
        F.max(F.when(F.col("scenario_key") == "steady_state", F.col("steady"))).alias("steady"),
        F.max(F.when(F.col("scenario_key") == "demand_shock", F.col("shock"))).alias("shock"))
    both = models.join(per, MODEL, "left").na.fill(0.0, ["steady", "shock"])
    raw = (0.7 * F.col("steady") + 0.3 * F.col("shock")) * 1.10 + 0.005
    return both.select(MODEL, F.round(F.greatest(F.lit(0.02), F.least(F.lit(0.85), raw)), 4).alias("threshold"))


def metric_table(scores: DataFrame, series: Series) -> DataFrame:
    """The operational metrics of every model, one row each (``scores`` carries ``threshold``).

    The same figures as the functions above, from a single ordered pass over each run: rows from the onset
    on are those up to which some row was a leak. ``series`` orders the rows of a (model, run).
    """
    rows = scores.withColumn("_on", _hit().cast("int"))
    rows = scan(rows, series, previous={"_was": F.col("_on")}, maxima={"_begun": F.col("target")})
    leak, on = F.col("target") == 1, F.col("_on")
    micro = {"_faint": leak & (F.col("leak_severity") < 0.3), "_micro": leak & (F.col("scenario_key") == "micro_leak")}
    normal = {f"_{k}": ~leak & (F.col("target") == 0) & (F.col("scenario_key") == k) for k in ("steady_state", "demand_shock")}
    seep = F.col("scenario_key") == "slow_seep"
    counted = {**micro, **normal}
    runs = rows.groupBy(*series.keys).agg(
        F.max("threshold").alias("threshold"), F.max("target").alias("_leak"), F.count(F.lit(1)).alias("_n"),
        F.sum(F.abs(on - F.coalesce("_was", on))).alias("_flips"),
        F.min(F.when(seep & leak, F.col("step_index"))).alias("_onset"),
        F.min(F.when(seep & (F.col("_begun") == 1) & (on == 1), F.col("step_index"))).alias("_found"),
        *[F.count_if(c).alias(f"{k}_n") for k, c in counted.items()],
        *[F.count_if(c & (on == 1)).alias(f"{k}_hit") for k, c in counted.items()],
    )

    def share(k: str) -> Column:
        return F.sum(f"{k}_hit") / F.nullif(F.sum(f"{k}_n"), F.lit(0))

    started = F.col("_onset").isNotNull()
    return runs.groupBy(MODEL).agg(
        F.max("threshold").alias("threshold"), share("_steady_state").alias("fpr_steady_state"), share("_demand_shock").alias("fpr_demand_shock"),
        F.avg(F.when(started, F.col("_found") - F.col("_onset"))).alias("delay"),
        F.avg(F.when(started, F.col("_found").isNotNull().cast("double"))).alias("detection_rate"),
        F.coalesce(share("_faint"), share("_micro")).alias("sensitivity"),
        F.avg(F.when(F.col("_leak") == 1, F.col("_flips") / F.col("_n"))).alias("toggle_rate"),
    )


def leaderboard(metrics: DataFrame) -> DataFrame:
    """Rank models by steady-state false positives, then delay (none counts as 999)."""
    w = Window.orderBy("fpr_steady_state", F.coalesce("delay", F.lit(999.0)), MODEL)  # one row per model
    return metrics.withColumn("rank", F.row_number().over(w).cast("long"))


def rank_by_quality(metrics: DataFrame) -> DataFrame:
    """Rank models by AUC, then F1, highest first; unknown values come last."""
    w = Window.orderBy(F.col("roc_auc").desc_nulls_last(), F.col("f1").desc_nulls_last(), MODEL)  # one row per model
    return metrics.withColumn("rank", F.row_number().over(w).cast("long"))


def visible_models(metrics: DataFrame, floor: float = 0.55) -> DataFrame:
    """Models worth showing: AUC at or above the floor, or unknown."""
    return metrics.where(F.coalesce("roc_auc", F.lit(1.0)) >= floor)


def thresholds_for(models: DataFrame, calibrated: DataFrame) -> DataFrame:
    """Calibrated threshold per model, else the default."""
    return models.join(calibrated, MODEL, "left").withColumn("threshold", F.coalesce("threshold", F.lit(DEFAULT_THRESHOLD)))


SUMMARY_MODELS = "map<string, struct<roc_auc: double, accuracy: double, f1: double, f1_score: double>>"


def compare_runs(summaries: DataFrame) -> DataFrame:
    """Flatten run summaries ``(path, run_label, best_model, models)`` to one row per model, best one marked."""
    distinct = summaries.dropDuplicates(["path"])
    rows = distinct.select("path", "run_label", "best_model", F.explode("models").alias("model", "m"))
    rows = rows.select("path", "run_label", "best_model", "model", "m.roc_auc", "m.accuracy", F.coalesce("m.f1", "m.f1_score").alias("f1"))
    top = Window.partitionBy("path").orderBy(F.desc_nulls_last("roc_auc"), "model")  # a few models per summary
    best = F.coalesce(F.col("model") == F.col("best_model"), F.row_number().over(top) == 1)
    return rows.withColumn("is_best_model", best).drop("best_model").orderBy("run_label", F.desc("roc_auc"), F.desc("f1"), "model")


def harvest_metrics(summaries: DataFrame) -> DataFrame:
    """AUC and F1 per model over many summaries; the last in path order wins."""
    rows = summaries.select("path", F.explode("models").alias("model", "m"))
    rows = rows.withColumns({
        "roc_auc": F.round(F.coalesce("m.roc_auc", F.lit(0.0)), 3),
        "f1": F.round(F.coalesce("m.f1", "m.f1_score", F.lit(0.0)), 3)})
    last = rows.groupBy("model").agg(F.max_by(F.struct("roc_auc", "f1"), "path").alias("r"))
    return last.select("model", "r.roc_auc", "r.f1")


def baseline_gap(runs: DataFrame, baseline: DataFrame) -> DataFrame:
    """AUC of each model against its source-domain value."""
    base = baseline.select(MODEL, F.col("roc_auc").alias("source_roc_auc"))
    return runs.join(base, MODEL, "left").withColumn("auc_gap", F.col("roc_auc") - F.col("source_roc_auc"))
