"""Validation report for generated telemetry: coverage, realism, and how easily leaks separate."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import is_disturbance
from ..ml import train as tr
from ..operators import profile as pf
from ..operators import runs as rn
from ..operators.features import build_features
from ..operators.metrics import roc_auc
from ..operators.sampling import group_folds
from ..operators.series import Series

RAW = ["pressure", "flow_rate", "temperature", "pump_speed", "energy_consumption"]
DYNAMIC = ["pressure_delta", "flow_rate_delta", "pressure_pct_delta", "flow_pct_delta", "pressure_roll_z", "flow_roll_z",
           "pressure_delta_deviation", "flow_neg_streak", "pressure_baseline_dev", "flow_baseline_dev",
           "pressure_segment_deviation", "flow_segment_deviation"]


def out_of_fold(df: DataFrame, features: Sequence[str], k: int) -> DataFrame:
    """Every row of a frame kept for fits scored by a logistic model that has not seen its group."""
    def run(i: int) -> DataFrame:
        model = tr.fit(tr.logistic(), df.where(F.col("fold") != i), features, None)
        return tr.score(model, df.where(F.col("fold") == i), features).select("target", "scenario_context", "leak_score")

    return reduce(DataFrame.unionByName, tr.side_by_side(df, run, range(k)))


def validation_report(df: DataFrame, series: Series, history: str = "history_id", k: int = 5) -> DataFrame:
    """One row of measures with the warnings that follow from them."""
    featured = build_features(df, series, DYNAMIC)
    raw = [c for c in RAW if c in df.columns]
    folded = tr.kept_for_fits(group_folds(featured, history, k).select("fold", "target", "scenario_context", *raw, *DYNAMIC))
    sensors = [c for c in ("pressure", "flow_rate", "temperature", "pump_speed") if c in df.columns]
    try:
        aucs, false_rate = {}, None
        for name, columns in (("raw_sensor_auc", raw), ("dynamics_auc", DYNAMIC)):
            scored = out_of_fold(folded, columns, k).persist()
            aucs[name] = roc_auc(scored, "leak_score", "target").first()["roc_auc"]
            if name == "dynamics_auc":
                quiet = scored.where(is_disturbance("scenario_context") & (F.col("target") == 0))
                false_rate = quiet.agg(F.avg((F.col("leak_score") >= 0.5).cast("double"))).first()[0]
            scored.unpersist()
    finally:
        folded.unpersist()
    events = rn.leak_events(df, series).agg(
        *[F.count_if(F.col("kind") == k_).alias(f"{k_}_leak_event_count") for k_ in ("slow", "abrupt", "borderline")])
    parts = [
        df.agg(F.count(F.lit(1)).alias("rows"), F.countDistinct(*series.keys).alias("segment_count")),
        pf.history_summary(df, history), events, pf.row_rates(df), pf.missing_rate(df),
        rn.stale_rate(df, series, sensors).select("stale_sensor_rate"),
        pf.band_overlap(featured, "pressure_delta").select("leak_disturbance_overlap"),
    ]
    one = df.sparkSession.range(1).select(*[F.lit(v).cast("double").alias(c) for c, v in aucs.items()],
                                          F.lit(false_rate).cast("double").alias("disturbance_false_positive_rate"))
    for part in parts:
        one = one.withColumn("_m", part.select(F.struct(*part.columns)).scalar()).select("*", "_m.*").drop("_m")
    return pf.validation_warnings(one)
