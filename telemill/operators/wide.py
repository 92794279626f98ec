"""The 27 features of the multi-sensor (pressure / flow / temperature) table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import as_number, stable_ratio
from .features import flat_to_zero, rows
from .keys import join_keys
from .series import Series, frames

SENSORS = ["P_inlet", "P_mid", "P_outlet", "Q_inlet", "Q_outlet", "T_inlet", "T_mid", "T_outlet"]
ROLLED = SENSORS[:5]
STAND_IN = {"P": "pressure", "Q": "flow_rate", "T": "temperature"}
BALANCE = ["P_drop_inlet_to_mid", "P_drop_mid_to_outlet", "P_drop_total", "P_ratio_in_out", "Q_imbalance",
           "Q_imbalance_pct", "Q_ratio", "T_drop_inlet_to_outlet", "T_gradient_per_km"]


def rolled_names(window: int) -> list[str]:
    return [f"{c}_rolling_{k}_{window}" for c in ROLLED for k in ("mean", "std")]


def wide_feature_names(window: int = 5) -> list[str]:
    return SENSORS + BALANCE + rolled_names(window)


def wide_features(df: DataFrame, series: Series, window: int = 5, ratio_mode: str = "safe") -> DataFrame:
    """Add raw, balance and rolling columns; keys with fewer rows than the window get rolling zeros.

    ``ratio_mode``: ``safe`` keeps denominators away from zero and clips; ``epsilon`` adds 1e-6 to them.
    """

    def raw(c: str) -> Column:
        source = c if c in df.columns else STAND_IN[c[0]] if STAND_IN[c[0]] in df.columns else None
        return F.lit(0.0) if source is None else F.coalesce(as_number(source), F.lit(0.0))

    def div(n: Column, d: Column, limit: float) -> Column:
        return stable_ratio(n, d, limit=limit) if ratio_mode == "safe" else n / F.nullif(d + 1e-6, F.lit(0.0))

    own = df.columns
    df = df.withColumns({c: raw(c) for c in SENSORS})
    c = F.col
    df = df.withColumns({
        "P_drop_inlet_to_mid": c("P_inlet") - c("P_mid"),
        "P_drop_mid_to_outlet": c("P_mid") - c("P_outlet"),
        "P_drop_total": c("P_inlet") - c("P_outlet"),
        "P_ratio_in_out": div(c("P_inlet"), c("P_outlet"), 1e3),
        "Q_imbalance": c("Q_inlet") - c("Q_outlet"),
        "Q_imbalance_pct": div(100 * (c("Q_inlet") - c("Q_outlet")), c("Q_inlet"), 1e4),
        "Q_ratio": div(c("Q_inlet"), c("Q_outlet"), 1e3),
        "T_drop_inlet_to_outlet": c("T_inlet") - c("T_outlet"),
        "T_gradient_per_km": (c("T_inlet") - c("T_outlet")) * 0.1,
    })
    if series.slot is None:
        whole = Window.partitionBy(*series.keys)
        df = df.withColumn("_wide_size", F.count(F.lit(1)).over(series.window().rowsBetween(
            Window.unboundedPreceding, Window.unboundedFollowing)) if series.keys else F.count(F.lit(1)).over(whole))
    else:
        sizes = df.groupBy(*series.keys).agg(F.count(F.lit(1)).alias("_wide_size"))
        df = join_keys(df, sizes, series.keys)
    df, local, keep = frames(df, series, window)
    w = local.window()
    enough = F.col("_wide_size") >= window
    rolled = {}
    for s in ROLLED:
        rolled[f"{s}_rolling_mean_{window}"] = F.avg(s).over(rows(w, window))
        rolled[f"{s}_rolling_std_{window}"] = F.stddev_samp(s).over(rows(w, window))
    df = df.withColumns(rolled).where(keep)
    df = df.withColumns({c: F.when(enough, flat_to_zero(c) if "_std_" in c else F.col(c)).otherwise(0.0) for c in rolled})
    return df.select(*own, *[n for n in wide_feature_names(window) if n not in own])


# What a sensor's prefix measures.
SENSOR_KINDS = {"P": "pressure", "Q": "flow", "T": "temperature"}


def to_long(df: DataFrame, ids: list[str]) -> DataFrame:
    """Wide sensors to ``(ids, sensor_id, variable, value)``; NULL values stay."""
    names = [c for c in df.columns if c[:2] in ("P_", "Q_", "T_")]
    kinds = F.create_map(*[F.lit(v) for pair in SENSOR_KINDS.items() for v in pair])
    long = df.select(*ids, *names).unpivot(ids, names, "raw", "value")
    parts = F.split("raw", "_", 2)
    return long.select(*ids, parts[1].alias("sensor_id"), F.try_element_at(kinds, parts[0]).alias("variable"), "value")
