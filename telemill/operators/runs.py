"""Runs, history ids, snapshots and other order-based row selections."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .keys import join_keys
from .series import Series, scan


def number_runs(df: DataFrame, series: Series, changed: Column, previous: dict[str, Column], out: str) -> DataFrame:
    """Number maximal runs along a series: ``changed`` says, from the ``previous`` columns, where one starts."""
    df = scan(df, series, previous=previous)
    df = scan(df, series, sums={out: F.when(changed, 1).otherwise(0)})
    return df.drop(*previous)


def equal_runs(df: DataFrame, series: Series, columns: Sequence[str], out: str = "run") -> DataFrame:
    """Runs of rows on which ``columns`` keep their values (1-based)."""
    now = F.struct(*columns)
    return number_runs(df, series, ~F.col("_was").eqNullSafe(now), {"_was": now}, out)


def leak_events(df: DataFrame, series: Series) -> DataFrame:
    """One row per maximal run of ``target = 1`` with its length, peak severity and kind."""
    runs = equal_runs(df, series, ["target"]).where(F.col("target") == 1)
    events = runs.groupBy(*series.keys, "run").agg(
        F.count(F.lit(1)).alias("duration"),
        F.max(F.coalesce("leak_severity", F.lit(0.0))).alias("max_severity"),
    )
    return events.withColumn(
        "kind",
        F.when(F.col("max_severity") < 0.18, "borderline")
        .when((F.col("duration") >= 30) & (F.col("max_severity") < 0.45), "slow")
        .otherwise("abrupt"),
    )


def stale_rate(df: DataFrame, series: Series, sensors: Sequence[str]) -> DataFrame:
    """Share of rows repeating the row before, per sensor and on average."""
    df = scan(df, series, previous={f"_p_{c}": F.col(c) for c in sensors})
    per = [F.avg(F.when(F.abs(F.col(c) - F.col(f"_p_{c}")) < 1e-9, 1.0).otherwise(0.0)).alias(f"{c}_stale") for c in sensors]
    rates = df.agg(*per)
    total = sum((F.col(f"{c}_stale") for c in sensors), F.lit(0.0))
    return rates.withColumn("stale_sensor_rate", total / len(sensors))


def history_ids(df: DataFrame, arrival: Series, time: str = "timestamp", out: str = "history_id") -> DataFrame:
    """A row's history: a declared id where there is one, else a new one whenever time steps back on arrival."""
    declared = next((c for c in ("history_id", "scenario_id", "run_id") if c in df.columns), None)
    if declared:
        return df.withColumn(out, F.col(declared).cast("string"))
    df = number_runs(df, arrival, F.coalesce(F.col("_t") > F.col(time), F.lit(False)), {"_t": F.col(time)}, "_h")
    name = F.concat(F.col(arrival.keys[0]).cast("string"), F.lit("|hist_"), F.col("_h").cast("string"))
    return df.withColumn(out, name).drop("_h")


def drop_warmup(df: DataFrame, series: Series, rows: int = 5) -> DataFrame:
    """Drop the first ``rows`` rows of each key."""
    return scan(df, series, position="_warm").where(F.col("_warm") > rows).drop("_warm")


def step_index(df: DataFrame, series: Series, out: str = "step_index") -> DataFrame:
    """0-based step within each key."""
    return scan(df, series, position=out).withColumn(out, F.col(out).cast("long") - 1)


def last_rows(df: DataFrame, keys: Sequence[str], order: Sequence[str], k: int) -> DataFrame:
    """The last ``k`` rows of each key; ranks above ``k`` are cut before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order])
    return df.withColumn("_last", F.row_number().over(w)).where(F.col("_last") <= k).drop("_last")


def ideal_detections(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first actionable leak row of each key."""
    actionable = (F.col("target") == 1) | F.col("event_type").isin("warning", "fault")
    in_leak = F.contains(F.coalesce("scenario_context", F.lit("")), F.lit("leak_progression"))
    rest = [c for c in df.columns if c not in keys]
    first = df.where(in_leak & actionable).groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_r"))
    out = first.select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest])
    return out.withColumn("marker_label", F.lit("Ideal detection"))


def trailing_run(df: DataFrame, keys: Sequence[str], order: Sequence[str], holds: Column, out: str = "trailing") -> DataFrame:
    """Per key, how many rows at the end satisfy ``holds`` without a break.

    Two aggregates and a join: where the condition last failed, then the rows after that.
    """
    rank = F.struct(*order)
    ok = F.coalesce(holds, F.lit(False))
    broken = df.groupBy(*keys).agg(F.max(F.when(~ok, rank)).alias("_broken"))
    after = F.col("_broken").isNull() | (rank > F.col("_broken"))
    return join_keys(df, broken, keys).groupBy(*keys).agg(F.sum(F.when(after, 1).otherwise(0)).alias(out))


def latest_snapshot(df: DataFrame, time: str = "timestamp") -> DataFrame:
    """Rows at the latest timestamp of the table."""
    return df.where(F.col(time) == df.agg(F.max(time)).scalar())


def spikes_and_stale(df: DataFrame, series: Series, signal: str, sigmas: float = 3.5) -> DataFrame:
    """Flag spikes beyond ``sigmas`` deviations of the key's mean, and number blocks of repeated values."""
    stats = df.groupBy(*series.keys).agg(F.avg(signal).alias("_mean"), F.stddev_samp(signal).alias("_std"))
    df = join_keys(equal_runs(df, series, [signal], "block"), stats, series.keys)
    spike = F.abs(F.col(signal) - F.col("_mean")) > sigmas * F.col("_std")
    return df.withColumn("spike", F.coalesce(spike, F.lit(False))).drop("_mean", "_std")


def stale_blocks(df: DataFrame, series: Series, signal: str, at_least: int = 2) -> DataFrame:
    """Maximal blocks of one repeated value with their length."""
    runs = equal_runs(df, series, [signal], "block")
    sized = runs.groupBy(*series.keys, "block").agg(F.count(F.lit(1)).alias("length"), F.max(signal).alias(signal))
    return sized.where(F.col("length") >= at_least)


# Detectors in their order, the feature each looks at and the magnitude above which it responds.
DRIFT_DETECTORS = [
    ("expanding", "pressure_expanding_dev", 0.001),
    ("baseline", "pressure_baseline_pct", 0.001),
    ("deficit", "flow_cusum_neg30", 0.01),
    ("divergence", "pressure_flow_divergence", 0.02),
    ("drop", "pressure_cusum_neg30", 0.01),
    ("ema", "pressure_ema_dev", 0.001),
]


def drift_signals(df: DataFrame, limit: int = 4) -> DataFrame:
    """The first ``limit`` drift detectors that respond on a row, as structs of detector and value."""
    found = [F.when(F.abs(F.col(c)) > floor, F.struct(F.lit(name).alias("detector"), F.col(c).alias("value"))) for name, c, floor in DRIFT_DETECTORS]
    return df.withColumn("signals", F.slice(F.array_compact(F.array(*found)), 1, limit))


def resample_linear(df: DataFrame, series: Series, value: str, points: int) -> DataFrame:
    """Each key's series stretched linearly onto ``points`` equally spaced positions."""
    at = scan(df, series, position="_n").select(*series.keys, (F.col("_n") - 1).alias("_n"), F.col(value).alias("_v"))
    size = at.groupBy(*series.keys).agg(F.count(F.lit(1)).alias("_size"))
    grid = size.withColumn("point", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
    spot = F.col("point") * (F.col("_size") - 1) / F.lit(float(max(points - 1, 1)))
    grid = grid.withColumns({"_at": spot, "_lo": F.floor(spot), "_hi": F.ceil(spot)})
    keys = list(series.keys)
    lo = at.select(*keys, F.col("_n").alias("_lo"), F.col("_v").alias("_vlo"))
    hi = at.select(*keys, F.col("_n").alias("_hi"), F.col("_v").alias("_vhi"))
    both = join_keys(join_keys(grid, lo, [*keys, "_lo"]), hi, [*keys, "_hi"])
    return both.select(*keys, "point", (F.col("_vlo") + (F.col("_vhi") - F.col("_vlo")) * (F.col("_at") - F.col("_lo"))).alias(value))
