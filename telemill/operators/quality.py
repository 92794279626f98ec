"""Per-scenario data-quality checks on the multi-sensor table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .runs import last_rows
from .series import Series, scan

CRITICAL = ["no_nan_inf", "pressure_range", "flow_non_negative"]
PRESSURES = ["P_inlet", "P_mid", "P_outlet"]
FLOWS = ["Q_inlet", "Q_outlet"]


def _broken(c: str) -> Column:
    v = F.col(c)
    return v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))


def scenario_checks(df: DataFrame, onsets: DataFrame, key: str, time: str, tiebreak: list[str]) -> DataFrame:
    """One row per scenario and check: ``(key, name, passed, detail)``, ``detail`` being the number the verdict rests on.

    ``onsets`` holds ``(key, onset, ramp_seconds)`` of scenarios with a leak; the imbalance check looks at
    the first row once the leak has settled and is absent where there is none.
    """
    order = [time, *tiebreak]
    rank = F.struct(*order)
    settled = df.join(onsets, key).where(
        F.unix_timestamp(time) >= F.unix_timestamp("onset") + F.greatest("ramp_seconds", F.lit(60.0)) + 60.0
    )
    late = settled.groupBy(key).agg(F.min_by(F.struct(*FLOWS), rank).alias("l"))
    late = late.select(key, F.struct((F.col("l.Q_inlet") > F.col("l.Q_outlet") * 1.001).alias("passed"), (F.col("l.Q_inlet") - F.col("l.Q_outlet")).alias("detail")).alias("_late"))

    tail = last_rows(df, [key], order, 20).select(key, *order, F.col("P_outlet").alias("p"))
    series = Series((key,), tuple(order))
    tail = scan(tail, series, previous={"p1": F.col("p")})
    tail = scan(tail, series, previous={"p2": F.col("p1")})
    wobble = tail.groupBy(key).agg(
        F.stddev_pop(F.col("p") - 2 * F.col("p1") + F.col("p2")).alias("_d2"), F.stddev_pop("p").alias("_sd"))
    calm = wobble.select(key, (F.col("_d2") / F.greatest("_sd", F.lit(1.0))).alias("_calm"))

    lows = [F.min(c) for c in PRESSURES]
    highs = [F.max(c) for c in PRESSURES]
    first = F.min_by(F.struct(*PRESSURES, *FLOWS), rank)
    whole = df.groupBy(key).agg(
        first.alias("f"), F.count(F.lit(1)).alias("_n"),
        F.count_if(sum_any([_broken(c) for c in PRESSURES + FLOWS])).alias("_bad"),
        F.least(*lows).alias("_low"), F.greatest(*highs).alias("_high"), F.least(*[F.min(c) for c in FLOWS]).alias("_flow"),
    )
    imbalance = F.abs(F.col("f.Q_inlet") - F.col("f.Q_outlet")) / F.greatest(F.abs(F.col("f.Q_inlet")), F.lit(1e-10))
    falls = (F.col("f.P_inlet") >= F.col("f.P_mid")) & (F.col("f.P_mid") >= F.col("f.P_outlet"))

    def check(name: str, passed: Column, detail: Column) -> Column:
        return F.struct(F.lit(name).alias("name"), F.coalesce(passed, F.lit(False)).alias("passed"), detail.cast("double").alias("detail"))

    checks = F.array(
        check("pressure_decreasing_initial", falls, F.col("f.P_inlet") - F.col("f.P_outlet")),
        check("no_nan_inf", F.col("_bad") == 0, F.col("_bad")),
        check("mass_balance_initial", imbalance < 0.02, imbalance),
        F.when(F.col("_late.passed").isNotNull(), check("leak_flow_imbalance", F.col("_late.passed"), F.col("_late.detail"))),
        check("pressure_range", (F.col("_low") > 0.0) & (F.col("_high") < 50.0e6), F.col("_high")),
        check("flow_non_negative", F.col("_flow") >= -1e-4, F.col("_flow")),
        F.when(F.col("_n") > 20, check("no_numerical_oscillation", F.col("_calm") < 0.5, F.col("_calm"))),
    )
    rows = whole.join(late, key, "left").join(calm, key, "left")
    return rows.select(key, F.inline(F.array_compact(checks)))


def sum_any(flags: list[Column]) -> Column:
    out = flags[0]
    for f in flags[1:]:
        out = out | f
    return out


def gate(checks: DataFrame, key: str) -> DataFrame:
    """Verdict per scenario: ``fail`` on a critical check, ``warn`` on another, else ``pass``."""
    bad, critical = ~F.col("passed"), F.col("name").isin(CRITICAL)
    return checks.groupBy(key).agg(
        F.when(F.bool_or(bad & critical), "fail").when(F.bool_or(bad), "warn").otherwise("pass").alias("verdict"))


def exclude_failed(df: DataFrame, checks: DataFrame, key: str) -> DataFrame:
    """Rows of scenarios without a critical failure."""
    failed = checks.where(F.col("name").isin(CRITICAL) & ~F.col("passed")).select(key)
    return df.join(failed, key, "left_anti")
