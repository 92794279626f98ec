"""Dataset profiles, summaries and quality reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import finite, is_disturbance
from .quantiles import exact_quantiles
from .runs import last_rows


def numeric_profile(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Nulls, mean, deviation and range of each column, one row per column, from one pass."""
    aggs = []
    for c in columns:
        v = finite(c)
        aggs += [F.count_if(v.isNull()).alias(f"{c}|nulls"), F.avg(v).alias(f"{c}|mean"), F.stddev_samp(v).alias(f"{c}|std"),
                 F.min(v).alias(f"{c}|min"), F.max(v).alias(f"{c}|max")]
    one = df.agg(F.count(F.lit(1)).alias("row_count"), *aggs)
    cell = [F.struct(F.lit(c).alias("column"), F.col("row_count"), F.col(f"`{c}|nulls`").alias("nulls"),
                     *[F.round(F.col(f"`{c}|{k}`") + 1e-9, 4).alias(k) for k in ("mean", "std", "min", "max")])
            for c in columns]
    return one.select(F.explode(F.array(*cell)).alias("r")).select("r.*")


def null_counts(df: DataFrame) -> DataFrame:
    """Columns holding NULLs and how many."""
    names = df.columns
    one = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in names])
    cells = [F.struct(F.lit(c).alias("column"), F.col(c).alias("nulls")) for c in names]
    return one.select(F.explode(F.array(*cells)).alias("r")).select("r.*").where(F.col("nulls") > 0)


def time_profile(df: DataFrame, time: str = "timestamp") -> DataFrame:
    """Distinct timestamps, their range, and whether they can order the data."""
    return df.agg(
        F.countDistinct(time).alias("timestamp_unique"), F.min(time).alias("first"), F.max(time).alias("last"),
    ).withColumn("timestamp_usable", F.col("timestamp_unique") > 1)


def label_profile(df: DataFrame, label: str) -> DataFrame:
    """Number of classes, majority share, and the verdict on a dataset's usability."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    one = counts.agg(F.sum("n").alias("row_count"), F.count(F.lit(1)).alias("n_classes"), F.max("n").alias("_top"))
    share = F.col("_top") / F.col("row_count")
    usable = (F.col("n_classes") >= 2) & (share < 0.99)
    return one.select(
        "row_count", "n_classes", F.round(share + 1e-9, 4).alias("majority_class_pct"), usable.alias("labels_usable"),
        F.when(F.col("row_count") < 500, "too_small").when(~usable, "no_usable_labels")
        .when(F.col("row_count") >= 10000, "usable_large").otherwise("usable_small").alias("dataset_verdict"),
    )


def processing_summary(df: DataFrame) -> DataFrame:
    """Rows, wells, scenarios, label balance and event distribution of a processed well table."""
    # one entry per event class
    events = df.groupBy("event_class").agg(F.count(F.lit(1)).alias("rows")).agg(F.sort_array(F.collect_list(F.struct("event_class", "rows")))).scalar()
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"), F.countDistinct("well_id").alias("n_wells"),
        F.countDistinct("scenario_id").alias("n_scenarios"),
        F.count_if(F.col("target") == 0).alias("label_0"), F.count_if(F.col("target") == 1).alias("label_1"),
    ).withColumn("events", events)


def distribution(df: DataFrame, *columns: str, out: str = "n") -> DataFrame:
    return df.groupBy(*columns).agg(F.count(F.lit(1)).alias(out))


def history_hours(df: DataFrame, history: str = "history_id", time: str = "timestamp") -> DataFrame:
    """Hours covered by each history."""
    hours = (F.unix_micros(F.max(time)) - F.unix_micros(F.min(time))) / F.lit(3.6e9)
    return df.groupBy(history).agg(F.coalesce(hours, F.lit(0.0)).alias("hours"))


def history_summary(df: DataFrame, history: str = "history_id", time: str = "timestamp") -> DataFrame:
    """Number of histories with their median and longest duration."""
    hours = history_hours(df, history, time)
    median = exact_quantiles(hours, [], "hours", {"median_history_hours": 0.5})
    return hours.agg(F.count(F.lit(1)).alias("history_count"), F.max("hours").alias("max_history_hours")).withColumn(
        "median_history_hours", median.scalar())


def missing_rate(df: DataFrame) -> DataFrame:
    """Mean over columns of the share of missing values."""
    parts = [F.avg(F.col(c).isNull().cast("double")) for c in df.columns]
    return df.agg((sum(parts, F.lit(0.0)) / len(parts)).alias("missing_value_rate"))


def row_rates(df: DataFrame, context: str = "scenario_context") -> DataFrame:
    """Share of disturbed rows and of leak rows."""
    return df.agg(F.avg(is_disturbance(context).cast("double")).alias("disturbance_row_rate"),
                  F.avg(F.col("target").cast("double")).alias("leak_row_rate"))


def band_overlap(df: DataFrame, value: str, context: str = "scenario_context") -> DataFrame:
    """How far the 10-90 % bands of leak rows and of disturbed normal rows overlap."""
    kind = F.when(F.col("target") == 1, "leak").when(is_disturbance(context), "dist")
    rows = df.select(kind.alias("kind"), F.abs(F.col(value)).alias("v")).where(F.col("kind").isNotNull())
    bands = exact_quantiles(rows, ["kind"], "v", {"lo": 0.1, "hi": 0.9})
    is_leak = F.col("kind") == "leak"
    one = bands.agg(*[F.max(F.when(is_leak == flag, F.col(side))).alias(name) for flag, side, name in [
        (True, "lo", "leak_lo"), (True, "hi", "leak_hi"), (False, "lo", "dist_lo"), (False, "hi", "dist_hi")]])
    shared = F.greatest(F.lit(0.0), F.least("leak_hi", "dist_hi") - F.greatest("leak_lo", "dist_lo"))
    span = F.greatest("leak_hi", "dist_hi") - F.least("leak_lo", "dist_lo")
    known = F.col("leak_lo").isNotNull() & F.col("dist_lo").isNotNull()
    return one.withColumn("leak_disturbance_overlap", F.when(known, F.when(span > 0, shared / span).otherwise(0.0)))


WARNINGS = {
    "short": "Half of the histories cover less than a day.",
    "easy": "A model on unprocessed sensors reaches an AUC above 0.93: leaks may be given away.",
    "flat": "Features over time gain under 0.02 AUC on unprocessed sensors.",
    "tame": "Under 2 % of disturbances without a leak are mistaken for one.",
    "thin": "No slow leak, or no borderline leak, is in the data.",
    "ideal": "Hardly any value is missing or stale.",
}


def validation_warnings(df: DataFrame) -> DataFrame:
    """Warnings that follow from a row of validation measures; unknown measures raise none."""
    c = F.col
    rules = [
        ("short", c("median_history_hours") < 24),
        ("easy", c("raw_sensor_auc") > 0.93),
        ("flat", c("dynamics_auc") - c("raw_sensor_auc") < 0.02),
        ("tame", c("disturbance_false_positive_rate") < 0.02),
        ("thin", (c("slow_leak_event_count") == 0) | (c("borderline_leak_event_count") == 0)),
        ("ideal", (c("missing_value_rate") < 0.001) & (c("stale_sensor_rate") < 0.005)),
    ]
    return df.withColumn("warnings", F.array_compact(F.array(*[F.when(cond, WARNINGS[k]) for k, cond in rules])))


def operational_snapshot(latest: DataFrame, scored: DataFrame) -> DataFrame:
    """Headline figures: leaks and extremes at the latest step, false detections overall."""
    false_hits = scored.agg(F.count_if(F.col("model_alert") & (F.col("target") == 0))).scalar()
    return latest.agg(
        F.sum("target").alias("active_leaks"), F.max("leak_severity").alias("max_severity"),
        F.min("pump_efficiency").alias("min_efficiency"),
    ).withColumn("false_detections", false_hits)


def recent_series(df: DataFrame, keys: Sequence[str], order: Sequence[str], signals: dict[str, int], keep: int) -> DataFrame:
    """Ordered arrays of rounded signals over the last ``keep`` rows of each key; older rows are left out by the caller's choice."""
    recent = last_rows(df, keys, order, keep)
    rows = F.sort_array(F.collect_list(F.struct(*order, *[F.coalesce(F.col(c), F.lit(0.0)).alias(f"v_{c}") for c in signals])))
    out = recent.groupBy(*keys).agg(rows.alias("_rows"))

    def pick(name: str, digits: int):
        scale = float(10**digits)
        return F.transform("_rows", lambda x: F.rint(x[f"v_{name}"] * scale) / scale)

    return out.select(*keys, *[pick(c, d).alias(c) for c, d in signals.items()])


FINGERPRINT_MODULUS = 2**61 - 1


def fingerprint(df: DataFrame) -> DataFrame:
    """Row count and an order-independent fingerprint of a table's contents.

    Row hashes are added up, so copies count; a value goes in with its length and NULL without one, so that
    neighbouring values cannot run together.
    """
    def marked(c: str) -> Column:
        v = F.col(c).cast("string")
        return F.coalesce(F.concat(F.char_length(v).cast("string"), F.lit(":"), v), F.lit("-"))

    part = F.conv(F.substring(F.md5(F.concat(*[marked(c) for c in df.columns])), 1, 15), 16, 10).cast("decimal(38,0)")
    total = F.coalesce(F.sum(part), F.lit(0).cast("decimal(38,0)")) % F.lit(FINGERPRINT_MODULUS).cast("decimal(38,0)")
    return df.agg(F.count(F.lit(1)).alias("row_count"), total.cast("long").alias("fingerprint"))


def class_weight(df: DataFrame, label: str = "target") -> DataFrame:
    """Negatives per positive, both at least one."""
    pos, neg = F.greatest(F.sum(label), F.lit(1)), F.greatest(F.count(F.lit(1)) - F.sum(label), F.lit(1))
    return df.agg(pos.alias("positives"), neg.alias("negatives"), (neg / pos).alias("positive_weight"))


def minute_means(df: DataFrame, seconds: str, signals: Sequence[str]) -> DataFrame:
    """Mean per minute, scaled by the largest magnitude of each signal."""
    means = df.groupBy(F.floor(F.col(seconds) / 60).alias("minute")).agg(*[F.avg(c).alias(c) for c in signals])
    peak = means.agg(F.struct(*[F.greatest(F.max(F.abs(F.col(c))), F.lit(1e-6)).alias(c) for c in signals])).scalar()
    means = means.withColumn("_peak", peak)
    return means.select("minute", *[(F.col(c) / F.col(f"_peak.{c}")).alias(c) for c in signals])
