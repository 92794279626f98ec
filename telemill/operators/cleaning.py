"""Cleaning, label and schema normalisation, and sensor repair."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import (SENSOR_BOUNDS, as_number, as_timestamp, binary_label, bounded_sensor, clip, event_class,
                         event_class_name, finite)
from ..schema import BACKFILL_DEFAULTS, ESSENTIAL_COLUMNS, REQUIRED_COLUMNS, require_columns, resolve_target
from .labels import numbered, segment_codes
from .quantiles import exact_quantiles
from .series import Series, scan


def type_of(df: DataFrame, name: str) -> str:
    return df.schema[name].dataType.simpleString()


def usable(df: DataFrame) -> DataFrame:
    """Drop rows lacking any essential value; NaN counts as missing."""
    floats = [f.name for f in df.schema.fields
              if f.name in ESSENTIAL_COLUMNS and isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    present = [c for c in ESSENTIAL_COLUMNS if c in df.columns]
    return df.withColumns({c: finite(c) for c in floats}).dropna(subset=present)


def clean(df: DataFrame) -> DataFrame:
    """Basic cleaning: distinct rows, parsed timestamps, usable rows only."""
    parsed = df.dropDuplicates().withColumn("timestamp", as_timestamp("timestamp"))
    return usable(parsed)


def load_and_clean(df: DataFrame) -> DataFrame:
    """Schema check followed by basic cleaning."""
    return clean(require_columns(df))


def map_columns(df: DataFrame, aliases: Mapping[str, str | Sequence[str]]) -> DataFrame:
    """Add canonical columns from the first alias present; originals and existing columns stay."""
    added = {}
    for canonical, spec in aliases.items():
        options = [spec] if isinstance(spec, str) else list(spec or [])
        source = next((o for o in options if o in df.columns), None)
        if source is not None and canonical not in df.columns:
            added[canonical] = F.col(f"`{source}`")
    return df.withColumns(added) if added else df


def backfill(df: DataFrame) -> DataFrame:
    """Give a processed export the operational columns it lacks."""
    if "segment_id" not in df.columns:
        source = next((c for c in ("scenario_id", "well_id", "source_file") if c in df.columns), None)
        df = segment_codes(df, source)
    df = df.withColumns({c: F.lit(v) for c, v in BACKFILL_DEFAULTS.items() if c not in df.columns})
    if "event_type" not in df.columns:
        if "target" in df.columns:
            leak = binary_label("target", type_of(df, "target")) == 1
            df = df.withColumn("event_type", F.when(leak, "leak").otherwise("normal"))
        else:
            df = df.withColumn("event_type", F.lit("normal"))
    return df


def adopt_export(df: DataFrame, source: str) -> DataFrame:
    """A processed telemetry export: back-filled, checked, tagged and reduced to usable rows."""
    df = require_columns(backfill(df))
    return usable(df.withColumns({"timestamp": as_timestamp("timestamp"), "source_dataset": F.lit(source)}))


def fill_with_median(df: DataFrame, name: str, default: float) -> DataFrame:
    """Coerce to numbers and fill gaps with the exact median, or a constant if there is none."""
    if name not in df.columns:
        return df.withColumn(name, F.lit(default))
    df = df.withColumn(name, as_number(name))
    median = exact_quantiles(df, [], name, {"m": 0.5}).select("m").scalar()
    return df.withColumn(name, F.coalesce(F.col(name), median, F.lit(default)))


def training_frame(
    df: DataFrame,
    dataset: str,
    declared_target: str | None = None,
    order: Sequence[str] = (),
    start: str = "2026-01-01 00:00:00",
) -> DataFrame:
    """Canonical columns to the fixed training schema.

    ``order`` names the columns that give rows without timestamps their one-minute steps.
    """
    spark = df.sparkSession
    label = resolve_target(df, declared_target)
    if label is None or not {"pressure", "flow_rate"} <= set(df.columns):
        fields = [T.StructField(c, T.StringType()) for c in [*REQUIRED_COLUMNS, "source_dataset"]]
        return spark.createDataFrame([], T.StructType(fields))
    df = df.withColumn("_target", binary_label(label, type_of(df, label)))
    if "timestamp" in df.columns:
        df = df.withColumn("timestamp", as_timestamp("timestamp"))
    else:
        df = numbered(df, order, "_n")
        df = df.withColumn("timestamp", F.timestamp_add("MINUTE", F.col("_n").cast("int"), F.lit(start).cast("timestamp")))
    source = next((c for c in ("segment_id", "sensor_id", "asset_id", "source_file") if c in df.columns), None)
    df = segment_codes(fill_with_median(df, "temperature", 20.0), source)
    out = df.select(
        "timestamp", "segment_id", as_number("pressure").alias("pressure"), as_number("flow_rate").alias("flow_rate"),
        "temperature",
        *[F.lit(v).alias(c) for c, v in BACKFILL_DEFAULTS.items()],
        F.when(F.col("_target") == 1, "leak").otherwise("normal").alias("event_type"),
        F.col("_target").alias("target"), F.lit(dataset).alias("source_dataset"),
    )
    return usable(out).select(*REQUIRED_COLUMNS, "source_dataset")


def sensors(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c[:2] in SENSOR_BOUNDS]


def bound_sensors(df: DataFrame) -> DataFrame:
    """Impossible readings become NULL."""
    return df.withColumns({c: bounded_sensor(c) for c in sensors(df)})


def drop_silent_rows(df: DataFrame) -> DataFrame:
    """Drop rows on which every sensor is NULL."""
    return df.dropna(how="all", subset=sensors(df)) if sensors(df) else df


# Raw well sensor names and the columns they become.
WELL_SENSORS = {
    "P-PDG": "P_inlet",
    "P-TPT": "P_mid",
    "P-MON-CKP": "P_outlet",
    "T-PDG": "T_inlet",
    "T-TPT": "T_mid",
    "QGL": "Q_inlet",
}
# Raw columns worth reading.
WELL_COLUMNS = ["P-PDG", "P-TPT", "P-MON-CKP", "P-JUS-CKP", "T-PDG", "T-TPT", "QGL", "class"]


def rename_well_sensors(df: DataFrame) -> DataFrame:
    return df.withColumnsRenamed(WELL_SENSORS)


def label_events(df: DataFrame, column: str = "class", strict: bool = False) -> DataFrame:
    """Event class, binary target and event name; ``strict`` drops rows without a class."""
    if strict:
        df = df.where(F.col(column).isNotNull())
    df = df.withColumn("event_class", event_class(column))
    return df.withColumns({
        "target": (F.col("event_class") != 0).cast("int"),
        "event_type": event_class_name(F.col("event_class")),
    })


def every_nth(df: DataFrame, series: Series, step: int) -> DataFrame:
    """Rows 0, N, 2N, ... of each key."""
    if step <= 1:
        return df
    return scan(df, series, position="_nth").where((F.col("_nth") - 1) % step == 0).drop("_nth")


def derive_sensors(df: DataFrame) -> DataFrame:
    """Estimate outlet sensors and telemetry aliases where a column is absent altogether."""
    have = set(df.columns)
    new = {}
    if "P_outlet" not in have and "P_mid" in have:
        new["P_outlet"] = F.col("P_mid") * 0.85
    if "Q_outlet" not in have and "Q_inlet" in have:
        new["Q_outlet"] = F.col("Q_inlet") * F.when(F.col("target") == 1, 0.85).otherwise(0.98)
    if "T_outlet" not in have and "T_mid" in have:
        new["T_outlet"] = F.col("T_mid") - 2.0
    elif "T_outlet" not in have and "T_inlet" in have:
        new["T_outlet"] = F.col("T_inlet") - 5.0
    for alias, source in (("pressure", "P_inlet"), ("flow_rate", "Q_inlet"), ("temperature", "T_inlet")):
        if alias not in have and source in have:
            new[alias] = F.col(source)
    return df.withColumns(new) if new else df


def fill_along(df: DataFrame, series: Series, columns: Sequence[str], backward_first: bool = False) -> DataFrame:
    """Fill gaps from the latest value before, then from the earliest after (or the other way)."""
    df = scan(df, series, last_valid={f"_b_{c}": F.col(c) for c in columns},
              next_valid={f"_a_{c}": F.col(c) for c in columns})
    order = ("_a_", "_b_") if backward_first else ("_b_", "_a_")
    df = df.withColumns({c: F.coalesce(F.col(c), *[F.col(p + c) for p in order]) for c in columns})
    return df.drop(*[p + c for p in order for c in columns])


def model_matrix(df: DataFrame, series: Series, columns: Sequence[str], limit: float = 1e9) -> DataFrame:
    """Model-ready numbers: gaps filled backward, then forward, then 0; clipped; single precision."""
    df = df.withColumns({c: as_number(c) for c in columns})
    df = fill_along(df, series, columns, backward_first=True)
    return df.withColumns({c: clip(F.coalesce(F.col(c), F.lit(0.0)), -limit, limit).cast("float") for c in columns})


def reindex(df: DataFrame, columns: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Exactly ``columns`` in that order: absent ones are 0, extra ones go (``keep`` stays in front)."""
    return df.select(*keep, *[F.col(c) if c in df.columns else F.lit(0.0).alias(c) for c in columns])


def filter_view(df: DataFrame, segments: Sequence[int], first_day: str, last_day: str) -> DataFrame:
    """Rows of some segments between two days, as a range on the timestamp so that files can be skipped."""
    lo = F.lit(first_day).cast("date").cast("timestamp")
    hi = F.date_add(F.lit(last_day).cast("date"), 1).cast("timestamp")
    return df.where(F.col("segment_id").isin(list(segments)) & (F.col("timestamp") >= lo) & (F.col("timestamp") < hi))


# Flow, pressure, pump and energy multipliers of each operating regime.
REGIME_MULTIPLIERS = {
    "shutdown": {"flow": 0.08, "pressure": 0.72, "pump": 0.18, "energy": 0.28},
    "startup": {"flow": 0.65, "pressure": 0.88, "pump": 0.82, "energy": 0.78},
    "low_demand": {"flow": 0.82, "pressure": 1.05, "pump": 0.92, "energy": 0.87},
    "nominal": {"flow": 1.00, "pressure": 1.00, "pump": 1.00, "energy": 1.00},
    "high_demand": {"flow": 1.18, "pressure": 0.94, "pump": 1.10, "energy": 1.12},
    "maintenance_bypass": {"flow": 0.74, "pressure": 0.90, "pump": 0.75, "energy": 0.72},
}


def normalise_regime(df: DataFrame, regime: str = "operating_regime", signals: Mapping[str, str] | None = None) -> DataFrame:
    """Divide signals by what their operating regime multiplies them with (six-row dimension)."""
    signals = signals or {"flow_rate": "flow", "pressure": "pressure", "pump_speed": "pump", "energy_consumption": "energy"}
    rows = [(name, m["flow"], m["pressure"], m["pump"], m["energy"]) for name, m in REGIME_MULTIPLIERS.items()]
    dim = df.sparkSession.createDataFrame(rows, f"{regime} string, _flow double, _pressure double, _pump double, _energy double")
    out = df.join(F.broadcast(dim), regime, "left")
    used = {c: F.col(c) / F.coalesce(F.col(f"_{m}"), F.lit(1.0)) for c, m in signals.items() if c in df.columns}
    return out.withColumns(used).drop("_flow", "_pressure", "_pump", "_energy")
