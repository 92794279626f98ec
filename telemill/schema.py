"""Table schemas, fixed column lists, and schema checks that need no job."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import types as T

# Columns every training table must carry.
REQUIRED_COLUMNS = [
    "timestamp", "segment_id", "pressure", "flow_rate", "temperature",
    "valve_status", "pump_state", "pump_speed", "compressor_state",
    "energy_consumption", "alarm_triggered", "event_type", "target",
]

# Rows lacking any of these are unusable for training.
ESSENTIAL_COLUMNS = ["timestamp", "pressure", "flow_rate", "temperature", "target"]

# Constants for operational columns a source does not have.
BACKFILL_DEFAULTS = {
    "valve_status": 1,
    "pump_state": 1,
    "pump_speed": 0.0,
    "compressor_state": 1,
    "energy_consumption": 0.0,
    "alarm_triggered": 0,
}

# Canonical columns a heterogeneous source may be mapped to.
CANONICAL_COLUMNS = [
    "timestamp", "asset_id", "segment_id", "sensor_id", "pressure", "flow_rate",
    "temperature", "vibration", "rpm", "power", "status_label", "leak_label",
    "anomaly_label", "target_localization", "dataset_name",
]

TELEMETRY_SCHEMA = T.StructType([
    T.StructField("timestamp", T.TimestampType()),
    T.StructField("segment_id", T.IntegerType()),
    T.StructField("pressure", T.DoubleType()),
    T.StructField("flow_rate", T.DoubleType()),
    T.StructField("temperature", T.DoubleType()),
    T.StructField("valve_status", T.IntegerType()),
    T.StructField("pump_state", T.IntegerType()),
    T.StructField("pump_speed", T.DoubleType()),
    T.StructField("compressor_state", T.IntegerType()),
    T.StructField("energy_consumption", T.DoubleType()),
    T.StructField("alarm_triggered", T.IntegerType()),
    T.StructField("event_type", T.StringType()),
    T.StructField("target", T.IntegerType()),
])

INCIDENT_SCHEMA = T.StructType([
    T.StructField("history_id", T.StringType()),
    T.StructField("event_id", T.StringType()),
    T.StructField("event_type", T.StringType()),
    T.StructField("segment_ids", T.StringType()),
    T.StructField("start_step", T.IntegerType()),
    T.StructField("duration_steps", T.IntegerType()),
    T.StructField("intensity", T.DoubleType()),
    T.StructField("kind", T.StringType()),
])


def require_columns(df: DataFrame, required: Iterable[str] = tuple(REQUIRED_COLUMNS)) -> DataFrame:
    """Return ``df`` unchanged, or raise ``ValueError`` naming what is missing."""
    missing = [name for name in required if name not in df.columns]
    if missing:
        raise ValueError(f"Missing required columns: {missing}")
    return df


def numeric_columns(df: DataFrame, exclude: Iterable[str] = ("target", "timestamp", "alarm_triggered")) -> list[str]:
    """Names of the numeric columns that may serve as model inputs."""
    skip = set(exclude)
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType) and f.name not in skip]


def resolve_target(df: DataFrame, declared: str | None = None) -> str | None:
    """The label column: the declared one, else ``target``, else ``leak_label``, else nothing."""
    for name in (declared, "target", "leak_label"):
        if name and name in df.columns:
            return name
    return None
