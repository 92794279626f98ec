"""Column expressions shared by the operators; all stay inside generated JVM code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def finite(col: Column | str) -> Column:
    """NaN and infinities become NULL, so Spark aggregates skip them."""
    c = F.col(col) if isinstance(col, str) else col
    c = c.cast("double")
    return F.when(F.isnan(c) | (F.abs(c) == F.lit(float("inf"))), F.lit(None)).otherwise(c)


def as_number(col: Column | str) -> Column:
    """Numeric coercion: whatever does not parse becomes NULL."""
    c = F.col(col) if isinstance(col, str) else col
    return finite(c.try_cast("double"))


def as_timestamp(col: Column | str) -> Column:
    """Timestamp coercion for text or timestamp input: what does not parse becomes NULL."""
    c = F.col(col) if isinstance(col, str) else col
    return F.try_to_timestamp(c.cast("string"))


def ratio(num: Column, den: Column) -> Column:
    """``num/den`` with 0 where the denominator is 0 or either side is missing."""
    return F.coalesce(num / F.nullif(den, F.lit(0.0)), F.lit(0.0))


def clip(c: Column, low: float | None = None, high: float | None = None) -> Column:
    """NULL-preserving clip."""
    out = c
    if low is not None:
        out = F.when(c < low, F.lit(float(low))).otherwise(out)
    if high is not None:
        out = F.when(c > high, F.lit(float(high))).otherwise(out)
    return out


def stable_ratio(num: Column, den: Column, eps: float = 1e-3, limit: float | None = None) -> Column:
    """Division by a denominator kept at least ``eps`` away from zero, keeping its sign."""
    n, d = F.coalesce(num, F.lit(0.0)), F.coalesce(den, F.lit(0.0))
    floor = F.when(F.abs(d) >= eps, d).when(d < 0, F.lit(-eps)).otherwise(F.lit(eps))
    out = n / floor
    return out if limit is None else clip(out, -limit, limit)


# Texts that mean a positive label.
POSITIVE_TEXTS = [
    "1", "true", "yes", "y", "leak", "burst", "fault", "warning", "alarm",
    "anomaly", "incident", "abnormal",
]
# Texts a benchmark label column uses for its positive class.
BENCHMARK_POSITIVE_TEXTS = ["true", "1", "yes", "leak", "fault", "abnormal"]


def binary_label(name: str, dtype: str) -> Column:
    """0/1 label from a boolean, numeric or text column (numeric values above 1 are kept)."""
    c = F.col(name)
    if dtype == "boolean":
        return F.coalesce(c.cast("int"), F.lit(0))
    if dtype == "string":
        return F.when(F.lower(F.trim(c)).isin(POSITIVE_TEXTS), 1).otherwise(0)
    return F.greatest(F.coalesce(finite(c), F.lit(0.0)), F.lit(0.0)).cast("int")


# Well event classes and their names.
EVENT_CLASS_NAMES = {
    0: "NORMAL",
    1: "ABRUPT_INCREASE_OF_BSW",
    2: "SPURIOUS_CLOSURE_OF_DHSV",
    3: "SEVERE_SLUGGING",
    4: "FLOW_INSTABILITY",
    5: "RAPID_PRODUCTIVITY_LOSS",
    6: "QUICK_RESTRICTION_IN_PCK",
    7: "SCALING_IN_PCK",
    8: "HYDRATE_IN_PRODUCTION_LINE",
    9: "HYDRATE_IN_SERVICE_LINE",
}


def event_class(col: Column | str) -> Column:
    """Base class of a transient code: 0-9 stay, 100+n becomes n, missing becomes 0."""
    code = F.floor(as_number(col)).cast("int")
    return (
        F.when(code.isNull(), 0)
        .when(code.between(0, 9), code)
        .when((code >= 100) & (code % 100 <= 9), code % 100)
        .otherwise(code)
    )


def event_class_name(code: Column) -> Column:
    """Name of a base class, ``UNKNOWN`` where it has none (a literal map: ten entries)."""
    names = F.create_map(*[F.lit(v) for pair in EVENT_CLASS_NAMES.items() for v in pair])
    return F.coalesce(F.try_element_at(names, code), F.lit("UNKNOWN"))


# Plausible range per sensor family.
SENSOR_BOUNDS = {"P_": (-1e6, 1e9), "T_": (-100.0, 500.0), "Q_": (-1e3, 1e3)}


def bounded_sensor(name: str) -> Column:
    """A reading, or NULL where it is not finite or lies outside its family's range."""
    low, high = SENSOR_BOUNDS[name[:2]]
    c = as_number(name)
    return F.when(c.between(low, high), c)


# Words in the scenario context that mark a disturbance.
DISTURBANCE_WORDS = [
    "demand", "pump_wear", "valve", "sensor", "maintenance", "startup", "shutdown", "disturb", "drift",
]


def is_disturbance(col: Column | str) -> Column:
    """True where the context names any disturbance, whatever the case."""
    c = F.col(col) if isinstance(col, str) else col
    return F.coalesce(c.rlike("(?i)" + "|".join(DISTURBANCE_WORDS)), F.lit(False))


def add_tag(context: Column, tag: Column) -> Column:
    """Append a tag to a ``|``-joined tag set; an empty or ``nominal`` set is replaced."""
    empty = context.isNull() | context.isin("", "nominal")
    return F.when(empty, tag).otherwise(
        F.array_join(F.array_union(F.split(context, r"\|"), F.array(tag)), "|")
    )


# Event reported for each operating state; anything else is normal.
STATE_EVENTS = {"startup": "normal", "high_demand": "warning", "low_demand": "normal", "normal": "normal"}
# Fixed value: leak rate (m3/s) that counts as severity 1.
FULL_LEAK_RATE = 0.05


def state_event(state: Column) -> Column:
    """Event type of an operating state."""
    alerts = [s for s, e in STATE_EVENTS.items() if e == "warning"]
    return F.when(state.isin(alerts), "warning").otherwise("normal")


def leak_severity(rate: Column) -> Column:
    """Leak rate scaled to [0, 1]."""
    return clip(rate / FULL_LEAK_RATE, 0.0, 1.0)


def health_colour(severity: Column, efficiency: Column) -> Column:
    """Red / orange / green from leak severity and pump efficiency."""
    return (
        F.when((severity >= 0.55) | (efficiency < 0.75), "red")
        .when((severity >= 0.18) | (efficiency < 0.88), "orange")
        .otherwise("green")
    )


def health_label(severity: Column, efficiency: Column) -> Column:
    """Operator wording of a segment's condition."""
    return (
        F.when(severity >= 0.55, "LEAK ALARM")
        .when(severity >= 0.18, "LEAK WARNING")
        .when(efficiency < 0.75, "PUMP FAULT")
        .when(efficiency < 0.88, "PUMP DEGRADED")
        .otherwise("NORMAL")
    )


def confidence_band(score: Column) -> Column:
    """High / Medium / Low from a score."""
    return F.when(score >= 0.8, "High").when(score >= 0.4, "Medium").otherwise("Low")


def leak_type(score: Column, baseline_pct: Column, cusum: Column, event: Column, steps: Column) -> Column:
    """Rule-based leak type with its confidence as a struct ``(label, confidence)``."""
    dev = F.abs(F.coalesce(baseline_pct, F.lit(0.0)))
    drop = F.abs(F.coalesce(cusum, F.lit(0.0)))

    def verdict(label: str, confidence: str) -> Column:
        return F.struct(F.lit(label).alias("label"), F.lit(confidence).alias("confidence"))

    return (
        F.when((score >= 0.85) & (dev >= 0.05), verdict("Fast Rupture", "High"))
        .when((dev >= 0.04) | (drop >= 0.6), verdict("Slow Seep", "High"))
        .when((event == "warning") & (dev >= 0.015), verdict("Pump-Assisted Leak", "Medium"))
        .when((dev < 0.025) & (steps >= 4), verdict("Micro Leak", "Medium"))
        .otherwise(verdict("Slow Seep", "Medium"))
    )


def severity_weight(target: Column, severity: Column) -> Column:
    """Training weight: faint leaks count more."""
    s = F.coalesce(severity, F.lit(0.0))
    return (
        F.when(target != 1, 1.0)
        .when(s < 0.15, 12.0)
        .when(s < 0.3, 15.0)
        .when(s < 0.6, 3.0)
        .otherwise(1.0)
    )


def effective_score(score: Column, severity: Column, context: Column) -> Column:
    """Score fed to the alert policy: silent below the severity a scenario calls for."""
    floor = F.when(F.contains(F.lower(F.coalesce(context, F.lit(""))), F.lit("leak")), 0.03).otherwise(0.55)
    return F.when(severity.isNull(), score).when(severity >= floor, score).otherwise(0.0)


def sigmoid(x: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-x))


def model_label(name: Column) -> Column:
    """``field_random_forest`` -> ``Field Random Forest``."""
    return F.initcap(F.replace(name, F.lit("_"), F.lit(" ")))


def calendar_phases(ts: Column, segment: Column) -> dict[str, Column]:
    """Daily, half-day, weekly and ambient phase terms of a timestamp."""
    turn = F.lit(2.0) * F.pi()
    day = (F.hour(ts) * 60 + F.minute(ts)) / F.lit(1440.0)
    week = F.weekday(ts) / F.lit(7.0)
    return {
        "daily": F.sin(turn * (day - 0.18)),
        "shoulder": F.sin(turn * 2.0 * (day + segment * 0.03)),
        "weekly": F.sin(turn * (week + segment * 0.09)),
        "ambient": F.sin(turn * (day - 0.05)),
    }


def round_even(c: Column, digits: int) -> Column:
    """Round half to even on the scaled binary value, as NumPy does."""
    scale = float(10**digits)
    return F.rint(c * scale) / scale


def r6(c: Column | str, digits: int = 6) -> Column:
    """Rounding used when comparing results across engines: nudged off exact ties, -0.0 turned into 0.0.

    Works on the scaled binary value, which is far cheaper than the decimal arithmetic of ``round``.
    """
    c = F.col(c) if isinstance(c, str) else c
    scale = float(10**digits)
    return F.rint((c + 1e-9) * scale) / scale + 0.0
