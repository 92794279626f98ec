"""Time-series features over the telemetry and shipment views."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from telemill.functions import r6
from telemill.operators import features as ft
from telemill.operators.series import scan, time_series
from telemill.sources import views

from .registry import SHIPMENTS, TELEMETRY, query, r

SEQ = "PARTITION BY segment_id ORDER BY timestamp, seq"
SHIP = "PARTITION BY segment_id ORDER BY timestamp, l_orderkey, l_linenumber, l_partkey"


def back(n: int, spec: str = SEQ) -> str:
    return f"({spec} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def std(col: str, n: int, spec: str = SEQ) -> str:
    s = f"stddev_samp({col}) OVER {back(n, spec)}"
    return f"CASE WHEN {s} >= 1e-9 THEN {s} ELSE 0.0 END"


def deltas(source: str = "telemetry", spec: str = SEQ) -> str:
    """A CTE with lags and deltas; windows over it see deltas as plain columns."""
    return f"""
d AS (
  SELECT *, lag(pressure) OVER ({spec}) AS lp, lag(flow_rate) OVER ({spec}) AS lf,
         coalesce(pressure - lag(pressure) OVER ({spec}), 0) AS dp,
         coalesce(flow_rate - lag(flow_rate) OVER ({spec}), 0) AS df,
         row_number() OVER ({spec}) AS rn
  FROM {source})"""


def telemetry_features(spark: SparkSession, folder: str, wanted: list[str], tick: str = "tick") -> DataFrame:
    t = views.telemetry(spark, folder)
    s = time_series(t, ["segment_id"])
    out = ft.build_features(t, s, wanted, tick=tick)
    return out.select("segment_id", "seq", *[r6(c).alias(c) for c in wanted])


# SQL per feature over the CTE ``d``
def feature_sql(spec: str) -> dict[str, str]:
    def div(a: str, b: str) -> str:
        return f"coalesce(({a}) / nullif({b}, 0), 0)"

    m = {k: f"avg({c}) OVER {back(n, spec)}" for k, c, n in [
        ("p5", "pressure", 5), ("f5", "flow_rate", 5), ("p20", "pressure", 20), ("f20", "flow_rate", 20),
        ("p30", "pressure", 30), ("f30", "flow_rate", 30), ("p90", "pressure", 90), ("f90", "flow_rate", 90)]}
    upto = f"({spec} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    return {
        "pressure_delta": "dp",
        "flow_rate_delta": "df",
        "pressure_pct_delta": div("dp", "abs(lp)"),
        "flow_pct_delta": div("df", "abs(lf)"),
        "pressure_flow_ratio": div("pressure", "flow_rate"),
        "pressure_roll_mean": m["p5"],
        "pressure_roll_std": std("pressure", 5, spec),
        "flow_roll_mean": m["f5"],
        "flow_roll_std": std("flow_rate", 5, spec),
        "pressure_roll_z": div(f"pressure - {m['p5']}", std("pressure", 5, spec)),
        "flow_roll_z": div(f"flow_rate - {m['f5']}", std("flow_rate", 5, spec)),
        "pressure_delta_deviation": f"dp - avg(dp) OVER {back(5, spec)}",
        "flow_neg_streak": f"sum(CASE WHEN df < -0.01 THEN 1.0 ELSE 0.0 END) OVER {back(10, spec)}",
        "pressure_baseline_dev": f"pressure - {m['p20']}",
        "flow_baseline_dev": f"flow_rate - {m['f20']}",
        "pressure_baseline_pct": div(f"pressure - {m['p20']}", f"abs({m['p20']})"),
        "pressure_roll30_std": std("pressure", 30, spec),
        "flow_roll30_std": std("flow_rate", 30, spec),
        "pressure_cusum_neg30": f"sum(least(dp, 0)) OVER {back(30, spec)}",
        "flow_cusum_neg30": f"sum(least(df, 0)) OVER {back(30, spec)}",
        "pressure_flow_divergence":
            f"{div('pressure - ' + m['p30'], 'abs(' + m['p30'] + ')')} - "
            f"{div('flow_rate - ' + m['f30'], 'abs(' + m['f30'] + ')')}",
        "pressure_neg_streak15": f"sum(CASE WHEN dp < -0.05 THEN 1.0 ELSE 0.0 END) OVER {back(15, spec)}",
        "pressure_accel": f"coalesce(dp - lag(dp) OVER ({spec}), 0)",
        "pressure_baseline60_dev": f"pressure - {m['p90']}",
        "flow_baseline60_dev": f"flow_rate - {m['f90']}",
        "pressure_expanding_dev": f"pressure - avg(pressure) OVER {upto}",
        "flow_expanding_dev": f"flow_rate - avg(flow_rate) OVER {upto}",
    }


FEATURE_SQL = feature_sql(SEQ)
SHIP_FEATURE_SQL = feature_sql(SHIP)


def sql_for(wanted: list[str]) -> str:
    cols = ", ".join(r(FEATURE_SQL[c], c) for c in wanted)
    return f"WITH {TELEMETRY}, {deltas()} SELECT segment_id, seq, {cols} FROM d"


FAMILIES = {
    "features_delta": ("W1", ft.DELTAS),
    "features_relative_change": ("W2 W3", ft.RELATIVE),
    "features_rolling": ("W4 W5", ft.ROLLING),
    "features_zscore": ("W6", ft.ZSCORES),
    "features_short_trend": ("W7 W8", ft.SHORT_TREND),
    "features_baseline": ("W10 W19", ft.BASELINE),
    "features_slow_leak": ("W11 W12 W13 W14 W16", ft.SLOW_LEAK),
    "features_long_baseline": ("W17", ft.LONG_BASELINE),
    "features_expanding": ("W18", ft.EXPANDING),
}


def _register_family(name: str, covers: str, wanted: list[str]) -> None:
    @query(name, covers, sql_for(wanted))
    def run(spark: SparkSession, folder: str) -> DataFrame:
        return telemetry_features(spark, folder, wanted)


for _name, (_ids, _cols) in FAMILIES.items():
    _register_family(_name, _ids, _cols)


@query("features_cross_segment", "W9 A4", f"""
WITH {TELEMETRY}, m AS (SELECT tick, avg(pressure) AS mp, avg(flow_rate) AS mf FROM telemetry GROUP BY tick)
SELECT segment_id, seq, {r('pressure - mp', 'pressure_segment_deviation')},
       {r('flow_rate - mf', 'flow_segment_deviation')}
FROM telemetry JOIN m USING (tick)""")
def features_cross_segment(spark, folder):
    return telemetry_features(spark, folder, ft.CROSS_SEGMENT)


_EMA_SQL = f"""
WITH RECURSIVE {TELEMETRY},
o AS (SELECT *, row_number() OVER ({SEQ}) AS rn FROM telemetry),
e AS (
  SELECT segment_id, seq, rn, pressure, flow_rate, pressure AS np, flow_rate AS nf, CAST(1.0 AS DOUBLE) AS w
  FROM o WHERE rn = 1
  UNION ALL
  SELECT o.segment_id, o.seq, o.rn, o.pressure, o.flow_rate, e.np * (19.0 / 21.0) + o.pressure,
         e.nf * (19.0 / 21.0) + o.flow_rate, e.w * (19.0 / 21.0) + 1.0
  FROM e JOIN o ON o.segment_id = e.segment_id AND o.rn = e.rn + 1)
SELECT segment_id, seq, {r('pressure - np / w', 'pressure_ema_dev')}, {r('flow_rate - nf / w', 'flow_ema_dev')}
FROM e"""


@query("features_ema", "W15", _EMA_SQL)
def features_ema(spark, folder):
    return telemetry_features(spark, folder, ft.EMA)


_ALL_SHIP = [c for c in ft.FEATURES if c not in ft.CROSS_SEGMENT + ft.EMA]


@query("features_full_shipments", "W1 W2 W3 W4 W5 W6 W7 W8 W9 W10 W11 W12 W13 W14 W16 W17 W18 W19", f"""
WITH {SHIPMENTS}, {deltas('shipments', SHIP)},
m AS (SELECT timestamp, avg(pressure) AS mp, avg(flow_rate) AS mf FROM shipments GROUP BY timestamp)
SELECT segment_id, rn AS step, {', '.join(r(SHIP_FEATURE_SQL[c], c) for c in _ALL_SHIP)},
       {r('pressure - mp', 'pressure_segment_deviation')}, {r('flow_rate - mf', 'flow_segment_deviation')}
FROM d JOIN m USING (timestamp)""")
def features_full_shipments(spark, folder):
    t = views.shipments(spark, folder)
    s = time_series(t, ["segment_id"], tiebreak=views.SHIPMENT_ORDER)
    wanted = _ALL_SHIP + ft.CROSS_SEGMENT
    out = ft.build_features(scan(t, s, position="step"), s, wanted)
    return out.select("segment_id", F.col("step").cast("long").alias("step"), *[r6(c).alias(c) for c in wanted])


# SQL per feature over the CTEs ``d`` and ``e``
EMA_SQL = {"pressure_ema_dev": "pressure - np / w", "flow_ema_dev": "flow_rate - nf / w"}


def ema() -> str:
    """A recursive CTE with the weighted sums behind the exponential means, on the rows of ``d``."""
    return """
e AS (
  SELECT segment_id, rn, pressure AS np, flow_rate AS nf, CAST(1.0 AS DOUBLE) AS w FROM d WHERE rn = 1
  UNION ALL
  SELECT d.segment_id, d.rn, e.np * (19.0 / 21.0) + d.pressure, e.nf * (19.0 / 21.0) + d.flow_rate, e.w * (19.0 / 21.0) + 1.0
  FROM e JOIN d ON d.segment_id = e.segment_id AND d.rn = e.rn + 1)"""


@query("features_whole_shipments", "W1 W2 W3 W4 W5 W6 W7 W8 W9 W10 W11 W12 W13 W14 W15 W16 W17 W18 W19 D7", f"""
WITH RECURSIVE {SHIPMENTS}, {deltas('shipments', SHIP)}, {ema()},
m AS (SELECT timestamp, avg(pressure) AS mp, avg(flow_rate) AS mf FROM shipments GROUP BY timestamp),
c AS (SELECT regime, row_number() OVER (ORDER BY regime) - 1 AS code FROM (SELECT DISTINCT regime FROM shipments WHERE regime IS NOT NULL))
SELECT segment_id, rn AS step, {', '.join(r(SHIP_FEATURE_SQL[c], c) for c in _ALL_SHIP)}, {', '.join(r(x, c) for c, x in EMA_SQL.items())},
       {r('pressure - mp', 'pressure_segment_deviation')}, {r('flow_rate - mf', 'flow_segment_deviation')}, CAST(coalesce(code, -1) AS INTEGER) AS event_type_encoded
FROM d JOIN e USING (segment_id, rn) JOIN m USING (timestamp) LEFT JOIN c USING (regime)""")
def features_whole_shipments(spark, folder):
    """Every feature column; the regime stands in for the event type, which shipments lack."""
    t = views.shipments(spark, folder).withColumn("event_type", F.col("regime"))
    s = time_series(t, ["segment_id"], tiebreak=views.SHIPMENT_ORDER)
    out = ft.build_features(scan(t, s, position="step"), s, encode_events=True)
    return out.select("segment_id", F.col("step").cast("long").alias("step"), *[r6(c).alias(c) for c in ft.FEATURES], ft.EVENT_CODE)


_CODES = """
c AS (SELECT event_type, row_number() OVER (ORDER BY event_type) - 1 AS code FROM (SELECT DISTINCT event_type FROM telemetry WHERE event_type IS NOT NULL))"""
_FIVE = f"({SEQ} ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)"
_TWENTY = f"({SEQ} ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)"
# columns of the two sets, written out so that the check does not follow the library's own lists
_MINIMAL_SQL = [
    r("dp", "pressure_delta"), r("df", "flow_rate_delta"),
    r(f"avg(pressure) OVER {_FIVE}", "pressure_roll_mean"), r(f"avg(flow_rate) OVER {_FIVE}", "flow_roll_mean"),
    r(f"CASE WHEN stddev_samp(pressure) OVER {_FIVE} >= 1e-9 THEN stddev_samp(pressure) OVER {_FIVE} ELSE 0 END", "pressure_roll_std"),
    r(f"CASE WHEN stddev_samp(flow_rate) OVER {_FIVE} >= 1e-9 THEN stddev_samp(flow_rate) OVER {_FIVE} ELSE 0 END", "flow_roll_std"),
    r("coalesce(pressure / nullif(flow_rate, 0), 0)", "pressure_flow_ratio"),
    "CAST(coalesce(code, -1) AS INTEGER) AS event_type_encoded",
]
_FAST_SQL = _MINIMAL_SQL + [
    r("coalesce(dp / nullif(abs(lp), 0), 0)", "pressure_pct_delta"), r("coalesce(df / nullif(abs(lf), 0), 0)", "flow_pct_delta"),
    r(f"coalesce(CASE WHEN stddev_samp(pressure) OVER {_FIVE} >= 1e-9 THEN (pressure - avg(pressure) OVER {_FIVE}) / stddev_samp(pressure) OVER {_FIVE} END, 0)", "pressure_roll_z"),
    r(f"coalesce(CASE WHEN stddev_samp(flow_rate) OVER {_FIVE} >= 1e-9 THEN (flow_rate - avg(flow_rate) OVER {_FIVE}) / stddev_samp(flow_rate) OVER {_FIVE} END, 0)", "flow_roll_z"),
    r(f"dp - avg(dp) OVER {_FIVE}", "pressure_delta_deviation"),
    r(f"sum(CASE WHEN df < -0.01 THEN 1 ELSE 0 END) OVER ({SEQ} ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)", "flow_neg_streak"),
    r("pressure - mp", "pressure_segment_deviation"), r("flow_rate - mf", "flow_segment_deviation"),
    r(f"pressure - avg(pressure) OVER {_TWENTY}", "pressure_baseline_dev"), r(f"flow_rate - avg(flow_rate) OVER {_TWENTY}", "flow_baseline_dev"),
]


def coded_features(spark: SparkSession, folder: str, wanted: list[str]) -> DataFrame:
    t = views.telemetry(spark, folder)
    out = ft.build_features(t, time_series(t, ["segment_id"]), wanted, tick="tick", encode_events=True)
    return out.select("segment_id", "seq", *[r6(c).alias(c) for c in wanted], ft.EVENT_CODE)


@query("features_minimal", "W36", f"""
WITH {TELEMETRY}, {deltas()}, {_CODES}
SELECT segment_id, seq, {', '.join(_MINIMAL_SQL)} FROM d LEFT JOIN c USING (event_type)""")
def features_minimal(spark, folder):
    return coded_features(spark, folder, ft.MINIMAL_FEATURES)


@query("features_fast", "W36", f"""
WITH {TELEMETRY}, {deltas()}, {_CODES}, m AS (SELECT tick, avg(pressure) AS mp, avg(flow_rate) AS mf FROM telemetry GROUP BY tick)
SELECT segment_id, seq, {', '.join(_FAST_SQL)} FROM d JOIN m USING (tick) LEFT JOIN c USING (event_type)""")
def features_fast(spark, folder):
    return coded_features(spark, folder, ft.FAST_FEATURES)


@query("event_codes", "D7", f"""
WITH {TELEMETRY}, c AS (
  SELECT event_type, row_number() OVER (ORDER BY event_type) - 1 AS code
  FROM (SELECT DISTINCT event_type FROM telemetry WHERE event_type IS NOT NULL))
SELECT seq, CAST(coalesce(code, -1) AS INTEGER) AS event_type_encoded FROM telemetry LEFT JOIN c USING (event_type)""")
def event_codes(spark, folder):
    from telemill.operators.labels import category_codes

    return category_codes(views.telemetry(spark, folder), "event_type", "event_type_encoded").select(
        "seq", "event_type_encoded")


_V = {
    "pressure": f"coalesce(last_value(nullif(pressure, 100.0) IGNORE NULLS) OVER ({SEQ} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0)",
    "flow_rate": f"coalesce(last_value(flow_rate IGNORE NULLS) OVER ({SEQ} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0)",
    "temperature": f"coalesce(last_value(temperature IGNORE NULLS) OVER ({SEQ} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0)",
}


def _generic_cols(c: str) -> str:
    return ", ".join([
        r(f"avg({c}) OVER {back(5)}", f"{c}_roll_mean"), r(std(c, 5), f"{c}_roll_std"),
        r(f"min({c}) OVER {back(5)}", f"{c}_roll_min"), r(f"max({c}) OVER {back(5)}", f"{c}_roll_max"),
        r(f"coalesce({c} - lag({c}) OVER ({SEQ}), 0)", f"{c}_delta"), r(c, c),
    ])


@query("features_generic_sensors", "W25", f"""
WITH {TELEMETRY},
v AS (SELECT segment_id, seq, timestamp, coalesce(nullif(pressure, 100.0), 0) AS raw_p, flow_rate AS raw_f,
             {', '.join(f'{e} AS {c}' for c, e in _V.items())} FROM telemetry),
k AS (SELECT avg(raw_p) AS mp FROM v)
SELECT segment_id, seq, {', '.join(_generic_cols(c) for c in _V)},
       {r('raw_p / coalesce(nullif(raw_f, 0), (SELECT mp FROM k))', 'pressure_flow_ratio')}
FROM v""")
def features_generic_sensors(spark, folder):
    t = views.telemetry(spark, folder).withColumn("pressure", F.nullif("pressure", F.lit(100.0)))
    out = ft.sensor_features(t, time_series(t, ["segment_id"]))
    made = [f"{c}_{k}" for c in _V for k in ("roll_mean", "roll_std", "roll_min", "roll_max", "delta")]
    return out.select("segment_id", "seq", *[r6(c).alias(c) for c in [*made, *_V, "pressure_flow_ratio"]])


@query("first_order_lag", "W32", f"""
WITH RECURSIVE {TELEMETRY},
o AS (SELECT *, row_number() OVER ({SEQ}) AS rn FROM telemetry),
e AS (
  SELECT segment_id, seq, rn, pressure AS y FROM o WHERE rn = 1
  UNION ALL
  SELECT o.segment_id, o.seq, o.rn, e.y + (10.0 / 40.0) * (o.pressure - e.y)
  FROM e JOIN o ON o.segment_id = e.segment_id AND o.rn = e.rn + 1)
SELECT segment_id, seq, {r('y', 'smoothed')} FROM e""")
def first_order_lag(spark, folder):
    t = views.telemetry(spark, folder)
    out = ft.smooth(t, time_series(t, ["segment_id"]), {"smoothed": "pressure"}, dt=10.0, tau=30.0)
    return out.select("segment_id", "seq", r6("smoothed").alias("smoothed"))
