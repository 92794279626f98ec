"""Runs, histories, snapshots, profiles and quality checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from telemill.functions import calendar_phases, r6
from telemill.operators import features as ft
from telemill.operators import profile as pf
from telemill.operators import quality as qa
from telemill.operators import runs as rn
from telemill.operators import wide as wd
from telemill.operators.cleaning import bound_sensors, label_events
from telemill.operators.quantiles import exact_quantiles
from telemill.operators.series import Series, time_series
from telemill.sources import views

from .cleaning import BOUNDED, ROW, ROW_SQL, WELL, stable_sql, well_series
from .features import FEATURE_SQL, SEQ, deltas
from .registry import SCORES, SHIPMENTS, TELEMETRY, WIDE, query, r

CTX_SQL = "CASE seq % 7 WHEN 0 THEN 'leak_progression' WHEN 1 THEN 'pump_wear' WHEN 2 THEN 'Demand_shock|leak_progression' ELSE 'nominal' END"
CONTEXT = f"ctx AS (SELECT *, {CTX_SQL} AS scenario_context FROM telemetry)"


def with_context(t):
    k = F.col("seq") % 7
    return t.withColumn("scenario_context", F.when(k == 0, "leak_progression").when(k == 1, "pump_wear")
                        .when(k == 2, "Demand_shock|leak_progression").otherwise("nominal"))


_ISLANDS = f"""
flag AS (SELECT *, CASE WHEN lag(target) OVER ({SEQ}) IS DISTINCT FROM target THEN 1 ELSE 0 END AS ch FROM telemetry),
isl AS (SELECT *, sum(ch) OVER ({SEQ} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run FROM flag)"""


@query("leak_event_runs", "W20", f"""
WITH {TELEMETRY}, {_ISLANDS}
SELECT segment_id, CAST(run AS BIGINT) AS run, count(*) AS duration, {r('max(leak_severity)', 'max_severity')},
       CASE WHEN max(leak_severity) < 0.18 THEN 'borderline' WHEN count(*) >= 30 AND max(leak_severity) < 0.45 THEN 'slow' ELSE 'abrupt' END AS kind
FROM isl WHERE target = 1 GROUP BY segment_id, run""")
def leak_event_runs(spark, folder):
    t = views.telemetry(spark, folder)
    out = rn.leak_events(t, time_series(t, ["segment_id"]))
    return out.select("segment_id", "run", "duration", r6("max_severity").alias("max_severity"), "kind")


@query("stale_sensor_rate", "W21", f"""
WITH {TELEMETRY}, p AS (SELECT *, lag(pressure) OVER ({SEQ}) AS lp, lag(flow_rate) OVER ({SEQ}) AS lf, lag(temperature) OVER ({SEQ}) AS lt FROM telemetry),
s AS (SELECT avg(CASE WHEN abs(pressure - lp) < 1e-9 THEN 1.0 ELSE 0.0 END) AS a, avg(CASE WHEN abs(flow_rate - lf) < 1e-9 THEN 1.0 ELSE 0.0 END) AS b,
             avg(CASE WHEN abs(temperature - lt) < 1e-9 THEN 1.0 ELSE 0.0 END) AS c FROM p)
SELECT {r('a', 'pressure_stale')}, {r('b', 'flow_rate_stale')}, {r('c', 'temperature_stale')}, {r('(a + b + c) / 3', 'stale_sensor_rate')} FROM s""")
def stale_sensor_rate(spark, folder):
    t = views.telemetry(spark, folder)
    out = rn.stale_rate(t, time_series(t, ["segment_id"]), ["pressure", "flow_rate", "temperature"])
    return out.select(*[r6(c).alias(c) for c in out.columns])


@query("history_ids", "W22", f"""
WITH {SHIPMENTS}, a AS (
  SELECT *, coalesce(lag(timestamp) OVER w > timestamp, false) AS reset FROM shipments WINDOW w AS (PARTITION BY segment_id ORDER BY l_orderkey, l_linenumber, l_partkey, timestamp))
SELECT segment_id, l_orderkey, l_linenumber, l_partkey, CAST(segment_id AS VARCHAR) || '|hist_' ||
       CAST(CAST(sum(CASE WHEN reset THEN 1 ELSE 0 END) OVER (PARTITION BY segment_id ORDER BY l_orderkey, l_linenumber, l_partkey, timestamp ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS VARCHAR) AS history_id FROM a""")
def history_ids(spark, folder):
    s = views.shipments(spark, folder)
    arrival = time_series(s, ["segment_id"], time="timestamp", tiebreak=[])
    arrival = Series(arrival.keys, (*views.SHIPMENT_ORDER, "timestamp"), None if arrival.slot is None else F.floor(F.col("l_orderkey") / 1_000_000))
    return rn.history_ids(s, arrival).select("segment_id", *views.SHIPMENT_ORDER, "history_id")


@query("context_blocks", "W23", f"""
WITH {TELEMETRY}, {CONTEXT}, f AS (SELECT *, CASE WHEN lag(scenario_context) OVER ({SEQ}) IS DISTINCT FROM scenario_context THEN 1 ELSE 0 END AS ch FROM ctx)
SELECT segment_id, seq, CAST(sum(ch) OVER ({SEQ} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS block FROM f""")
def context_blocks(spark, folder):
    t = with_context(views.telemetry(spark, folder))
    return rn.equal_runs(t, time_series(t, ["segment_id"]), ["scenario_context"], "block").select("segment_id", "seq", "block")


_W5 = "(PARTITION BY scenario_id ORDER BY timestamp, l_orderkey, l_linenumber, l_partkey ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)"
_SENS = ", ".join(f"coalesce({c}, 0.0) AS {c}" for c in wd.SENSORS)


def _wide_cols(mode: str) -> dict[str, str]:
    def div(n: str, d: str, limit: float) -> str:
        return stable_sql(n, d, limit) if mode == "safe" else f"({n}) / (({d}) + 1e-6)"

    cols = {c: (f"{c} / 1e6" if c[0] == "P" else c) for c in wd.SENSORS}
    cols |= {
        "P_drop_inlet_to_mid": "(P_inlet - P_mid) / 1e6", "P_drop_mid_to_outlet": "(P_mid - P_outlet) / 1e6",
        "P_drop_total": "(P_inlet - P_outlet) / 1e6", "Q_imbalance": "Q_inlet - Q_outlet",
        "Q_imbalance_pct": div("100 * (Q_inlet - Q_outlet)", "Q_inlet", 1e4), "Q_ratio": div("Q_inlet", "Q_outlet", 1e3),
        "T_drop_inlet_to_outlet": "T_inlet - T_outlet", "T_gradient_per_km": "(T_inlet - T_outlet) * 0.1"}
    if mode == "safe":
        cols["P_ratio_in_out"] = div("P_inlet", "P_outlet", 1e3)
    for c in wd.ROLLED:
        unit = " / 1e6" if c[0] == "P" else ""
        cols[f"{c}_rolling_mean_5"] = f"CASE WHEN size >= 5 THEN avg({c}) OVER {_W5} ELSE 0.0 END{unit}"
        sd = f"stddev_samp({c}) OVER {_W5}"
        cols[f"{c}_rolling_std_5"] = f"CASE WHEN size >= 5 AND {sd} >= 1e-9 THEN {sd} ELSE 0.0 END{unit}"
    return cols


def _wide_query(name: str, mode: str, exact: dict[str, str] = {}) -> None:
    """``exact``: further columns, compared without rounding."""
    cols = _wide_cols(mode)

    @query(name, "W24", f"""
    WITH {WIDE}, {BOUNDED}, z AS (SELECT scenario_id, timestamp, l_orderkey, l_linenumber, l_partkey, {_SENS}, count(*) OVER (PARTITION BY scenario_id) AS size FROM bounded)
    SELECT {', '.join([ROW_SQL, *[r(e, c) for c, e in cols.items()], *[f'{e} AS {c}' for c, e in exact.items()]])} FROM z""")
    def run(spark, folder):
        w = bound_sensors(views.wide(spark, folder))
        out = wd.wide_features(w, well_series(w), ratio_mode=mode)

        def scaled(c: str):  # pressures in MPa, ratios as they are
            return F.col(c) / 1e6 if c[0] == "P" and "ratio" not in c else F.col(c)

        return out.select(*ROW, *[r6(scaled(c)).alias(c) for c in cols], *exact)


_wide_query("wide_features", "safe")
_wide_query("wide_features_epsilon", "epsilon")
# over a zero outlet pressure the ratio is near 1e14, where six decimals are beyond a double
_wide_query("wide_features_epsilon_whole", "epsilon", {"P_ratio_in_out": "P_inlet / (P_outlet + CAST(1e-6 AS DOUBLE))"})


@query("drop_warmup", "W26", f"WITH {TELEMETRY}, n AS (SELECT *, row_number() OVER ({SEQ}) AS k FROM telemetry) SELECT seq, segment_id FROM n WHERE k > 5")
def drop_warmup(spark, folder):
    t = views.telemetry(spark, folder)
    return rn.drop_warmup(t, time_series(t, ["segment_id"])).select("seq", "segment_id")


@query("step_index", "W27", f"WITH {SCORES} SELECT model_name, run_id, seq, step AS step_index FROM steps")
def step_index(spark, folder):
    s = views.scores(spark, folder)
    return rn.step_index(s, time_series(s, ["model_name", "run_id", "segment_id"])).select("model_name", "run_id", "seq", "step_index")


@query("ideal_detections", "W28", f"""
WITH {TELEMETRY}, {CONTEXT}, x AS (SELECT *, CASE WHEN event_type = 'click' THEN 'warning' ELSE event_type END AS ev FROM ctx)
SELECT segment_id, seq, pressure, flow_rate, ev AS event_type, target, 'Ideal detection' AS marker_label FROM x
WHERE scenario_context LIKE '%leak_progression%' AND (target = 1 OR ev IN ('warning', 'fault'))
QUALIFY row_number() OVER (PARTITION BY segment_id ORDER BY timestamp, seq) = 1""")
def ideal_detections(spark, folder):
    t = with_context(views.telemetry(spark, folder)).withColumn(
        "event_type", F.when(F.col("event_type") == "click", "warning").otherwise(F.col("event_type")))
    return rn.ideal_detections(t, ["segment_id"], ["timestamp", "seq"]).select(
        "segment_id", "seq", "pressure", "flow_rate", "event_type", "target", "marker_label")


@query("last_rows", "W29 T4 P8", f"WITH {TELEMETRY} SELECT segment_id, seq FROM telemetry QUALIFY row_number() OVER (PARTITION BY segment_id ORDER BY timestamp DESC, seq DESC) <= 30")
def last_rows(spark, folder):
    return rn.last_rows(views.telemetry(spark, folder), ["segment_id"], ["timestamp", "seq"], 30).select("segment_id", "seq")


@query("trailing_runs", "W30", f"""
WITH {SCORES}, b AS (SELECT model_name, segment_id, max(step) FILTER (WHERE leak_score < 0.3) AS broken FROM steps GROUP BY ALL)
SELECT model_name, segment_id, count(*) FILTER (WHERE broken IS NULL OR step > broken) AS trailing FROM steps JOIN b USING (model_name, segment_id) GROUP BY ALL""")
def trailing_runs(spark, folder):
    return rn.trailing_run(views.scores(spark, folder), ["model_name", "segment_id"], ["timestamp", "seq"], F.col("leak_score") >= 0.3)


@query("latest_snapshot", "W31", f"WITH {SHIPMENTS} SELECT segment_id, l_orderkey, l_linenumber, l_partkey, pressure FROM shipments WHERE timestamp = (SELECT max(timestamp) FROM shipments)")
def latest_snapshot(spark, folder):
    return rn.latest_snapshot(views.shipments(spark, folder)).select("segment_id", *views.SHIPMENT_ORDER, "pressure")


@query("resampled_series", "W33", f"""
WITH {TELEMETRY}, o AS (SELECT segment_id, pressure, row_number() OVER ({SEQ}) - 1 AS n, count(*) OVER (PARTITION BY segment_id) AS size FROM telemetry),
g AS (SELECT DISTINCT segment_id, size, p.point, p.point * (size - 1) / 23.0 AS at FROM o, (SELECT unnest(range(24)) AS point) p)
SELECT g.segment_id, CAST(g.point AS INTEGER) AS point, {r('a.pressure + (b.pressure - a.pressure) * (g.at - floor(g.at))', 'pressure')}
FROM g JOIN o a ON a.segment_id = g.segment_id AND a.n = floor(g.at) JOIN o b ON b.segment_id = g.segment_id AND b.n = ceil(g.at)""")
def resampled_series(spark, folder):
    t = views.telemetry(spark, folder)
    out = rn.resample_linear(t, time_series(t, ["segment_id"]), "pressure", 24)
    return out.select("segment_id", "point", r6("pressure").alias("pressure"))


_BLOCKS = """
fl AS (SELECT *, CASE WHEN lag(flow_rate) OVER (PARTITION BY segment_id ORDER BY timestamp, l_orderkey, l_linenumber, l_partkey) IS DISTINCT FROM flow_rate THEN 1 ELSE 0 END AS ch FROM shipments),
bl AS (SELECT *, sum(ch) OVER (PARTITION BY segment_id ORDER BY timestamp, l_orderkey, l_linenumber, l_partkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS block FROM fl)"""


def ship(spark, folder):
    s = views.shipments(spark, folder)
    return s, time_series(s, ["segment_id"], tiebreak=views.SHIPMENT_ORDER)


@query("stale_blocks", "W34", f"""
WITH {SHIPMENTS}, {_BLOCKS} SELECT segment_id, CAST(block AS BIGINT) AS block, count(*) AS length, max(flow_rate) AS flow_rate FROM bl GROUP BY segment_id, block HAVING count(*) >= 2""")
def stale_blocks(spark, folder):
    return rn.stale_blocks(*ship(spark, folder), "flow_rate")


@query("spike_flags", "W34", f"""
WITH {SHIPMENTS}, st AS (SELECT segment_id, avg(pressure) AS m, stddev_samp(pressure) AS sd FROM shipments GROUP BY segment_id)
SELECT segment_id, l_orderkey, l_linenumber, l_partkey, coalesce(abs(pressure - m) > 1.5 * sd, false) AS spike FROM shipments JOIN st USING (segment_id)""")
def spike_flags(spark, folder):
    s, series = ship(spark, folder)
    return rn.spikes_and_stale(s, series, "pressure", 1.5).select("segment_id", *views.SHIPMENT_ORDER, "spike")


_DRIFT = ["pressure_expanding_dev", "pressure_baseline_pct", "flow_cusum_neg30", "pressure_flow_divergence", "pressure_cusum_neg30"]
_DRIFT_TESTS = [("expanding", "pressure_expanding_dev", 0.001), ("baseline", "pressure_baseline_pct", 0.001), ("deficit", "flow_cusum_neg30", 0.01),
                ("divergence", "pressure_flow_divergence", 0.02), ("drop", "pressure_cusum_neg30", 0.01), ("ema", "pressure_ema_dev", 0.001)]


@query("drift_signals", "W35", f"""
WITH RECURSIVE {TELEMETRY}, {deltas()},
o AS (SELECT segment_id, seq, pressure, row_number() OVER ({SEQ}) AS rn FROM telemetry),
e AS (SELECT segment_id, seq, rn, pressure, pressure AS np, CAST(1.0 AS DOUBLE) AS w FROM o WHERE rn = 1
  UNION ALL SELECT o.segment_id, o.seq, o.rn, o.pressure, e.np * (19.0 / 21.0) + o.pressure, e.w * (19.0 / 21.0) + 1.0 FROM e JOIN o ON o.segment_id = e.segment_id AND o.rn = e.rn + 1),
f AS (SELECT segment_id, seq, {', '.join(f'{FEATURE_SQL[c]} AS {c}' for c in _DRIFT)} FROM d),
g AS (SELECT f.*, e.pressure - np / w AS pressure_ema_dev FROM f JOIN e USING (segment_id, seq)),
k AS (SELECT segment_id, seq, list_filter([{', '.join(f"CASE WHEN abs({c}) > {x} THEN ['{n}', '{c}'] END" for n, c, x in _DRIFT_TESTS)}], lambda x: x IS NOT NULL)[1:4] AS kinds,
  list_filter([{', '.join(f"CASE WHEN abs({c}) > {x} THEN {c} END" for n, c, x in _DRIFT_TESTS)}], lambda x: x IS NOT NULL)[1:4] AS amounts FROM g)
SELECT segment_id, seq, array_to_string(list_transform(kinds, lambda x: x[1]), ',') AS kinds, {r('coalesce(list_sum(amounts), 0)', 'total', 5)} FROM k""")
def drift_signals(spark, folder):
    t = views.telemetry(spark, folder)
    out = rn.drift_signals(ft.build_features(t, time_series(t, ["segment_id"]), [*_DRIFT, "pressure_ema_dev"]))
    total = F.aggregate("signals", F.lit(0.0), lambda acc, s: acc + s["value"])
    return out.select("segment_id", "seq", F.array_join(F.transform("signals", lambda s: s["detector"]), ",").alias("kinds"), r6(total, 5).alias("total"))


@query("numeric_profile", "A1", f"""
WITH {TELEMETRY}, u AS (SELECT 'pressure' AS "column", nullif(pressure, 100.0) AS v FROM telemetry UNION ALL SELECT 'flow_rate', flow_rate FROM telemetry UNION ALL SELECT 'temperature', temperature FROM telemetry)
SELECT "column", count(*) AS row_count, count(*) FILTER (WHERE v IS NULL) AS nulls, {r('avg(v)', 'mean', 4)}, {r('stddev_samp(v)', 'std', 4)}, {r('min(v)', 'min', 4)}, {r('max(v)', 'max', 4)} FROM u GROUP BY "column" """)
def numeric_profile(spark, folder):
    t = views.telemetry(spark, folder).withColumn("pressure", F.nullif("pressure", F.lit(100.0)))
    return pf.numeric_profile(t, ["pressure", "flow_rate", "temperature"])


@query("null_counts", "A1", f"""
WITH {WIDE} SELECT * FROM (SELECT 'P_mid' AS "column", count(*) FILTER (WHERE P_mid IS NULL) AS nulls FROM wide UNION ALL SELECT 'class', count(*) FILTER (WHERE class IS NULL) FROM wide) WHERE nulls > 0""")
def null_counts(spark, folder):
    return pf.null_counts(views.wide(spark, folder))


@query("time_profile", "A2", f"""
WITH {SHIPMENTS} SELECT count(DISTINCT timestamp) AS timestamp_unique, strftime(min(timestamp), '%Y-%m-%d') AS first, strftime(max(timestamp), '%Y-%m-%d') AS last, count(DISTINCT timestamp) > 1 AS timestamp_usable FROM shipments""")
def time_profile(spark, folder):
    p = pf.time_profile(views.shipments(spark, folder))
    return p.select("timestamp_unique", *[F.date_format(c, "yyyy-MM-dd").alias(c) for c in ("first", "last")], "timestamp_usable")


@query("label_profile", "A3", f"""
WITH {WIDE}, c AS (SELECT class, count(*) AS n FROM wide GROUP BY class)
SELECT CAST(sum(n) AS BIGINT) AS row_count, count(*) AS n_classes, {r('max(n) / sum(n)', 'majority_class_pct', 4)}, (count(*) >= 2 AND max(n) / sum(n) < 0.99) AS labels_usable,
       CASE WHEN sum(n) < 500 THEN 'too_small' WHEN NOT (count(*) >= 2 AND max(n) / sum(n) < 0.99) THEN 'no_usable_labels' WHEN sum(n) >= 10000 THEN 'usable_large' ELSE 'usable_small' END AS dataset_verdict FROM c""")
def label_profile(spark, folder):
    return pf.label_profile(views.wide(spark, folder), "class")


@query("label_distribution", "A3", f"WITH {WIDE} SELECT coalesce(CAST(class AS VARCHAR), 'missing') AS class, count(*) AS n FROM wide GROUP BY class")
def label_distribution(spark, folder):
    d = pf.distribution(views.wide(spark, folder), "class")
    return d.withColumn("class", F.coalesce(F.col("class").cast("string"), F.lit("missing")))


@query("group_labels", "A5", f"WITH {SCORES} SELECT run_id, max(target) AS label, count(*) AS rows FROM scores GROUP BY run_id")
def group_labels(spark, folder):
    from telemill.operators.sampling import group_table

    return group_table(views.scores(spark, folder), "run_id")


@query("history_summary", "A6", f"""
WITH {TELEMETRY}, h AS (SELECT segment_id, epoch(max(timestamp) - min(timestamp)) / 3600.0 AS hours FROM telemetry GROUP BY segment_id)
SELECT count(*) AS history_count, {r('max(hours)', 'max_history_hours')}, {r('median(hours)', 'median_history_hours')} FROM h""")
def history_summary(spark, folder):
    out = pf.history_summary(views.telemetry(spark, folder), "segment_id")
    return out.select("history_count", r6("max_history_hours").alias("max_history_hours"), r6("median_history_hours").alias("median_history_hours"))


_WIDE_COLUMNS = ["scenario_id", "timestamp", "l_orderkey", "l_linenumber", "l_partkey", *wd.SENSORS, "class"]


@query("missing_value_rate", "A7", f"WITH {WIDE} SELECT {r('(' + ' + '.join(f'avg(CASE WHEN {c} IS NULL THEN 1.0 ELSE 0.0 END)' for c in _WIDE_COLUMNS) + f') / {len(_WIDE_COLUMNS)}', 'missing_value_rate')} FROM wide")
def missing_value_rate(spark, folder):
    return pf.missing_rate(views.wide(spark, folder)).select(r6("missing_value_rate").alias("missing_value_rate"))


_DIST = "regexp_matches(scenario_context, '(?i)demand|pump_wear|valve|sensor|maintenance|startup|shutdown|disturb|drift')"


@query("row_rates", "A8", f"WITH {TELEMETRY}, {CONTEXT} SELECT {r(f'avg(CASE WHEN {_DIST} THEN 1.0 ELSE 0.0 END)', 'disturbance_row_rate')}, {r('avg(target)', 'leak_row_rate')} FROM ctx")
def row_rates(spark, folder):
    return pf.row_rates(with_context(views.telemetry(spark, folder))).select(
        r6("disturbance_row_rate").alias("disturbance_row_rate"), r6("leak_row_rate").alias("leak_row_rate"))


_BAND = f"""
{CONTEXT}, dl AS (SELECT *, abs(coalesce(pressure - lag(pressure) OVER ({SEQ}), 0)) AS v FROM ctx),
b AS (SELECT quantile_cont(v, 0.1) FILTER (WHERE target = 1) AS leak_lo, quantile_cont(v, 0.9) FILTER (WHERE target = 1) AS leak_hi,
             quantile_cont(v, 0.1) FILTER (WHERE target = 0 AND {_DIST}) AS dist_lo, quantile_cont(v, 0.9) FILTER (WHERE target = 0 AND {_DIST}) AS dist_hi FROM dl),
o AS (SELECT *, greatest(0, least(leak_hi, dist_hi) - greatest(leak_lo, dist_lo)) / (greatest(leak_hi, dist_hi) - least(leak_lo, dist_lo)) AS leak_disturbance_overlap FROM b)"""


def banded(spark, folder):
    t = with_context(views.telemetry(spark, folder))
    return pf.band_overlap(ft.build_features(t, time_series(t, ["segment_id"]), ["pressure_delta"]), "pressure_delta")


@query("band_overlap", "A9", f"WITH {TELEMETRY}, {_BAND} SELECT {', '.join(r(c, c) for c in ['leak_lo', 'leak_hi', 'dist_lo', 'dist_hi', 'leak_disturbance_overlap'])} FROM o")
def band_overlap(spark, folder):
    out = banded(spark, folder)
    return out.select(*[r6(c).alias(c) for c in out.columns])


_MEASURES = f"""
hh AS (SELECT median(hours) AS median_history_hours FROM (SELECT segment_id, epoch(max(timestamp) - min(timestamp)) / 3600.0 AS hours FROM telemetry GROUP BY segment_id)),
{_ISLANDS}, ev AS (SELECT segment_id, run, count(*) AS n, max(leak_severity) AS s FROM isl WHERE target = 1 GROUP BY ALL),
ec AS (SELECT count(*) FILTER (WHERE s < 0.18) AS borderline, count(*) FILTER (WHERE s >= 0.18 AND n >= 30 AND s < 0.45) AS slow FROM ev)"""


# measures per segment, from its own rows, spread so that each rule holds for some segments and not for others
_MEASURED = {
    "raw_sensor_auc": ("0.85 + avg(target) * 0.4", lambda: 0.85 + F.avg("target") * 0.4),
    "dynamics_auc": ("0.85 + avg(target) * 0.4 + avg(flow_rate) / 2500.0", lambda: 0.85 + F.avg("target") * 0.4 + F.avg("flow_rate") / 2500.0),
    "disturbance_false_positive_rate": ("avg(CASE WHEN pressure > 200 THEN 1.0 ELSE 0.0 END)", lambda: F.avg(F.when(F.col("pressure") > 200, 1.0).otherwise(0.0))),
    "missing_value_rate": ("avg(CASE WHEN pressure > 330 THEN 1.0 ELSE 0.0 END)", lambda: F.avg(F.when(F.col("pressure") > 330, 1.0).otherwise(0.0))),
    "stale_sensor_rate": ("avg(CASE WHEN flow_rate < 0.5 THEN 1.0 ELSE 0.0 END)", lambda: F.avg(F.when(F.col("flow_rate") < 0.5, 1.0).otherwise(0.0))),
    "median_history_hours": ("count(*) % 48", lambda: (F.count(F.lit(1)) % 48).cast("double")),
}
_RULES = {
    "short": "median_history_hours < 24", "easy": "raw_sensor_auc > 0.93", "flat": "dynamics_auc - raw_sensor_auc < 0.02",
    "tame": "disturbance_false_positive_rate < 0.02", "thin": "slow = 0 OR borderline = 0", "ideal": "missing_value_rate < 0.001 AND stale_sensor_rate < 0.005",
}


@query("validation_warnings", "A10", f"""
WITH {TELEMETRY}, {_ISLANDS}, ev AS (SELECT segment_id, run, count(*) AS n, max(leak_severity) AS s FROM isl WHERE target = 1 GROUP BY ALL),
ec AS (SELECT segment_id, count(*) FILTER (WHERE s < 0.18) AS borderline, count(*) FILTER (WHERE s >= 0.18 AND n >= 30 AND s < 0.45) AS slow FROM ev GROUP BY segment_id),
m AS (SELECT segment_id, {', '.join(f'{q} AS {c}' for c, (q, _) in _MEASURED.items())} FROM telemetry GROUP BY segment_id),
b AS (SELECT m.*, coalesce(borderline, 0) AS borderline, coalesce(slow, 0) AS slow FROM m LEFT JOIN ec USING (segment_id))
SELECT segment_id, array_to_string(list_filter([{', '.join(f"CASE WHEN {c} THEN '{k}' END" for k, c in _RULES.items())}], lambda x: x IS NOT NULL), ',') AS warnings,
       borderline AS borderline_leak_event_count, slow AS slow_leak_event_count FROM b""")
def validation_warnings(spark, folder):
    t = views.telemetry(spark, folder)
    events = rn.leak_events(t, time_series(t, ["segment_id"])).groupBy("segment_id").agg(
        *[F.count_if(F.col("kind") == k).alias(f"{k}_leak_event_count") for k in ("borderline", "slow")])
    rows = t.groupBy("segment_id").agg(*[make().alias(c) for c, (_, make) in _MEASURED.items()]).join(events, "segment_id", "left")
    rows = rows.fillna(0, ["borderline_leak_event_count", "slow_leak_event_count"])
    name = F.create_map(*[F.lit(x) for k, v in pf.WARNINGS.items() for x in (v, k)])
    out = pf.validation_warnings(rows)
    return out.select("segment_id", F.array_join(F.transform("warnings", lambda w: F.try_element_at(name, w)), ",").alias("warnings"),
                      "borderline_leak_event_count", "slow_leak_event_count")


@query("processing_summary", "A17", f"""
WITH {WIDE}, t AS (SELECT *, CASE WHEN coalesce(class, 0) <> 0 THEN 1 ELSE 0 END AS target, CASE WHEN class IS NULL THEN 0 WHEN class >= 100 THEN class % 100 ELSE class END AS k FROM wide),
e AS (SELECT string_agg(CAST(k AS VARCHAR) || ':' || CAST(n AS VARCHAR), ',' ORDER BY k) AS events FROM (SELECT k, count(*) AS n FROM t GROUP BY k))
SELECT count(*) AS n_rows, count(DISTINCT l_partkey % 50) AS n_wells, count(DISTINCT scenario_id) AS n_scenarios, count(*) FILTER (WHERE target = 0) AS label_0, count(*) FILTER (WHERE target = 1) AS label_1,
       (SELECT events FROM e) AS events FROM t""")
def processing_summary(spark, folder):
    w = label_events(views.wide(spark, folder)).withColumn("well_id", F.col("l_partkey") % 50)
    text = F.transform("events", lambda e: F.concat_ws(":", e["event_class"].cast("string"), e["rows"].cast("string")))
    return pf.processing_summary(w).withColumn("events", F.array_join(text, ","))


@query("operational_snapshot", "A19", f"""
WITH {SHIPMENTS}, l AS (SELECT * FROM shipments WHERE timestamp = (SELECT max(timestamp) FROM shipments))
SELECT CAST(sum(target) AS BIGINT) AS active_leaks, {r('max(pressure / 200.0)', 'max_severity')}, {r('min(flow_rate / 50.0)', 'min_efficiency')},
       (SELECT count(*) FROM shipments WHERE pressure >= 50 AND target = 0) AS false_detections FROM l""")
def operational_snapshot(spark, folder):
    s = views.shipments(spark, folder).withColumns({
        "leak_severity": F.col("pressure") / 200.0, "pump_efficiency": F.col("flow_rate") / 50.0, "model_alert": F.col("pressure") >= 50})
    out = pf.operational_snapshot(rn.latest_snapshot(s), s)
    return out.select("active_leaks", r6("max_severity").alias("max_severity"), r6("min_efficiency").alias("min_efficiency"), "false_detections")


@query("recent_series", "A20", f"""
WITH {TELEMETRY}, k AS (SELECT * FROM telemetry QUALIFY row_number() OVER (PARTITION BY segment_id ORDER BY timestamp DESC, seq DESC) <= 720)
SELECT segment_id, array_to_string(list(CAST(CAST(flow_rate AS INTEGER) AS VARCHAR) ORDER BY timestamp, seq), ',') AS flow_rate FROM k GROUP BY segment_id""")
def recent_series(spark, folder):
    out = pf.recent_series(views.telemetry(spark, folder), ["segment_id"], ["timestamp", "seq"], {"flow_rate": 3}, keep=720)
    return out.select("segment_id", F.array_join(F.transform("flow_rate", lambda v: v.cast("int").cast("string")), ",").alias("flow_rate"))


@query("recent_series_short", "A20", f"""
WITH {TELEMETRY}, k AS (SELECT * FROM telemetry QUALIFY row_number() OVER (PARTITION BY segment_id ORDER BY timestamp DESC, seq DESC) <= 12)
SELECT segment_id, count(*) AS kept, (SELECT max(n) > 12 FROM (SELECT count(*) AS n FROM telemetry GROUP BY segment_id)) AS exceeded,
  array_to_string(list(CAST(CAST(flow_rate AS INTEGER) AS VARCHAR) ORDER BY timestamp, seq), ',') AS flow_rate FROM k GROUP BY segment_id""")
def recent_series_short(spark, folder):
    """A retention that keys of the table exceed."""
    t = views.telemetry(spark, folder)
    out = pf.recent_series(t, ["segment_id"], ["timestamp", "seq"], {"flow_rate": 3}, keep=12)
    longest = t.groupBy("segment_id").count().agg(F.max("count") > 12).scalar()
    text = F.array_join(F.transform("flow_rate", lambda v: v.cast("int").cast("string")), ",")
    return out.select("segment_id", F.size("flow_rate").cast("long").alias("kept"), longest.alias("exceeded"), text.alias("flow_rate"))


@query("minute_means", "A21", f"""
WITH {TELEMETRY}, m AS (SELECT CAST(floor(epoch(timestamp - TIMESTAMP '2024-01-01') / 60) AS BIGINT) AS minute, avg(pressure) AS p, avg(flow_rate) AS f FROM telemetry GROUP BY 1)
SELECT minute, {r('p / (SELECT greatest(max(abs(p)), 1e-6) FROM m)', 'pressure')}, {r('f / (SELECT greatest(max(abs(f)), 1e-6) FROM m)', 'flow_rate')} FROM m""")
def minute_means(spark, folder):
    t = views.telemetry(spark, folder)
    base = F.lit("2024-01-01 00:00:00").cast("timestamp")
    t = t.withColumn("secs", (F.unix_micros("timestamp") - F.unix_micros(base)) / F.lit(1e6))
    return pf.minute_means(t, "secs", ["pressure", "flow_rate"]).select("minute", r6("pressure").alias("pressure"), r6("flow_rate").alias("flow_rate"))


_PRINT = ["CAST(o_orderkey AS VARCHAR)", "CAST(o_custkey AS VARCHAR)", "o_orderstatus", "CAST(CAST(round(o_totalprice * 100) AS BIGINT) AS VARCHAR)",
          "strftime(o_orderdate, '%Y-%m-%d')", "o_orderpriority"]


@query("table_fingerprint", "A22", f"""
WITH t AS (SELECT md5({' || '.join(f"coalesce(CAST(length({c}) AS VARCHAR) || ':' || {c}, '-')" for c in _PRINT)}) AS h FROM orders)
SELECT count(*) AS row_count, CAST(sum(CAST('0x' || substr(h, 1, 15) AS BIGINT)) % 2305843009213693951 AS BIGINT) AS fingerprint FROM t""")
def table_fingerprint(spark, folder):
    o = views.table(spark, folder, "orders")
    return pf.fingerprint(o.withColumns({"o_totalprice": F.round(F.col("o_totalprice") * 100).cast("long"), "o_orderdate": F.date_format("o_orderdate", "yyyy-MM-dd")}))


@query("class_weight", "A23", f"""
WITH {TELEMETRY} SELECT CAST(greatest(sum(target), 1) AS BIGINT) AS positives, CAST(greatest(count(*) - sum(target), 1) AS BIGINT) AS negatives,
       {r('greatest(count(*) - sum(target), 1) / greatest(sum(target), 1)', 'positive_weight')} FROM telemetry""")
def class_weight(spark, folder):
    out = pf.class_weight(views.telemetry(spark, folder))
    return out.select("positives", "negatives", r6("positive_weight").alias("positive_weight"))


@query("exact_quantiles", "V6 A9", f"""
WITH {SHIPMENTS} SELECT segment_id, {r('quantile_cont(pressure, 0.1)', 'p10')}, {r('quantile_cont(pressure, 0.5)', 'p50')}, {r('quantile_cont(pressure, 0.95)', 'p95')} FROM shipments GROUP BY segment_id""")
def exact_quantile_rows(spark, folder):
    out = exact_quantiles(views.shipments(spark, folder), ["segment_id"], "pressure", {"p10": 0.1, "p50": 0.5, "p95": 0.95})
    return out.select("segment_id", *[r6(c).alias(c) for c in ("p10", "p50", "p95")])


_SHORT = WIDE.replace("wide AS (", "raw_wide AS (", 1) + """,
wide AS (SELECT * REPLACE (scenario_id || '_' || CAST(l_orderkey % 20 AS VARCHAR) AS scenario_id,
  P_inlet / 4 AS P_inlet, P_mid / 4 AS P_mid, P_outlet / 4 AS P_outlet) FROM raw_wide)"""
_ONSETS = "onsets AS (SELECT scenario_id, min(timestamp) AS onset, 3600.0 AS ramp FROM wide WHERE class > 0 GROUP BY scenario_id)"
_Q = [f"({c} IS NULL OR isnan({c}) OR isinf({c}))" for c in ("P_inlet", "P_mid", "P_outlet", "Q_inlet", "Q_outlet")]
_QUALITY = f"""
{_ONSETS},
n AS (SELECT *, row_number() OVER ({WELL}) AS k, row_number() OVER (PARTITION BY scenario_id ORDER BY timestamp DESC, l_orderkey DESC, l_linenumber DESC, l_partkey DESC) AS back FROM wide),
one AS (SELECT scenario_id, P_inlet >= P_mid AND P_mid >= P_outlet AS dec, P_inlet - P_outlet AS fall, abs(Q_inlet - Q_outlet) / greatest(abs(Q_inlet), 1e-10) AS rel FROM n WHERE k = 1),
agg AS (SELECT scenario_id, count(*) AS size, count(*) FILTER ({' OR '.join(_Q)}) AS bad, least(min(P_inlet), min(P_mid), min(P_outlet)) AS low, greatest(max(P_inlet), max(P_mid), max(P_outlet)) AS high,
        least(min(Q_inlet), min(Q_outlet)) AS flow FROM wide GROUP BY scenario_id),
late AS (SELECT n.scenario_id, Q_inlet > Q_outlet * 1.001 AS leak, Q_inlet - Q_outlet AS lost FROM n JOIN onsets o USING (scenario_id) WHERE epoch(timestamp) >= epoch(onset) + 3600.0 + 60.0
         QUALIFY row_number() OVER (PARTITION BY n.scenario_id ORDER BY timestamp, l_orderkey, l_linenumber, l_partkey) = 1),
tail AS (SELECT scenario_id, P_outlet AS p, P_outlet - 2 * lag(P_outlet) OVER w + lag(P_outlet, 2) OVER w AS d2 FROM n WHERE back <= 20 WINDOW w AS (PARTITION BY scenario_id ORDER BY k)),
osc AS (SELECT scenario_id, stddev_pop(d2) / greatest(stddev_pop(p), 1.0) AS wobble FROM tail GROUP BY scenario_id),
checks AS (
  SELECT scenario_id, 'pressure_decreasing_initial' AS name, coalesce(dec, false) AS passed, fall AS detail FROM one
  UNION ALL SELECT scenario_id, 'no_nan_inf', bad = 0, bad FROM agg UNION ALL SELECT scenario_id, 'mass_balance_initial', coalesce(rel < 0.02, false), rel FROM one
  UNION ALL SELECT scenario_id, 'leak_flow_imbalance', leak, lost FROM late WHERE leak IS NOT NULL UNION ALL SELECT scenario_id, 'pressure_range', coalesce(low > 0 AND high < 50e6, false), high FROM agg
  UNION ALL SELECT scenario_id, 'flow_non_negative', coalesce(flow >= -1e-4, false), flow FROM agg
  UNION ALL SELECT scenario_id, 'no_numerical_oscillation', coalesce(wobble < 0.5, false), wobble FROM osc JOIN agg USING (scenario_id) WHERE size > 20)"""


def checked(spark, folder):
    w = views.wide(spark, folder)
    w = w.withColumn("scenario_id", F.concat("scenario_id", F.lit("_"), (F.col("l_orderkey") % 20).cast("string")))
    w = w.withColumns({c: F.col(c) / 4 for c in qa.PRESSURES})
    onsets = w.where(F.col("class") > 0).groupBy("scenario_id").agg(F.min("timestamp").alias("onset"), F.lit(3600.0).alias("ramp_seconds"))
    return w, qa.scenario_checks(w, onsets, "scenario_id", "timestamp", views.SHIPMENT_ORDER)


@query("quality_checks", "Q-a Q-b Q-c Q-d Q-e Q-f Q-g", f"WITH {_SHORT}, {_QUALITY} SELECT scenario_id, name, passed, {r('detail', 'detail', 4)} FROM checks")
def quality_checks(spark, folder):
    return checked(spark, folder)[1].withColumn("detail", r6("detail", 4))


@query("quality_gate", "Q-h", f"""
WITH {_SHORT}, {_QUALITY} SELECT scenario_id, CASE WHEN bool_or(NOT passed AND name IN ('no_nan_inf', 'pressure_range', 'flow_non_negative')) THEN 'fail' WHEN bool_or(NOT passed) THEN 'warn' ELSE 'pass' END AS verdict FROM checks GROUP BY scenario_id""")
def quality_gate(spark, folder):
    return qa.gate(checked(spark, folder)[1], "scenario_id")


@query("quality_exclusion", "Q-h", f"""
WITH {_SHORT}, {_QUALITY} SELECT {ROW_SQL} FROM wide WHERE scenario_id NOT IN (SELECT scenario_id FROM checks WHERE NOT passed AND name IN ('no_nan_inf', 'pressure_range', 'flow_non_negative'))""")
def quality_exclusion(spark, folder):
    w, checks = checked(spark, folder)
    return qa.exclude_failed(w, checks, "scenario_id").select(*ROW)


@query("wide_to_long", "R1", f"""
WITH {WIDE}, u AS ({' UNION ALL '.join(f"SELECT scenario_id, l_orderkey, l_linenumber, l_partkey, '{c}' AS raw, {c} AS value FROM wide" for c in wd.SENSORS)})
SELECT scenario_id, l_orderkey, l_linenumber, l_partkey, substr(raw, 3) AS sensor_id, CASE substr(raw, 1, 1) WHEN 'P' THEN 'pressure' WHEN 'Q' THEN 'flow' ELSE 'temperature' END AS variable,
       {r('CASE WHEN abs(value) < 1e12 THEN value END', 'value', 3)} FROM u""")
def wide_to_long(spark, folder):
    out = wd.to_long(views.wide(spark, folder), ["scenario_id", *views.SHIPMENT_ORDER])
    return out.withColumn("value", r6(F.when(F.abs("value") < 1e12, F.col("value")), 3))


_DAY = "(hour(timestamp) * 60 + minute(timestamp)) / 1440.0"


@query("calendar_phases", "R3", f"""
WITH {TELEMETRY} SELECT seq, {r(f'sin(2 * pi() * ({_DAY} - 0.18))', 'daily')}, {r(f'sin(4 * pi() * ({_DAY} + segment_id * 0.03))', 'shoulder')},
       {r("sin(2 * pi() * ((isodow(timestamp) - 1) / 7.0 + segment_id * 0.09))", 'weekly')}, {r(f'sin(2 * pi() * ({_DAY} - 0.05))', 'ambient')} FROM telemetry""")
def calendar_phase_rows(spark, folder):
    t = views.telemetry(spark, folder)
    return t.select("seq", *[r6(c).alias(k) for k, c in calendar_phases(F.col("timestamp"), F.col("segment_id")).items()])


@query("tumbling_windows", "P11", """
SELECT user_id AS segment_id, strftime(time_bucket(INTERVAL 6 HOUR, ts), '%Y-%m-%d %H') AS start, count(*) AS n, round(avg(value) + 1e-9, 6) + 0.0 AS mean_pressure FROM events GROUP BY ALL""")
def tumbling_windows(spark, folder):
    t = views.telemetry(spark, folder)
    out = t.groupBy("segment_id", F.window("timestamp", "6 hours")).agg(F.count(F.lit(1)).alias("n"), r6(F.avg("pressure")).alias("mean_pressure"))
    return out.select("segment_id", F.date_format("window.start", "yyyy-MM-dd HH").alias("start"), "n", "mean_pressure")


@query("session_windows", "P11", """
WITH g AS (SELECT user_id AS segment_id, ts, value, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 12 HOUR THEN 0 ELSE 1 END AS fresh, event_id FROM events),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY segment_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS k FROM g)
SELECT segment_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n, round(max(value) + 1e-9, 6) + 0.0 AS max_pressure FROM s GROUP BY segment_id, k""")
def session_windows(spark, folder):
    t = views.telemetry(spark, folder)
    out = t.groupBy("segment_id", F.session_window("timestamp", "12 hours")).agg(F.count(F.lit(1)).alias("n"), r6(F.max("pressure")).alias("max_pressure"))
    return out.select("segment_id", F.date_format("session_window.start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n", "max_pressure")
