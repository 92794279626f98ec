"""Cleaning, labels, sensor repair."""

from __future__ import annotations

from pyspark.sql import functions as F

from telemill import functions as fn
from telemill.functions import r6
from telemill.operators import cleaning as cl
from telemill.operators.labels import benchmark_label, segment_codes
from telemill.operators.series import time_series
from telemill.schema import numeric_columns
from telemill.sources import views

from telemill.operators.wide import SENSORS

from .registry import SHIPMENTS, TELEMETRY, WIDE, query, r

WELL = "PARTITION BY scenario_id ORDER BY timestamp, l_orderkey, l_linenumber, l_partkey"
ROW = ["l_orderkey", "l_linenumber", "l_partkey", "scenario_id"]
ROW_SQL = ", ".join(ROW)


def well_series(df):
    return time_series(df, ["scenario_id"], tiebreak=views.SHIPMENT_ORDER)


# every event twice, with timestamps as text and every 10th one broken
_MESSY = f"""
messy AS (
  SELECT CASE WHEN seq % 10 = 0 THEN 'not a time' ELSE strftime(timestamp, '%Y-%m-%d %H:%M:%S') END AS timestamp,
         segment_id, CASE WHEN seq % 7 = 0 THEN NULL ELSE pressure END AS pressure, flow_rate, temperature, target, seq
  FROM telemetry, (SELECT 1 UNION ALL SELECT 2))"""


def messy(spark, folder):
    t = views.telemetry(spark, folder)
    once = t.select(
        F.when(F.col("seq") % 10 == 0, "not a time")
        .otherwise(F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss")).alias("timestamp"),
        "segment_id", F.when(F.col("seq") % 7 != 0, F.col("pressure")).alias("pressure"),
        "flow_rate", "temperature", "target", "seq",
    )
    return once.union(once)


@query("clean_basic", "D2 U2", f"""
WITH {TELEMETRY}, {_MESSY}
SELECT seq, segment_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts_text, pressure, flow_rate, target
FROM (SELECT DISTINCT *, TRY_CAST(timestamp AS TIMESTAMP) AS ts FROM messy)
WHERE ts IS NOT NULL AND pressure IS NOT NULL AND flow_rate IS NOT NULL""")
def clean_basic(spark, folder):
    out = cl.clean(messy(spark, folder))
    return out.select("seq", "segment_id", F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss").alias("ts_text"),
                      "pressure", "flow_rate", "target")


@query("distinct_rows", "U2", "SELECT DISTINCT l_suppkey, l_shipdate::DATE::VARCHAR AS day, l_returnflag FROM lineitem")
def distinct_rows(spark, folder):
    li = views.table(spark, folder, "lineitem")
    return li.select("l_suppkey", F.date_format("l_shipdate", "yyyy-MM-dd").alias("day"), "l_returnflag").dropDuplicates()


ALIASES = {"segment_id": ["device", "l_suppkey"], "pressure": "l_extendedprice", "flow_rate": ["l_quantity", "l_tax"],
           "l_discount": "l_tax", "vibration": "shake"}


@query("map_columns", "D3", """
SELECT l_orderkey, l_suppkey, l_suppkey AS segment_id, l_extendedprice AS pressure, l_quantity AS flow_rate, l_discount
FROM lineitem""")
def map_columns(spark, folder):
    out = cl.map_columns(views.table(spark, folder, "lineitem"), ALIASES)
    return out.select("l_orderkey", "l_suppkey", "segment_id", "pressure", "flow_rate", "l_discount")


@query("backfill_columns", "D4 D6", f"""
WITH {WIDE}, codes AS (SELECT scenario_id, row_number() OVER (ORDER BY scenario_id) AS code
                       FROM (SELECT DISTINCT scenario_id FROM wide))
SELECT {ROW_SQL}, CAST(code AS INTEGER) AS segment_id, 1 AS valve_status, 1 AS pump_state,
       CAST(0.0 AS DOUBLE) AS pump_speed, 0 AS alarm_triggered,
       CASE WHEN class > 0 THEN 1 ELSE 0 END AS target,
       CASE WHEN class > 0 THEN 'leak' ELSE 'normal' END AS event_type
FROM wide JOIN codes USING (scenario_id)""")
def backfill_columns(spark, folder):
    w = views.wide(spark, folder).withColumn("target", F.when(F.col("class") > 0, 1).otherwise(0))
    out = cl.backfill(w)
    return out.select(*ROW, "segment_id", "valve_status", "pump_state", "pump_speed", "alarm_triggered", "target", "event_type")


@query("segment_codes", "D6", """
WITH named AS (SELECT c_custkey, coalesce(CASE WHEN c_custkey % 9 = 0 THEN NULL ELSE c_mktsegment END, 'segment-1') AS s FROM customer),
codes AS (SELECT s, row_number() OVER (ORDER BY s) AS code FROM (SELECT DISTINCT s FROM named))
SELECT c_custkey, CAST(code AS INTEGER) AS segment_id FROM named JOIN codes USING (s)""")
def segment_codes_query(spark, folder):
    c = views.table(spark, folder, "customer")
    c = c.withColumn("unit", F.when(F.col("c_custkey") % 9 != 0, F.col("c_mktsegment")))
    return segment_codes(c, "unit").select("c_custkey", "segment_id")


_WORDS = ", ".join(f"'{w}'" for w in fn.POSITIVE_TEXTS)


@query("binary_labels", "D5", f"""
WITH {TELEMETRY}, t AS (
  SELECT seq, CASE seq % 5 WHEN 0 THEN ' Leak ' WHEN 1 THEN 'normal' WHEN 2 THEN 'TRUE' WHEN 3 THEN event_type END AS word,
         CASE WHEN seq % 11 = 0 THEN NULL ELSE pressure / 50.0 - 1.0 END AS num, target = 1 AS flag
  FROM telemetry)
SELECT seq, CASE WHEN lower(trim(word)) IN ({_WORDS}) THEN 1 ELSE 0 END AS from_text,
       CAST(trunc(greatest(coalesce(num, 0), 0)) AS INTEGER) AS from_number, CAST(flag AS INTEGER) AS from_flag
FROM t""")
def binary_labels(spark, folder):
    k = F.col("seq") % 5
    t = views.telemetry(spark, folder).select(
        "seq",
        F.when(k == 0, " Leak ").when(k == 1, "normal").when(k == 2, "TRUE").when(k == 3, F.col("event_type")).alias("word"),
        F.when(F.col("seq") % 11 != 0, F.col("pressure") / 50.0 - 1.0).alias("num"),
        (F.col("target") == 1).alias("flag"),
    )
    return t.select("seq", fn.binary_label("word", "string").alias("from_text"),
                    fn.binary_label("num", "double").alias("from_number"),
                    fn.binary_label("flag", "boolean").alias("from_flag"))


_POS = ", ".join(f"'{w}'" for w in fn.BENCHMARK_POSITIVE_TEXTS)


@query("benchmark_labels", "D5b", f"""
SELECT event_id, CASE WHEN lower(word) IN ({_POS}) THEN 1 ELSE 0 END AS y_words,
       CASE WHEN num <> 0 THEN 1 ELSE 0 END AS y_number, bin AS y_binary
FROM (SELECT event_id, CASE WHEN event_type = 'error' THEN 'Fault' ELSE event_type END AS word,
             CAST((event_id % 3) * 2 AS INTEGER) AS num, CAST(event_id % 2 AS INTEGER) AS bin FROM events)""")
def benchmark_labels(spark, folder):
    e = views.table(spark, folder, "events").select(
        "event_id", F.when(F.col("event_type") == "error", "Fault").otherwise(F.col("event_type")).alias("word"),
        ((F.col("event_id") % 3) * 2).cast("int").alias("num"), (F.col("event_id") % 2).cast("int").alias("bin"))
    for source, out in (("word", "y_words"), ("num", "y_number"), ("bin", "y_binary")):
        e = benchmark_label(e, source, out, fn.BENCHMARK_POSITIVE_TEXTS)
    return e.select("event_id", "y_words", "y_number", "y_binary")


@query("median_fill", "D8 J11", f"""
WITH {TELEMETRY}, t AS (SELECT seq, CASE WHEN seq % 6 = 0 THEN NULL ELSE temperature END AS temperature FROM telemetry)
SELECT seq, {r('coalesce(temperature, (SELECT median(temperature) FROM t))', 'temperature')}, CAST(20.0 AS DOUBLE) AS vibration
FROM t""")
def median_fill(spark, folder):
    t = views.telemetry(spark, folder)
    t = t.select("seq", F.when(F.col("seq") % 6 == 0, "n/a").otherwise(F.col("temperature").cast("string")).alias("temperature"))
    out = cl.fill_with_median(cl.fill_with_median(t, "temperature", 20.0), "vibration", 20.0)
    return out.select("seq", r6("temperature").alias("temperature"), "vibration")


@query("training_frame", "D9 D10", f"""
WITH {TELEMETRY}, s AS (SELECT *, 'unit-' || CAST(segment_id AS VARCHAR) AS unit FROM telemetry),
codes AS (SELECT unit, row_number() OVER (ORDER BY unit) AS code FROM (SELECT DISTINCT unit FROM s))
SELECT strftime(TIMESTAMP '2026-01-01 00:00:00' + INTERVAL 1 MINUTE * (row_number() OVER (ORDER BY timestamp, seq) - 1), '%Y-%m-%d %H:%M') AS minute,
       CAST(code AS INTEGER) AS segment_id, pressure, flow_rate, {r('temperature', 'temperature')}, target,
       CASE WHEN target = 1 THEN 'leak' ELSE 'normal' END AS event_type, 'feed' AS source_dataset
FROM s JOIN codes USING (unit)""")
def training_frame(spark, folder):
    t = views.telemetry(spark, folder).withColumnsRenamed({"timestamp": "at", "target": "leak_label"})
    t = t.withColumn("sensor_id", F.concat(F.lit("unit-"), F.col("segment_id").cast("string"))).drop("segment_id", "event_type")
    out = cl.training_frame(t, "feed", order=["at", "seq"])
    return out.select(F.date_format("timestamp", "yyyy-MM-dd HH:mm").alias("minute"), "segment_id", "pressure",
                      "flow_rate", r6("temperature").alias("temperature"), "target", "event_type", "source_dataset")


@query("event_classes", "D11", f"""
WITH {WIDE}, c AS (
  SELECT {ROW_SQL}, CASE WHEN class IS NULL THEN 0 WHEN class BETWEEN 0 AND 9 THEN class
         WHEN class >= 100 AND class % 100 <= 9 THEN class % 100 ELSE class END AS event_class FROM wide)
SELECT {ROW_SQL}, CAST(event_class AS INTEGER) AS event_class, CASE WHEN event_class <> 0 THEN 1 ELSE 0 END AS target,
       CASE event_class {' '.join(f"WHEN {k} THEN '{v}'" for k, v in fn.EVENT_CLASS_NAMES.items())} ELSE 'UNKNOWN' END AS event_type
FROM c""")
def event_classes(spark, folder):
    return cl.label_events(views.wide(spark, folder)).select(*ROW, "event_class", "target", "event_type")


def bound_sql(c: str) -> str:
    low, high = fn.SENSOR_BOUNDS[c[:2]]
    return f"CASE WHEN {c} BETWEEN {low!r} AND {high!r} THEN {c} END"


SENSORS = ["P_inlet", "P_mid", "P_outlet", "Q_inlet", "Q_outlet", "T_inlet", "T_mid", "T_outlet"]
BOUNDED = f"bounded AS (SELECT scenario_id, timestamp, l_orderkey, l_linenumber, l_partkey, class, {', '.join(f'{bound_sql(c)} AS {c}' for c in SENSORS)} FROM wide)"


@query("bound_sensors", "D12", f"WITH {WIDE}, {BOUNDED} SELECT {ROW_SQL}, {', '.join(r(c, c, 3) for c in SENSORS)} FROM bounded")
def bound_sensors(spark, folder):
    return cl.bound_sensors(views.wide(spark, folder)).select(*ROW, *[r6(c, 3).alias(c) for c in SENSORS])


@query("rename_and_drop_silent", "D13 D14", f"""
WITH {WIDE}, {BOUNDED} SELECT {ROW_SQL}, {r('P_inlet', 'P_inlet', 3)}, {r('P_mid', 'P_mid', 3)}
FROM bounded WHERE P_inlet IS NOT NULL OR P_mid IS NOT NULL""")
def rename_and_drop_silent(spark, folder):
    w = views.wide(spark, folder)
    raw = w.select(*ROW, F.col("P_inlet").alias("P-PDG"), F.col("P_mid").alias("P-TPT"))
    out = cl.drop_silent_rows(cl.bound_sensors(cl.rename_well_sensors(raw)))
    return out.select(*ROW, r6("P_inlet", 3).alias("P_inlet"), r6("P_mid", 3).alias("P_mid"))


@query("downsample", "D15", f"""
WITH {WIDE}, n AS (SELECT *, row_number() OVER ({WELL}) AS rn FROM wide)
SELECT {ROW_SQL}, {r('Q_inlet', 'Q_inlet')} FROM n WHERE (rn - 1) % 10 = 0""")
def downsample(spark, folder):
    w = views.wide(spark, folder)
    return cl.every_nth(w, well_series(w), 10).select(*ROW, r6("Q_inlet").alias("Q_inlet"))


@query("derive_sensors", "D16", f"""
WITH {WIDE}, {BOUNDED}, t AS (SELECT *, CASE WHEN coalesce(class, 0) <> 0 THEN 1 ELSE 0 END AS target FROM bounded)
SELECT {ROW_SQL}, {r('P_mid * 0.85', 'P_outlet', 3)}, {r('Q_inlet * CASE WHEN target = 1 THEN 0.85 ELSE 0.98 END', 'Q_outlet')},
       {r('T_mid - 2.0', 'T_outlet')}, {r('P_inlet', 'pressure', 3)}, {r('Q_inlet', 'flow_rate')}, {r('T_inlet', 'temperature')}
FROM t""")
def derive_sensors(spark, folder):
    w = cl.bound_sensors(cl.label_events(views.wide(spark, folder))).drop("P_outlet", "Q_outlet", "T_outlet")
    out = cl.derive_sensors(w)
    return out.select(*ROW, r6("P_outlet", 3).alias("P_outlet"), r6("Q_outlet").alias("Q_outlet"),
                      r6("T_outlet").alias("T_outlet"), r6("pressure", 3).alias("pressure"),
                      r6("flow_rate").alias("flow_rate"), r6("temperature").alias("temperature"))


def fill_sql(c: str, backward: bool = False) -> str:
    b = f"last_value({c} IGNORE NULLS) OVER ({WELL} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    a = f"first_value({c} IGNORE NULLS) OVER ({WELL} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"
    return f"coalesce({c}, {a}, {b})" if backward else f"coalesce({c}, {b}, {a})"


@query("fill_along_well", "D17", f"""
WITH {WIDE}, {BOUNDED}
SELECT {ROW_SQL}, {', '.join(r(fill_sql(c), c, 3) for c in SENSORS)} FROM bounded""")
def fill_along_well(spark, folder):
    w = cl.bound_sensors(views.wide(spark, folder))
    out = cl.fill_along(w, well_series(w), SENSORS)
    return out.select(*ROW, *[r6(c, 3).alias(c) for c in SENSORS])


@query("filter_view", "D18", f"""
WITH {SHIPMENTS} SELECT segment_id, l_orderkey, l_linenumber, l_partkey, pressure FROM shipments
WHERE segment_id IN (1, 2, 3, 5, 8) AND timestamp::DATE BETWEEN DATE '1994-01-01' AND DATE '1997-12-31'""")
def filter_view(spark, folder):
    out = cl.filter_view(views.shipments(spark, folder), [1, 2, 3, 5, 8], "1994-01-01", "1997-12-31")
    return out.select("segment_id", *views.SHIPMENT_ORDER, "pressure")


@query("filter_targets", "D19", f"WITH {TELEMETRY} SELECT seq, segment_id, pressure FROM telemetry WHERE target = 1")
def filter_targets(spark, folder):
    return views.telemetry(spark, folder).where(F.col("target") == 1).select("seq", "segment_id", "pressure")


_TAGS = """CASE event_id % 6 WHEN 0 THEN 'Demand_spike' WHEN 1 THEN 'nominal' WHEN 2 THEN '' WHEN 3 THEN 'leak_progression|pump_wear'
           WHEN 4 THEN NULL ELSE event_type END"""


def tag_column():
    k = F.col("event_id") % 6
    return (F.when(k == 0, "Demand_spike").when(k == 1, "nominal").when(k == 2, "").when(k == 3, "leak_progression|pump_wear")
            .when(k == 4, F.lit(None).cast("string")).otherwise(F.col("event_type")))


@query("disturbances_and_tags", "D20 D21", f"""
WITH t AS (SELECT event_id, event_type, {_TAGS} AS ctx FROM events)
SELECT event_id, coalesce(regexp_matches(ctx, '(?i){'|'.join(fn.DISTURBANCE_WORDS)}'), false) AS disturbed,
       CASE WHEN ctx IS NULL OR ctx IN ('', 'nominal') THEN event_type
            WHEN list_contains(string_split(ctx, '|'), event_type) THEN ctx ELSE ctx || '|' || event_type END AS tags
FROM t""")
def disturbances_and_tags(spark, folder):
    e = views.table(spark, folder, "events").withColumn("ctx", tag_column())
    return e.select("event_id", fn.is_disturbance("ctx").alias("disturbed"),
                    fn.add_tag(F.col("ctx"), F.col("event_type")).alias("tags"))


@query("state_events", "D22", f"""
WITH {WIDE}, s AS (SELECT *, CASE l_linenumber % 4 WHEN 0 THEN 'startup' WHEN 1 THEN 'high_demand' WHEN 2 THEN 'odd' ELSE 'normal' END AS state,
                   (Q_inlet - Q_outlet) / 50.0 AS leak_rate FROM wide)
SELECT {ROW_SQL}, CASE WHEN state = 'high_demand' THEN 'warning' ELSE 'normal' END AS event_type,
       CASE WHEN leak_rate > 0.001 THEN 1 ELSE 0 END AS alarm_triggered,
       {r('greatest(least(leak_rate / 0.05, 1.0), 0.0)', 'leak_severity')} FROM s""")
def state_events(spark, folder):
    k = F.col("l_linenumber") % 4
    w = views.wide(spark, folder).withColumns({
        "state": F.when(k == 0, "startup").when(k == 1, "high_demand").when(k == 2, "odd").otherwise("normal"),
        "leak_rate": (F.col("Q_inlet") - F.col("Q_outlet")) / 50.0})
    return w.select(*ROW, fn.state_event(F.col("state")).alias("event_type"),
                    (F.col("leak_rate") > 0.001).cast("int").alias("alarm_triggered"),
                    r6(fn.leak_severity(F.col("leak_rate"))).alias("leak_severity"))


@query("round_half_even", "D23", """
WITH y AS (SELECT event_id, value / 8.0 * 1000.0 AS y FROM events)
SELECT event_id, CASE WHEN y - floor(y) = 0.5 THEN floor(y) + floor(y) % 2 ELSE round(y) END / 1000.0 AS rounded FROM y""")
def round_half_even(spark, folder):
    return views.table(spark, folder, "events").select("event_id", fn.round_even(F.col("value") / 8.0, 3).alias("rounded"))


@query("model_inputs", "D24 D25", f"""
WITH {TELEMETRY} SELECT seq, segment_id, pressure, flow_rate, temperature, leak_severity, CAST(0.0 AS DOUBLE) AS vibration FROM telemetry""")
def model_inputs(spark, folder):
    t = views.telemetry(spark, folder)
    return cl.reindex(t, [*numeric_columns(t), "vibration"])


def stable_sql(n: str, d: str, limit: float) -> str:
    den = f"CASE WHEN abs(coalesce({d}, 0)) >= 1e-3 THEN {d} WHEN {d} < 0 THEN -1e-3 ELSE 1e-3 END"
    return f"greatest(least(coalesce({n}, 0) / ({den}), {limit}), -{limit})"


@query("stable_division", "D26", f"""
WITH {WIDE}, {BOUNDED} SELECT {ROW_SQL}, {r(stable_sql('P_inlet', 'P_outlet', 1000.0), 'p_ratio')},
       {r(stable_sql('Q_inlet', 'Q_outlet - Q_inlet', 1000.0), 'q_ratio')} FROM bounded""")
def stable_division(spark, folder):
    w = cl.bound_sensors(views.wide(spark, folder))
    return w.select(*ROW, r6(fn.stable_ratio(F.col("P_inlet"), F.col("P_outlet"), limit=1000.0)).alias("p_ratio"),
                    r6(fn.stable_ratio(F.col("Q_inlet"), F.col("Q_outlet") - F.col("Q_inlet"), limit=1000.0)).alias("q_ratio"))


@query("model_matrix", "D27", f"""
WITH {WIDE}, {BOUNDED}
SELECT {ROW_SQL}, {', '.join(f"round(CAST(CAST(greatest(least(coalesce({fill_sql(c, True)}, 0), 1e9), -1e9) AS FLOAT) AS DOUBLE), 1) AS {c}" for c in SENSORS)}
FROM bounded""")
def model_matrix(spark, folder):
    w = cl.bound_sensors(views.wide(spark, folder))
    out = cl.model_matrix(w, well_series(w), SENSORS)
    return out.select(*ROW, *[F.round(F.col(c).cast("double"), 1).alias(c) for c in SENSORS])


@query("leak_type_rules", "D28 D31", f"""
WITH {TELEMETRY}, x AS (SELECT seq, event_type, least(pressure / 100.0, 1.0) AS score, flow_rate / 1000.0 AS dev,
                        -pressure / 300.0 AS cusum, seq % 9 AS steps, leak_severity >= 0.5 AS forced FROM telemetry),
o AS (SELECT *, CASE WHEN event_type = 'error' THEN 'warning' ELSE 'normal' END AS ev FROM x)
SELECT seq, CASE WHEN forced THEN 'Fast Rupture' WHEN score >= 0.85 AND dev >= 0.05 THEN 'Fast Rupture' WHEN dev >= 0.04 OR abs(cusum) >= 0.6 THEN 'Slow Seep'
       WHEN ev = 'warning' AND dev >= 0.015 THEN 'Pump-Assisted Leak' WHEN dev < 0.025 AND steps >= 4 THEN 'Micro Leak' ELSE 'Slow Seep' END AS leak_type,
       CASE WHEN forced THEN 'Confirmed' WHEN (score >= 0.85 AND dev >= 0.05) OR dev >= 0.04 OR abs(cusum) >= 0.6 THEN 'High' ELSE 'Medium' END AS confidence,
       CASE WHEN score >= 0.8 THEN 'High' WHEN score >= 0.4 THEN 'Medium' ELSE 'Low' END AS band
FROM o""")
def leak_type_rules(spark, folder):
    t = views.telemetry(spark, folder)
    score = F.least(F.col("pressure") / 100.0, F.lit(1.0))
    known = t.where(F.col("leak_severity") >= 0.5).select("seq", F.lit("Fast Rupture").alias("known"))
    kind = fn.leak_type(score, F.col("flow_rate") / 1000.0, -F.col("pressure") / 300.0,
                        F.when(F.col("event_type") == "error", "warning").otherwise("normal"), F.col("seq") % 9)
    out = t.withColumn("kind", kind).join(known, "seq", "left")
    return out.select("seq", F.coalesce("known", "kind.label").alias("leak_type"),
                      F.when(F.col("known").isNotNull(), "Confirmed").otherwise(F.col("kind.confidence")).alias("confidence"),
                      fn.confidence_band(score).alias("band"))


@query("segment_health", "D29", f"""
WITH {TELEMETRY}, x AS (SELECT seq, leak_severity AS s, 1.0 - flow_rate / 300.0 AS e FROM telemetry)
SELECT seq, CASE WHEN s >= 0.55 OR e < 0.75 THEN 'red' WHEN s >= 0.18 OR e < 0.88 THEN 'orange' ELSE 'green' END AS colour,
       CASE WHEN s >= 0.55 THEN 'LEAK ALARM' WHEN s >= 0.18 THEN 'LEAK WARNING' WHEN e < 0.75 THEN 'PUMP FAULT'
            WHEN e < 0.88 THEN 'PUMP DEGRADED' ELSE 'NORMAL' END AS label FROM x""")
def segment_health(spark, folder):
    t = views.telemetry(spark, folder)
    s, e = F.col("leak_severity"), 1.0 - F.col("flow_rate") / 300.0
    return t.select("seq", fn.health_colour(s, e).alias("colour"), fn.health_label(s, e).alias("label"))


_REGIME = "CASE l_returnflag WHEN 'R' THEN 'high_demand' WHEN 'A' THEN 'shutdown' ELSE 'unknown' END"


@query("normalise_regime", "D32 J5", f"""
SELECT l_orderkey, l_linenumber, l_partkey, {r("l_quantity / CASE l_returnflag WHEN 'R' THEN 1.18 WHEN 'A' THEN 0.08 ELSE 1.0 END", 'flow_rate')},
       {r("l_extendedprice / 1000.0 / CASE l_returnflag WHEN 'R' THEN 0.94 WHEN 'A' THEN 0.72 ELSE 1.0 END", 'pressure')} FROM lineitem""")
def normalise_regime(spark, folder):
    s = views.shipments(spark, folder).withColumn(
        "operating_regime", F.when(F.col("regime") == "R", "high_demand").when(F.col("regime") == "A", "shutdown").otherwise("unknown"))
    out = cl.normalise_regime(s)
    return out.select(*views.SHIPMENT_ORDER, r6("flow_rate").alias("flow_rate"), r6("pressure").alias("pressure"))


@query("text_functions", "D20 D23", """
SELECT event_id, trim(lower('  ' || upper(event_type) || ' ')) AS cleaned, event_type LIKE '%rr%' AS has_rr,
       replace(event_type || '_model', '_', ' ') AS spaced, strftime(ts, '%H:%M:%S') AS clock,
       CAST(floor(epoch(ts) - epoch(TIMESTAMP '2024-01-01')) AS BIGINT) AS secs, regexp_replace(event_type, '^(er|vi)', '') AS stripped FROM events""")
def text_functions(spark, folder):
    e = views.table(spark, folder, "events")
    ts = F.col("ts").cast("timestamp")
    return e.select(
        "event_id", F.trim(F.lower(F.concat(F.lit("  "), F.upper("event_type"), F.lit(" ")))).alias("cleaned"),
        F.contains("event_type", F.lit("rr")).alias("has_rr"),
        F.lower(fn.model_label(F.concat("event_type", F.lit("_model")))).alias("spaced"),
        F.date_format(ts, "HH:mm:ss").alias("clock"),
        (F.unix_timestamp(ts) - F.unix_timestamp(F.lit("2024-01-01 00:00:00").cast("timestamp"))).alias("secs"),
        F.regexp_replace("event_type", "^(er|vi)", "").alias("stripped"))
