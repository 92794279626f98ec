"""Joins, set operations, top-k."""

from __future__ import annotations

from pyspark.sql import functions as F

from telemill.functions import r6
from telemill.operators import joins as jn
from telemill.operators.series import time_series
from telemill.sources import views

from .registry import INCIDENTS, SCORES, SHIPMENTS, TELEMETRY, query, r


@query("join_scores_rows", "J1", f"""
WITH {SCORES} SELECT t.seq, s.model_name, {r('s.leak_score', 'leak_score')}, t.pressure
FROM telemetry t JOIN scores s USING (segment_id, timestamp)""")
def join_scores_rows(spark, folder):
    t, s = views.telemetry(spark, folder), views.scores(spark, folder)
    out = t.select("seq", "segment_id", "timestamp", "pressure").join(
        s.select("segment_id", "timestamp", "model_name", "leak_score"), jn.SCORE_KEY)
    return out.select("seq", "model_name", r6("leak_score").alias("leak_score"), "pressure")


@query("unscored_rows", "J2 U5", f"""
WITH {TELEMETRY}, done AS (SELECT segment_id, timestamp FROM telemetry WHERE event_type = 'view')
SELECT seq FROM telemetry t WHERE NOT EXISTS (SELECT 1 FROM done d WHERE d.segment_id = t.segment_id AND d.timestamp = t.timestamp)""")
def unscored_rows(spark, folder):
    t = views.telemetry(spark, folder)
    return jn.missing(t, t.where(F.col("event_type") == "view")).select("seq")


@query("rows_of_leak_segments", "J3", f"""
WITH {TELEMETRY} SELECT seq FROM telemetry WHERE segment_id IN (SELECT segment_id FROM telemetry WHERE leak_severity >= 0.5)""")
def rows_of_leak_segments(spark, folder):
    t = views.telemetry(spark, folder)
    return jn.matching(t, t.where(F.col("leak_severity") >= 0.5), ["segment_id"]).select("seq")


@query("severity_lookup", "J4", f"""
WITH {SHIPMENTS}, last AS (
  SELECT segment_id, timestamp, pressure AS last_pressure FROM shipments
  QUALIFY row_number() OVER (PARTITION BY segment_id, timestamp ORDER BY l_orderkey DESC, l_linenumber DESC, l_partkey DESC) = 1)
SELECT s.l_orderkey, s.l_linenumber, s.l_partkey, s.segment_id, l.last_pressure
FROM shipments s LEFT JOIN last l ON l.segment_id = s.segment_id AND l.timestamp = s.timestamp""")
def severity_lookup(spark, folder):
    s = views.shipments(spark, folder)
    right = s.withColumnRenamed("pressure", "last_pressure")
    return jn.lookup(s, right, jn.SCORE_KEY, views.SHIPMENT_ORDER, ["last_pressure"]).select(
        *views.SHIPMENT_ORDER, "segment_id", "last_pressure")


@query("dimension_names", "J5", """
SELECT s_suppkey, n_name, r_name FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""")
def dimension_names(spark, folder):
    n = views.table(spark, folder, "nation").join(
        F.broadcast(views.table(spark, folder, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    s = views.table(spark, folder, "supplier")
    return s.join(F.broadcast(n), s["s_nationkey"] == n["n_nationkey"]).select("s_suppkey", "n_name", "r_name")


@query("incident_rows", "J6", f"""
WITH {SHIPMENTS}, {INCIDENTS}
SELECT s.l_orderkey, s.l_linenumber, s.l_partkey, i.event_id, i.event_type, {r('i.intensity', 'intensity')}
FROM shipments s JOIN incidents i ON s.segment_id = i.segment_id AND s.timestamp >= i.start_ts AND s.timestamp < i.end_ts""")
def incident_rows(spark, folder):
    s, i = views.shipments(spark, folder), views.incidents(spark, folder)
    out = jn.interval_join(s, i, ["segment_id"], "timestamp", "start_ts", "end_ts", unit=86400)
    return out.select(*views.SHIPMENT_ORDER, "event_id", "event_type", r6("intensity").alias("intensity"))


_LIST = "CAST(o_custkey % 7 AS VARCHAR) || ', ' || CAST(o_custkey % 11 AS VARCHAR) || ',' || CAST(o_custkey % 13 AS VARCHAR)"


@query("explode_segment_lists", "J6", f"""
SELECT o_orderkey, CAST(trim(unnest(string_split({_LIST}, ','))) AS INTEGER) AS segment_id FROM orders""")
def explode_segment_lists(spark, folder):
    o = views.table(spark, folder, "orders")
    k = F.col("o_custkey")
    text = F.concat((k % 7).cast("string"), F.lit(", "), (k % 11).cast("string"), F.lit(","), (k % 13).cast("string"))
    return jn.explode_segments(o.select("o_orderkey", text.alias("segment_ids"))).select("o_orderkey", "segment_id")


@query("incident_labels", "J7", f"""
WITH {SHIPMENTS}, {INCIDENTS},
hits AS (
  SELECT s.l_orderkey, s.l_linenumber, s.l_partkey, s.segment_id, i.event_id, i.event_type AS kind, i.intensity, i.event_type LIKE '%leak' AS leak,
         row_number() OVER (PARTITION BY s.l_orderkey, s.l_linenumber, s.l_partkey, s.segment_id, s.timestamp ORDER BY i.start_ts, i.event_type, i.event_id) AS k
  FROM shipments s JOIN incidents i ON s.segment_id = i.segment_id AND s.timestamp >= i.start_ts AND s.timestamp < i.end_ts),
run AS (
  SELECT *, max(CASE WHEN leak THEN intensity END) OVER (PARTITION BY l_orderkey, l_linenumber, l_partkey, segment_id ORDER BY k) AS sev_so_far FROM hits),
roll AS (
  SELECT l_orderkey, l_linenumber, l_partkey, segment_id, coalesce(max(CASE WHEN leak THEN intensity END), 0) AS sev,
         max(CASE WHEN leak AND sev_so_far >= CASE kind WHEN 'micro_leak' THEN 0.03 ELSE 0.12 END THEN 1 ELSE 0 END) AS target,
         bool_or(NOT leak) AS disturbed, max_by(event_id, k) FILTER (WHERE leak) AS leak_id, min_by(event_id, k) FILTER (WHERE NOT leak) AS other_id
  FROM run GROUP BY ALL),
kinds AS (
  SELECT l_orderkey, l_linenumber, l_partkey, segment_id, string_agg(kind, '|' ORDER BY k) AS tags
  FROM (SELECT l_orderkey, l_linenumber, l_partkey, segment_id, kind, min(k) AS k FROM hits GROUP BY ALL) GROUP BY ALL)
SELECT s.l_orderkey, s.l_linenumber, s.l_partkey, s.segment_id, {r('coalesce(sev, 0)', 'leak_severity')},
       coalesce(r.target, 0) AS target, coalesce(tags, 'nominal') AS scenario_context,
       CASE WHEN sev >= 0.45 THEN 'fault' WHEN sev >= 0.12 OR disturbed THEN 'warning' ELSE 'normal' END AS event_type,
       CASE WHEN sev >= 0.35 THEN 1 ELSE 0 END AS alarm_triggered,
       coalesce(CAST(coalesce(leak_id, other_id) AS VARCHAR), '') AS active_event_id
FROM shipments s LEFT JOIN roll r USING (l_orderkey, l_linenumber, l_partkey, segment_id)
LEFT JOIN kinds USING (l_orderkey, l_linenumber, l_partkey, segment_id)""")
def incident_labels(spark, folder):
    s, i = views.shipments(spark, folder), views.incidents(spark, folder)
    out = jn.label_with_incidents(s, i, [*views.SHIPMENT_ORDER, "segment_id"], ["segment_id"], "timestamp", "start_ts", "end_ts",
                                  unit=86400, leak_types=["micro_leak", "slow_leak"])
    return out.select(*views.SHIPMENT_ORDER, "segment_id", r6("leak_severity").alias("leak_severity"), "target",
                      "scenario_context", "event_type", "alarm_triggered", "active_event_id")


@query("incident_conflicts", "J8", f"""
WITH {INCIDENTS} SELECT event_id, segment_id, coalesce(start_ts < max(end_ts) OVER (PARTITION BY segment_id ORDER BY start_ts, event_id
       ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + INTERVAL 12 HOUR, false) AS conflict FROM incidents""")
def incident_conflicts(spark, folder):
    i = views.incidents(spark, folder)
    s = time_series(i, ["segment_id"], time="start_ts", tiebreak=["event_id"])
    return jn.gap_conflicts(i, s, "start_ts", "end_ts", 12 * 3600).select("event_id", "segment_id", "conflict")


@query("paired_runs", "J9", """
WITH a AS (SELECT l_orderkey % 1000 AS slot, avg(l_extendedprice) AS p, avg(l_quantity) AS f FROM lineitem WHERE l_returnflag = 'N' GROUP BY 1),
b AS (SELECT l_orderkey % 1000 AS slot, avg(l_extendedprice) AS p, avg(l_quantity) AS f FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1)
SELECT a.slot, round(b.p - a.p + 1e-9, 4) + 0.0 AS pressure_effect, round(b.f - a.f + 1e-9, 4) + 0.0 AS flow_rate_effect FROM a JOIN b USING (slot)""")
def paired_runs(spark, folder):
    li = views.table(spark, folder, "lineitem").withColumn("slot", F.col("l_orderkey") % 1000)
    means = [F.avg("l_extendedprice").alias("pressure"), F.avg("l_quantity").alias("flow_rate")]
    runs = [li.where(F.col("l_returnflag") == flag).groupBy("slot").agg(*means) for flag in ("N", "R")]
    out = jn.paired_difference(runs[0], runs[1], ["slot"], ["pressure", "flow_rate"])
    return out.select("slot", r6("pressure_effect", 4).alias("pressure_effect"), r6("flow_rate_effect", 4).alias("flow_rate_effect"))


@query("table_statistics", "J11", f"""
WITH {TELEMETRY} SELECT seq, {r('(pressure - lo) / (hi - lo)', 'scaled')} FROM telemetry, (SELECT min(pressure) AS lo, max(pressure) AS hi FROM telemetry)""")
def table_statistics(spark, folder):
    t = jn.with_statistics(views.telemetry(spark, folder), lo=F.min("pressure"), hi=F.max("pressure"))
    return t.select("seq", r6((F.col("pressure") - F.col("lo")) / (F.col("hi") - F.col("lo"))).alias("scaled"))


@query("union_by_name", "U1", """
SELECT c_custkey AS id, c_acctbal AS balance, c_mktsegment AS unit, 'customer' AS source FROM customer
UNION ALL SELECT s_suppkey, s_acctbal, NULL, 'supplier' FROM supplier""")
def union_by_name(spark, folder):
    c = views.table(spark, folder, "customer").select(
        F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("unit"), F.lit("customer").alias("source"))
    s = views.table(spark, folder, "supplier").select(F.col("s_acctbal").alias("balance"), F.col("s_suppkey").alias("id"), F.lit("supplier").alias("source"))
    return c.unionByName(s, allowMissingColumns=True)


@query("keep_last_arrival", "U3 P7", f"""
WITH {SHIPMENTS} SELECT segment_id, strftime(timestamp, '%Y-%m-%d') AS day, l_orderkey, l_linenumber, l_partkey, pressure FROM shipments
QUALIFY row_number() OVER (PARTITION BY segment_id, timestamp ORDER BY l_orderkey DESC, l_linenumber DESC, l_partkey DESC) = 1""")
def keep_last_arrival(spark, folder):
    s = views.shipments(spark, folder)
    return jn.latest_per_key(s, jn.SCORE_KEY, views.SHIPMENT_ORDER).select(
        "segment_id", F.date_format("timestamp", "yyyy-MM-dd").alias("day"), *views.SHIPMENT_ORDER, "pressure")


@query("key_set_algebra", "U5", """
SELECT l_suppkey, l_partkey, 'both' AS side FROM (SELECT l_suppkey, l_partkey FROM lineitem WHERE l_returnflag = 'R' INTERSECT SELECT l_suppkey, l_partkey FROM lineitem WHERE l_returnflag = 'A')
UNION ALL SELECT l_suppkey, l_partkey, 'returned only' FROM (SELECT l_suppkey, l_partkey FROM lineitem WHERE l_returnflag = 'R' EXCEPT SELECT l_suppkey, l_partkey FROM lineitem WHERE l_returnflag = 'A')""")
def key_set_algebra(spark, folder):
    li = views.table(spark, folder, "lineitem")
    a, b = [li.where(F.col("l_returnflag") == f).select("l_suppkey", "l_partkey") for f in ("R", "A")]
    return a.intersect(b).withColumn("side", F.lit("both")).union(a.subtract(b).withColumn("side", F.lit("returned only")))


@query("top_scores", "T2", f"""
WITH {SCORES} SELECT model_name, seq, {r('leak_score', 'leak_score')} FROM scores ORDER BY leak_score DESC, seq, model_name LIMIT 50""")
def top_scores(spark, folder):
    s = views.scores(spark, folder)
    return s.orderBy(F.desc("leak_score"), "seq", "model_name").limit(50).select("model_name", "seq", r6("leak_score").alias("leak_score"))


@query("recent_log", "T3", f"WITH {TELEMETRY} SELECT seq, segment_id, event_type FROM telemetry ORDER BY timestamp DESC, seq DESC LIMIT 40")
def recent_log(spark, folder):
    return views.telemetry(spark, folder).orderBy(F.desc("timestamp"), F.desc("seq")).limit(40).select("seq", "segment_id", "event_type")


@query("total_order", "T1", f"WITH {SHIPMENTS} SELECT segment_id, strftime(timestamp, '%Y-%m-%d') AS day, count(*) AS n FROM shipments GROUP BY 1, 2 ORDER BY 2, 1")
def total_order(spark, folder):
    from telemill.sources.sinks import total_order as ordered

    s = ordered(views.shipments(spark, folder), ["timestamp", "segment_id"])
    return s.groupBy("segment_id", F.date_format("timestamp", "yyyy-MM-dd").alias("day")).agg(F.count(F.lit(1)).alias("n"))
