"""Registration of queries and the SQL views they share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
COVERS: dict[str, list[str]] = {}


def query(name: str, covers: str, sql: str | None = None):
    """Register ``fn(spark, folder)`` under ``name``; ``covers`` lists inventory ids."""

    def register(fn: Callable[[SparkSession, str], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        COVERS[name] = covers.split()
        if sql is not None:
            SQL[name] = sql
        return fn

    return register


def r(expr: str, alias: str, digits: int = 6) -> str:
    """SQL counterpart of the rounding helper (adding zero turns -0.0 into 0.0)."""
    return f"(round(({expr}) + 1e-9, {digits}) + 0.0) AS {alias}"


TELEMETRY = """
telemetry AS (
  SELECT event_id AS seq, user_id AS segment_id, ts AS timestamp, date_trunc('hour', ts) AS tick,
         value AS pressure, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS flow_rate,
         CAST(20.0 + (event_id % 97) / 10.0 AS DOUBLE) AS temperature, event_type,
         CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS target,
         CASE WHEN event_type = 'error' THEN least(value / 500.0, 1.0) ELSE 0.0 END AS leak_severity
  FROM events)"""

SHIPMENTS = """
shipments AS (
  SELECT l_suppkey AS segment_id, l_shipdate AS timestamp, l_orderkey, l_linenumber, l_partkey,
         l_extendedprice / 1000.0 AS pressure, l_quantity AS flow_rate, l_returnflag AS regime,
         CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS target
  FROM lineitem)"""

WIDE = """
wide AS (
  SELECT CONCAT('s', CAST(l_suppkey AS VARCHAR)) AS scenario_id, l_shipdate AS timestamp,
         l_orderkey, l_linenumber, l_partkey,
         CASE WHEN l_partkey % 50 = 0 THEN -1.18e42 ELSE l_extendedprice * 1000.0 END AS P_inlet,
         CASE WHEN l_partkey % 33 = 0 THEN NULL ELSE l_extendedprice * 900.0 END AS P_mid,
         CASE WHEN l_partkey % 41 = 0 THEN 0.0 ELSE l_extendedprice * 800.0 END AS P_outlet,
         l_quantity AS Q_inlet, l_quantity * (1.0 - l_discount) AS Q_outlet,
         40.0 + l_tax * 100.0 AS T_inlet, 38.0 + l_tax * 50.0 AS T_mid, CAST(35.0 AS DOUBLE) AS T_outlet,
         CASE WHEN l_linenumber = 7 THEN NULL WHEN l_returnflag = 'R' THEN 100 + l_linenumber ELSE 0 END AS class
  FROM lineitem)"""

SCORES = TELEMETRY + """,
scores AS (
  SELECT CONCAT('run_', CAST(segment_id AS VARCHAR)) AS run_id,
         CASE segment_id % 5 WHEN 0 THEN 'steady_state' WHEN 1 THEN 'demand_shock' WHEN 2 THEN 'slow_seep'
              WHEN 3 THEN 'compound_incident' ELSE 'micro_leak' END AS scenario_key,
         segment_id, seq, timestamp, target, leak_severity, m.model_name,
         CASE m.model_name WHEN 'a' THEN least(pressure / 200.0, 1.0) ELSE flow_rate / 100.0 END AS leak_score
  FROM telemetry CROSS JOIN (SELECT 'a' AS model_name UNION ALL SELECT 'b') m),
steps AS (
  SELECT *, row_number() OVER (PARTITION BY model_name, run_id, segment_id ORDER BY timestamp, seq) - 1 AS step
  FROM scores)"""

INCIDENTS = """
incidents AS (
  SELECT o_orderkey AS event_id, o_custkey % 100 AS segment_id, o_orderdate AS start_ts,
         o_orderdate + INTERVAL 1 DAY * (1 + o_orderkey % 5) AS end_ts,
         CASE WHEN o_orderpriority LIKE '1%' THEN 'micro_leak' WHEN o_orderpriority LIKE '2%' THEN 'slow_leak'
              WHEN o_orderpriority LIKE '3%' THEN 'demand_spike' ELSE 'sensor_drift' END AS event_type,
         o_totalprice / 500000.0 AS intensity
  FROM orders)"""
