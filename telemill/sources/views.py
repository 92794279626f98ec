"""Telemetry-shaped views over the shared test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import configure


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    configure(spark)
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def telemetry(spark: SparkSession, folder: str) -> DataFrame:
    """``events`` as sensor readings: one segment per user, errors as leaks."""
    e = table(spark, folder, "events")
    is_error = F.col("event_type") == "error"
    ts = F.col("ts").cast("timestamp")
    return e.select(
        F.col("event_id").alias("seq"),
        F.col("user_id").alias("segment_id"),
        ts.alias("timestamp"),
        F.date_trunc("hour", ts).alias("tick"),
        F.col("value").alias("pressure"),
        F.get_json_object("props", "$.k").cast("double").alias("flow_rate"),
        (F.lit(20.0) + (F.col("event_id") % 97) / 10.0).alias("temperature"),
        "event_type",
        F.when(is_error, 1).otherwise(0).alias("target"),
        F.when(is_error, F.least(F.col("value") / 500.0, F.lit(1.0))).otherwise(0.0).alias("leak_severity"),
    )


SHIPMENT_ORDER = ["l_orderkey", "l_linenumber", "l_partkey"]


def shipments(spark: SparkSession, folder: str) -> DataFrame:
    """``lineitem`` as a busier feed with many equal timestamps."""
    li = table(spark, folder, "lineitem")
    return li.select(
        F.col("l_suppkey").alias("segment_id"),
        F.col("l_shipdate").cast("timestamp").alias("timestamp"),
        *SHIPMENT_ORDER,
        (F.col("l_extendedprice") / 1000.0).alias("pressure"),
        F.col("l_quantity").alias("flow_rate"),
        F.col("l_returnflag").alias("regime"),
        F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("target"),
    )


def wide(spark: SparkSession, folder: str) -> DataFrame:
    """``lineitem`` as multi-sensor wells, with sentinels and gaps."""
    li = table(spark, folder, "lineitem")
    price, part = F.col("l_extendedprice"), F.col("l_partkey")
    return li.select(
        F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("scenario_id"),
        F.col("l_shipdate").cast("timestamp").alias("timestamp"),
        *SHIPMENT_ORDER,
        F.when(part % 50 == 0, F.lit(-1.18e42)).otherwise(price * 1000.0).alias("P_inlet"),
        F.when(part % 33 == 0, F.lit(None).cast("double")).otherwise(price * 900.0).alias("P_mid"),
        F.when(part % 41 == 0, F.lit(0.0)).otherwise(price * 800.0).alias("P_outlet"),
        F.col("l_quantity").alias("Q_inlet"),
        (F.col("l_quantity") * (1.0 - F.col("l_discount"))).alias("Q_outlet"),
        (40.0 + F.col("l_tax") * 100.0).alias("T_inlet"),
        (38.0 + F.col("l_tax") * 50.0).alias("T_mid"),
        F.lit(35.0).alias("T_outlet"),
        F.when(F.col("l_linenumber") == 7, F.lit(None).cast("int"))
        .when(F.col("l_returnflag") == "R", 100 + F.col("l_linenumber"))
        .otherwise(0).alias("class"),
    )


def scores(spark: SparkSession, folder: str) -> DataFrame:
    """Long score table of two stand-in models over the telemetry view."""
    t = telemetry(spark, folder)
    kinds = ["steady_state", "demand_shock", "slow_seep", "compound_incident"]
    kind = F.lit("micro_leak")
    for i, name in enumerate(kinds):
        kind = F.when(F.col("segment_id") % 5 == i, name).otherwise(kind)
    wide_scores = t.select(
        F.concat(F.lit("run_"), F.col("segment_id").cast("string")).alias("run_id"),
        kind.alias("scenario_key"),
        "segment_id", "seq", "timestamp", "target", "leak_severity",
        F.least(F.col("pressure") / 200.0, F.lit(1.0)).alias("a"),
        (F.col("flow_rate") / 100.0).alias("b"),
    )
    ids = ["run_id", "scenario_key", "segment_id", "seq", "timestamp", "target", "leak_severity"]
    return wide_scores.unpivot(ids, ["a", "b"], "model_name", "leak_score")


def incidents(spark: SparkSession, folder: str) -> DataFrame:
    """``orders`` as half-open incident intervals per segment."""
    o = table(spark, folder, "orders")
    start = F.col("o_orderdate").cast("timestamp")
    pr = F.col("o_orderpriority")
    return o.select(
        F.col("o_orderkey").alias("event_id"),
        (F.col("o_custkey") % 100).alias("segment_id"),
        start.alias("start_ts"),
        (start + F.make_dt_interval((1 + F.col("o_orderkey") % 5).cast("int"))).alias("end_ts"),
        F.when(pr.startswith("1"), "micro_leak").when(pr.startswith("2"), "slow_leak")
        .when(pr.startswith("3"), "demand_spike").otherwise("sensor_drift").alias("event_type"),
        (F.col("o_totalprice") / 500000.0).alias("intensity"),
    )
