"""Scans and sinks. Files are written from the shared tables to the checkpoint folder, then read back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from telemill.functions import r6
from telemill.operators.cleaning import label_events
from telemill.plans import evaluate as ev
from telemill.session import checkpoint_dir
from telemill.sources import readers, sinks, views

from .registry import TELEMETRY, WIDE, query, r


def scratch(spark) -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/files-{uuid.uuid4().hex}"


@query("csv_scan", "S1 S10", "SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def csv_scan(spark, folder):
    path = sinks.write_csv(views.table(spark, folder, "customer"), scratch(spark) + "/customer.csv")
    return readers.read_csv(spark, path, "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string")


@query("scan_by_extension", "S2 S9", """
SELECT s_suppkey AS id, s_acctbal AS balance, 'parquet' AS kind FROM supplier UNION ALL SELECT c_custkey, c_acctbal, 'csv' FROM customer""")
def scan_by_extension(spark, folder):
    base = scratch(spark)
    s = views.table(spark, folder, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("balance"))
    c = views.table(spark, folder, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("balance"))
    a = readers.read_table(spark, sinks.write_parquet(s, base, "supplier"))
    b = readers.read_table(spark, sinks.write_csv(c, base + "/customer.csv"), schema="id bigint, balance double")
    return a.withColumn("kind", F.lit("parquet")).unionByName(b.withColumn("kind", F.lit("csv")))


@query("glob_scan", "S3 U1", """
SELECT n_nationkey AS id, n_name AS name, n_regionkey AS region, NULL AS balance, 'csv' AS kind FROM nation
UNION ALL SELECT r_regionkey, r_name, NULL, NULL, 'csv' FROM region
UNION ALL SELECT s_suppkey, s_name, NULL, CAST(floor(s_acctbal) AS BIGINT), 'csv' FROM supplier
UNION ALL SELECT p_partkey, p_name, NULL, NULL, 'parquet' FROM part""")
def glob_scan(spark, folder):
    base = scratch(spark)
    t = {k: views.table(spark, folder, k) for k in ("nation", "region", "supplier", "part")}
    n = t["nation"].select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"), F.col("n_regionkey").alias("region"))
    # three header shapes under one pattern, one of them in another order, and a blank in a path
    sinks.write_csv(n, base + "/a/nation")
    sinks.write_csv(t["region"].select(F.col("r_name").alias("name"), F.col("r_regionkey").alias("id")), base + "/a/region names")
    sinks.write_csv(t["supplier"].select(F.col("s_suppkey").alias("id"), F.floor("s_acctbal").alias("balance"), F.col("s_name").alias("name")), base + "/a/supplier")
    t["part"].select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name")).write.parquet(base + "/b/part")
    df = readers.read_matching(spark, base, ["*.csv", "*.parquet", "*.xls"], recursive=True)
    kind = F.when(F.col("source_file").endswith(".csv"), "csv").otherwise("parquet")
    return df.select(F.col("id").cast("bigint").alias("id"), "name", F.col("region").cast("int").alias("region"), F.col("balance").cast("bigint").alias("balance"), kind.alias("kind"))


WELLS = 16


def well_files(spark, folder, name: str = "wells", by_well: bool = False) -> str:
    """One directory per event class, as the field data is laid out; ``by_well`` gives each class a file per well, in order."""
    path = f"{scratch(spark)}/{name}"
    w = label_events(views.wide(spark, folder))
    w = w.select(F.col("P_inlet").alias("P-PDG"), F.col("Q_inlet").alias("QGL"), "class", "timestamp", "event_class", F.col("l_partkey").alias("seq"))
    if by_well:  # files are named by their partition
        w = w.repartitionById(WELLS, (F.col("seq") % WELLS).cast("int"))
    w.write.option("maxRecordsPerFile", 0).partitionBy("event_class").parquet(path)
    return path


@query("well_scan", "S4", f"""
WITH {WIDE}, c AS (SELECT *, CASE WHEN class IS NULL THEN 0 WHEN class >= 100 THEN class % 100 ELSE class END AS k FROM wide)
SELECT 'event_class=' || CAST(k AS VARCHAR) AS event_dir, count(*) AS n, {r('sum(Q_inlet)', 'flow', 3)}, true AS named FROM c GROUP BY k""")
def well_scan(spark, folder):
    df = readers.read_wells(spark, well_files(spark, folder))
    named = F.col("scenario_id") == F.concat("event_dir", F.lit("_"), "well_id")
    return df.groupBy("event_dir").agg(F.count(F.lit(1)).alias("n"), r6(F.sum("QGL"), 3).alias("flow"), F.bool_and(named).alias("named"))


@query("sample_files_per_label", "S5", f"""
WITH {WIDE}, c AS (SELECT *, l_partkey % 16 AS well, CASE WHEN class IS NULL THEN 0 WHEN class >= 100 THEN class % 100 ELSE class END AS k FROM wide),
f AS (SELECT k, well, row_number() OVER (PARTITION BY k ORDER BY well) AS place FROM (SELECT DISTINCT k, well FROM c))
SELECT 'event_class=' || CAST(k AS VARCHAR) AS event_dir, count(*) AS n, count(DISTINCT well) AS wells, CAST(sum(l_partkey) AS BIGINT) AS parts, true AS named
FROM c JOIN f USING (k, well) WHERE place <= 3 GROUP BY k""")
def sample_files_per_label(spark, folder):
    """The rows of the first three files of each label; only those files are opened."""
    path = well_files(spark, folder, "wells of the field", by_well=True)
    files = readers.list_files(spark, path)
    labels = files.select(F.regexp_extract("path", r"([^/]+)/[^/]+$", 1)).distinct().count()
    df = readers.read_wells(spark, path, readers.sample_files(files, 3 * labels))
    named = F.col("scenario_id") == F.concat_ws("_", "event_dir", "well_id")
    return df.groupBy("event_dir").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("well_id").alias("wells"), F.sum("seq").alias("parts"), F.bool_and(named).alias("named"))


@query("export_scan", "S6 D4", f"""
WITH {TELEMETRY}, codes AS (SELECT segment_id, row_number() OVER (ORDER BY 'w' || CAST(segment_id AS VARCHAR)) AS code FROM (SELECT DISTINCT segment_id FROM telemetry))
SELECT seq, CAST(code AS INTEGER) AS segment_id, pressure, target, 1 AS pump_state, CASE WHEN target = 1 THEN 'leak' ELSE 'normal' END AS event_type, 'export' AS source_dataset
FROM telemetry JOIN codes USING (segment_id)""")
def export_scan(spark, folder):
    t = views.telemetry(spark, folder).select(
        "timestamp", F.concat(F.lit("w"), F.col("segment_id").cast("string")).alias("well_id"), "pressure", "flow_rate", "temperature", "target", "seq")
    path = sinks.write_csv(t, scratch(spark) + "/export.csv")
    out = readers.read_export(spark, path, "export")
    return out.select(F.col("seq").cast("bigint").alias("seq"), "segment_id", "pressure", "target", "pump_state", "event_type", "source_dataset")


DATASETS = {
    "orders": {"phase": 1, "telemetry_compatible": True, "live_training_eligible": True, "target": "o_orderstatus",
               "file_globs": ["orders*.parquet"], "column_map": {"segment_id": ["unit", "o_custkey"], "pressure": "o_totalprice", "timestamp": "o_orderdate"}},
    "events": {"phase": 1, "telemetry_compatible": True, "live_training_eligible": False, "file_globs": ["events.parquet"]},
    "part": {"phase": 2, "telemetry_compatible": False, "file_globs": ["part.parquet"]},
}


@query("registry_lookup", "S8 D3", """
SELECT o_orderkey, o_custkey AS segment_id, o_totalprice AS pressure, strftime(o_orderdate, '%Y-%m-%d') AS day, 'orders' AS dataset_name FROM orders
UNION ALL SELECT NULL, NULL, NULL, 'not_live_training_eligible', 'events' UNION ALL SELECT NULL, NULL, NULL, 'not_telemetry_compatible', 'part'""")
def registry_lookup(spark, folder):
    reg = readers.Registry({k: {**v, "folder": folder} for k, v in DATASETS.items()})
    df = reg.load(spark, "orders").select("o_orderkey", "segment_id", "pressure", F.date_format("timestamp", "yyyy-MM-dd").alias("day"), "dataset_name")
    out = reg.skip_reasons(spark).where(F.col("reason").isNotNull())
    return df.unionByName(out.select(F.col("reason").alias("day"), F.col("key").alias("dataset_name")), allowMissingColumns=True)


@query("json_summaries", "S11", """
SELECT o_orderpriority AS run_label, o_orderstatus AS model, round(avg(o_totalprice) / 500000.0, 4) AS roc_auc FROM orders GROUP BY ALL""")
def json_summaries(spark, folder):
    o = views.table(spark, folder, "orders").groupBy("o_orderpriority", "o_orderstatus").agg(F.round(F.avg("o_totalprice") / 500000.0, 4).alias("roc_auc"))
    packed = o.groupBy(F.col("o_orderpriority").alias("run_label")).agg(F.map_from_entries(F.collect_list(F.struct("o_orderstatus", F.struct("roc_auc")))).alias("models"))
    path = sinks.write_summary(packed.repartitionByRange(16, "run_label"), scratch(spark) + "/summaries")
    back = readers.read_summaries(spark, [path, path], f"run_label string, models {ev.SUMMARY_MODELS}")
    return back.select("run_label", F.explode("models").alias("model", "m")).select("run_label", "model", "m.roc_auc")
