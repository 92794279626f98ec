"""Sampling, splitting and the training corpus. Hash ranks are md5, so SQL draws the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from telemill.functions import severity_weight
from telemill.operators import sampling as sp
from telemill.plans.corpus import build_corpus, corpus_from_files, corpus_summary, summary_with_reasons
from telemill.sources import views

from .registry import SHIPMENTS, TELEMETRY, query


def h(*cols: str) -> str:
    return "md5(concat_ws('|', '42', " + ", ".join(f"CAST({c} AS VARCHAR)" for c in cols) + "))"


@query("rebalance_classes", "X1", f"""
WITH {TELEMETRY}, k AS (SELECT *, row_number() OVER (PARTITION BY target ORDER BY {h('seq')}, seq) AS rk, sum(target) OVER () AS pos FROM telemetry)
SELECT seq, target FROM k WHERE target = 1 OR rk <= floor(pos * 2.0)""")
def rebalance_classes(spark, folder):
    return sp.rebalance(views.telemetry(spark, folder), ["seq"], 2.0).select("seq", "target")


@query("cap_rows_per_source", "X2", f"""
WITH {SHIPMENTS} SELECT regime, l_orderkey, l_linenumber, l_partkey, segment_id FROM shipments
QUALIFY row_number() OVER (PARTITION BY regime ORDER BY {h('l_orderkey', 'l_linenumber', 'l_partkey', 'segment_id')}, l_orderkey, l_linenumber, l_partkey, segment_id) <= 2500""")
def cap_rows_per_source(spark, folder):
    s = views.shipments(spark, folder)
    return sp.cap_rows(s, [*views.SHIPMENT_ORDER, "segment_id"], 2500, ["regime"]).select("regime", *views.SHIPMENT_ORDER, "segment_id")


@query("class_capped_rows", "X3", f"""
WITH {TELEMETRY}, k AS (SELECT *, row_number() OVER (PARTITION BY target ORDER BY {h('seq')}, seq) AS rk, sum(target) OVER () AS pos FROM telemetry)
SELECT seq, target FROM k WHERE (target = 1 AND rk <= least(pos, 1000)) OR (target = 0 AND rk <= 3000 - least(pos, 1000))""")
def class_capped_rows(spark, folder):
    return sp.class_capped(views.telemetry(spark, folder), ["seq"], 3000).select("seq", "target")


_GROUPS = "grp AS (SELECT segment_id, max(CASE WHEN leak_severity >= 0.4 THEN 1 ELSE 0 END) AS label, count(*) AS n FROM telemetry GROUP BY segment_id)"


def severe(spark, folder):
    return views.telemetry(spark, folder).withColumn("target", F.when(F.col("leak_severity") >= 0.4, 1).otherwise(0))


@query("sample_whole_scenarios", "X4", f"""
WITH {TELEMETRY}, {_GROUPS},
c AS (SELECT sum(label) AS a, sum(1 - label) AS b, count(*) AS n FROM grp),
y AS (SELECT *, 40.0 * a / n AS want FROM c),
q1 AS (SELECT *, least(a, greatest(CASE WHEN a > 0 THEN 1 ELSE 0 END, CASE WHEN want - floor(want) = 0.5 THEN floor(want) + floor(want) % 2 ELSE round(want) END)) AS share FROM y),
q2 AS (SELECT *, least(b, 40 - share) AS normal FROM q1), q AS (SELECT *, least(a, 40 - normal) AS positive FROM q2),
pick AS (SELECT segment_id FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY {h('segment_id')}, segment_id) AS rk FROM grp), q
         WHERE (n <= 40) OR rk <= CASE label WHEN 1 THEN positive ELSE normal END)
SELECT seq, segment_id FROM telemetry WHERE segment_id IN (SELECT segment_id FROM pick)""".replace("WHERE (n <= 40) OR rk", "WHERE rk"))
def sample_whole_scenarios(spark, folder):
    return sp.sample_groups(severe(spark, folder), "segment_id", 40).select("seq", "segment_id")


@query("stratified_split", "X5", f"""
WITH {TELEMETRY}, k AS (SELECT *, row_number() OVER (PARTITION BY target ORDER BY {h('seq')}, seq) AS rk, count(*) OVER (PARTITION BY target) AS n FROM telemetry)
SELECT seq, target, CASE WHEN rk <= ceil(n * 0.2) THEN 'test' WHEN rk <= ceil(n * 0.2) + ceil(n * 0.1) THEN 'valid' ELSE 'train' END AS part FROM k""")
def stratified_split(spark, folder):
    return sp.stratified_split(views.telemetry(spark, folder), ["seq"], "target", {"test": 0.2, "valid": 0.1, "train": 0.0}).select("seq", "target", "part")


@query("group_split", "X6", f"""
WITH {TELEMETRY}, {_GROUPS}, k AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY {h('segment_id')}, segment_id) AS rk, count(*) OVER (PARTITION BY label) AS size FROM grp)
SELECT seq, segment_id, CASE WHEN rk <= ceil(size * 0.25) THEN 'test' ELSE 'train' END AS part FROM telemetry JOIN k USING (segment_id)""")
def group_split(spark, folder):
    return sp.group_split(severe(spark, folder), "segment_id", {"test": 0.25, "train": 0.0}).select("seq", "segment_id", "part")


@query("group_folds", "X7", f"""
WITH {TELEMETRY}, {_GROUPS},
k AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY floor(log2(n)) DESC, {h('segment_id')}, segment_id) - 1 AS rk FROM grp)
SELECT seq, segment_id, CAST((CASE WHEN (rk // 5) % 2 = 0 THEN rk % 5 ELSE 4 - rk % 5 END + label) % 5 AS INTEGER) AS fold FROM telemetry JOIN k USING (segment_id)""")
def group_folds(spark, folder):
    return sp.group_folds(severe(spark, folder), "segment_id", 5).select("seq", "segment_id", "fold")


@query("severity_weights", "X8", f"""
WITH {TELEMETRY} SELECT seq, CAST(CASE WHEN target <> 1 THEN 1.0 WHEN leak_severity < 0.15 THEN 12.0 WHEN leak_severity < 0.3 THEN 15.0 WHEN leak_severity < 0.6 THEN 3.0 ELSE 1.0 END AS DOUBLE) AS weight FROM telemetry""")
def severity_weights(spark, folder):
    return views.telemetry(spark, folder).select("seq", severity_weight(F.col("target"), F.col("leak_severity")).alias("weight"))


_CORPUS = f"""
src AS (SELECT 'events' AS source_dataset, CAST(seq AS VARCHAR) AS row_key, segment_id, timestamp, pressure, target FROM telemetry
        UNION ALL SELECT 'shipments', l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || segment_id, segment_id, timestamp, pressure, target FROM shipments),
cnt AS (SELECT source_dataset, sum(target) AS pos, count(*) - sum(target) AS neg FROM src GROUP BY 1),
bal AS (SELECT s.*, row_number() OVER (PARTITION BY s.source_dataset, target ORDER BY {h('row_key')}, row_key) AS rk, floor(pos * 1.5) AS lim, pos, neg FROM src s JOIN cnt USING (source_dataset)),
kept AS (SELECT * FROM bal WHERE NOT (pos > 0 AND neg > lim) OR target = 1 OR rk <= lim),
corpus AS (SELECT * FROM kept QUALIFY row_number() OVER (PARTITION BY source_dataset ORDER BY {h('row_key')}, row_key) <= 4000)"""


def corpus(spark, folder):
    t = views.telemetry(spark, folder).withColumn("row_key", F.col("seq").cast("string"))
    s = views.shipments(spark, folder).withColumn("row_key", F.concat_ws("-", *views.SHIPMENT_ORDER, "segment_id"))
    cols = ["row_key", "segment_id", "timestamp", "pressure", "target"]
    return build_corpus({"events": t.select(*cols), "shipments": s.select(*cols)}, ["row_key"], 1.5, 4000)


@query("training_corpus", "U4 X1 X2 U1", f"WITH {TELEMETRY}, {SHIPMENTS}, {_CORPUS} SELECT source_dataset, row_key, segment_id, pressure, target FROM corpus")
def training_corpus(spark, folder):
    return corpus(spark, folder).select("source_dataset", "row_key", "segment_id", "pressure", "target")


@query("corpus_summary", "A18", f"""
WITH {TELEMETRY}, {SHIPMENTS}, {_CORPUS}
SELECT source_dataset, count(*) AS row_count, count(*) FILTER (WHERE target = 1) AS positive_count, count(*) FILTER (WHERE target = 0) AS negative_count FROM corpus GROUP BY 1""")
def corpus_summary_rows(spark, folder):
    return corpus_summary(corpus(spark, folder)).drop("skipped")


@query("corpus_sources", "U4 A18", f"""
WITH {TELEMETRY}, {SHIPMENTS}, {_CORPUS}
SELECT source_dataset, count(*) AS row_count, count(*) FILTER (WHERE target = 1) AS positive_count, count(*) FILTER (WHERE target = 0) AS negative_count,
       CAST(NULL AS VARCHAR) AS skipped FROM corpus GROUP BY 1
UNION ALL SELECT 'orders', count(*), 0, 0, 'no_usable_rows' FROM orders WHERE o_totalprice < 0
UNION ALL SELECT 'absent', 0, 0, 0, 'missing_file'""")
def corpus_sources(spark, folder):
    """The corpus from files, one of which does not exist and one of which has no usable rows."""
    cols = ["row_key", "segment_id", "timestamp", "pressure", "target"]
    names = {"events": "events", "shipments": "lineitem", "orders": "orders", "absent": "readings_of_no_one"}
    prepare = {
        "events": lambda _: views.telemetry(spark, folder).withColumn("row_key", F.col("seq").cast("string")).select(*cols),
        "shipments": lambda _: views.shipments(spark, folder).withColumn("row_key", F.concat_ws("-", *views.SHIPMENT_ORDER, "segment_id")).select(*cols),
        "orders": lambda df: df.where("o_totalprice < 0").select(
            F.col("o_orderkey").cast("string").alias("row_key"), F.col("o_custkey").alias("segment_id"), F.col("o_orderdate").cast("timestamp").alias("timestamp"),
            F.col("o_totalprice").alias("pressure"), F.lit(1).alias("target")),
    }
    paths = {n: f"{folder.rstrip('/')}/{t}.parquet" for n, t in names.items()}
    rows, absent = corpus_from_files(spark, paths, prepare, ["row_key"], max_negative_ratio=1.5, max_rows_per_source=4000)
    return summary_with_reasons(rows, list(paths), absent)
