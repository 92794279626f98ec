"""Steps that several queries share must not deal all rows out by a few keys, nor fill memory with fits."""

from __future__ import annotations

import threading
import time

import pytest
from pyspark.sql import functions as F

from telemill.ml import train as tr
from telemill.operators import features as ft
from telemill.operators import sampling as sp
from telemill.operators.series import time_series
from telemill.plans import evaluate as ev


@pytest.fixture()
def nothing_looks_small(spark):
    """Tables whose size the planner can only guess count as large, as they do at size."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "20KB")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def plan(df) -> str:
    return df._jdf.queryExecution().sparkPlan().toString()


def rows(spark, n=4000):
    return spark.range(n).select(
        F.col("id").alias("seq"), (F.col("id") % 2).cast("string").alias("source"), (F.col("id") % 7 == 0).cast("int").alias("target"),
        (F.col("id") % 40).alias("segment_id"), F.timestamp_seconds(F.col("id")).alias("timestamp"),
        F.date_trunc("hour", F.timestamp_seconds(F.col("id"))).alias("tick"),
        (F.col("id") % 13).cast("double").alias("pressure"), (F.col("id") % 11).cast("double").alias("flow_rate"))


def test_rows_of_few_sources_are_picked_without_dealing_them_out(spark, nothing_looks_small):
    out = sp.rebalance(rows(spark), ["seq"], 1.5, ["source"], cap=500)
    assert "SortMergeJoin" not in plan(out)
    assert {r["source"]: r["count"] for r in out.groupBy("source").count().collect()} == {"0": 500, "1": 500}


def test_thresholds_of_few_models_are_broadcast(spark, nothing_looks_small):
    scores = rows(spark).select(F.col("source").alias("model_name"), F.col("pressure").alias("leak_score"))
    found = scores.groupBy("model_name").agg(F.max("leak_score").alias("threshold"))
    assert "SortMergeJoin" not in plan(ev.with_threshold(scores, found))


def test_wide_rows_stay_where_they_are(spark, nothing_looks_small, monkeypatch):
    t = rows(spark)
    series = time_series(t, ["segment_id"])
    late = ft.build_features(t, series, tick="tick")
    assert "SortMergeJoin" not in plan(late)
    monkeypatch.setattr(ft, "MOST_TICKS", 0)
    early = ft.build_features(t, series, tick="tick")
    assert early.columns == late.columns
    assert early.exceptAll(late).isEmpty() and late.exceptAll(early).isEmpty()


@pytest.mark.parametrize("parts, least, most", [(64, 1, 1), (1, 2, tr.SIDE_BY_SIDE)])
def test_fits_of_a_large_table_do_not_fill_memory_together(spark, monkeypatch, parts, least, most):
    now, peak, lock = [0], [0], threading.Lock()

    def fitted(builder, train, features, weight):
        with lock:
            now[0] += 1
            peak[0] = max(peak[0], now[0])
        time.sleep(0.05)
        with lock:
            now[0] -= 1
        return tr.Majority(0)

    monkeypatch.setattr(tr, "fit", fitted)
    monkeypatch.setattr(tr, "ROWS_PER_TASK", 1)
    data = rows(spark, 640).withColumn("fold", (F.col("seq") % 3).cast("int")).repartition(parts)
    tr.cross_validate(data, {"a": 1, "b": 2, "c": 3}, ["pressure"], k=3)
    assert least <= peak[0] <= most
