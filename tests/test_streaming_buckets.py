"""Many keys share a bucket of a stream: calls are as many as buckets, and every key's rows come out as on their own."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from telemill.operators import features as ft
from telemill.operators.alerts import AlertPolicy, apply_policy
from telemill.operators.series import time_series
from telemill.sources import views
from telemill.streaming import ordered
from telemill.streaming import windows as sw
from telemill.streaming.alerts import stream_alerts
from telemill.streaming.features import STREAMED, stream_features
from telemill.streaming.source import drain, stream_files, stream_table

from .conftest import close, rows
from .test_streaming import small, temp


@pytest.fixture(scope="module")
def telemetry(spark, data):
    t = views.telemetry(spark, data).select("segment_id", "timestamp", "seq", "pressure", "flow_rate")
    # keys of very unequal length, one of them NULL
    key = F.when(F.col("seq") % 3 == 0, F.lit(1)).when(F.col("seq") % 11 == 0, F.lit(None)).otherwise(F.col("seq") % 37).cast("long")
    return t.withColumns({"segment_id": key, "pressure": F.when(F.col("seq") % 31 != 0, F.col("pressure"))}).cache()


def test_calls_are_as_many_as_buckets(spark, telemetry):
    def step(new, starts, carries):
        return {"together": np.full(starts[-1], float(len(carries)))}, [(c[0] + b - a,) for c, a, b in zip(carries, starts[:-1].tolist(), starts[1:].tolist())]

    out = ordered.process_in_order(
        stream_table(telemetry, steps=2, delay="1 hour"), ["segment_id"], ["pressure"], step, lambda: (0,), [T.StructField("n", T.IntegerType())],
        [T.StructField("together", T.DoubleType())], buckets=1)
    got = drain(out, temp() + "/o", temp()).where("seq >= 0")
    assert got.count() == telemetry.count()
    assert got.agg(F.max("together")).first()[0] > 20  # of 38 keys


def test_features_of_keys_in_one_bucket_equal_batch(spark, telemetry, monkeypatch):
    monkeypatch.setattr(ordered, "BLOCK", 50)  # keys are cut between calls
    monkeypatch.setattr(ordered, "ENTRY", 40)
    got = drain(stream_features(stream_table(telemetry, delay="1 hour"), buckets=2), temp() + "/o", temp()).where("seq >= 0")
    got = got.select("segment_id", "seq", *[F.nanvl(F.col(c), F.lit(None).cast("double")).alias(c) for c in STREAMED])
    want = ft.build_features(telemetry, time_series(telemetry, ["segment_id"]), STREAMED).select("segment_id", "seq", *STREAMED)
    close(rows(got, "seq"), rows(want, "seq"), 1e-8)


@pytest.mark.parametrize("mode", ["persistence", "confirmation"])
def test_alerts_of_keys_in_one_bucket_equal_batch(spark, telemetry, mode, monkeypatch):
    monkeypatch.setattr(ordered, "BLOCK", 50)
    model = F.when(F.col("seq") % 2 == 0, "even")  # NULL otherwise
    scores = telemetry.select(model.alias("model_name"), "segment_id", "timestamp", "seq", (F.col("flow_rate") / 100).alias("leak_score"))
    policy = AlertPolicy(threshold=0.4, mode=mode)
    got = drain(stream_alerts(stream_table(scores, delay="1 hour"), policy=policy, sticky=3, buckets=1), temp() + "/o", temp()).where("seq >= 0")
    want = apply_policy(scores, time_series(scores, ["model_name", "segment_id"]), policy)
    named = ["seq", "model_name", "segment_id", "model_alert"]
    assert rows(got.select(named), "seq") == rows(want.select(named), "seq")
    since, held = {}, []
    for r in got.orderBy("timestamp", "seq").collect():
        key = (r.model_name, r.segment_id)
        since[key] = 0 if r.model_alert else since.get(key, 3) + 1
        held.append(r.pinned == (since[key] < 3))
    assert all(held)


def test_an_idle_key_leaves_a_bucket_that_goes_on(spark):
    folder = temp() + "/in"
    schema = small(spark, folder, [(1, 0, 1, 1.0), (2, 0, 2, 1.0)], [(2, 50, 3, 1.0)], [(2, 100, 4, 1.0)], [(2, 150, 5, 1.0)], [(2, 200, 6, 1.0)],
                   [(1, 210, 7, 1.0), (2, 210, 8, 1.0)], [(3, 900, 9, 0.0)])
    rows_ = stream_files(spark, folder, schema, delay="1 minute")
    gone = {idle: {r["seq"]: r["gone_seq"] for r in drain(sw.retain_stream(rows_, keep=1, values=["leak_score"], idle=idle, buckets=1), temp() + "/o", temp()).collect()}
            for idle in (None, 3600)}
    assert [gone[None][s] for s in (3, 4, 5, 6, 8)] == [gone[3600][s] for s in (3, 4, 5, 6, 8)] == [2, 3, 4, 5, 6]
    assert gone[None][7] == 1 and gone[3600][7] is None


def test_great_keys_beside_a_null_stay_apart(spark):
    folder, far = temp() + "/in", dt.datetime(2026, 1, 1)
    big = 2**60
    df = spark.createDataFrame([(k, far + dt.timedelta(minutes=m), 10 * i + m) for i, k in enumerate([big + 1, big + 2, 0, None]) for m in range(2)]
                               + [(7, far + dt.timedelta(days=9), 99)], "segment_id long, timestamp timestamp, seq long").withColumn("pressure", F.lit(1.0))
    df.coalesce(1).write.parquet(folder)
    out = drain(sw.retain_stream(stream_files(spark, folder, df.schema), keep=1, buckets=1), temp() + "/o", temp()).where("seq < 99")
    assert {r.seq: (r.segment_id, r.gone_seq) for r in out.collect()} == {
        0: (big + 1, None), 1: (big + 1, 0), 10: (big + 2, None), 11: (big + 2, 10), 20: (0, None), 21: (0, 20), 30: (None, None), 31: (None, 30)}
