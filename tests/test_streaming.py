"""Streams must give what a batch over the same rows gives, and late rows must be dropped and counted."""

import datetime as dt
import tempfile

import pytest
from pyspark.sql import functions as F

from telemill.operators import features as ft
from telemill.operators.alerts import AlertPolicy, apply_policy
from telemill.operators.series import time_series
from telemill.sources import views
from telemill.streaming import windows as sw
from telemill.streaming.alerts import stream_alerts
from telemill.streaming.features import STREAMED, stream_features
from telemill.streaming.source import StepReader, drain, finish, late_rows, stream_files, stream_table, write_stream

from .conftest import close, rows


def temp():
    return tempfile.mkdtemp(prefix="spark-", dir="/tmp")


@pytest.fixture(scope="module")
def telemetry(spark, data):
    t = views.telemetry(spark, data).select("segment_id", "timestamp", "seq", "pressure", "flow_rate")
    return t.withColumns({"segment_id": F.col("segment_id") % 5, "pressure": F.when(F.col("seq") % 31 != 0, F.col("pressure"))}).cache()


def test_features_equal_batch(spark, telemetry):
    stream = stream_table(telemetry, delay="1 hour")
    got = drain(stream_features(stream), temp() + "/o", temp()).where("seq >= 0")
    got = got.select("segment_id", "seq", *[F.nanvl(F.col(c), F.lit(None).cast("double")).alias(c) for c in STREAMED])
    want = ft.build_features(telemetry, time_series(telemetry, ["segment_id"]), STREAMED).select("segment_id", "seq", *STREAMED)
    close(rows(got, "segment_id", "seq"), rows(want, "segment_id", "seq"), 1e-8)


@pytest.mark.parametrize("mode", ["persistence", "confirmation"])
def test_alerts_equal_batch(spark, telemetry, mode):
    scores = telemetry.select(F.lit("m").alias("model_name"), "segment_id", "timestamp", "seq", (F.col("flow_rate") / 100).alias("leak_score"))
    policy = AlertPolicy(threshold=0.4, mode=mode)
    stream = stream_table(scores, delay="1 hour")
    got = drain(stream_alerts(stream, policy=policy), temp() + "/o", temp()).where("seq >= 0")
    want = apply_policy(scores, time_series(scores, ["model_name", "segment_id"]), policy)
    assert rows(got.select("seq", "model_alert")) == rows(want.select("seq", "model_alert"))
    assert got.where("model_alert and not pinned").count() == 0
    assert got.where("pinned").count() > got.where("model_alert").count()


def small(spark, folder, *batches):
    for b in batches:
        df = spark.createDataFrame([(s, dt.datetime(2026, 1, 1) + dt.timedelta(minutes=m), i, v) for s, m, i, v in b],
                                   "segment_id int, timestamp timestamp, seq long, leak_score double")
        df.coalesce(1).write.mode("append").parquet(folder)
    return df.schema


def test_rows_out_of_order_within_the_delay(spark):
    folder = temp() + "/in"
    # minute 2 arrives after minute 3: in order there are three highs in a row at minute 3
    schema = small(spark, folder, [(1, 0, 0, 0.1), (1, 1, 1, 0.9), (1, 3, 3, 0.9)], [(1, 2, 2, 0.9), (1, 4, 4, 0.1)], [(1, 5000, 9, 0.0)])
    stream = stream_files(spark, folder, schema, delay="10 minutes").withColumn("model_name", F.lit("m"))
    got = drain(stream_alerts(stream), temp() + "/o", temp())
    assert rows(got.where("seq < 9").select("seq", "model_alert")) == [(0, False), (1, False), (2, False), (3, True), (4, False)]


def test_late_rows_are_dropped_and_counted(spark):
    # a batch judges lateness by the watermark the batch before it ran with
    folder = temp() + "/in"
    schema = small(spark, folder, [(1, 0, 0, 1.0)], [(1, 600, 1, 1.0)], [(1, 601, 2, 1.0)], [(1, 1, 3, 1.0), (1, 602, 4, 1.0)], [(1, 5000, 5, 1.0)])
    stream = stream_files(spark, folder, schema, delay="10 minutes").withColumn("pressure", F.col("leak_score"))
    out = temp() + "/o"
    q = write_stream(sw.tumbling(stream, "1 minute"), out, temp())
    finish(q)
    assert late_rows(q) == 1
    assert spark.read.parquet(out).agg(F.sum("n")).first()[0] == 4  # the last window stays open


def test_sessions_and_sliding_windows(spark):
    folder = temp() + "/in"
    schema = small(spark, folder, [(1, 0, 0, 1.0), (1, 5, 1, 3.0), (1, 100, 2, 2.0)], [(1, 5000, 3, 0.0)])
    stream = stream_files(spark, folder, schema, delay="1 minute").withColumn("pressure", F.col("leak_score"))
    got = drain(sw.sessions(stream, "30 minutes"), temp() + "/o", temp())
    assert rows(got.select("n", "max_pressure")) == [(1, 2.0), (2, 3.0)]
    slid = drain(sw.tumbling(stream, "10 minutes", "5 minutes"), temp() + "/o", temp())
    assert slid.agg(F.sum("n")).first()[0] == 6


def test_scoring_sink_is_repeatable(spark):
    path = temp() + "/scored"
    sink = sw.score_batches(lambda b: b.withColumn("leak_score", F.col("v") * 1.0), path, ["segment_id", "timestamp"])
    t0 = dt.datetime(2026, 1, 1)
    one = spark.createDataFrame([(1, t0, 0, 1), (1, t0, 1, 2)], "segment_id int, timestamp timestamp, seq long, v int")
    two = spark.createDataFrame([(1, t0, 5, 9), (2, t0, 6, 3)], one.schema)
    sink(one, 0)
    for _ in range(2):
        sink(two, 1)
    assert rows(spark.read.parquet(path).select("segment_id", "seq", "leak_score")) == [(1, 1, 2.0), (2, 6, 3.0)]


def test_retention(spark, telemetry):
    kept = sw.retain(telemetry, 7).groupBy("segment_id").count()
    assert {r["count"] for r in kept.collect()} == {7}


def stepwise(spark, df, folder, batches, result):
    """Run a stream over one file a batch; yields the state rows after each."""
    out, state = temp() + "/o", temp()
    for b in batches:
        small(spark, folder, b)
        q = write_stream(df, out, state)
        finish(q)
        result.append([int(op["numRowsTotal"]) for p in q.recentProgress for op in p["stateOperators"]][-1])
    return spark.read.schema(df.schema).parquet(out)


def test_an_idle_key_leaves_the_state_and_comes_back_fresh(spark):
    folder, held = temp() + "/in", []
    high = 0.9
    batches = [[(1, 0, 1, high), (1, 1, 2, high), (2, 1, 3, high)], [(2, 30, 4, high)], [(2, 200, 5, high)], [(2, 260, 6, high)],
               [(1, 270, 7, high), (2, 271, 8, high)], [(2, 600, 9, high)]]
    schema = small(spark, folder, batches[0][:0] or [(3, 0, 0, 0.0)])
    rows_ = stream_files(spark, folder, schema, delay="10 minutes")
    alerts = stream_alerts(rows_, keys=["segment_id"], policy=AlertPolicy(threshold=0.5, persistence=3), idle=3600)
    got = stepwise(spark, alerts, folder, batches, held)
    fired = {r["seq"]: r["model_alert"] for r in got.collect()}
    # two of three high readings were forgotten with the key, so the third does not fire; key 2 was never idle for an hour of its own
    assert fired[7] is False and 8 in fired
    assert min(held[3:]) < max(held[:3])  # keys 1 and 3 have left the store
    plain = stream_alerts(stream_files(spark, folder, schema, delay="10 minutes"), keys=["segment_id"], policy=AlertPolicy(threshold=0.5, persistence=3))
    kept = {r["seq"]: r["model_alert"] for r in drain(plain, temp() + "/o", temp()).collect()}
    assert kept[7] is True  # without an idle time the earlier readings count


def test_retention_on_a_stream_names_the_row_that_leaves(spark):
    folder = temp() + "/in"
    first = [(s, m, 10 * s + m, float(m)) for s in (1, 2) for m in range(3)]
    later = [(1, m, 10 + m, float(m)) for m in range(3, 7)] + [(2, 400, 90, 0.0), (1, 500, 91, 0.0), (2, 500, 92, 0.0)]
    schema = small(spark, folder, first, later)
    rows_ = stream_files(spark, folder, schema, delay="1 minute")
    out = drain(sw.retain_stream(rows_, keep=3, values=["leak_score"]), temp() + "/o", temp()).where("seq < 91")
    gone = {r["seq"]: r["gone_seq"] for r in out.collect()}
    assert gone == {10: None, 11: None, 12: None, 13: 10, 14: 11, 15: 12, 16: 13, 20: None, 21: None, 22: None, 90: 20}
    live = set(gone) - set(gone.values())
    want = {r["seq"] for r in sw.retain(out.withColumn("x", F.lit(1)), 3).collect()}
    assert live == want


def test_a_null_key_streams_like_any_other(spark):
    folder = temp() + "/in"
    schema = small(spark, folder, [(None, 0, 1, 0.9), (None, 1, 2, 0.9), (4, 1, 3, 0.9)], [(None, 300, 4, 0.1), (4, 300, 5, 0.1)], [(4, 900, 6, 0.1)])
    out = drain(stream_alerts(stream_files(spark, folder, schema, delay="1 minute"), keys=["segment_id"], policy=AlertPolicy(persistence=2)), temp() + "/o", temp())
    assert {r["seq"]: r["model_alert"] for r in out.collect() if r["seq"] < 4} == {1: False, 2: True, 3: False}


def test_steps_are_read_by_offset_and_again(spark):
    reader = StepReader(0, 6, 3)
    seen, at = [], reader.initialOffset()
    for _ in range(4):
        rows_, end = reader.read(at)
        got = list(rows_)
        assert got == list(reader.readBetweenOffsets(at, end))
        seen, at = seen + got, end
    assert seen == [(k,) for k in range(7)]


def test_a_stored_table_streams_step_by_step_and_goes_on_where_it_stopped(spark, telemetry):
    out, state = temp() + "/o", temp()
    stream = stream_table(telemetry, steps=4, close=False)
    q = finish(write_stream(stream, out, state))
    counts = [p["numInputRows"] for p in q.recentProgress if p["numInputRows"]]
    assert len(counts) >= 4
    got = spark.read.schema(stream.schema).parquet(out)
    assert rows(got.select("seq")) == rows(telemetry.select("seq"))
    finish(write_stream(stream_table(telemetry, steps=4, close=False), out, state))
    assert spark.read.schema(stream.schema).parquet(out).count() == telemetry.count()
    closed = drain(stream_table(telemetry.limit(0), steps=2), temp() + "/o", temp())
    assert [r["seq"] for r in closed.collect()] == [-1]
