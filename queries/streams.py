"""Streaming queries: a source steps through the stored event table; a closing row moves the watermark past all others."""

from __future__ import annotations

from pyspark.sql import functions as F

from telemill.functions import r6
from telemill.operators.alerts import AlertPolicy
from telemill.sources import views
from telemill.streaming import windows as sw
from telemill.streaming.alerts import stream_alerts
from telemill.streaming.features import STREAMED, stream_features, stream_segment_deviation
from telemill.streaming.source import drain, finish, stream_table

from .evaluation import _ABOVE, policy_cte
from .features import EMA_SQL, FEATURE_SQL, deltas, ema
from .registry import SCORES, TELEMETRY, query, r
from .sources import scratch

def streamed(spark, df, close=True):
    """The table as a stream; the closing row has ``seq`` -1."""
    return stream_table(df, steps=4, delay="1 hour", close=close)


@query("stream_alerts", "P4 S12", f"WITH RECURSIVE {SCORES}, {_ABOVE}, {policy_cte('ab')} SELECT model_name, seq, alert AS model_alert FROM fired")
def stream_alert_rows(spark, folder):
    s = views.scores(spark, folder).select("model_name", "segment_id", "timestamp", "seq", "leak_score")
    out = stream_alerts(streamed(spark, s), policy=AlertPolicy(threshold=0.4))
    done = drain(out, scratch(spark) + "/out", scratch(spark))
    return done.where(F.col("seq") >= 0).select("model_name", "seq", "model_alert")


_STREAM_CHECK = [c for c in STREAMED if not c.endswith(("_z", "ema_dev"))]


@query("stream_features", "P5", f"""
WITH {TELEMETRY}, {deltas()} SELECT segment_id, seq, {', '.join(r(FEATURE_SQL[c], c, 5) for c in _STREAM_CHECK)} FROM d""")
def stream_feature_rows(spark, folder):
    t = views.telemetry(spark, folder).select("segment_id", "timestamp", "seq", "pressure", "flow_rate")
    out = stream_features(streamed(spark, t))
    done = drain(out, scratch(spark) + "/out", scratch(spark))
    return done.where(F.col("seq") >= 0).select("segment_id", "seq", *[r6(c, 5).alias(c) for c in _STREAM_CHECK])


@query("stream_features_whole", "P5 W15 W6", f"""
WITH RECURSIVE {TELEMETRY}, {deltas()}, {ema()}
SELECT segment_id, seq, {', '.join(r((FEATURE_SQL | EMA_SQL)[c], c, 5) for c in STREAMED)} FROM d JOIN e USING (segment_id, rn)""")
def stream_features_whole(spark, folder):
    """Every streamed feature, the z-scores and exponential means included."""
    t = views.telemetry(spark, folder).select("segment_id", "timestamp", "seq", "pressure", "flow_rate")
    out = stream_features(streamed(spark, t))
    done = drain(out, scratch(spark) + "/out", scratch(spark))
    return done.where(F.col("seq") >= 0).select("segment_id", "seq", *[r6(c, 5).alias(c) for c in STREAMED])


@query("stream_segment_deviation", "P12 W9", f"""
WITH {TELEMETRY}, m AS (SELECT tick, avg(pressure) AS mp, avg(flow_rate) AS mf FROM telemetry GROUP BY tick)
SELECT segment_id, seq, {r('pressure - mp', 'pressure_segment_deviation')}, {r('flow_rate - mf', 'flow_segment_deviation')} FROM telemetry JOIN m USING (tick)""")
def stream_deviation_rows(spark, folder):
    t = views.telemetry(spark, folder).select("segment_id", "timestamp", "seq", "pressure", "flow_rate")
    out = stream_segment_deviation(streamed(spark, t))
    done = drain(out, scratch(spark) + "/out", scratch(spark))
    return done.where(F.col("seq") >= 0).select("segment_id", "seq", r6("pressure_segment_deviation").alias("pressure_segment_deviation"),
                                                r6("flow_segment_deviation").alias("flow_segment_deviation"))


@query("stream_tumbling_windows", "P11 P10", """
SELECT user_id AS segment_id, strftime(time_bucket(INTERVAL 6 HOUR, ts), '%Y-%m-%d %H') AS start, count(*) AS n, round(avg(value) + 1e-9, 6) + 0.0 AS mean_pressure FROM events GROUP BY ALL""")
def stream_tumbling(spark, folder):
    t = views.telemetry(spark, folder).select("segment_id", "timestamp", "seq", "pressure")
    done = drain(sw.tumbling(streamed(spark, t), "6 hours"), scratch(spark) + "/out", scratch(spark))
    return done.where(F.col("start") < F.lit("2099-01-01").cast("timestamp")).select(
        "segment_id", F.date_format("start", "yyyy-MM-dd HH").alias("start"), "n", r6("mean_pressure").alias("mean_pressure"))


@query("stream_deduplicated", "P7", f"WITH {TELEMETRY} SELECT seq, segment_id, pressure FROM telemetry")
def stream_deduplicated(spark, folder):
    t = views.telemetry(spark, folder).select("segment_id", "timestamp", "seq", "pressure")
    rows = streamed(spark, t.union(t), close=False)
    done = drain(sw.first_arrivals(rows, ["seq"]), scratch(spark) + "/out", scratch(spark))
    return done.select("seq", "segment_id", "pressure")


@query("stream_retained", "P8", f"""
WITH {TELEMETRY}, n AS (SELECT segment_id, seq, row_number() OVER (PARTITION BY segment_id ORDER BY timestamp, seq) AS rn FROM telemetry)
SELECT a.segment_id, a.seq, b.seq AS gone_seq FROM n a LEFT JOIN n b ON a.segment_id = b.segment_id AND b.rn = a.rn - 20""")
def stream_retained(spark, folder):
    """Each reading as it arrives in order, with the one that leaves the newest twenty of its segment."""
    t = views.telemetry(spark, folder).select("segment_id", "timestamp", "seq", "pressure")
    done = drain(sw.retain_stream(streamed(spark, t), keep=20), scratch(spark) + "/out", scratch(spark))
    return done.where(F.col("seq") >= 0).select("segment_id", "seq", "gone_seq")


@query("stream_incremental_scores", "P6 P8", f"WITH {TELEMETRY} SELECT seq, segment_id, {r('pressure / 200.0', 'leak_score')} FROM telemetry")
def stream_incremental_scores(spark, folder):
    t = views.telemetry(spark, folder).select("segment_id", "timestamp", "seq", "pressure")
    rows = streamed(spark, t.union(t), close=False)
    path = scratch(spark) + "/scored"
    sink = sw.score_batches(lambda b: b.withColumn("leak_score", F.col("pressure") / 200.0), path, ["segment_id", "timestamp"])
    finish(rows.writeStream.foreachBatch(sink).option("checkpointLocation", scratch(spark)).start())
    return spark.read.parquet(path).select("seq", "segment_id", r6("leak_score").alias("leak_score"))
