"""Cutting long keys must not change results."""

import pytest
from pyspark.sql import functions as F

from telemill.operators import features as ft
from telemill.operators import runs as rn
from telemill.operators import wide as wd
from telemill.operators.alerts import AlertPolicy, apply_policy
from telemill.operators.cleaning import bound_sensors, every_nth, fill_along
from telemill.operators.joins import gap_conflicts
from telemill.operators.metrics import roc_auc
from telemill.operators.quantiles import exact_quantiles
from telemill.operators.series import Series, cut_series, frames, scan, time_series, value_series
from telemill.sources import views

from .conftest import close, rows


def pair(df, keys, **kw):
    """The same series uncut and cut into many slots."""
    plain = time_series(df, keys, **kw)
    cut = time_series(df, keys, max_rows=7, **kw)
    assert plain.slot is None and cut.slot is not None
    return plain, cut


@pytest.fixture(scope="module")
def telemetry(spark, data):
    t = views.telemetry(spark, data)
    # one segment holds most rows; a few gaps
    t = t.withColumns({
        "segment_id": F.when(F.col("segment_id") % 3 > 0, 1).otherwise(F.col("segment_id")),
        "pressure": F.when(F.col("seq") % 17 != 0, F.col("pressure"))})
    return t.cache()


def test_scan_same_with_slots(telemetry):
    plain, cut = pair(telemetry, ["segment_id"])
    args = dict(position="pos", sums={"total": F.col("flow_rate")}, maxima={"top": F.col("pressure")},
                previous={"before": F.col("pressure")}, last_valid={"lv": F.col("pressure")}, next_valid={"nv": F.col("pressure")})
    cols = ["segment_id", "seq", "pos", "total", "top", "before", "lv", "nv"]
    close(rows(scan(telemetry, plain, **args).select(*cols)), rows(scan(telemetry, cut, **args).select(*cols)))


def test_scan_without_keys(telemetry):
    whole = Series((), ("timestamp", "seq"))
    cut = Series((), ("timestamp", "seq"), F.floor(F.unix_timestamp("timestamp") / 86400))
    args = dict(position="pos", sums={"total": F.col("flow_rate")})
    close(rows(scan(telemetry, whole, **args).select("seq", "pos", "total")),
          rows(scan(telemetry, cut, **args).select("seq", "pos", "total")))


def test_features_same_with_blocks(telemetry):
    plain, cut = pair(telemetry, ["segment_id"])
    wanted = [c for c in ft.FEATURES if c not in ft.EMA]
    a = ft.build_features(telemetry, plain, wanted, tick="tick").select("segment_id", "seq", *wanted)
    b = ft.build_features(telemetry, cut, wanted, tick="tick", block=97).select("segment_id", "seq", *wanted)
    assert a.count() == telemetry.count()
    close(rows(a, "segment_id", "seq"), rows(b, "segment_id", "seq"))


def test_exponential_mean_same_with_blocks(telemetry):
    plain, cut = pair(telemetry, ["segment_id"])
    a = ft.build_features(telemetry, plain, ft.EMA).select("seq", *ft.EMA)
    b = ft.build_features(telemetry, cut, ft.EMA, block=600).select("seq", *ft.EMA)
    close(rows(a, "seq"), rows(b, "seq"))


def test_exponential_mean_matches_pandas_over_many_rows(spark):
    df = spark.range(20000).select(
        F.lit(1).alias("segment_id"), F.col("id").alias("seq"), F.timestamp_seconds(F.col("id") * 60).alias("timestamp"),
        (F.sin(F.col("id") / 50.0) * 10 + 70 + F.pmod(F.xxhash64("id"), F.lit(100)) / 50.0).alias("pressure"),
        F.when(F.col("id") % 13 != 0, F.cos(F.col("id") / 30.0)).alias("flow_rate"))
    got = ft.build_features(df, time_series(df, ["segment_id"]), ft.EMA).orderBy("seq").toPandas()
    for c, out in (("pressure", "pressure_ema_dev"), ("flow_rate", "flow_ema_dev")):
        want = got[c] - got[c].ewm(span=20, min_periods=1).mean()
        assert (got[out] - want).abs().max() < 1e-9
        assert got[out].isna().sum() == got[c].isna().sum()


def test_generic_and_wide_features_same_with_blocks(spark, telemetry, data):
    plain, cut = pair(telemetry, ["segment_id"])
    a, b = (ft.sensor_features(telemetry, s).drop("timestamp", "tick") for s in (plain, cut))
    close(rows(a.select(sorted(a.columns)), "seq"), rows(b.select(sorted(a.columns)), "seq"))
    w = bound_sensors(views.wide(spark, data))
    plain, cut = pair(w, ["scenario_id"], tiebreak=views.SHIPMENT_ORDER)
    key = ["scenario_id", "timestamp", *views.SHIPMENT_ORDER]
    names = wd.wide_feature_names()
    assert len(names) == 27
    close(rows(wd.wide_features(w, plain).select(*key, *names), *key), rows(wd.wide_features(w, cut).select(*key, *names), *key))
    close(rows(every_nth(w, plain, 10).select(*key)), rows(every_nth(w, cut, 10).select(*key)))
    close(rows(fill_along(w, plain, ["P_mid"]).select(*key, "P_mid"), *key), rows(fill_along(w, cut, ["P_mid"]).select(*key, "P_mid"), *key))


def test_runs_same_with_slots(telemetry):
    plain, cut = pair(telemetry, ["segment_id"])
    for make in (lambda s: rn.leak_events(telemetry, s), lambda s: rn.stale_rate(telemetry, s, ["flow_rate"]),
                 lambda s: rn.drop_warmup(telemetry, s).select("seq"), lambda s: rn.resample_linear(telemetry, s, "flow_rate", 10),
                 lambda s: ft.smooth(telemetry, s, {"y": "flow_rate"}, 10.0, 30.0).select("seq", "y")):
        close(rows(make(plain)), rows(make(cut)))


@pytest.mark.parametrize("mode", ["persistence", "confirmation"])
def test_alerts_same_with_slots(telemetry, mode):
    scored = telemetry.withColumn("leak_score", F.col("flow_rate") / 100.0)
    plain, cut = pair(scored, ["segment_id"])
    policy = AlertPolicy(threshold=0.4, mode=mode)
    a, b = (rows(apply_policy(scored, s, policy).select("seq", "model_alert")) for s in (plain, cut))
    assert a == b and any(r[1] for r in a)


def test_gap_conflicts_against_all_pairs(spark, data):
    i = views.incidents(spark, data)
    plain, cut = pair(i, ["segment_id"], time="start_ts", tiebreak=["event_id"])
    a, b = (rows(gap_conflicts(i, s, "start_ts", "end_ts", 43200).select("event_id", "conflict")) for s in (plain, cut))
    assert a == b
    events = [r.asDict() for r in i.collect()]
    brute = []
    for e in events:
        earlier = [o for o in events if o["segment_id"] == e["segment_id"] and (o["start_ts"], o["event_id"]) < (e["start_ts"], e["event_id"])]
        brute.append((e["event_id"], any((e["start_ts"] - o["end_ts"]).total_seconds() < 43200 for o in earlier)))
    assert sorted(brute) == a


def test_quantiles_and_auc_same_with_slots(spark, data):
    s = views.scores(spark, data)
    probs = {"p10": 0.1, "p50": 0.5, "p95": 0.95}
    a = [rows(exact_quantiles(s, ["model_name"], "leak_score", probs)), rows(roc_auc(s, "leak_score", "target", ["model_name"]))]
    spark.conf.set("telemill.series.maxRowsPerTask", "20")
    try:
        counts = s.groupBy("model_name", "leak_score").count()
        assert value_series(counts, ["model_name"], "leak_score").slot is not None
        b = [rows(exact_quantiles(s, ["model_name"], "leak_score", probs)), rows(roc_auc(s, "leak_score", "target", ["model_name"]))]
    finally:
        spark.conf.unset("telemill.series.maxRowsPerTask")
    for x, y in zip(a, b):
        close(x, y)
    got = s.where("model_name = 'a'").toPandas()["leak_score"].quantile([0.1, 0.5, 0.95]).tolist()
    close([a[0][0]], [("a", *got)])


def ordered_rows(spark):
    """Keys of 700, 350 and 5 rows, one of them NULL; half of the first lies at one time, and some times are NULL."""
    made = [("a", 50 if i % 2 else i, i) for i in range(700)]
    made += [(None, None if i % 10 == 0 else i % 7, i) for i in range(350)] + [("few", i, i) for i in range(5)]
    return spark.createDataFrame(made, "k string, t int, seq long").withColumn("timestamp", F.timestamp_seconds("t"))


@pytest.mark.parametrize("fan", [3, 1024])
def test_slots_follow_the_order_and_split_bursts(spark, fan):
    df = ordered_rows(spark)
    series = cut_series(df, Series(("k",), ("timestamp", "seq")), df, 20, fan)
    assert len(series.cuts) == (4 if fan == 3 else 1)
    found = series.slotted(df)
    assert found.columns == [*df.columns, "_slot"]
    by_key = {}
    for r in found.collect():
        by_key.setdefault(r["k"], []).append(((r["t"] is not None, r["t"] or 0, r["seq"]), r["_slot"]))
    for k, n in (("a", 700), (None, 350), ("few", 5)):
        slots = [s for _, s in sorted(by_key[k])]
        assert len(slots) == n and slots == sorted(slots)
        # every tenth row in order is a mark; it opens the next slot
        assert slots == [(i + 1) // 10 if n > 20 else 0 for i in range(n)]


def test_scans_same_with_a_deep_tree_of_marks(spark):
    df = ordered_rows(spark)
    plain = Series(("k",), ("timestamp", "seq"))
    args = dict(position="n", sums={"s": F.col("t")}, previous={"p": F.col("seq")}, last_valid={"l": F.col("t")})
    found = [sorted(map(tuple, scan(df, s, **args).select("k", "seq", "n", "s", "p", "l").collect()), key=repr)
             for s in (plain, cut_series(df, plain, df, 20, 3))]
    assert found[0] == found[1] and len(found[0]) == 1055


def test_sampled_marks_give_even_slots_without_keys(spark):
    df = spark.range(60_000).select((F.col("id") % 11).alias("t"), F.col("id").alias("seq"))
    series = cut_series(df, Series((), ("t", "seq")), df, 4000)
    sizes = [r["count"] for r in series.slotted(df).groupBy("_slot").count().collect()]
    assert sum(sizes) == 60_000 and len(sizes) > 20 and max(sizes) <= 4000


def test_halo_must_fit(telemetry):
    with pytest.raises(ValueError):
        frames(telemetry, time_series(telemetry, ["segment_id"], max_rows=7), halo=90, block=50)


def test_one_exchange_by_segment(telemetry, spark, data):
    t = views.telemetry(spark, data)
    out = ft.build_features(t, time_series(t, ["segment_id"]), [c for c in ft.FEATURES if c not in ft.CROSS_SEGMENT])
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_fills_stay_linear_and_keys_may_be_null(spark):
    rows = [(k, t, float(t) if t % 3 == 0 else None) for k in ("a", None) for t in range(40)]
    df = spark.createDataFrame(rows, "k string, t long, x double").withColumn("timestamp", F.timestamp_seconds(F.col("t") * 60))
    plain, cut = (time_series(df, ["k"], tiebreak=["t"], max_rows=m) for m in (1000, 7))
    assert plain.slot is None and cut.slot is not None
    found = [
        sorted(map(tuple, scan(df, s, position="n", sums={"s": F.col("t")}, last_valid={"b": F.col("x")}, next_valid={"a": F.col("x")})
                   .select("k", "t", "n", "s", "b", "a").collect()), key=repr) for s in (plain, cut)]
    assert found[0] == found[1] and len(found[0]) == 80


def test_dense_and_sparse_keys_both_fall_into_slots(spark):
    dense = spark.range(900).select(F.lit("dense").alias("k"), F.col("id").alias("t"))
    sparse = spark.range(1000).select(F.lit("sparse").alias("k"), (F.col("id") * 1000).alias("t"))
    df = dense.unionByName(sparse).withColumn("timestamp", F.timestamp_seconds("t"))
    series = time_series(df, ["k"], tiebreak=["t"], max_rows=100)
    sizes = series.slotted(df).groupBy("k", "_slot").count()
    assert sizes.agg(F.max("count")).first()[0] <= 100
