import datetime as dt

import pytest
from pyspark.sql import functions as F

from telemill import functions as fn
from telemill.operators import cleaning as cl
from telemill.operators import features as ft
from telemill.operators.labels import benchmark_label, dense_codes, segment_codes
from telemill.operators.series import Series, time_series
from telemill.operators.wide import wide_features
from telemill.schema import REQUIRED_COLUMNS, numeric_columns, require_columns, resolve_target

from .conftest import rows


def full_row(spark, n=1, **over):
    base = dict(timestamp="2026-01-01 00:00:00", segment_id=1, pressure=70.0, flow_rate=3.0, temperature=20.0, valve_status=1,
                pump_state=1, pump_speed=0.0, compressor_state=1, energy_consumption=0.0, alarm_triggered=0, event_type="normal", target=0)
    return spark.createDataFrame([{**base, **over}] * n)


def test_required_columns(spark):
    with pytest.raises(ValueError, match="Missing required columns"):
        require_columns(spark.createDataFrame([], "timestamp timestamp, pressure double"))
    df = full_row(spark)
    assert require_columns(df) is df


def test_duplicates_and_bad_rows_go(spark):
    df = full_row(spark, 2).union(full_row(spark, timestamp="garbage")).union(full_row(spark, pressure=float("nan")))
    out = cl.load_and_clean(df)
    assert out.count() == 1
    assert out.schema["timestamp"].dataType.simpleString() == "timestamp"


def test_first_alias_wins_and_originals_stay(spark):
    df = spark.createDataFrame([(1.0, 2.0, 5.0)], "`Pressure (bar)` double, `Flow Rate (L/s)` double, temperature double")
    out = cl.map_columns(df, {"pressure": ["p", "Pressure (bar)", "Flow Rate (L/s)"], "flow_rate": "Flow Rate (L/s)", "temperature": "Pressure (bar)"})
    assert out.columns == df.columns + ["pressure", "flow_rate"]
    assert rows(out)[0] == (1.0, 2.0, 5.0, 1.0, 2.0)


def test_training_frame(spark):
    df = spark.createDataFrame([("2026-01-01 00:00:00", "b", 1.0, 2.0, None, 0), ("2026-01-01 00:01:00", "a", 1.5, 2.5, 21.0, 1)],
                               "timestamp string, sensor_id string, pressure double, flow_rate double, temperature double, leak_label int")
    out = cl.training_frame(df, "src")
    assert out.columns == REQUIRED_COLUMNS + ["source_dataset"]
    got = out.orderBy("timestamp").collect()
    assert [r.target for r in got] == [0, 1] and [r.segment_id for r in got] == [2, 1]
    assert [r.temperature for r in got] == [21.0, 21.0] and [r.event_type for r in got] == ["normal", "leak"]
    assert cl.training_frame(df.drop("pressure"), "src").count() == 0
    assert cl.training_frame(df.drop("leak_label"), "src").columns == REQUIRED_COLUMNS + ["source_dataset"]


def test_backfill(spark):
    df = spark.createDataFrame([("2026-01-01", "s", 1.0, 2.0, 20.0, "0"), ("2026-01-02", "s", 1.0, 2.0, 20.0, "leak")],
                               "timestamp string, scenario_id string, pressure double, flow_rate double, temperature double, target string")
    out = cl.adopt_export(df, "x").orderBy("timestamp").collect()
    assert [r.event_type for r in out] == ["normal", "leak"] and {r.segment_id for r in out} == {1}
    assert {(r.valve_status, r.pump_speed, r.alarm_triggered, r.source_dataset) for r in out} == {(1, 0.0, 0, "x")}


def test_event_class(spark):
    df = spark.createDataFrame([(0, "0"), (1, "3"), (2, "101"), (3, "109"), (4, None), (5, "x"), (6, "57"), (7, "110"), (8, "4.0")], "i int, c string")
    assert [r[1] for r in rows(df.select("i", fn.event_class("c").alias("c")))] == [0, 3, 1, 9, 0, 0, 57, 110, 4]
    out = cl.label_events(df, "c")
    assert [(r.target, r.event_type) for r in out.orderBy("i").collect()][:3] == [(0, "NORMAL"), (1, "SEVERE_SLUGGING"), (1, "ABRUPT_INCREASE_OF_BSW")]
    assert out.where("event_class = 57").first().event_type == "UNKNOWN"
    assert cl.label_events(df, "c", strict=True).count() == 8


def test_sentinels(spark):
    df = spark.createDataFrame([(0, -1.18e42, -1.71e38, float("inf")), (1, 2e7, 60.0, 0.5)], "i int, P_inlet double, T_inlet double, Q_inlet double")
    assert rows(cl.bound_sensors(df), "i") == [(0, None, None, None), (1, 2e7, 60.0, 0.5)]
    assert cl.drop_silent_rows(cl.bound_sensors(df)).count() == 1


def test_ratios_stay_finite(spark):
    df = spark.createDataFrame([("s", i, 5e6, 4e6, p, 1.0, q, 50.0, 45.0, 40.0, 0) for i, (p, q) in enumerate([(0.0, 0.0), (1e-12, 1e-12), (1.0, 1.0)])],
                               "scenario_id string, seq int, P_inlet double, P_mid double, P_outlet double, Q_inlet double, Q_outlet double, T_inlet double, T_mid double, T_outlet double, target int")
    out = wide_features(df, Series(("scenario_id",), ("seq",))).collect()
    for r in out:
        assert abs(r.P_ratio_in_out) <= 1000 and abs(r.Q_ratio) <= 1000
        assert r.P_inlet_rolling_mean_5 == 0.0  # fewer rows than the window


def test_feature_values(spark):
    p = [70.0, 69.5, 69.0, 68.0, 68.5, 67.0]
    start = dt.datetime(2026, 1, 1)
    df = spark.createDataFrame([(start + dt.timedelta(minutes=i), i, 1, v, 3.0 - i * 0.1, "normal") for i, v in enumerate(p)],
                               "timestamp timestamp, seq long, segment_id int, pressure double, flow_rate double, event_type string")
    out = ft.build_features(df, time_series(df, ["segment_id"]), encode_events=True).orderBy("seq").toPandas()
    assert len(out) == 6 and set(ft.FEATURES) <= set(out.columns)
    assert out.pressure_delta.tolist() == [0.0, -0.5, -0.5, -1.0, 0.5, -1.5]
    assert set(out.event_type_encoded) == {0}
    assert abs(out.pressure_roll_mean.iloc[4] - sum(p[:5]) / 5) < 1e-12
    assert out.pressure_roll_std.iloc[0] == 0.0
    assert abs(out.pressure_cusum_neg30.iloc[5] + 3.5) < 1e-12
    assert out.pressure_segment_deviation.abs().max() == 0.0


def test_minimal_and_fast_subsets(spark, data):
    from telemill.sources import views

    t = views.telemetry(spark, data)
    s = time_series(t, ["segment_id"])
    assert len(ft.FEATURES) == 31 and (len(ft.MINIMAL_FEATURES), len(ft.FAST_FEATURES)) == (7, 17)
    for wanted in (ft.MINIMAL_FEATURES, ft.FAST_FEATURES, ["pressure_roll_z"]):
        out = ft.build_features(t, s, wanted)
        assert set(out.columns) - set(t.columns) == set(wanted)


def test_codes(spark):
    df = spark.createDataFrame([(0, "b"), (1, None), (2, "a"), (3, "b")], "i int, l string")
    assert [r[1] for r in rows(segment_codes(df, "l", "seg").select("i", "seg"))] == [2, 3, 1, 2]
    assert {r[1] for r in rows(segment_codes(df, None, "seg").select("i", "seg"))} == {1}
    assert rows(dense_codes(df, "l")) == [("a", 0), ("b", 1)]
    many = spark.range(1000).select(F.format_string("%05d", (F.col("id") * 7) % 1000).alias("l")).repartition(6)
    assert rows(dense_codes(many, "l")) == [("%05d" % k, k) for k in range(1000)]


def test_binary_label_keeps_larger_values(spark):
    df = spark.createDataFrame([(2.7,), (-1.0,), (None,), (1.0,)], "v double")
    assert sorted(r[0] for r in df.select(fn.binary_label("v", "double")).collect()) == [0, 0, 1, 2]


def test_benchmark_label_without_known_words(spark):
    df = spark.createDataFrame([("2",), ("0",), ("what",)], "v string")
    out = benchmark_label(df, "v", "y", fn.BENCHMARK_POSITIVE_TEXTS)
    assert rows(out) == [("0", 0), ("2", 1), ("what", 0)]


def test_targets_and_numeric_columns(spark):
    df = spark.createDataFrame([(1, 2.0, "x", 0)], "target int, pressure double, s string, leak_label int")
    assert resolve_target(df, "s") == "s" and resolve_target(df, "nope") == "target"
    assert resolve_target(df.drop("target")) == "leak_label" and resolve_target(df.select("s")) is None
    assert numeric_columns(df) == ["pressure", "leak_label"]


def test_reindex(spark):
    df = spark.createDataFrame([(1.0, 2.0, 3.0)], "a double, b double, c double")
    out = cl.reindex(df, ["c", "z", "a"])
    assert out.columns == ["c", "z", "a"] and rows(out) == [(3.0, 0.0, 1.0)]


def test_tags(spark):
    df = spark.createDataFrame([(0, "nominal"), (1, ""), (2, "a|b"), (3, "leak"), (4, None)], "i int, c string")
    assert [r[1] for r in rows(df.select("i", fn.add_tag(F.col("c"), F.lit("leak")).alias("t")))] == ["leak", "leak", "a|b|leak", "leak", "leak"]


def test_derived_sensors_only_where_absent(spark):
    df = spark.createDataFrame([(1, 100.0, 10.0, 50.0), (0, 100.0, 10.0, 50.0)], "target int, P_mid double, Q_inlet double, T_inlet double")
    out = cl.derive_sensors(df).orderBy("target").collect()
    assert [r.Q_outlet for r in out] == [9.8, 8.5] and out[0].P_outlet == 85.0 and out[0].T_outlet == 45.0
    kept = cl.derive_sensors(df.withColumn("P_outlet", F.lit(None).cast("double")))
    assert kept.first().P_outlet is None


def test_float32_matrix(spark):
    df = spark.createDataFrame([("s", 0, None), ("s", 1, 5e9), ("s", 2, None), ("t", 0, None)], "k string, seq int, x double")
    out = cl.model_matrix(df, Series(("k",), ("seq",)), ["x"])
    assert rows(out) == [("s", 0, 1e9), ("s", 1, 1e9), ("s", 2, 1e9), ("t", 0, 0.0)]
    assert out.schema["x"].dataType.simpleString() == "float"
