import datetime as dt
import tempfile

import pytest
from pyspark.sql import functions as F

from telemill.operators import cleaning as cl
from telemill.operators import joins as jn
from telemill.operators import profile as pf
from telemill.operators import runs as rn
from telemill.operators.series import Series
from telemill.sources import readers, sinks

from .conftest import rows


@pytest.fixture
def folder():
    return tempfile.mkdtemp(prefix="spark-", dir="/tmp")


def test_missing_and_unsupported_files(spark, folder):
    with pytest.raises(FileNotFoundError):
        readers.read_csv(spark, folder + "/nope.csv")
    with pytest.raises(ValueError):
        readers.read_table(spark, folder + "/x.xlsx")


def test_formats_and_preview(spark, folder):
    df = spark.range(10).withColumn("v", F.col("id") * 1.5)
    assert readers.read_table(spark, sinks.write_parquet(df, folder, "t"), rows=3).count() == 3
    assert rows(readers.read_table(spark, sinks.write_csv(df, folder + "/t.csv"))) == rows(df)


def test_total_order_spans_files(spark, folder):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("timestamp"), (F.col("id") % 3).alias("segment_id"))
    path = sinks.write_csv(df, folder + "/sorted.csv", ["timestamp", "segment_id"])
    import glob

    values = [int(line.split(",")[0]) for name in sorted(glob.glob(path + "/part-*")) for line in open(name).read().splitlines()[1:]]
    assert values == sorted(values) and len(values) == 1000


def test_matching_files_align_by_name(spark, folder):
    spark.createDataFrame([(1, 2.0)], "id int, a double").coalesce(1).write.parquet(folder + "/x/one")
    spark.createDataFrame([(2, "z")], "id int, b string").coalesce(1).write.csv(folder + "/y/two", header=True)
    df = readers.read_matching(spark, folder, ["*.parquet", "*.csv", "*.doc"], recursive=True)
    assert {r["id"]: (r["a"], r["b"], r["source_file"].rsplit(".", 1)[1]) for r in df.collect()} == {1: (2.0, None, "parquet"), 2: (None, "z", "csv")}
    assert readers.read_matching(spark, folder, ["*.doc"]) is None


def test_well_paths(spark, folder):
    import os

    import pyarrow as pa
    import pyarrow.parquet as pq

    for label, well in (("0", "W1"), ("0", "W2"), ("3", "W1"), ("folds", "F")):
        os.makedirs(f"{folder}/d/{label}", exist_ok=True)
        pq.write_table(pa.table({"P-PDG": [1.0, None], "QGL": [0.5, None], "class": pa.array([int(label) + 100 if label == "3" else 0, None], pa.int32()) if label != "folds" else pa.array([0, 0], pa.int32())}), f"{folder}/d/{label}/{well}.parquet")
    wells = readers.read_wells(spark, folder + "/d")
    assert {(r["well_id"], r["scenario_id"]) for r in wells.collect()} == {("W1", "0_W1"), ("W2", "0_W2"), ("W1", "3_W1")}
    out = cl.drop_silent_rows(cl.bound_sensors(cl.rename_well_sensors(cl.label_events(wells))))
    assert out.count() == 3 and {r["event_class"] for r in out.collect()} == {0, 3}
    files = readers.list_files(spark, folder + "/d")
    one = readers.sample_files(files, 2)
    assert sorted(r["path"].split("/d/")[1] for r in one.collect()) == ["0/W1.parquet", "3/W1.parquet"]
    assert readers.sample_files(files, 5).count() == 3
    assert {r["scenario_id"] for r in readers.read_wells(spark, folder + "/d", one).collect()} == {"0_W1", "3_W1"}


def test_registry(spark, folder):
    reg = readers.Registry({"a": {"phase": 1, "telemetry_compatible": True, "live_training_eligible": True, "folder": folder + "/none",
                                  "column_map": {"pressure": ["p", "q"]}}, "b": {"phase": 2}})
    assert [d["key"] for d in reg.phase(1)] == ["a"]
    with pytest.raises(KeyError):
        reg.get("c")
    assert reg.load(spark, "a") is None
    assert {r["key"]: r["reason"] for r in reg.skip_reasons(spark).collect()} == {"a": None, "b": "not_telemetry_compatible"}


def test_json_summaries_once_per_path(spark, folder):
    import json

    for i in range(2):
        with open(f"{folder}/s{i}.json", "w") as fh:
            json.dump({"run_label": f"r{i}", "models": {"m": {"roc_auc": 0.5 + i / 10}}}, fh, indent=1)
    df = readers.read_summaries(spark, [f"{folder}/s0.json", f"{folder}/s1.json", f"{folder}/s0.json"], "run_label string, models map<string, struct<roc_auc: double>>")
    assert sorted(r["run_label"] for r in df.collect()) == ["r0", "r1"]


def test_histories_split_where_time_steps_back(spark):
    t0 = dt.datetime(2026, 1, 1)
    df = spark.createDataFrame([(1, i, t0 + dt.timedelta(minutes=m)) for i, m in enumerate([0, 1, 0, 1])], "segment_id int, seq long, timestamp timestamp")
    out = rn.history_ids(df, Series(("segment_id",), ("seq",)))
    assert [r[1] for r in rows(out.select("seq", "history_id"))] == ["1|hist_0", "1|hist_0", "1|hist_1", "1|hist_1"]
    assert rows(pf.history_summary(out).select("history_count")) == [(2,)]
    named = rn.history_ids(df.withColumn("run_id", F.lit(9)), Series(("segment_id",), ("seq",)))
    assert {r["history_id"] for r in named.collect()} == {"9"}


def test_warnings(spark):
    base = dict(median_history_hours=2.0, raw_sensor_auc=0.99, dynamics_auc=0.99, disturbance_false_positive_rate=0.5,
                slow_leak_event_count=0, borderline_leak_event_count=1, missing_value_rate=0.0, stale_sensor_rate=0.0)
    got = pf.validation_warnings(spark.createDataFrame([base])).first()["warnings"]
    assert got == [pf.WARNINGS[k] for k in ("short", "easy", "flat", "thin", "ideal")]


def test_interval_join_against_all_pairs(spark, data):
    from telemill.sources import views

    s, i = views.shipments(spark, data), views.incidents(spark, data)
    got = jn.interval_join(s, i, ["segment_id"], "timestamp", "start_ts", "end_ts", 3 * 86400)
    want = s.join(i.withColumnRenamed("segment_id", "seg"), (F.col("segment_id") == F.col("seg")) & (F.col("timestamp") >= F.col("start_ts")) & (F.col("timestamp") < F.col("end_ts")))
    cols = [*views.SHIPMENT_ORDER, "event_id"]
    assert rows(got.select(*cols)) == rows(want.select(*cols)) and got.count() > 0


def test_incident_labels_in_event_order(spark):
    rows_ = spark.createDataFrame([(0, 1, 5), (1, 1, 50), (2, 2, 5)], "row int, segment_id int, step int")
    events = spark.createDataFrame([
        ("e1", 1, 0, 10, "slow_leak", 0.05), ("e2", 1, 2, 10, "micro_leak", 0.01), ("e3", 1, 3, 10, "valve_fault", 0.9),
        ("e4", 2, 0, 10, "micro_leak", 0.5)], "event_id string, segment_id int, start int, end int, event_type string, intensity double")
    out = jn.label_with_incidents(rows_, events, ["row"], ["segment_id"], "step", "start", "end", 4, ["slow_leak", "micro_leak"])
    cols = ["row", "leak_severity", "target", "event_type", "alarm_triggered", "active_event_id", "scenario_context"]
    assert rows(out.select(*cols)) == [
        (0, 0.05, 1, "warning", 0, "e2", "slow_leak|micro_leak|valve_fault"),
        (1, 0.0, 0, "normal", 0, "", "nominal"),
        (2, 0.5, 1, "fault", 1, "e4", "micro_leak")]


def test_csv_headers_may_differ_and_sampled_wells_are_read_alone(spark, tmp_path):
    for name, text in (("a b.csv", "x,y\n1,2\n"), ("c.csv", "y,z\n3,4\n5,6\n"), ("d.csv", "x,y\n7,8\n"), ("e.csv", "")):
        (tmp_path / name).write_text(text)
    df = readers.read_matching(spark, str(tmp_path), ["*.csv"])
    assert rows(df.select("x", "y", "z", "source_file"), "y") == [(1, 2, None, "a%20b.csv"), (None, 3, 4, "c.csv"), (None, 5, 6, "c.csv"), (7, 8, None, "d.csv")]
    base = str(tmp_path / "wells of a field")
    for label in ("0", "1"):
        for well in ("A 1", "B"):
            spark.range(3).select(F.col("id").alias("seq"), F.lit(1.0).alias("QGL")).repartition(1).write.parquet(f"{base}/{label}/{well}")
    files = readers.list_files(spark, base)
    picked = readers.sample_files(files.where(F.contains("path", F.lit("A"))), 2)
    assert readers.read_wells(spark, base, picked).count() == 3 * picked.count() and readers.read_wells(spark, base).count() == 12
    assert readers.read_wells(spark, base, picked.where("false")).count() == 0


def test_fingerprint_counts_copies_and_separates_values(spark):
    from telemill.operators.profile import fingerprint

    a = spark.createDataFrame([("a|", "b", 1), (None, "~", 2)], "x string, y string, n int")
    b = spark.createDataFrame([("a", "|b", 1), ("~", None, 2)], "x string, y string, n int")
    prints = [fingerprint(t).first()["fingerprint"] for t in (a, a.union(a), b, a.where("false"))]
    assert len(set(prints)) == 4 and prints[3] == 0
    assert fingerprint(a.orderBy("n")).first() == fingerprint(a.orderBy(F.desc("n"))).first()
