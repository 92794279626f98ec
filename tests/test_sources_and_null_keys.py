"""Corpora from files that may be absent or empty, scores looked up by day, and NULL as a key of every keyed operator."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from telemill.ml.ensemble import from_samples
from telemill.operators import runs as rn
from telemill.operators.series import Series
from telemill.operators.wide import SENSORS, wide_features
from telemill.plans import corpus as cp
from telemill.streaming import windows as sw


def test_corpus_names_absent_and_unusable_sources(spark, tmp_path):
    rows = [(i, i % 3, dt.datetime(2026, 1, 1), float(i), int(i % 4 == 0)) for i in range(40)]
    df = spark.createDataFrame(rows, "row_key long, segment_id long, timestamp timestamp, pressure double, target int")
    df.write.parquet(str(tmp_path / "a.parquet"))
    df.limit(0).write.parquet(str(tmp_path / "b.parquet"))
    paths = {n: str(tmp_path / f"{n}.parquet") for n in "abcd"}
    paths["d"] = str(tmp_path / "a.parquet")
    prepare = {n: (lambda x: x) for n in "abc"} | {"d": lambda x: x.where("pressure < 0")}
    rows_, absent = cp.corpus_from_files(spark, paths, prepare, ["row_key"], max_rows_per_source=None)
    assert absent == ["c"]
    got = {r["source_dataset"]: (r["row_count"], r["positive_count"], r["skipped"]) for r in cp.summary_with_reasons(rows_, list(paths), absent).collect()}
    assert got == {"a": (40, 10, None), "b": (0, 0, cp.UNUSABLE), "c": (0, 0, cp.MISSING), "d": (0, 0, cp.UNUSABLE)}
    with pytest.raises(ValueError):
        cp.corpus_from_files(spark, {"c": paths["c"]}, prepare, ["row_key"])


def test_earlier_scores_are_read_from_the_days_of_the_batch_only(spark, tmp_path):
    path = str(tmp_path / "scores")
    day = lambda d, i: (1, dt.datetime(2026, 1, d, 12), i, 1.0)
    sink = sw.score_batches(lambda b: b.withColumn("leak_score", F.lit(0.5)), path, ["segment_id", "timestamp"])
    make = lambda rows: spark.createDataFrame(rows, "segment_id int, timestamp timestamp, seq long, pressure double")
    sink(make([day(1, 1), day(2, 2), (1, None, 8, 1.0)]), 0)
    for bad in os.listdir(path):  # what is not of the batch's days is never opened
        if bad == "day=2026-01-01":
            for folder in os.listdir(f"{path}/{bad}"):
                for f in os.listdir(f"{path}/{bad}/{folder}"):
                    if f.endswith(".parquet"):
                        open(f"{path}/{bad}/{folder}/{f}", "w").write("not a table")
                    else:
                        os.remove(f"{path}/{bad}/{folder}/{f}")
    for _ in range(2):  # a batch that runs again replaces itself
        sink(make([day(2, 3), day(3, 4)]), 1)
    got = spark.read.option("basePath", path).parquet(f"{path}/day=2026-01-02", f"{path}/day=2026-01-03").collect()
    assert sorted(r["seq"] for r in got) == [2, 4]


@pytest.fixture(scope="module")
def keyed(spark):
    rows = [(k, i, float((i * 7) % 5), "kept") for k in (None, 1) for i in range(12)]
    return spark.createDataFrame(rows, "k int, seq long, v double, _extra string")


@pytest.mark.parametrize("slots", [False, True])
def test_null_is_a_key_on_both_sides_of_the_size_limit(spark, keyed, slots):
    series = Series(("k",), ("seq",), slot=F.floor(F.col("seq") / 4) if slots else None)
    both = lambda df, *c: [sorted(tuple(r[x] for x in c) for r in df.where(w).collect()) for w in ("k IS NULL", "k = 1")]
    spikes = rn.spikes_and_stale(keyed, series, "v", 1.0)
    a, b = both(spikes, "seq", "block", "spike")
    assert a == b and len(a) == 12 and any(s for *_, s in a)
    a, b = both(rn.resample_linear(keyed, series, "v", 5), "point", "v")
    assert a == b and len(a) == 5
    wide = wide_features(keyed.withColumns({s: F.col("v") + i for i, s in enumerate(SENSORS)}), series)
    a, b = both(wide, "seq", "_extra", "P_inlet_rolling_mean_5", "P_inlet_rolling_std_5")
    assert a == b and len(a) == 12 and a[0][1] == "kept"
    a, b = both(rn.leak_events(keyed.withColumns({"target": (F.col("seq") > 6).cast("int"), "leak_severity": F.lit(0.2)}), series), "duration", "kind")
    assert a == b == [(5, "abrupt")]


def test_null_is_a_key_of_runs_at_the_end_and_of_scaled_scores(keyed):
    got = {r["k"]: r["trailing"] for r in rn.trailing_run(keyed, ["k"], ["seq"], F.col("seq") > 8).collect()}
    assert got == {None: 3, 1: 3}
    scaled = from_samples(keyed, "v", "s", ["k"])
    assert scaled.count() == 24 and scaled.where("k IS NULL").agg(F.min("s"), F.max("s")).first() == (0.0, 1.0)
