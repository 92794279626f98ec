"""The dyadic interval index against all pairs."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from telemill.operators import joins as jn


def nodes(spark, pairs):
    df = spark.createDataFrame(pairs, "lo long, hi long")
    return [[(n["level"], n["node"]) for n in r["n"]] for r in df.select(jn.dyadic_nodes(F.col("lo"), F.col("hi")).alias("n")).collect()]


def test_nodes_make_up_the_interval_exactly(spark):
    rng = np.random.default_rng(3)
    pairs = [tuple(int(v) for v in sorted(rng.integers(-300, 300, 2))) for _ in range(300)] + [(0, 0), (5, 3), (-8, 8), (-1, 1), (7, 8)]
    for (lo, hi), found in zip(pairs, nodes(spark, pairs)):
        covered = sorted(t for level, n in found for t in range(n << level, (n + 1) << level))
        assert covered == list(range(lo, hi))
        assert len(found) <= 2 * max(1, hi - lo).bit_length()


def test_ten_years_of_seconds_take_few_nodes(spark):
    year = 31_556_952
    found = nodes(spark, [(1_000_000_007, 1_000_000_007 + 10 * year), (-2 ** 62, 2 ** 62 - 1), (None, 5), (5, None)])
    assert len(found[0]) < 70 and len(found[1]) < 130 and found[2] == found[3] == []


@pytest.mark.parametrize("unit", [1, 7, 1000])
def test_join_is_all_pairs_with_null_keys_and_clashing_columns(spark, unit):
    rng = np.random.default_rng(unit)
    key = lambda: None if rng.random() < 0.2 else int(rng.integers(3))
    rows = [(i, key(), float(v) if rng.random() > 0.05 else None, "r") for i, v in enumerate(rng.integers(-2000, 2000, 400) / 4)]
    events = []
    for i in range(120):
        a = float(rng.integers(-2000, 2000)) / 4
        events.append((i, key(), a, a + float(rng.choice([0, -3, 0.25, 5, 40, 4000])), "e"))
    events += [(500, 1, None, 4.0, "e"), (501, 1, 4.0, None, "e")]
    r = spark.createDataFrame(rows, "id long, k int, at double, start string")
    e = spark.createDataFrame(events, "event long, k int, begin double, stop double, start string")
    out = jn.interval_join(r, e, ["k"], "at", "begin", "stop", unit)
    assert out.columns == ["id", "k", "at", "start", "event", "begin", "stop", "_e_start"]
    want = sorted((i, n) for i, k, at, _ in rows for n, q, a, b, _ in events
                  if k == q and None not in (at, a, b) and a <= at < b)
    assert sorted((x["id"], x["event"]) for x in out.collect()) == want and len(want) > 200
    assert jn.interval_join(r, e.where("false"), ["k"], "at", "begin", "stop", unit).count() == 0


def test_parts_of_seconds_count(spark):
    t = dt.datetime(2024, 1, 1, 12, 0, 0)
    rows = spark.createDataFrame([(1, t + dt.timedelta(milliseconds=ms)) for ms in (0, 499, 500, 1500, 2499, 2500)], "k int, at timestamp")
    events = spark.createDataFrame([(1, t + dt.timedelta(milliseconds=500), t + dt.timedelta(milliseconds=2500))], "k int, a timestamp, b timestamp")
    got = jn.interval_join(rows, events, ["k"], "at", "a", "b").orderBy("at").collect()
    assert [(r["at"] - t).total_seconds() for r in got] == [0.5, 1.5, 2.499]


def test_a_long_incident_is_stored_under_few_nodes(spark):
    """The other side of the join grows with the levels in use, not with the length of an interval."""
    t = dt.datetime(2014, 1, 1)
    rows = spark.range(1000).select(F.lit(1).alias("k"), F.timestamp_add("HOUR", F.col("id").cast("int"), F.lit(t)).alias("at"))
    events = spark.createDataFrame([(1, t + dt.timedelta(hours=1, seconds=5), t + dt.timedelta(days=3652))], "k int, a timestamp, b timestamp")
    out = jn.interval_join(rows, events, ["k"], "at", "a", "b")
    assert out.count() == 998
