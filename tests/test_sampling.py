from pyspark.sql import functions as F

from telemill.functions import severity_weight
from telemill.operators import sampling as sp
from telemill.plans.corpus import build_corpus, corpus_summary

from .conftest import rows


def labelled(spark, pos, neg):
    return spark.range(pos + neg).select(F.col("id").alias("k"), (F.col("id") < pos).cast("int").alias("target"))


def counts(df):
    return {r["target"]: r["count"] for r in df.groupBy("target").count().collect()}


def test_rebalance_limits_negatives(spark):
    df = labelled(spark, 4, 16)
    assert counts(sp.rebalance(df, ["k"], 2.0)) == {1: 4, 0: 8}
    assert rows(sp.rebalance(df, ["k"], 2.0)) == rows(sp.rebalance(df.repartition(7), ["k"], 2.0))
    assert counts(sp.rebalance(df, ["k"], 10.0)) == {1: 4, 0: 16}
    assert counts(sp.rebalance(labelled(spark, 0, 5), ["k"])) == {0: 5}
    assert counts(sp.rebalance(labelled(spark, 5, 0), ["k"])) == {1: 5}


def test_rebalance_per_source_and_cap(spark):
    a, b = labelled(spark, 10, 200), labelled(spark, 50, 20).withColumn("k", F.col("k") + 1000)
    out = build_corpus({"a": a, "b": b}, ["k"], 2.0, 25)
    got = {r["source_dataset"]: (r["row_count"], r["positive_count"]) for r in corpus_summary(out).collect()}
    assert got["a"][0] == 25 and got["b"][0] == 25
    free = {r["source_dataset"]: (r["row_count"], r["positive_count"]) for r in corpus_summary(build_corpus({"a": a, "b": b}, ["k"], 2.0, None)).collect()}
    assert free == {"a": (30, 10), "b": (70, 50)}


def test_take_is_exact_at_every_quota(spark):
    df = spark.range(500).select(F.col("id").alias("k"), (F.col("id") % 2).alias("g"))
    order = [r["k"] for r in df.where("g = 0").orderBy(sp.hash_rank(42, ["k"])).collect()]
    for quota in (0, 1, 17, 249, 250, 999):
        q = spark.createDataFrame([(0, quota)], "g long, quota long")
        assert sorted(r["k"] for r in sp.take(df, ["g"], ["k"], q).collect()) == sorted(order[:quota])


def test_class_cap(spark):
    assert counts(sp.class_capped(labelled(spark, 100, 300), ["k"], 90)) == {1: 30, 0: 60}
    assert counts(sp.class_capped(labelled(spark, 10, 300), ["k"], 90)) == {1: 10, 0: 80}
    assert counts(sp.class_capped(labelled(spark, 10, 20), ["k"], 90)) == {1: 10, 0: 20}


def test_whole_groups(spark):
    df = spark.range(8).select(F.concat(F.lit("s"), (F.col("id") / 2).cast("int").cast("string")).alias("s"), (F.col("id") < 4).cast("int").alias("target"))
    out = sp.sample_groups(df, "s", 2)
    assert out.count() == 4 and out.select("s").distinct().count() == 2
    assert sorted(counts(out).items()) == [(0, 2), (1, 2)]
    assert sp.sample_groups(df, "s", 10).count() == 8


def test_folds_never_split_groups_and_stay_balanced(spark):
    df = spark.range(4000).select(F.col("id"), (F.floor(F.sqrt(F.col("id") * 2))).alias("g"))
    df = df.withColumn("target", (F.col("g") % 4 == 0).cast("int"))
    out = sp.group_folds(df, "g", 5).cache()
    assert out.count() == 4000
    assert out.groupBy("g").agg(F.countDistinct("fold").alias("n")).where("n > 1").count() == 0
    groups = {r["fold"]: (r["g"], r["p"]) for r in out.groupBy("fold").agg(
        F.countDistinct("g").alias("g"), F.countDistinct(F.when(F.col("target") == 1, F.col("g"))).alias("p")).collect()}
    assert len(groups) == 5
    for i in (0, 1):
        sizes = [v[i] for v in groups.values()]
        assert max(sizes) - min(sizes) <= 2


def test_split_fractions(spark):
    out = sp.stratified_split(labelled(spark, 100, 400), ["k"], "target", {"test": 0.2, "valid": 0.1, "train": 0.0})
    got = {(r["target"], r["part"]): r["count"] for r in out.groupBy("target", "part").count().collect()}
    assert got == {(1, "test"): 20, (1, "valid"): 10, (1, "train"): 70, (0, "test"): 80, (0, "valid"): 40, (0, "train"): 280}


def test_severity_weights(spark):
    df = spark.createDataFrame([(1, 0.1), (1, 0.15), (1, 0.3), (1, 0.6), (0, 0.1), (1, None)], "t int, s double")
    assert [r[0] for r in df.select(severity_weight(F.col("t"), F.col("s"))).collect()] == [12.0, 15.0, 3.0, 1.0, 1.0, 12.0]


def test_null_groups_and_labels_keep_their_rows(spark):
    rows = [(i, None if i % 4 == 0 else "g%d" % (i % 3), None if i % 4 == 0 else i % 2) for i in range(20)]
    df = spark.createDataFrame(rows, "id long, g string, target int")
    assert sp.stratified_split(df, ["id"], "target", {"test": 0.4, "train": 0}).count() == 20
    assert sp.group_split(df, "g", {"test": 0.4, "train": 0}).count() == 20
    assert sp.group_folds(df, "g", 3).count() == 20
    assert sp.cap_rows(df, ["id"], 3, ["g"]).groupBy("g").count().where("count <> 3").count() == 0
    assert sp.cap_rows(df, ["id"], 3, ["g"]).count() == 12
    assert sp.class_capped(df, ["id"], 20).count() == 20
    assert sp.class_capped(df, ["id"], 6).groupBy("target").count().count() == 2
    assert sp.sample_groups(df, "g", 10).count() == 20
