"""The whole queries return every column of their operators, and these match SQL."""

import __spark_entry__ as entry
from check import normal
from queries import QUERIES, SQL
from telemill.operators.features import EVENT_CODE, FEATURES
from telemill.operators.wide import wide_feature_names
from telemill.streaming.features import STREAMED

from .test_queries import con  # noqa: F401


def test_entry_has_every_feature(spark):
    assert {*FEATURES, EVENT_CODE} <= set(entry.entry(spark).columns)


def test_epsilon_has_every_column(spark, data):
    assert set(wide_feature_names()) <= set(QUERIES["wide_features_epsilon_whole"](spark, data).columns)


def test_stream_has_every_column_and_matches_sql(spark, con, data):  # noqa: F811
    got, want = QUERIES["stream_features_whole"](spark, data).toPandas(), con.execute(SQL["stream_features_whole"]).df()
    assert set(STREAMED) <= set(got.columns) and sorted(got.columns) == sorted(want.columns) and len(got) == len(want)
    a, b = normal(got), normal(want)
    assert (a == b).all(axis=None), a[(a != b).any(axis=1)].head()
