"""Queries of the subpackage against their SQL, and the pipeline over a table that was loaded twice."""

from collections import Counter

import duckdb
import pytest

import corpus_pipeline
from check import TABLES, normal
from telemill.llm import exact_dedup
from telemill.llm.queries import QUERIES, SQL


@pytest.fixture(scope="module")
def con(data):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, con, data, name):
    got, want = QUERIES[name](spark, data).toPandas(), con.execute(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and len(got) == len(want)
    a, b = normal(got), normal(want)
    assert (a == b).all(axis=None), a[(a != b).any(axis=1)].head()


def test_fully_repeated_rows_leave_one(spark):
    rows = [(1, "One text", "a"), (2, "one TEXT", "a"), (2, "one TEXT", "a"), (3, "other", "a"), (3, "other", "b"), (3, "other", "b"),
            (None, "nameless", "a"), (None, "nameless", "a"), (4, None, "a"), (5, "", "a"), (5, "", "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    last = {}
    for i, t, _ in rows:
        last[(t or "").lower()] = max(last.get((t or "").lower(), -1), -1 if i is None else i)
    want = {r for r in rows if last[(r[1] or "").lower()] == (-1 if r[0] is None else r[0])}
    assert Counter(map(tuple, exact_dedup.drop_copies(docs, repeats=False).collect())) == Counter(want)


def test_pipeline_of_a_table_loaded_twice(spark, data, tmp_path):
    """Every stage is run; no document leaves the pipeline twice, and every piece belongs to an input row."""
    docs = spark.read.parquet(f"{data}/documents.parquet")
    docs.union(docs).write.parquet(f"{tmp_path}/documents.parquet")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{data}/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path)).toPandas()
    assert len(out) and not out.duplicated(["doc_id", "start"]).any()
    assert set(out.doc_id) <= {r.doc_id for r in docs.select("doc_id").collect()}
    covered = out.groupby("doc_id").agg(length=("length", "sum"), tokens=("doc_tokens", "first"))
    assert (covered.length == covered.tokens).all()
