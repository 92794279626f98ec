"""Run registered queries against their SQL on the shared tables: ``python check.py [folder] [name ...]``."""

from __future__ import annotations

import os
import sys
import time

import duckdb
import pandas as pd

from queries import QUERIES, SQL
from telemill.session import local_session

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def normal(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        df[c] = df[c].map(lambda v: "NULL" if v is None or v is pd.NaT or (isinstance(v, float) and v != v)
                          else repr(float(v)) if isinstance(v, (int, float)) and not isinstance(v, bool)
                          else str(list(v)) if hasattr(v, "__len__") and not isinstance(v, (str, dict)) else str(v))
    return df.sort_values(list(df.columns)).reset_index(drop=True)


def compare(spark, con, folder: str, name: str) -> str:
    start = time.time()
    got = QUERIES[name](spark, folder).toPandas()
    took = time.time() - start
    if name not in SQL:
        return f"rows  {name}: {len(got)} rows {took:.1f}s"
    start = time.time()
    want = con.execute(SQL[name]).df()
    sql_took = time.time() - start
    if sorted(got.columns) != sorted(want.columns):
        return f"FAIL  {name}: columns {sorted(got.columns)} vs {sorted(want.columns)}"
    if len(got) != len(want):
        return f"FAIL  {name}: {len(got)} rows vs {len(want)}"
    a, b = normal(got), normal(want)
    bad = (a != b).any(axis=1)
    if bad.any():
        cols = [c for c in a.columns if (a[c] != b[c]).any()]
        i = bad.idxmax()
        return f"FAIL  {name}: {bad.sum()} of {len(a)} rows differ in {cols}: {a.loc[i].to_dict()} vs {b.loc[i].to_dict()}"
    kinds = {c: (str(got[c].dtype), str(want[c].dtype)) for c in got.columns if str(got[c].dtype) != str(want[c].dtype)}
    return f"ok    {name}: {len(a)} rows {took:.1f}s sql {sql_took:.1f}s" + (f" dtypes {kinds}" if kinds else "")


def main() -> int:
    args = sys.argv[1:]
    folder = args.pop(0) if args and os.path.isdir(args[0]) else "/root/testdata/sf0.01"
    names = args or list(QUERIES)
    spark = local_session(8)
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    failed = 0
    for name in names:
        try:
            line = compare(spark, con, folder, name)
        except Exception as exc:  # report and go on
            line = f"FAIL  {name}: {type(exc).__name__}: {str(exc)[:1500]}"
        failed += line.startswith("FAIL")
        print(line, flush=True)
    print(f"{len(names) - failed}/{len(names)} passed")
    return failed


if __name__ == "__main__":
    sys.exit(main())
