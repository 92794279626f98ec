"""Joins on keys that may be NULL."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def join_keys(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on ``keys`` with NULL equal to NULL; key columns come from the left side. Without keys ``right`` has one row."""
    if not keys:  # the right side is a single row
        one = left.withColumn("_one", right.select(F.struct(*right.columns)).scalar())
        return one.withColumns({c: F.col(f"_one.{c}") for c in right.columns}).drop("_one")
    named = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    on = [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys]
    return left.join(named, on, how).drop(*[f"_r_{k}" for k in keys])
