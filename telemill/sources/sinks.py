"""Writers: Parquet, CSV and JSON summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def total_order(df: DataFrame, columns: Sequence[str], partitions: int | None = None) -> DataFrame:
    """Rows in total order: range partitions, each sorted, so files in name order form one sequence."""
    parts = (partitions,) if partitions else ()
    return df.repartitionByRange(*parts, *columns).sortWithinPartitions(*columns)


def write_parquet(df: DataFrame, folder: str, name: str, suffix: str = "normalized", partition_by: Sequence[str] = ()) -> str:
    """Write ``<folder>/<name>/<suffix>.parquet`` and return the path."""
    path = f"{folder.rstrip('/')}/{name}/{suffix}.parquet"
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)
    return path


def write_csv(df: DataFrame, path: str, order: Sequence[str] = ()) -> str:
    out = total_order(df, order) if order else df
    out.write.mode("overwrite").csv(path, header=True, timestampFormat="yyyy-MM-dd HH:mm:ss")
    return path


def write_summary(df: DataFrame, path: str) -> str:
    """Write a summary (few rows by nature) as JSON lines."""
    df.write.mode("overwrite").json(path, ignoreNullFields=False)
    return path


def as_json(df: DataFrame, out: str = "json") -> DataFrame:
    """Each row as one JSON text."""
    return df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias(out))
