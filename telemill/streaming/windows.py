"""Windowed roll-ups, de-duplication and retention on telemetry streams."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.joins import latest_per_key, missing
from ..plans.corpus import exists
from .ordered import BUCKETS, process_in_order


def tumbling(rows: DataFrame, width: str = "1 minute", slide: str | None = None, time: str = "timestamp") -> DataFrame:
    """Per-segment mean and count in tumbling (or sliding) windows."""
    out = rows.groupBy("segment_id", F.window(time, width, slide or width)).agg(
        F.count(F.lit(1)).alias("n"), F.avg("pressure").alias("mean_pressure"))
    return out.select("segment_id", F.col("window.start").alias("start"), "n", "mean_pressure")


def sessions(rows: DataFrame, gap: str = "30 minutes", time: str = "timestamp") -> DataFrame:
    """Per-segment sessions of readings closer together than ``gap``."""
    out = rows.groupBy("segment_id", F.session_window(time, gap)).agg(
        F.count(F.lit(1)).alias("n"), F.max("pressure").alias("max_pressure"))
    return out.select("segment_id", F.col("session_window.start").alias("start"), "n", "max_pressure")


def first_arrivals(rows: DataFrame, key: Sequence[str]) -> DataFrame:
    """Each key once; repeats within the watermark are dropped."""
    return rows.dropDuplicatesWithinWatermark(list(key))


def score_batches(
    score: Callable[[DataFrame], DataFrame], path: str, key: Sequence[str], time: str = "timestamp",
) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` sink scoring only rows not scored before, safe to repeat.

    Scores are laid out by day and batch, so a batch run again replaces what it wrote the first time, and the look-up
    of earlier scores lists and opens the folders of the batch's own days only, however long the history is (``time``
    is part of the key).
    """
    if time not in key:
        raise ValueError("the key must contain the time column")

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        day = F.coalesce(F.date_format(time, "yyyy-MM-dd"), F.lit("none"))
        scored = score(latest_per_key(batch, key, ["seq"]))
        schema = T.StructType([*scored.schema.fields, T.StructField("batch", T.IntegerType())])
        days = [r[0] for r in batch.select(day).distinct().collect()] if batch_id > 0 else []  # as many as the batch has days
        known = [f"{path}/day={d}" for d in days if exists(spark, f"{path}/day={d}")]
        if known:
            # earlier batches only, so that a repeated batch does not meet its own rows
            done = spark.read.schema(schema).option("basePath", path).parquet(*known).where(F.col("batch") < batch_id)
            scored = missing(scored, done, key)
        out = scored.withColumns({"day": day, "batch": F.lit(batch_id)})
        out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day", "batch").parquet(path)

    return run


def retain_stream(rows: DataFrame, keys: Sequence[str] = ("segment_id",), keep: int = 720, values: Sequence[str] = ("pressure",),
                  idle: float | None = None, buckets: int = BUCKETS) -> DataFrame:
    """Retention on a stream: every row once it is in order, with the row that leaves the newest ``keep`` for it.

    ``gone_seq`` is NULL while a key has no more than ``keep`` rows, so the rows that no other row has sent away are the
    ones a live view holds. State per key is the sequence numbers of those rows; of a key without rows for ``idle``
    seconds none are kept, and it begins anew when it returns.
    """
    def step(new: Mapping[str, np.ndarray], starts: np.ndarray, carries: list[tuple]) -> tuple[dict[str, object], list[tuple]]:
        gone, after = [], []
        for (before,), a, b in zip(carries, starts[:-1], starts[1:]):
            held = [*before, *new["_seq"][a:b].tolist()]
            over = len(before) - keep
            gone += [held[i] if i >= 0 else None for i in range(over, over + b - a)]
            after.append((held[-keep:],))
        return {"gone_seq": pd.array(gone, "Int64")}, after

    return process_in_order(rows, keys, values, step, lambda: ([],), [T.StructField("held", T.ArrayType(T.LongType()))],
                            [T.StructField("gone_seq", T.LongType())], idle=idle, buckets=buckets)


def retain(history: DataFrame, per_segment: int = 720, order: Sequence[str] = ("timestamp", "seq")) -> DataFrame:
    """The newest rows of each segment, as kept for live views."""
    from ..operators.runs import last_rows

    return last_rows(history, ["segment_id"], list(order), per_segment)
