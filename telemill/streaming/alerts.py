"""Streaming alert policy: two integers of state per key besides the rows still waiting."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ..operators.alerts import AlertPolicy, Machine, transitions
from .ordered import BUCKETS, process_in_order


def stream_alerts(
    scores: DataFrame, keys: Sequence[str] = ("model_name", "segment_id"), policy: AlertPolicy = AlertPolicy(), sticky: int = 30,
    idle: float | None = None, buckets: int = BUCKETS,
) -> DataFrame:
    """Alerts over a watermarked score stream; a key without rows for ``idle`` seconds starts afresh.

    Adds ``model_alert`` and ``pinned``, which stays true for ``sticky`` rows from an alert on.
    """
    table, made = transitions(policy), []

    def step(rows: Mapping[str, np.ndarray], starts: np.ndarray, carries: list[tuple]) -> tuple[dict[str, np.ndarray], list[tuple]]:
        if not made:  # the arrays are made once per worker; the job itself carries the small table only
            made.append(Machine(table))
        states, since = (np.array(c, np.int64) for c in zip(*carries))
        fired, states = made[0].walk_each(rows["leak_score"] >= policy.threshold, starts, states)
        at, lengths = np.arange(len(fired)), np.diff(starts)
        begin = np.repeat(starts[:-1], lengths)
        latest = np.maximum.accumulate(np.where(fired, at, -1))
        gap = np.where(latest >= begin, at - latest, np.repeat(since, lengths) + 1 + at - begin)
        after = np.minimum(gap[starts[1:] - 1], sticky)
        return {"model_alert": fired, "pinned": gap < sticky}, list(zip(states.tolist(), after.tolist()))

    return process_in_order(
        scores, keys, ["leak_score"], step, lambda: (0, sticky),
        [T.StructField("state", T.IntegerType()), T.StructField("since", T.IntegerType())],
        [T.StructField("model_alert", T.BooleanType()), T.StructField("pinned", T.BooleanType())], idle=idle, buckets=buckets)
