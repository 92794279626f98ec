"""Streaming features with fixed-size state per segment; equal to the batch features on the same rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.features import CROSS_SEGMENT, EWM_SPAN, FEATURES, FLAT_STD
from .ordered import BUCKETS, process_in_order

RING = 120  # readings kept: the longest frame is 90 rows, frames over deltas reach 31
STREAMED = [c for c in FEATURES if c not in CROSS_SEGMENT]


def _filled(x: np.ndarray) -> np.ndarray:
    return np.where(np.isfinite(x), x, 0.0)


class _Frames:
    """Trailing frames over readings, evaluated for those at ``at``; gaps are skipped."""

    def __init__(self, x: np.ndarray, at: np.ndarray):
        self.x, self.at = x, at

    def _view(self, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        # every key's readings begin with room for a ring, so no frame reaches into another key
        frame = np.lib.stride_tricks.sliding_window_view(self.x, k)[self.at - (k - 1)]
        seen = ~np.isnan(frame)
        return np.where(seen, frame, 0.0), seen, seen.sum(axis=1)

    def total(self, k: int) -> np.ndarray:
        return self._view(k)[0].sum(axis=1)

    def mean(self, k: int) -> np.ndarray:
        values, _, count = self._view(k)
        return values.sum(axis=1) / np.where(count > 0, count, np.nan)

    def std(self, k: int) -> np.ndarray:
        values, seen, count = self._view(k)
        mean = values.sum(axis=1) / np.where(count > 0, count, np.nan)
        spread = np.where(seen, values - mean[:, None], 0.0)
        out = np.sqrt((spread * spread).sum(axis=1) / np.where(count > 1, count - 1, np.nan))
        return np.where(out >= FLAT_STD, out, 0.0)


def window_features(p: np.ndarray, f: np.ndarray, at: np.ndarray, real: np.ndarray) -> dict[str, np.ndarray]:
    """Bounded-frame features of the readings at ``at``; what is not ``real`` is the empty room before a key's first."""
    out: dict[str, np.ndarray] = {}
    with np.errstate(all="ignore"):
        diffs = {}
        for name, x in (("pressure", p), ("flow", f)):
            before = np.concatenate([[np.nan], x[:-1]])
            d = np.where(np.isnan(x - before), 0.0, x - before)
            diffs[name] = d = np.where(real, d, np.nan)
            w, now = _Frames(x, at), x[at]
            m5, s5, m20 = w.mean(5), w.std(5), w.mean(20)
            out["pressure_delta" if name == "pressure" else "flow_rate_delta"] = d[at]
            out[f"{name}_pct_delta"] = _filled(d[at] / np.abs(before[at]))
            out[f"{name}_roll_mean"], out[f"{name}_roll_std"] = m5, s5
            out[f"{name}_roll_z"] = np.where(s5 > 0, _filled((now - m5) / s5), 0.0)
            out[f"{name}_baseline_dev"] = now - m20
            out[f"{name}_roll30_std"] = w.std(30)
            out[f"{name}_cusum_neg30"] = _Frames(np.minimum(d, 0.0), at).total(30)
            out[f"{name}_baseline60_dev"] = now - w.mean(90)
            m30 = w.mean(30)
            out[f"_{name}_trend"] = _filled((now - m30) / np.abs(m30))
            if name == "pressure":
                out["pressure_baseline_pct"] = _filled((now - m20) / np.abs(m20))
        dp, dq = diffs["pressure"], diffs["flow"]
        out["pressure_flow_ratio"] = _filled(p[at] / f[at])
        out["pressure_flow_divergence"] = out.pop("_pressure_trend") - out.pop("_flow_trend")
        out["pressure_delta_deviation"] = dp[at] - _Frames(dp, at).mean(5)
        out["flow_neg_streak"] = _Frames((dq < -0.01).astype(float), at).total(10)
        out["pressure_neg_streak15"] = _Frames((dp < -0.05).astype(float), at).total(15)
        out["pressure_accel"] = np.where(real[at - 1], dp[at] - dp[at - 1], 0.0)
    return out


def stream_features(rows: DataFrame, keys: Sequence[str] = ("segment_id",), wanted: Sequence[str] = tuple(STREAMED),
                    idle: float | None = None, buckets: int = BUCKETS) -> DataFrame:
    """Features over a watermarked telemetry stream.

    State per key: the last readings, running sums for the expanding means, and numerator and
    denominator of the exponential means. A key without rows for ``idle`` seconds starts afresh.
    """
    names = list(wanted)
    q = 1.0 - 2.0 / (EWM_SPAN + 1.0)

    def step(new: Mapping[str, np.ndarray], starts: np.ndarray, carries: list[tuple]) -> tuple[dict[str, np.ndarray], list[tuple]]:
        keys, lengths = len(carries), np.diff(starts)
        begin = starts[:-1] + RING * np.arange(1, keys + 1)  # each key's new readings, behind the room for its ring
        at = np.arange(starts[-1]) + np.repeat(begin - starts[:-1], lengths)
        signals = [np.full(starts[-1] + keys * RING, np.nan) for _ in range(2)]
        real = np.zeros(len(signals[0]), bool)
        real[at] = True
        for which, (x, c) in enumerate(zip(signals, ("pressure", "flow_rate"))):
            x[at] = new[c]
            for carry, b in zip(carries, begin):
                ring = carry[which]
                x[b - len(ring):b] = ring
                real[b - len(ring):b] = True
        cols = window_features(*signals, at, real)
        sums = [list(carry[2]) for carry in carries]
        for first, name, c in ((0, "pressure", "pressure"), (4, "flow", "flow_rate")):
            x = new[c]
            known = ~np.isnan(x)
            filled = np.where(known, x, 0.0)
            total, count, ema = np.empty(len(x)), np.empty(len(x)), []
            for mine, a, b in zip(sums, starts[:-1], starts[1:]):
                total[a:b] = filled[a:b].cumsum() + mine[first]
                count[a:b] = known[a:b].cumsum() + mine[first + 1]
                num, den = mine[first + 2], mine[first + 3]
                for v, k in zip(filled[a:b].tolist(), known[a:b].tolist()):
                    num, den = q * num + v, q * den + k
                    ema.append(num / den if den else np.nan)
                mine[first:first + 4] = [float(total[b - 1]), float(count[b - 1]), float(num), float(den)]
            with np.errstate(all="ignore"):
                cols[f"{name}_expanding_dev"] = x - total / count
            cols[f"{name}_ema_dev"] = x - np.array(ema)
        after = []
        for carry, mine, b, n in zip(carries, sums, begin, lengths):
            old = max(b - len(carry[0]), b + n - RING)
            after.append((*(x[old:b + n].tolist() for x in signals), mine))
        return {c: cols[c] for c in names}, after

    doubles = T.ArrayType(T.DoubleType())
    return process_in_order(
        rows, keys, ["pressure", "flow_rate"], step, lambda: ([], [], [0.0] * 8),
        [T.StructField(c, doubles) for c in ("ring_p", "ring_f", "sums")], [T.StructField(c, T.DoubleType()) for c in names], idle=idle, buckets=buckets)


def stream_segment_deviation(rows: DataFrame, tick: str = "1 hour", time: str = "timestamp") -> DataFrame:
    """Deviation from the mean over all segments of the same tick, once the tick is complete.

    The mean per tick is a windowed aggregate; it is joined back to the stream on the tick.
    """
    means = rows.groupBy(F.window(time, tick).alias("tick")).agg(F.avg("pressure").alias("_p"), F.avg("flow_rate").alias("_f"))
    left = rows.withColumn("tick", F.window(time, tick))
    joined = left.join(means, "tick")
    return joined.select(
        "segment_id", "seq", (F.col("pressure") - F.col("_p")).alias("pressure_segment_deviation"),
        (F.col("flow_rate") - F.col("_f")).alias("flow_segment_deviation"))
