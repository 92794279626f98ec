"""Per-segment time-series features.

All frames share one partitioning and one order, so the plan has a single exchange
by segment; the cross-segment means add a pre-aggregated table keyed by timestamp.
"""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from ..functions import finite, ratio
from ..session import checkpoint_dir
from .labels import category_codes
from .series import Series, frames, scan, stored

FLAT_STD = 1e-9      # a deviation this small is a constant window
EWM_SPAN = 20
EWM_BLOCK = 4096     # q**-4096 stays well inside double range
EWM_REACH = 512      # q**512 is below double resolution
REACH = 90           # longest bounded frame
MOST_TICKS = 200_000  # ticks whose means are small enough to be broadcast

DELTAS = ["pressure_delta", "flow_rate_delta"]
RELATIVE = ["pressure_pct_delta", "flow_pct_delta", "pressure_flow_ratio"]
ROLLING = ["pressure_roll_mean", "pressure_roll_std", "flow_roll_mean", "flow_roll_std"]
ZSCORES = ["pressure_roll_z", "flow_roll_z"]
SHORT_TREND = ["pressure_delta_deviation", "flow_neg_streak"]
CROSS_SEGMENT = ["pressure_segment_deviation", "flow_segment_deviation"]
BASELINE = ["pressure_baseline_dev", "flow_baseline_dev", "pressure_baseline_pct"]
SLOW_LEAK = ["pressure_roll30_std", "flow_roll30_std", "pressure_cusum_neg30", "flow_cusum_neg30",
             "pressure_flow_divergence", "pressure_neg_streak15", "pressure_accel"]
EMA = ["pressure_ema_dev", "flow_ema_dev"]
LONG_BASELINE = ["pressure_baseline60_dev", "flow_baseline60_dev"]
EXPANDING = ["pressure_expanding_dev", "flow_expanding_dev"]

FEATURES = (DELTAS + RELATIVE + ROLLING + ZSCORES + SHORT_TREND + CROSS_SEGMENT + BASELINE
            + SLOW_LEAK + EMA + LONG_BASELINE + EXPANDING)
EVENT_CODE = "event_type_encoded"
# The columns of the fast and of the minimal feature set (both also hold EVENT_CODE).
FAST_FEATURES = [
    "pressure_delta", "flow_rate_delta", "pressure_pct_delta", "flow_pct_delta", "pressure_flow_ratio",
    "pressure_roll_mean", "pressure_roll_std", "pressure_roll_z", "flow_roll_mean", "flow_roll_std", "flow_roll_z",
    "pressure_delta_deviation", "flow_neg_streak", "pressure_segment_deviation", "flow_segment_deviation",
    "pressure_baseline_dev", "flow_baseline_dev",
]
MINIMAL_FEATURES = [
    "pressure_delta", "flow_rate_delta", "pressure_roll_mean", "pressure_roll_std", "flow_roll_mean", "flow_roll_std",
    "pressure_flow_ratio",
]


def rows(w: WindowSpec, n: int) -> WindowSpec:
    """The current row and the ``n - 1`` before it."""
    return w.rowsBetween(-(n - 1), 0)


def flat_to_zero(std: Column | str) -> Column:
    """A sample deviation, 0 for one row or a constant window.

    Takes a computed column: a window expression written twice would be evaluated twice.
    """
    s = F.col(std) if isinstance(std, str) else std
    return F.when(s >= FLAT_STD, s).otherwise(0.0)


def ewm_mean(df: DataFrame, parts: list[str], place: str, cols: dict[str, str], span: int = EWM_SPAN) -> DataFrame:
    """Exponentially weighted means (weights renormalised from the start of the series).

    ``place`` is the 1-based position inside ``parts``. Sums are kept per block of 4096 rows,
    scaled so that nothing overflows; the block before enters through its closing value.
    """
    q = 1.0 - 2.0 / (span + 1.0)
    inside = Window.partitionBy(*parts, "_eb").orderBy(place).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*parts).orderBy("_eb", place).rowsBetween(Window.unboundedPreceding, -1)
    k = F.col("_ek")
    fall, rise = F.pow(F.lit(q), k), F.pow(F.lit(q), -k)
    df = df.withColumns({
        "_eb": F.floor((F.col(place) - 1) / EWM_BLOCK),
        "_ek": F.pmod(F.col(place) - 1, F.lit(EWM_BLOCK)).cast("double"),
    })
    sums: dict[str, Column] = {}
    for out, src in cols.items():
        x = F.col(src)
        sums[f"_n_{out}"] = fall * F.sum(F.coalesce(x, F.lit(0.0)) * rise).over(inside)
        sums[f"_d_{out}"] = fall * F.sum(F.when(x.isNotNull(), rise).otherwise(0.0)).over(inside)
    df = df.withColumns(sums)
    closing = {f"_t{c}": F.last(F.when(k == EWM_BLOCK - 1, F.col(c)), ignorenulls=True).over(before) for c in sums}
    df = df.withColumns(closing)
    lead = F.pow(F.lit(q), k + 1)

    def total(c: str) -> Column:
        return F.col(c) + lead * F.coalesce(F.col(f"_t{c}"), F.lit(0.0))

    means = {out: total(f"_n_{out}") / F.nullif(total(f"_d_{out}"), F.lit(0.0)) for out in cols}
    return df.withColumns(means).drop("_eb", "_ek", *sums, *closing)


def decay_stages(q: float, radix: int = 8, floor: float = 1e-18) -> list[int]:
    """Step widths 1, 8, 64, ... until weights ``q**n`` fall below double resolution."""
    steps, width = [], 1
    while q ** width > floor:
        steps.append(width)
        width *= radix
    return steps


def decay_step(w: WindowSpec, c: str, q: float, width: int, radix: int = 8) -> Column:
    """One stage of ``sum_j q^j x(t-j)``: eight sums over ``width`` rows become one over ``8 width``."""
    total = F.col(c)
    for i in range(1, radix):
        total = total + (q ** (i * width)) * F.coalesce(F.lag(c, i * width).over(w), F.lit(0.0))
    return total


def smooth(df: DataFrame, series: Series, cols: dict[str, str], dt: float, tau: float, block: int = 1_000_000) -> DataFrame:
    """First-order lag ``y = y' + a (x - y')`` with ``a = dt / (tau + dt)``; identity for ``tau <= 0``.

    Unrolled, ``y_t = a * sum_j q^j x(t-j) + q^t x_1`` with ``q = 1 - a``.
    """
    if tau <= 0:
        return df.withColumns({out: F.col(src) for out, src in cols.items()})
    a = dt / (tau + dt)
    q = 1.0 - a
    steps = decay_stages(q)
    rows_, local, keep = frames(df, series, 8 * steps[-1], max(block, 16 * steps[-1]))
    w = local.window()
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    start = {f"_first_{o}": F.first(F.col(c)).over(upto) for o, c in cols.items()}
    start["_t"] = F.row_number().over(w)
    rows_ = rows_.withColumns(start).withColumns({f"_y_{o}": F.col(c).cast("double") for o, c in cols.items()})
    for width in steps:
        rows_ = rows_.withColumns({f"_y_{o}": decay_step(w, f"_y_{o}", q, width) for o in cols})
    at = F.col("_pos" if "_pos" in rows_.columns else "_t").cast("double")
    out = {o: a * F.col(f"_y_{o}") + F.pow(F.lit(q), at) * F.col(f"_first_{o}") for o in cols}
    rows_ = rows_.withColumns(out).where(keep)
    return rows_.drop(*[c for c in rows_.columns if c.startswith("_") and c not in df.columns])


def cross_segment_means(df: DataFrame, tick: str, cols: dict[str, str]) -> DataFrame:
    """Mean over all segments at the same tick, one row per tick, kept in the shared folder."""
    means = df.groupBy(tick).agg(*[F.avg(src).alias(out) for out, src in cols.items()])
    return stored(means, f"{checkpoint_dir(df.sparkSession)}/means-{uuid4().hex}")


def segment_deviations(df: DataFrame, means: DataFrame, tick: str) -> DataFrame:
    """Deviation of the rows from the means of their tick."""
    return df.join(means, tick, "left").withColumns({
        "pressure_segment_deviation": F.col("pressure") - F.col("_tp"),
        "flow_segment_deviation": F.col("flow_rate") - F.col("_tf"),
    }).drop("_tp", "_tf")


def build_features(
    df: DataFrame,
    series: Series,
    wanted: list[str] | None = None,
    *,
    tick: str | None = "timestamp",
    encode_events: bool = False,
    block: int = 1_000_000,
) -> DataFrame:
    """Add the feature columns in ``wanted`` (all by default) to telemetry rows."""
    want = set(FEATURES if wanted is None else wanted)

    def needs(*names: str) -> bool:
        return bool(want.intersection(names))

    df = df.withColumns({"pressure": finite("pressure"), "flow_rate": finite("flow_rate")})
    p, f = F.col("pressure"), F.col("flow_rate")

    across = tick is not None and needs(*CROSS_SEGMENT)
    means, many = None, False
    if across:
        means = cross_segment_means(df, tick, {"_tp": "pressure", "_tf": "flow_rate"})
        many = means.count() > MOST_TICKS
    if many:  # rows are dealt out by tick while they are narrow
        df = segment_deviations(df, means, tick)

    expanding = needs(*EXPANDING)
    long_keys = series.slot is not None
    if expanding and long_keys:
        df = scan(df, series, sums={
            "_xp": p, "_xpn": F.when(p.isNotNull(), 1).otherwise(0),
            "_xf": f, "_xfn": F.when(f.isNotNull(), 1).otherwise(0),
        }).withColumns({"_xpm": F.col("_xp") / F.col("_xpn"), "_xfm": F.col("_xf") / F.col("_xfn")})
        df = df.drop("_xp", "_xpn", "_xf", "_xfn")

    df, local, keep = frames(df, series, EWM_REACH if needs(*EMA) else REACH, block)
    w = local.window()
    upto = w.rowsBetween(Window.unboundedPreceding, 0)

    # first pass: everything read straight from pressure and flow
    first: dict[str, Column] = {"_lp": F.lag(p).over(w), "_lf": F.lag(f).over(w)}
    if needs(*ROLLING, *ZSCORES):
        first |= {
            "_m5p": F.avg(p).over(rows(w, 5)), "_s5p": F.stddev_samp(p).over(rows(w, 5)),
            "_m5f": F.avg(f).over(rows(w, 5)), "_s5f": F.stddev_samp(f).over(rows(w, 5)),
        }
    if needs(*BASELINE):
        first |= {"_m20p": F.avg(p).over(rows(w, 20)), "_m20f": F.avg(f).over(rows(w, 20))}
    if needs("pressure_roll30_std", "flow_roll30_std"):
        first |= {"_s30p": F.stddev_samp(p).over(rows(w, 30)), "_s30f": F.stddev_samp(f).over(rows(w, 30))}
    if needs("pressure_flow_divergence"):
        first |= {"_m30p": F.avg(p).over(rows(w, 30)), "_m30f": F.avg(f).over(rows(w, 30))}
    if needs(*LONG_BASELINE):
        first |= {"_m90p": F.avg(p).over(rows(w, 90)), "_m90f": F.avg(f).over(rows(w, 90))}
    if expanding and not long_keys:
        first |= {"_xpm": F.avg(p).over(upto), "_xfm": F.avg(f).over(upto)}
    if needs(*EMA):
        first["_place"] = F.row_number().over(w)
    df = df.withColumns(first)

    zero = F.lit(0.0)
    df = df.withColumns({c: flat_to_zero(c) for c in ("_s5p", "_s5f", "_s30p", "_s30f") if c in first})
    df = df.withColumns({
        "pressure_delta": F.coalesce(p - F.col("_lp"), zero),
        "flow_rate_delta": F.coalesce(f - F.col("_lf"), zero),
    })
    dp, dq = F.col("pressure_delta"), F.col("flow_rate_delta")

    # second pass: frames over the deltas, same partitioning and order
    second: dict[str, Column] = {}
    if needs("pressure_delta_deviation"):
        second["pressure_delta_deviation"] = dp - F.avg(dp).over(rows(w, 5))
    if needs("flow_neg_streak"):
        second["flow_neg_streak"] = F.sum(F.when(dq < -0.01, 1.0).otherwise(0.0)).over(rows(w, 10))
    if needs("pressure_neg_streak15"):
        second["pressure_neg_streak15"] = F.sum(F.when(dp < -0.05, 1.0).otherwise(0.0)).over(rows(w, 15))
    if needs("pressure_cusum_neg30"):
        second["pressure_cusum_neg30"] = F.sum(F.least(dp, zero)).over(rows(w, 30))
    if needs("flow_cusum_neg30"):
        second["flow_cusum_neg30"] = F.sum(F.least(dq, zero)).over(rows(w, 30))
    if needs("pressure_accel"):
        second["pressure_accel"] = F.coalesce(dp - F.lag(dp).over(w), zero)
    if second:
        df = df.withColumns(second)
    if needs(*EMA):
        df = ewm_mean(df, list(local.parts), "_place", {"_ep": "pressure", "_ef": "flow_rate"})

    # row-level: no further windows
    third: dict[str, Column] = {
        "pressure_pct_delta": lambda: ratio(dp, F.abs(F.col("_lp"))),
        "flow_pct_delta": lambda: ratio(dq, F.abs(F.col("_lf"))),
        "pressure_flow_ratio": lambda: ratio(p, f),
        "pressure_roll_mean": lambda: F.col("_m5p"),
        "pressure_roll_std": lambda: F.col("_s5p"),
        "flow_roll_mean": lambda: F.col("_m5f"),
        "flow_roll_std": lambda: F.col("_s5f"),
        "pressure_roll_z": lambda: ratio(p - F.col("_m5p"), F.col("_s5p")),
        "flow_roll_z": lambda: ratio(f - F.col("_m5f"), F.col("_s5f")),
        "pressure_baseline_dev": lambda: p - F.col("_m20p"),
        "flow_baseline_dev": lambda: f - F.col("_m20f"),
        "pressure_baseline_pct": lambda: ratio(p - F.col("_m20p"), F.abs(F.col("_m20p"))),
        "pressure_roll30_std": lambda: F.col("_s30p"),
        "flow_roll30_std": lambda: F.col("_s30f"),
        "pressure_flow_divergence": lambda: (
            ratio(p - F.col("_m30p"), F.abs(F.col("_m30p"))) - ratio(f - F.col("_m30f"), F.abs(F.col("_m30f")))
        ),
        "pressure_ema_dev": lambda: p - F.col("_ep"),
        "flow_ema_dev": lambda: f - F.col("_ef"),
        "pressure_baseline60_dev": lambda: p - F.col("_m90p"),
        "flow_baseline60_dev": lambda: f - F.col("_m90f"),
        "pressure_expanding_dev": lambda: p - F.col("_xpm"),
        "flow_expanding_dev": lambda: f - F.col("_xfm"),
    }
    df = df.withColumns({name: make() for name, make in third.items() if name in want})
    scratch = [c for c in df.columns if c.startswith("_")]
    df = df.where(keep).drop(*scratch)
    if many:
        df = df.select(*[c for c in df.columns if c not in CROSS_SEGMENT], *CROSS_SEGMENT)
    elif across:  # wide rows stay where they are
        df = segment_deviations(df, F.broadcast(means), tick)
    if encode_events and "event_type" in df.columns:
        df = category_codes(df, "event_type", "event_type_encoded")
    hidden = [name for name in DELTAS if name not in want]
    return df.drop(*hidden) if wanted is not None else df


def sensor_features(
    df: DataFrame,
    series: Series,
    sensors: list[str] = ("pressure", "flow_rate", "temperature", "vibration", "rpm", "power"),
    window: int = 5,
) -> DataFrame:
    """Generic rolling features for whichever sensors a table has.

    Per sensor: value carried forward (then 0), rolling mean, deviation, minimum, maximum and the
    step from the row before; plus pressure over flow, where zero flow divides by mean pressure.
    """
    present = [c for c in sensors if c in df.columns]
    has_ratio = {"pressure", "flow_rate"} <= set(df.columns)
    if has_ratio:
        mean_pressure = df.agg(F.avg(F.coalesce(finite("pressure"), F.lit(0.0)))).scalar()
        safe = F.coalesce(F.nullif(F.coalesce(finite("flow_rate"), F.lit(0.0)), F.lit(0.0)), mean_pressure)
        df = df.withColumn("pressure_flow_ratio", F.coalesce(finite("pressure"), F.lit(0.0)) / safe)
    df = scan(df, series, last_valid={f"_v_{c}": finite(c) for c in present})
    df = df.withColumns({c: F.coalesce(F.col(f"_v_{c}"), F.lit(0.0)) for c in present})
    df = df.drop(*[f"_v_{c}" for c in present])
    df, local, keep = frames(df, series, window)
    w = local.window()
    out: dict[str, Column] = {}
    for c in present:
        out[f"{c}_roll_mean"] = F.avg(c).over(rows(w, window))
        out[f"{c}_roll_std"] = F.stddev_samp(c).over(rows(w, window))
        out[f"{c}_roll_min"] = F.min(c).over(rows(w, window))
        out[f"{c}_roll_max"] = F.max(c).over(rows(w, window))
        out[f"{c}_delta"] = F.coalesce(F.col(c) - F.lag(c).over(w), F.lit(0.0))
    df = df.withColumns(out).where(keep)
    df = df.withColumns({f"{c}_roll_std": flat_to_zero(f"{c}_roll_std") for c in present})
    return df.drop(*[c for c in df.columns if c.startswith("_")])
