"""Exact quantiles without gathering a group's values in one task."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .keys import join_keys
from .series import scan, value_series


def exact_quantiles(df: DataFrame, keys: list[str], value: str, probs: Mapping[str, float]) -> DataFrame:
    """Linearly interpolated quantiles per key, one column per entry of ``probs``.

    Equal values are counted first; running counts then show which values hold the two ranks
    around each quantile, so no task sees more than its slice of the distinct values.
    """
    counts = (
        df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    )
    series = value_series(counts, keys, value, df)
    placed = scan(counts, series, sums={"_upto": F.col("_n")})
    if series.slot is None:
        whole = series.window().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        placed = placed.withColumn("_total", F.sum("_n").over(whole))
    else:
        totals = counts.groupBy(*keys).agg(F.sum("_n").alias("_total"))
        placed = join_keys(placed, totals, keys)
    picks = []
    for name, p in probs.items():
        at = (F.col("_total") - 1) * p
        for side, rank in (("lo", F.floor(at)), ("hi", F.ceil(at))):
            held = (rank >= F.col("_upto") - F.col("_n")) & (rank < F.col("_upto"))
            picks.append(F.max(F.when(held, F.col(value))).alias(f"_{name}_{side}"))
        picks.append(F.max(at - F.floor(at)).alias(f"_{name}_part"))
    found = placed.groupBy(*keys).agg(*picks)
    out = [
        (F.col(f"_{n}_lo") + (F.col(f"_{n}_hi") - F.col(f"_{n}_lo")) * F.col(f"_{n}_part")).alias(n) for n in probs
    ]
    return found.select(*keys, *out)
