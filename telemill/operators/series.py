"""Ordered series at scale.

Every time-series operator works on rows of one key in a fixed order. A plain
window sends a whole key to one task, which breaks down when a single key holds
a large share of the table. ``Series`` therefore names, besides keys and order,
an optional *slot*: an expression that never decreases along the order and cuts a
long series into pieces. With a slot, operators run inside ``(key, slot)`` and
bring what came before as a carried value, computed from one small summary row
per slot; results equal those of the plain window.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, replace
from uuid import uuid4

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from ..session import checkpoint_dir, setting
from .keys import join_keys

SLOT = "_slot"
MAX_ROWS_PER_TASK = 5_000_000
PER_SLOT = 32  # sampled rows that a slot is cut from
FAN = 1024  # marks in one node of the tree that finds a row's slot


@dataclass(frozen=True)
class Series:
    """Keys, total order within a key, and the slot cutting long keys (``None``: whole keys).

    ``cuts`` holds, from the root down, the levels of a tree over the marks at which long keys are cut: per key and node
    up to ``fan`` marks. Without it ``slot`` is an expression over the rows.
    """

    keys: tuple[str, ...]
    order: tuple[str, ...]
    slot: Column | None = None
    cuts: tuple[DataFrame, ...] = ()
    fan: int = FAN

    @property
    def parts(self) -> list[str]:
        return list(self.keys) + ([SLOT] if self.slot is not None else [])

    def slotted(self, df: DataFrame) -> DataFrame:
        if self.slot is None:
            return df
        if not self.cuts:
            return df.withColumn(SLOT, self.slot)
        names, below = df.columns, marks_upto(F.col("_marks"), self.rank(), self.fan)
        root, *rest = self.cuts
        out = join_keys(df, root, self.keys, "left").select(*names, below.alias(SLOT))
        for level in rest:
            inner = join_keys(out, level, [*self.keys, SLOT], "left")
            out = inner.select(*names, (F.col(SLOT) * self.fan + below).alias(SLOT))
        return out

    def window(self) -> WindowSpec:
        return Window.partitionBy(*self.parts).orderBy(*self.order)

    def backward(self) -> WindowSpec:
        """The same rows from last to first: running frames over it look ahead and stay linear."""
        return Window.partitionBy(*self.parts).orderBy(*[F.col(c).desc() for c in self.order])

    def rank(self) -> Column:
        return F.struct(*self.order)


def marks_upto(marks: Column, rank: Column, most: int) -> Column:
    """How many of at most ``most`` sorted marks lie at or below ``rank``, by halving; 0 where there are none."""
    steps = F.array(*[F.lit(1 << i) for i in reversed(range(most.bit_length()))])
    found = F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.get(marks, at + step - 1) <= rank, at + step).otherwise(at))
    return found.cast("long")


def time_series(
    df: DataFrame,
    keys: list[str],
    time: str = "timestamp",
    tiebreak: list[str] = ("seq",),
    max_rows: int | None = None,
) -> Series:
    """A series ordered by ``(time, *tiebreak)``, cut where a key is too long for one task.

    One pruned, pre-aggregated pass counts rows per key; each key beyond the limit is cut at marks of its own order, see
    ``cut_series``. A burst of rows at one time is cut by the tiebreak.
    """
    return cut_series(df, Series(tuple(keys), (time, *tiebreak)), df, max_rows)


def value_series(
    df: DataFrame, keys: list[str], value: str, source: DataFrame | None = None, max_rows: int | None = None,
) -> Series:
    """A series ordered by a numeric value, cut as ``time_series`` is.

    Expects one row per ``(keys, value)``; ``source`` is a table with at least as many rows of each key that is cheaper
    to count.
    """
    return cut_series(df, Series(tuple(keys), (value,)), df if source is None else source, max_rows)


def cut_series(df: DataFrame, plain: Series, counted: DataFrame, max_rows: int | None = None, fan: int = FAN) -> Series:
    """The series with the keys of more than ``max_rows`` rows in ``counted`` cut into slots of about half that.

    Rows of long keys are sampled by a hash, one in some 80,000 at the default limit, and every ``PER_SLOT``-th of a
    key's sample in its order ``(time, tiebreak)`` is a mark. The number of slots grows with the key and has no limit. A
    row finds its slot by halving inside a tree of marks of as many levels as the longest key needs, so it never carries
    more than ``fan`` of them. The tree is written to the shared folder: slots stay the same in every pass, and its
    size is known to the planner when it chooses how to join.
    """
    spark, keys, order = df.sparkSession, plain.keys, plain.order
    limit = max_rows or setting(spark, "series.maxRowsPerTask", MAX_ROWS_PER_TASK)
    sizes = counted.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > limit)
    if sizes.isEmpty():
        return plain
    every = max(1, limit // (2 * PER_SLOT))
    per = max(1, limit // (2 * every))
    rows = join_keys(df.select(*dict.fromkeys([*keys, *order])), sizes, keys)
    if every > 1:
        rows = rows.where(F.pmod(F.xxhash64(*keys, *order), F.lit(every)) == 0)
    placed = rows.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    at = (F.col("_k") / per).cast("long") - 1
    folder = f"{checkpoint_dir(spark)}/series-{uuid4().hex}"
    marks = stored(placed.where(F.col("_k") % per == 0).select(*keys, plain.rank().alias("_mark"), at.alias("_k")), f"{folder}/marks")
    last = marks.agg(F.max("_k")).first()[0]
    if last is None:
        return plain
    levels = 1
    while fan**levels <= last:
        levels += 1
    cuts = []
    for level in reversed(range(levels)):
        step = fan**level
        # above the leaves a node's first mark goes without saying
        held = (F.col("_k") % step == 0) & (F.lit(level == 0) | (F.col("_k") % (step * fan) != 0))
        node = (F.col("_k") / (step * fan)).cast("long").alias(SLOT)
        table = marks.where(held).groupBy(*keys, node).agg(F.sort_array(F.collect_list("_mark")).alias("_marks"))
        table = stored(table, f"{folder}/level{level}")
        cuts.append(table if cuts else table.drop(SLOT))
    return replace(plain, slot=F.col(SLOT), cuts=tuple(cuts), fan=fan)


def stored(df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def scan(
    df: DataFrame,
    series: Series,
    *,
    position: str | None = None,
    sums: Mapping[str, Column] | None = None,
    maxima: Mapping[str, Column] | None = None,
    previous: Mapping[str, Column] | None = None,
    last_valid: Mapping[str, Column] | None = None,
    next_valid: Mapping[str, Column] | None = None,
) -> DataFrame:
    """Add running values along a series.

    ``position``    1-based row number in the key
    ``sums``        running sum up to and including the row
    ``maxima``      running maximum up to and including the row
    ``previous``    value at the row before (NULL at the first)
    ``last_valid``  latest non-NULL value at or before the row
    ``next_valid``  earliest non-NULL value at or after the row

    NULL is a key like any other.
    """
    sums, maxima, previous = sums or {}, maxima or {}, previous or {}
    last_valid, next_valid = last_valid or {}, next_valid or {}
    w = series.window()
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    ahead = series.backward().rowsBetween(Window.unboundedPreceding, 0)
    base = series.slotted(df)
    rn = F.row_number().over(w)

    if series.slot is None:
        cols: dict[str, Column] = {}
        if position:
            cols[position] = rn
        cols |= {k: F.sum(e).over(upto) for k, e in sums.items()}
        cols |= {k: F.max(e).over(upto) for k, e in maxima.items()}
        cols |= {k: F.lag(e).over(w) for k, e in previous.items()}
        cols |= {k: F.last(e, ignorenulls=True).over(upto) for k, e in last_valid.items()}
        cols |= {k: F.last(e, ignorenulls=True).over(ahead) for k, e in next_valid.items()}
        return base.withColumns(cols)

    aggs = [F.count(F.lit(1)).alias("_c_n")]
    aggs += [F.sum(e).alias(f"_c_{k}") for k, e in sums.items()]
    aggs += [F.max(e).alias(f"_c_{k}") for k, e in maxima.items()]
    aggs += [F.max_by(F.struct(e.alias("v")), series.rank()).alias(f"_c_{k}") for k, e in previous.items()]
    aggs += [F.max_by(e, F.when(e.isNotNull(), series.rank())).alias(f"_c_{k}") for k, e in last_valid.items()]
    aggs += [F.min_by(e, F.when(e.isNotNull(), series.rank())).alias(f"_c_{k}") for k, e in next_valid.items()]
    slots = base.groupBy(*series.parts).agg(*aggs)
    along = Window.partitionBy(*series.keys).orderBy(SLOT)
    before = along.rowsBetween(Window.unboundedPreceding, -1)
    beyond = Window.partitionBy(*series.keys).orderBy(F.col(SLOT).desc()).rowsBetween(Window.unboundedPreceding, -1)
    carried = [F.coalesce(F.sum("_c_n").over(before), F.lit(0)).alias("_c_n")]
    carried += [F.sum(f"_c_{k}").over(before).alias(f"_c_{k}") for k in sums]
    carried += [F.max(f"_c_{k}").over(before).alias(f"_c_{k}") for k in maxima]
    carried += [F.lag(f"_c_{k}").over(along)["v"].alias(f"_c_{k}") for k in previous]
    carried += [F.last(f"_c_{k}", ignorenulls=True).over(before).alias(f"_c_{k}") for k in last_valid]
    carried += [F.last(f"_c_{k}", ignorenulls=True).over(beyond).alias(f"_c_{k}") for k in next_valid]
    carry = slots.select(*series.parts, *carried)
    joined = join_keys(base, carry, series.parts, "left")

    cols = {}
    if position:
        cols[position] = (F.coalesce(F.col("_c_n"), F.lit(0)) + rn).cast("long")
    for k, e in sums.items():
        here = F.sum(e).over(upto)
        cols[k] = F.when(here.isNull(), F.col(f"_c_{k}")).otherwise(here + F.coalesce(F.col(f"_c_{k}"), F.lit(0)))
    cols |= {k: F.greatest(F.max(e).over(upto), F.col(f"_c_{k}")) for k, e in maxima.items()}
    cols |= {k: F.when(rn == 1, F.col(f"_c_{k}")).otherwise(F.lag(e).over(w)) for k, e in previous.items()}
    cols |= {k: F.coalesce(F.last(e, ignorenulls=True).over(upto), F.col(f"_c_{k}")) for k, e in last_valid.items()}
    cols |= {k: F.coalesce(F.last(e, ignorenulls=True).over(ahead), F.col(f"_c_{k}")) for k, e in next_valid.items()}
    names = ["_c_n"] + [f"_c_{k}" for m in (sums, maxima, previous, last_valid, next_valid) for k in m]
    return joined.withColumns(cols).drop(*names, SLOT)


def frames(df: DataFrame, series: Series, halo: int, block: int = 1_000_000) -> tuple[DataFrame, Series, Column]:
    """Prepare rows for frames reaching back at most ``halo`` rows.

    Returns the rows, the series to window over, and a filter to apply afterwards. Whole keys
    come back untouched. Long keys are cut into equal blocks by position; the last ``halo`` rows
    of a block are repeated at the head of the next, where the filter drops them again.
    """
    if series.slot is None:
        return df, series, F.lit(True)
    if block <= halo:
        raise ValueError("block must exceed halo")
    placed = scan(df, series, position="_pos")
    at, off = F.floor((F.col("_pos") - 1) / block), F.pmod(F.col("_pos") - 1, F.lit(block))
    copies = F.when(off >= block - halo, F.array(at, at + 1)).otherwise(F.array(at))
    rows = placed.withColumn("_home", at).withColumn("_block", F.explode(copies))
    keep = F.col("_block") == F.col("_home")
    return rows, Series((*series.keys, "_block"), ("_pos",)), keep
