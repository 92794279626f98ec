"""Joins between telemetry, scores, dimensions and incident intervals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import MapType

from .series import Series, scan

SCORE_KEY = ["segment_id", "timestamp"]


def tie_hash(df: DataFrame, columns: Sequence[str]) -> Column:
    """A hash that tells rows of equal order apart; maps, which have no hash, go in as their sorted entries."""
    maps = {f.name for f in df.schema.fields if isinstance(f.dataType, MapType)}
    return F.xxhash64(*[F.array_sort(F.map_entries(c)) if c in maps else F.col(c) for c in columns]).alias("_tie")


def latest_per_key(df: DataFrame, keys: Sequence[str], arrival: Sequence[str]) -> DataFrame:
    """Keep the row that arrived last for each key; copies of a key are reduced before the shuffle.

    Of rows that arrived together the one with the largest hash of its other columns stays, whatever the partitions.
    """
    rest = [c for c in df.columns if c not in keys]
    newest = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*arrival, tie_hash(df, rest))).alias("_row"))
    return newest.select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest])


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Keep the first row of each key; of equals the one with the smallest hash of its other columns."""
    rest = [c for c in df.columns if c not in keys]
    oldest = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order, tie_hash(df, rest))).alias("_row"))
    return oldest.select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest])


def matching(left: DataFrame, right: DataFrame, keys: Sequence[str] = SCORE_KEY) -> DataFrame:
    """Left rows whose key occurs on the right."""
    return left.join(right.select(*keys), list(keys), "left_semi")


def missing(left: DataFrame, right: DataFrame, keys: Sequence[str] = SCORE_KEY) -> DataFrame:
    """Left rows whose key does not occur on the right."""
    return left.join(right.select(*keys), list(keys), "left_anti")


def lookup(left: DataFrame, right: DataFrame, keys: Sequence[str], arrival: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Attach ``values`` of the last right row per key; NULL where there is none."""
    table = latest_per_key(right.select(*dict.fromkeys([*keys, *values, *arrival])), keys, arrival)
    return left.join(table.select(*keys, *values), list(keys), "left")


def with_statistics(df: DataFrame, **stats: Column) -> DataFrame:
    """Attach whole-table statistics to every row, as a scalar subquery rather than a join."""
    one = df.agg(F.struct(*[c.alias(n) for n, c in stats.items()])).scalar()
    wide = df.withColumn("_stats", one)
    return wide.select(*df.columns, *[F.col(f"_stats.{n}").alias(n) for n in stats])


def explode_segments(events: DataFrame, ids: str = "segment_ids", out: str = "segment_id") -> DataFrame:
    """One row per segment named in a comma-separated list."""
    parts = F.transform(F.split(F.col(ids), ","), lambda s: F.trim(s).try_cast("int"))
    return events.withColumn(out, F.explode(parts))


def _ticks(df: DataFrame, c: str, unit: int) -> Column:
    """A time (microseconds are kept) or number as a whole number of ``unit``, rounded down."""
    if df.schema[c].dataType.simpleString().startswith("timestamp"):
        return F.floor(F.unix_micros(F.col(c).cast("timestamp")) / F.lit(unit * 1_000_000)).cast("long")
    return F.floor(F.col(c) / unit).cast("long")


def dyadic_nodes(lo: Column, hi: Column) -> Column:
    """The dyadic nodes ``(level, node)`` that make up the ticks from ``lo`` to before ``hi``: two a level at most.

    Node ``n`` of level ``l`` covers the ticks from ``n * 2**l`` to before ``(n + 1) * 2**l``. An interval of ``m`` ticks
    consists of fewer than ``2 * log2(m) + 2`` of them; an empty one, or one with an unknown end, of none.
    """
    def at(level: Column) -> Column:
        # what is left of the interval on this level; an odd end is a node that no node above covers
        first = -F.call_function("shiftright", -lo, level)
        last = F.call_function("shiftright", hi, level)
        left = F.when((first < last) & (first.bitwiseAND(1) == 1), F.struct(level.alias("level"), first.alias("node")))
        right = F.when((first < last) & (last.bitwiseAND(1) == 1), F.struct(level.alias("level"), (last - 1).alias("node")))
        return F.array(left, right)

    return F.array_compact(F.flatten(F.transform(F.sequence(F.lit(0), F.lit(62)), at)))


def interval_join(
    rows: DataFrame,
    events: DataFrame,
    keys: Sequence[str],
    at: str,
    start: str,
    end: str,
    unit: int = 1,
) -> DataFrame:
    """Rows with the events whose half-open ``[start, end)`` contains them.

    Events are looked up through a dyadic index: an interval is stored under the few nodes that make it up, and a row
    looks at the node above it on each level that some event uses, so neither a long interval nor a busy key is copied
    per stretch of time. ``unit`` is the width of a tick (seconds for timestamps, else as ``at``); coarser ticks give
    fewer levels, and the ends are compared exactly in any case. NULL is a key like any other; intervals that are empty
    or lack an end, and rows without a time, meet nothing.
    """
    hi = _ticks(events, end, unit)
    # the tick in which the interval ends counts unless the end is its first moment; the exact test drops what is too much
    nodes = dyadic_nodes(_ticks(events, start, unit), hi + 1)
    stored = events.where(F.col(start) < F.col(end)).withColumn("_node", F.explode(nodes))
    levels = sorted(r[0] for r in stored.select("_node.level").distinct().collect())  # 63 numbers at most
    stored = stored.select(*[F.col(c).alias(f"_e_{c}") if c in rows.columns else F.col(c) for c in events.columns], "_node")
    tick = _ticks(rows, at, unit)
    above = [F.struct(F.lit(v).alias("level"), F.shiftright(tick, v).alias("node")) for v in levels]
    kind = "array<struct<level:int,node:bigint>>"
    asked = rows.withColumn("_at", F.explode(F.array(*above).cast(kind)))
    named = {c: (f"_e_{c}" if c in rows.columns else c) for c in [*keys, start, end]}
    on = [asked["_at"] == stored["_node"], *[asked[k].eqNullSafe(stored[named[k]]) for k in keys]]
    on += [asked[at] >= stored[named[start]], asked[at] < stored[named[end]]]
    return asked.join(stored, on).drop("_at", "_node", *[named[k] for k in keys])


# Severity from which a leak event of this kind labels a row positive.
TARGET_FLOORS = {"micro_leak": 0.03, "borderline_leak": 0.10}
OTHER_TARGET_FLOOR = 0.12


def label_with_incidents(
    rows: DataFrame,
    events: DataFrame,
    row_key: Sequence[str],
    keys: Sequence[str],
    at: str,
    start: str,
    end: str,
    unit: int,
    leak_types: Sequence[str],
) -> DataFrame:
    """Roll the incidents covering a row up onto it.

    Events apply in order of (start, type, id): leaks raise severity and own ``active_event_id``;
    disturbances take it only while it is empty. Rows without incidents come through unchanged.
    """
    hits = interval_join(
        rows.select(*dict.fromkeys([*row_key, *keys, at])),
        events.select(*keys, start, end, "event_id", F.col("event_type").alias("incident_type"), "intensity"),
        keys, at, start, end, unit,
    )
    leak = F.col("incident_type").isin(list(leak_types))
    rank = F.struct(F.col(start), "incident_type", "event_id")
    floors = {kind: v for kind, v in TARGET_FLOORS.items() if kind in leak_types}
    floor = F.lit(OTHER_TARGET_FLOOR)
    for kind, value in floors.items():
        floor = F.when(F.col("incident_type") == kind, value).otherwise(floor)
    levels = sorted({*floors.values(), OTHER_TARGET_FLOOR})
    # per row and incident type first: what remains per row is one entry per type
    typed = hits.groupBy(*row_key, "incident_type").agg(
        F.bool_or(leak).alias("_leak"),
        F.max(floor).alias("_floor"),
        F.max(F.when(leak, F.col("intensity"))).alias("_sev"),
        F.min(rank).alias("_lo"),
        F.max(rank).alias("_hi"),
        *[F.min(F.when(leak & (F.col("intensity") >= v), rank)).alias(f"_from{i}") for i, v in enumerate(levels)],
    )
    rolled = typed.groupBy(*row_key).agg(
        F.coalesce(F.max("_sev"), F.lit(0.0)).alias("leak_severity"),
        F.max(F.when(F.col("_leak"), F.col("_hi")))["event_id"].alias("_leak_id"),
        F.min(F.when(~F.col("_leak"), F.col("_lo")))["event_id"].alias("_other_id"),
        F.bool_or(~F.col("_leak")).alias("_disturbed"),
        F.array_sort(F.collect_list(F.struct("_lo", "incident_type"))).alias("_types"),
        *[F.min(f"_from{i}").alias(f"_from{i}") for i in range(len(levels))],
        *[F.max(F.when(F.col("_leak") & (F.col("_floor") == v), F.col("_hi"))).alias(f"_to{i}")
          for i, v in enumerate(levels)],
    )
    # severity is a running maximum, so an event labels the row if any event up to it reached its floor
    labelled = F.lit(False)
    for i in range(len(levels)):
        labelled = labelled | F.coalesce(F.col(f"_from{i}") <= F.col(f"_to{i}"), F.lit(False))
    rolled = rolled.select(
        *row_key,
        "leak_severity",
        labelled.cast("int").alias("target"),
        F.array_join(F.transform("_types", lambda t: t["incident_type"]), "|").alias("scenario_context"),
        F.when(F.col("leak_severity") >= 0.45, "fault")
        .when((F.col("leak_severity") >= 0.12) | F.col("_disturbed"), "warning")
        .otherwise("normal").alias("event_type"),
        (F.col("leak_severity") >= 0.35).cast("int").alias("alarm_triggered"),
        F.coalesce("_leak_id", "_other_id").cast("string").alias("active_event_id"),
    )
    blank = {"leak_severity": F.lit(0.0), "target": F.lit(0), "scenario_context": F.lit("nominal"),
             "event_type": F.lit("normal"), "alarm_triggered": F.lit(0), "active_event_id": F.lit("")}
    kept = rows.drop(*[c for c in blank if c in rows.columns])
    joined = kept.join(rolled, list(row_key), "left")
    return joined.withColumns({c: F.coalesce(F.col(c), v) for c, v in blank.items()})


def gap_conflicts(events: DataFrame, series: Series, start: str, end: str, gap_seconds: int) -> DataFrame:
    """Flag events starting before every earlier event of the key has ended and the gap has passed.

    ``series`` orders events by start. An event conflicts with some earlier one exactly when it starts
    before the largest earlier end plus the gap, so one running maximum replaces comparing all pairs.
    """
    ends = F.unix_timestamp(end)
    df = scan(events, series, maxima={"_end": ends})
    df = scan(df, series, previous={"_before": F.col("_end")})
    clash = F.unix_timestamp(start) < F.col("_before") + gap_seconds
    return df.withColumn("conflict", F.coalesce(clash, F.lit(False))).drop("_end", "_before")


def paired_difference(baseline: DataFrame, changed: DataFrame, keys: Sequence[str], signals: Sequence[str]) -> DataFrame:
    """Changed run minus baseline run, aligned on the keys."""
    left = changed.select(*keys, *signals)
    right = baseline.select(*keys, *[F.col(c).alias(f"_b_{c}") for c in signals])
    both = left.join(right, list(keys))
    return both.select(*keys, *[(F.col(c) - F.col(f"_b_{c}")).alias(f"{c}_effect") for c in signals])
