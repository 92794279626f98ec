"""Repeatable sampling and splitting by hash rank; no row order or random state involved."""

from __future__ import annotations

from collections.abc import Sequence
from uuid import uuid4

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import checkpoint_dir
from .keys import join_keys
from .series import Series, scan, stored

BUCKET_DIGITS = (3, 6, 9)  # hash digits counted in each round: 4096 buckets, then as many inside the one that matters


def hash_rank(seed: int, key: Sequence[str]) -> Column:
    """Hash deciding a row's place among its equals."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in key]))


def cutoffs(df: DataFrame, group: Sequence[str], key: Sequence[str], quotas: DataFrame, seed: int = 42) -> DataFrame:
    """Where each group's quota ends in hash order: ``(group, quota, cutoff)``, cutoff NULL where all rows fit.

    Counts per hash bucket show which bucket holds the last row wanted; that bucket alone is counted again by a longer
    prefix, and the bucket left after ``BUCKET_DIGITS`` rounds, less than a 10^10th of the group, is ranked. NULL is a
    group like any other. The table is read twice, to count and for the rows of the first round's bucket, a 4096th of it.
    All tables of a row per group are written to the checkpoint folder: their size is known to the planner, so that few
    groups are joined without dealing all rows out by group, and the rows are afterwards picked by a filter alone.
    """
    folder = f"{checkpoint_dir(df.sparkSession)}/cutoffs-{uuid4().hex}"
    quotas = stored(quotas.select(*group, "quota"), f"{folder}/quotas")
    rows = df.select(*dict.fromkeys([*group, *key])).withColumn("_hash", hash_rank(seed, key))
    edge = quotas.select(*group, F.col("quota").alias("_room"))
    within = list(group)
    for digits in BUCKET_DIGITS:
        rows = rows.withColumn(f"_b{digits}", F.substring("_hash", 1, digits))
        near = join_keys(rows, edge, within) if within else rows.withColumn("_room", edge.select("_room").scalar())
        sizes = near.groupBy(*within, f"_b{digits}").agg(F.count(F.lit(1)).alias("_n"), F.max("_room").alias("_room"))
        before = Window.partitionBy(*within).orderBy(f"_b{digits}").rowsBetween(Window.unboundedPreceding, -1)
        places = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
        within = [*within, f"_b{digits}"]
        edge = places.where((F.col("_before") < F.col("_room")) & (F.col("_room") <= F.col("_before") + F.col("_n")))
        edge = stored(edge.select(*within, (F.col("_room") - F.col("_before")).alias("_room")), f"{folder}/edge{digits}")
        if digits == BUCKET_DIGITS[0]:
            rows = stored(join_keys(rows, edge, within).drop("_room"), f"{folder}/rows")
    ranked = Window.partitionBy(*within).orderBy("_hash", *key)
    last = join_keys(rows, edge, within).withColumn("_rank", F.row_number().over(ranked))
    last = last.where(F.col("_rank") == F.col("_room"))
    found = last.groupBy(*group).agg(F.max(F.struct("_hash", *key)).alias("cutoff"))
    if group:
        return stored(join_keys(quotas, found, list(group), "left"), f"{folder}/ends")
    return stored(quotas.withColumn("cutoff", found.select("cutoff").scalar()), f"{folder}/ends")


def take(df: DataFrame, group: Sequence[str], key: Sequence[str], quotas: DataFrame, seed: int = 42) -> DataFrame:
    """The ``quota`` rows of lowest hash in each group; ``quotas`` holds ``(group, quota)``."""
    ends = cutoffs(df, group, key, quotas, seed)
    fits = (F.col("_quota") > 0) & (F.col("_cutoff").isNull() | (F.struct(hash_rank(seed, key).alias("_hash"), *key) <= F.col("_cutoff")))
    ends = ends.withColumnsRenamed({"quota": "_quota", "cutoff": "_cutoff"})
    if group:
        return join_keys(df, ends, list(group)).where(fits).select(*df.columns)
    one = df.withColumn("_end", ends.select(F.struct("_quota", "_cutoff")).scalar())
    one = one.withColumns({"_quota": F.col("_end._quota"), "_cutoff": F.col("_end._cutoff")})
    return one.where(fits).select(*df.columns)


def rebalance(
    df: DataFrame, key: Sequence[str], ratio: float = 3.0, by: Sequence[str] = (), seed: int = 42, cap: int | None = None,
) -> DataFrame:
    """Keep positives and at most ``ratio`` negatives per positive, then at most ``cap`` rows, per ``by``.

    A group lacking either class is left as it is; a reduced one holds labels 0 and 1 only.
    """
    counts = df.groupBy(*by).agg(F.count_if(F.col("target") == 1).alias("_pos"), F.count_if(F.col("target") == 0).alias("_neg"))
    limit = F.floor(F.col("_pos") * ratio)
    reduced = (F.col("_pos") > 0) & (F.col("_neg") > 0) & (F.col("_neg") > limit)
    plan = counts.select(*by, reduced.alias("_reduce"), F.when(reduced, limit).alias("quota"))
    # one small row per group decides everything; the rows are then read once and filtered
    ends = cutoffs(df.where(F.col("target") == 0), by, key, plan.where("_reduce").select(*by, "quota"), seed)
    ends = ends.withColumnsRenamed({"quota": "_quota", "cutoff": "_cutoff"})
    inside = (F.col("_quota") > 0) & (F.col("_cutoff").isNull() | (F.struct(hash_rank(seed, key).alias("_hash"), *key) <= F.col("_cutoff")))
    keep = F.col("_quota").isNull() | (F.col("target") == 1) | ((F.col("target") == 0) & inside)
    if by:
        out = join_keys(df, ends, list(by), "left").where(keep).select(*df.columns)
    else:
        one = df.withColumn("_end", ends.select(F.struct("_quota", "_cutoff")).scalar())
        out = one.withColumns({"_quota": F.col("_end._quota"), "_cutoff": F.col("_end._cutoff")}).where(keep).select(*df.columns)
    return out if cap is None else cap_rows(out, key, cap, by, seed)


def cap_rows(df: DataFrame, key: Sequence[str], cap: int, by: Sequence[str] = (), seed: int = 42) -> DataFrame:
    """At most ``cap`` rows per source."""
    quotas = df.groupBy(*by).agg(F.lit(cap).alias("quota")) if by else df.sparkSession.range(1).select(F.lit(cap).alias("quota"))
    return take(df, by, key, quotas, seed)


def class_capped(df: DataFrame, key: Sequence[str], max_rows: int, seed: int = 42) -> DataFrame:
    """At most ``max_rows`` rows, of which at most a third are positive; untouched when already small enough.

    A table that is reduced keeps labels 0 and 1 only; one that is small enough keeps rows of every label.
    """
    one = df.agg(F.count_if(F.col("target") == 1).alias("pos"), F.count_if(F.col("target") == 0).alias("neg"), F.count(F.lit(1)).alias("n"))
    fits = F.col("n") <= max_rows
    pos = F.when(fits, F.col("pos")).otherwise(F.least("pos", F.lit(max_rows // 3)))
    neg = F.when(fits, F.col("neg")).otherwise(F.least(F.col("neg"), max_rows - pos))
    others = F.when(fits, F.col("n") - F.col("pos") - F.col("neg")).otherwise(0)
    kind = F.when(F.col("target") == 1, 1).when(F.col("target") == 0, 0).otherwise(2)
    quotas = one.select(F.explode(F.array(*[
        F.struct(F.lit(k).alias("_kind"), n.cast("long").alias("quota")) for k, n in ((1, pos), (0, neg), (2, others))])).alias("q"))
    return take(df.withColumn("_kind", kind), ["_kind"], key, quotas.select("q._kind", "q.quota"), seed).drop("_kind")


def group_table(df: DataFrame, group: str, label: str = "target") -> DataFrame:
    """One row per group: its size and its label, the maximum over its rows."""
    return df.groupBy(group).agg(F.count(F.lit(1)).alias("rows"), F.max(label).alias("label"))


def sample_groups(df: DataFrame, group: str, max_groups: int, seed: int = 42) -> DataFrame:
    """Rows of at most ``max_groups`` whole groups, labels in proportion, at least one positive group.

    A group without any label counts as normal.
    """
    groups = group_table(df, group).withColumn("label", F.coalesce("label", F.lit(0)))
    one = groups.agg(F.count_if(F.col("label") == 1).alias("a"), F.count_if(F.col("label") == 0).alias("b"), F.count(F.lit(1)).alias("n"))
    share = F.rint(max_groups * F.col("a") / F.col("n")).cast("long")
    share = F.least("a", F.when(F.col("a") > 0, F.greatest(F.lit(1), share)).otherwise(share))
    normal = F.least(F.col("b"), max_groups - share)
    positive = F.least(F.col("a"), max_groups - normal)
    fits = F.col("n") <= max_groups
    quotas = one.select(F.explode(F.array(
        F.struct(F.lit(1).alias("label"), F.when(fits, F.col("a")).otherwise(positive).alias("quota")),
        F.struct(F.lit(0).alias("label"), F.when(fits, F.col("b")).otherwise(normal).alias("quota")))).alias("q"))
    chosen = take(groups, ["label"], [group], quotas.select("q.label", "q.quota"), seed)
    picked = chosen.select(F.col(group).alias("_picked"))
    return df.join(picked, F.col(group).eqNullSafe(F.col("_picked")), "left_semi")


def stratified_split(df: DataFrame, key: Sequence[str], label: str, fractions: dict[str, float], seed: int = 42) -> DataFrame:
    """Assign each row to a named part, keeping the share of every label; the last part takes the rest.

    ``fractions`` names every part but the last with its share, e.g. ``{"test": .2, "valid": .1, "train": 0}``.
    """
    sizes = df.groupBy(label).agg(F.count(F.lit(1)).alias("_size"))
    names = list(fractions)
    edge, part = F.lit(0).cast("long"), F.lit(names[-1])
    ends, bounds = None, []
    for i, name in enumerate(names[:-1]):
        edge = edge + F.ceil(F.col("_size") * fractions[name])
        end = cutoffs(df, [label], key, sizes.select(label, edge.alias("quota")), seed)
        end = end.withColumnsRenamed({"quota": f"_q{i}", "cutoff": f"_c{i}"})
        ends = end if ends is None else join_keys(ends, end, [label])
        place = F.struct(hash_rank(seed, key).alias("_hash"), *key)
        inside = (F.col(f"_q{i}") > 0) & (F.col(f"_c{i}").isNull() | (place <= F.col(f"_c{i}")))
        bounds.append((name, inside))
    if ends is None:
        return df.withColumn("part", part)
    for name, inside in reversed(bounds):
        part = F.when(inside, name).otherwise(part)
    return join_keys(df, ends, [label]).withColumn("part", part).select(*df.columns, "part")


def group_split(df: DataFrame, group: str, fractions: dict[str, float], seed: int = 42, label: str = "target") -> DataFrame:
    """Split whole groups, stratified by group label."""
    parts = stratified_split(group_table(df, group, label), [group], "label", fractions, seed)
    return join_keys(df, parts.select(group, "part"), [group])


def group_folds(df: DataFrame, group: str, k: int = 5, seed: int = 42, label: str = "target") -> DataFrame:
    """Assign folds so that no group is split, labels spread evenly and fold sizes stay close.

    Groups of a label are ranked by size class (power of two), then hash, and dealt out back and forth.
    """
    groups = group_table(df, group, label).withColumns({
        "_size": F.floor(F.log2("rows")).cast("int"), "_hash": hash_rank(seed, [group])})
    order = F.format_string("%03d%s", 999 - F.col("_size"), F.substring("_hash", 1, 2))
    groups = groups.withColumn("_order", F.format_string("%03d%s", 999 - F.col("_size"), F.col("_hash")))
    ranked = scan(groups, Series(("label",), ("_order", group), order), position="_rank")
    lap, at = F.floor((F.col("_rank") - 1) / k), F.pmod(F.col("_rank") - 1, F.lit(k))
    # laps run forth and back; each label starts at another fold so that leftovers do not pile up
    fold = F.pmod(F.when(lap % 2 == 0, at).otherwise(k - 1 - at) + F.coalesce(F.col("label"), F.lit(0)), F.lit(k)).cast("int")
    return join_keys(df, ranked.select(group, fold.alias("fold")), [group])
