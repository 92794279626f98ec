"""Dense codes for text labels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import checkpoint_dir


def numbered(df: DataFrame, order: Sequence[str | Column], out: str) -> DataFrame:
    """Rows with their 0-based place in ``order``.

    Rows are range-sorted and written to the checkpoint folder, so that partition offsets and rows come from the same
    split; places are then partition offset plus place in the partition. No task sees more than its own range.
    """
    checkpoint_dir(df.sparkSession)
    placed = df.orderBy(*order).withColumn("_id", F.monotonically_increasing_id()).checkpoint()
    placed = placed.withColumn("_part", F.shiftright("_id", 33))
    sizes = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_size"))
    # one row per partition
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_off"))
    inside = F.col("_id") - F.shiftleft(F.col("_part"), 33)
    return placed.join(offsets, "_part").withColumn(out, F.col("_off") + inside).drop("_id", "_part", "_off")


def dense_codes(df: DataFrame, label: str, code: str = "code") -> DataFrame:
    """One row per distinct non-NULL label with its 0-based place in sort order."""
    labels = df.select(label).where(F.col(label).isNotNull()).distinct()
    return numbered(labels, [label], code).withColumn(code, F.col(code).cast("int"))


def category_codes(df: DataFrame, label: str, code: str) -> DataFrame:
    """0-based code of a text column in sort order, -1 where it is NULL."""
    codes = dense_codes(df, label, code)
    return df.join(codes, label, "left").withColumn(code, F.coalesce(F.col(code), F.lit(-1)))


def segment_codes(df: DataFrame, source: str | None, out: str = "segment_id") -> DataFrame:
    """1-based segment ids from any identifying column; one segment where there is none."""
    if source is None:
        return df.withColumn(out, F.lit(1))
    named = df.withColumn("_seg", F.coalesce(F.col(source).cast("string"), F.lit("segment-1")))
    codes = dense_codes(named, "_seg", "_code")
    kept = named.drop(out) if out in named.columns else named
    return kept.join(codes, "_seg", "left").withColumn(out, F.col("_code") + 1).drop("_seg", "_code")


def benchmark_label(df: DataFrame, label: str, out: str, positives: list[str]) -> DataFrame:
    """0/1 label: kept if it already is, else by known positive words, else by being nonzero."""
    text = F.lower(F.col(label).cast("string"))
    number = F.coalesce(F.col(label).cast("string").try_cast("double"), F.lit(0.0))
    as_value = F.col(label).cast("string").try_cast("double")
    plan: Column = df.agg(
        F.struct(
            F.coalesce(
                F.bool_and(F.col(label).isNull() | F.coalesce(as_value.isin(0.0, 1.0), F.lit(False)))
                & F.bool_or(as_value == 0.0) & F.bool_or(as_value == 1.0),
                F.lit(False),
            ).alias("binary"),
            F.coalesce(F.bool_or(text.isin(positives)), F.lit(False)).alias("words"),
        )
    ).scalar()
    return df.withColumn("_plan", plan).withColumn(
        out,
        F.when(F.col("_plan.binary"), as_value.cast("int"))
        .when(F.col("_plan.words"), F.coalesce(text.isin(positives), F.lit(False)).cast("int"))
        .otherwise((number != 0).cast("int")),
    ).drop("_plan")
