"""Exact de-duplication by a tree-merge of sorted digest runs, in DataFrame operations only.

Keys ``(digest, length, check)`` are worked out once and written out. Every input partition forms a run of distinct keys
with the identifier kept so far and a count. In each binomial round, runs ``2 i`` and ``2 i + 1`` are exchanged into one:
tasks sort their share of the two runs by key, walk it in order, and of equal neighbours retain the kept identifier and
the sum of the counts. The exchange is by ``(run, key)``, so one run is spread over many tasks, a frequent key is merged
inside its own partition before it is sent and meets one row per run in a round, and the last run is never in one place.
A key is a SHA-256 digest verified by the byte length and an independent 64-bit hash of the same text, so texts are
merged only when all three agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import staging

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
KEY = ("_digest", "_length", "_check")
FAN_IN = 2
RUNS = 64


def normalised(text: str | Column) -> Column:
    """The text with A-Z lower-cased and null as the empty text."""
    return F.translate(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")), UPPER, LOWER)


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = normalised(F.col(f"`{text_col}`").cast("string"))
    return docs.select(F.col(f"`{id_col}`").alias("_id"), F.unhex(F.sha2(text, 256)).alias("_digest"),
                       F.octet_length(text).cast("long").alias("_length"), F.xxhash64(text).alias("_check"))


def merged_runs(rows: DataFrame, keep: str = "max", runs: int = RUNS, fan_in: int = FAN_IN) -> DataFrame:
    """One row per key: ``_keep`` (largest or smallest identifier) and ``_copies``, merged in rounds of ``fan_in`` runs.

    A sorted share of the runs that meet holds at most ``fan_in`` rows of a key, next to each other, best identifier first.
    """
    if fan_in < 2 or runs < 1 or keep not in ("max", "min"):
        raise ValueError("fan_in must be 2 or more, runs 1 or more, keep 'max' or 'min'")
    best = F.max if keep == "max" else F.min
    order = F.col("_keep").desc_nulls_last() if keep == "max" else F.col("_keep").asc_nulls_last()
    in_order = Window.partitionBy("_run", *KEY).orderBy(order)
    equals = in_order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (rows.withColumn("_run", F.spark_partition_id() % runs)
             .groupBy("_run", *KEY).agg(best("_id").alias("_keep"), F.count(F.lit(1)).alias("_copies")))
    while runs > 1:
        runs = -(-runs // fan_in)
        met = level.withColumn("_run", F.floor(F.col("_run") / fan_in).cast("int"))
        met = met.withColumns({"_place": F.row_number().over(in_order), "_copies": F.sum("_copies").over(equals)})
        level = met.where("_place = 1").drop("_place")
    return level.drop("_run")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "max",
                 runs: int = RUNS, fan_in: int = FAN_IN) -> DataFrame:
    """One row per input row: ``id, keep_id, group_size, kept, text_sha256``.

    Texts are equal when identical after lower-casing A-Z; null counts as empty. ``keep`` says whether the largest or the
    smallest identifier of a group stays. A row without an identifier is kept only where its whole group has none. Rows
    that repeat an identifier and its text are all marked alike, and each counts in ``group_size``. An empty table gives
    an empty result; other columns, whatever their names, are not read.
    """
    rows = staging.stage(docs.sparkSession, keyed(docs, id_col, text_col))
    groups = merged_runs(rows, keep, runs, fan_in)
    return rows.join(groups, list(KEY)).select(
        F.col("_id").alias(id_col), F.col("_keep").alias("keep_id"), F.col("_copies").alias("group_size"),
        F.col("_id").eqNullSafe(F.col("_keep")).alias("kept"), F.lower(F.hex("_digest")).alias("text_sha256"))


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "max", repeats: bool = True) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns.

    Of rows repeating identifier and text each stays; without ``repeats``, of those equal in every column one does.
    """
    groups = exact_groups(docs, id_col, text_col, keep).where("kept").select(F.col(id_col).alias("_kept_id"), "text_sha256")
    groups = groups.groupBy("_kept_id", "text_sha256").agg(F.count(F.lit(1)).alias("_rows"))
    digest = F.sha2(normalised(F.col(f"`{text_col}`").cast("string")), 256)

    def rows_of(some: DataFrame) -> DataFrame:
        return docs.join(some, docs[id_col].eqNullSafe(some["_kept_id"]) & (digest == some["text_sha256"]), "left_semi")

    if repeats:
        return rows_of(groups)
    # only rows that may repeat are compared as a whole
    return rows_of(groups.where("_rows = 1")).union(rows_of(groups.where("_rows > 1")).dropDuplicates())
