"""Classification metrics as aggregates over scored rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import ratio
from .keys import join_keys
from .series import scan, value_series


def confusion(df: DataFrame, actual: str, predicted: str, keys: Sequence[str] = ()) -> DataFrame:
    """Counts per (actual, predicted)."""
    return df.groupBy(*keys, actual, predicted).agg(F.count(F.lit(1)).alias("n"))


def _cells(actual: str, predicted: str, weight: Column, cls: int) -> tuple[Column, Column, Column]:
    a, p = F.col(actual) == cls, F.col(predicted) == cls
    return (F.sum(F.when(a & p, weight).otherwise(0)), F.sum(F.when(~a & p, weight).otherwise(0)),
            F.sum(F.when(a & ~p, weight).otherwise(0)))


def classification_report(df: DataFrame, actual: str, predicted: str, keys: Sequence[str] = ()) -> DataFrame:
    """Precision, recall, F1 and support of both classes, macro and weighted means; 0 where undefined."""
    counts = confusion(df, actual, predicted, keys)
    aggs = []
    for cls in (0, 1):
        tp, fp, fn = _cells(actual, predicted, F.col("n"), cls)
        aggs += [tp.alias(f"tp{cls}"), fp.alias(f"fp{cls}"), fn.alias(f"fn{cls}")]
    one = counts.groupBy(*keys).agg(*aggs)

    def cells(cls: int) -> tuple[Column, Column, Column, Column]:
        tp, fp, fn = (F.col(f"{k}{cls}").cast("double") for k in ("tp", "fp", "fn"))
        precision, recall = ratio(tp, tp + fp), ratio(tp, tp + fn)
        return precision, recall, ratio(2 * precision * recall, precision + recall), tp + fn

    c0, c1 = cells(0), cells(1)
    total = c0[3] + c1[3]
    lines = [("0", *c0), ("1", *c1)]
    lines.append(("macro avg", *[(a + b) / 2 for a, b in zip(c0[:3], c1[:3])], total))
    lines.append(("weighted avg", *[ratio(a * c0[3] + b * c1[3], total) for a, b in zip(c0[:3], c1[:3])], total))
    structs = [F.struct(F.lit(n).alias("class"), p.alias("precision"), r.alias("recall"), f.alias("f1"),
                        s.cast("long").alias("support")) for n, p, r, f, s in lines]
    return one.select(*keys, F.explode(F.array(*structs)).alias("l")).select(*keys, "l.*")


def transpose_report(report: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Metrics as rows and classes as columns."""
    long = report.unpivot([*keys, "class"], ["precision", "recall", "f1"], "metric", "value")
    return long.groupBy(*keys, "metric").pivot("class", ["0", "1", "macro avg", "weighted avg"]).agg(F.first("value"))


def score_counts(df: DataFrame, score: str, label: str, keys: Sequence[str]) -> DataFrame:
    """Positives and negatives per distinct score, with their running counts from the lowest score."""
    counts = df.where(F.col(score).isNotNull()).groupBy(*keys, score).agg(
        F.sum(F.when(F.col(label) == 1, 1).otherwise(0)).alias("pos"),
        F.sum(F.when(F.col(label) == 0, 1).otherwise(0)).alias("neg"),
    )
    series = value_series(counts, list(keys), score, df)
    return scan(counts, series, sums={"pos_upto": F.col("pos"), "neg_upto": F.col("neg")})


def roc_auc(df: DataFrame, score: str, label: str, keys: Sequence[str] = ()) -> DataFrame:
    """Exact area under the ROC curve per key, ties counted half; NULL with a single class."""
    return score_counts(df, score, label, keys).groupBy(*keys).agg(_auc().alias("roc_auc"))


def _auc() -> Column:
    """Share of (positive, negative) pairs in the right order, from counts per score."""
    wins = F.sum(F.col("pos") * (F.col("neg_upto") - F.col("neg") / 2.0))
    pairs = F.sum("pos").cast("double") * F.sum("neg")
    return wins / F.nullif(pairs, F.lit(0.0))


def roc_curve(df: DataFrame, score: str, label: str, keys: Sequence[str] = ()) -> DataFrame:
    """False and true positive rate at each distinct score taken as the threshold."""
    counts = score_counts(df, score, label, keys)
    totals = counts.groupBy(*keys).agg(F.sum("pos").alias("_p"), F.sum("neg").alias("_n"))
    counts = join_keys(counts, totals, keys)
    tp, fp = F.col("_p") - F.col("pos_upto") + F.col("pos"), F.col("_n") - F.col("neg_upto") + F.col("neg")
    return counts.select(*keys, F.col(score).alias("threshold"), (fp / F.nullif("_n", F.lit(0))).alias("fpr"),
                         (tp / F.nullif("_p", F.lit(0))).alias("tpr"))


def binary_metrics(
    df: DataFrame, score: str, label: str, keys: Sequence[str] = (), threshold: float = 0.5, digits: int = 4,
) -> DataFrame:
    """Accuracy, class-1 precision / recall / F1, confusion cells and exact AUC per key.

    Everything follows from the counts per distinct score, so the rows are read once. Rows with labels
    other than 0 and 1 are left out.
    """
    counts = score_counts(df.where(F.col(label).isin(0, 1)), score, label, keys)
    hit = F.col(score) >= threshold
    one = counts.groupBy(*keys).agg(
        F.sum(F.when(hit, F.col("pos")).otherwise(0)).alias("tp"), F.sum(F.when(hit, F.col("neg")).otherwise(0)).alias("fp"),
        F.sum(F.when(~hit, F.col("pos")).otherwise(0)).alias("fn"), F.sum(F.when(~hit, F.col("neg")).otherwise(0)).alias("tn"),
        _auc().alias("roc_auc"),
    )
    tp, fp, fn, tn = (F.col(k).cast("double") for k in ("tp", "fp", "fn", "tn"))
    precision, recall = ratio(tp, tp + fp), ratio(tp, tp + fn)

    def rounded(c: Column) -> Column:
        return F.round(c + 1e-9, digits)

    return one.select(
        *keys, rounded(ratio(tp + tn, tp + fp + fn + tn)).alias("accuracy"), rounded(precision).alias("precision"),
        rounded(recall).alias("recall"), rounded(ratio(2 * precision * recall, precision + recall)).alias("f1"),
        rounded(F.col("roc_auc")).alias("roc_auc"), "tn", "fp", "fn", "tp",
    )


CV_KEYS = ["accuracy", "precision", "recall", "f1", "roc_auc"]


def fold_summary(folds: DataFrame, keys: Sequence[str], columns: Sequence[str] = tuple(CV_KEYS), digits: int = 4) -> DataFrame:
    """Mean and population deviation over folds; NULL where no fold has a value."""
    aggs = []
    for c in columns:
        aggs += [F.round(F.avg(c) + 1e-9, digits).alias(f"{c}_cv_mean"),
                 F.round(F.stddev_pop(c) + 1e-9, digits).alias(f"{c}_cv_std")]
    return folds.groupBy(*keys).agg(*aggs)


def fold_sizes(df: DataFrame, fold: str, group: str) -> DataFrame:
    """Average rows and groups in the test and training parts over folds (a group lies in one fold)."""
    per = df.groupBy(fold, group).agg(F.count(F.lit(1)).alias("n"))
    per = per.groupBy(fold).agg(F.sum("n").alias("rows"), F.count(F.lit(1)).alias("groups"))
    one = per.agg(F.sum("rows").alias("r"), F.sum("groups").alias("g"), F.count(F.lit(1)).alias("k"))
    test_r, test_g = F.col("r") / F.col("k"), F.col("g") / F.col("k")
    return one.select(
        F.round(F.col("r") - test_r).cast("long").alias("avg_train_rows"), F.round(test_r).cast("long").alias("avg_test_rows"),
        F.round(F.col("g") - test_g).cast("long").alias("avg_train_scenarios"),
        F.round(test_g).cast("long").alias("avg_test_scenarios"),
    )
