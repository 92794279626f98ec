"""Training corpus from several sources in one plan."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.sampling import rebalance
from ..sources.readers import read_table
from ..sources.sinks import total_order

# Why a source is left out of the corpus.
MISSING, UNUSABLE = "missing_file", "no_usable_rows"


def build_corpus(
    frames: Mapping[str, DataFrame], key: Sequence[str], max_negative_ratio: float = 3.0,
    max_rows_per_source: int | None = 25_000, seed: int = 42,
) -> DataFrame:
    """Union by name with the source as a column; classes rebalanced and rows capped per source.

    The corpus is a bounded sample to fit on: ``max_rows_per_source`` (25,000 by default, ``None`` for all) is its bound.
    """
    if not frames:
        raise ValueError("No usable datasets were available for the training corpus.")
    union = None
    for name, df in frames.items():
        tagged = df.withColumn("source_dataset", F.lit(name))
        union = tagged if union is None else union.unionByName(tagged, allowMissingColumns=True)
    return rebalance(union, key, max_negative_ratio, ["source_dataset"], seed, max_rows_per_source)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path (or pattern) names something in whatever store Spark reads it from."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = place.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(place)
    return found is not None and len(found) > 0


def corpus_from_files(
    spark: SparkSession, paths: Mapping[str, str], prepare: Mapping[str, Callable[[DataFrame], DataFrame]], key: Sequence[str], **options,
) -> tuple[DataFrame, list[str]]:
    """Read, prepare and combine named sources, and the names of those without a file, which are looked up before planning.

    ``options`` are those of :func:`build_corpus`. Without any file it is an error.
    """
    absent = [n for n, p in paths.items() if not exists(spark, p)]
    frames = {n: prepare[n](read_table(spark, p)) for n, p in paths.items() if n not in absent}
    return build_corpus(frames, key, **options), absent


def summary_with_reasons(corpus: DataFrame, sources: Sequence[str], absent: Sequence[str]) -> DataFrame:
    """Rows and classes of every named source, and why it is left out where it is.

    Balancing and capping leave a row at least of a source that has one, so a source without rows in the corpus had none
    to use; the pass that counts the corpus finds these sources, too.
    """
    spark = corpus.sparkSession
    names = spark.createDataFrame([(n, MISSING if n in absent else None) for n in sources], "source_dataset string, _absent string")
    per = names.join(corpus_summary(corpus).drop("skipped"), "source_dataset", "left").na.fill(0, ["row_count", "positive_count", "negative_count"])
    skipped = F.coalesce("_absent", F.when(F.col("row_count") == 0, UNUSABLE))
    return per.withColumn("skipped", skipped).drop("_absent")


def in_order(corpus: DataFrame) -> DataFrame:
    """The corpus in the order it is written out."""
    return total_order(corpus, ["timestamp", "segment_id"])


def corpus_summary(corpus: DataFrame, reasons: DataFrame | None = None) -> DataFrame:
    """Rows and classes per source; with ``reasons`` (key, reason) also the sources left out."""
    per = corpus.groupBy("source_dataset").agg(
        F.count(F.lit(1)).alias("row_count"), F.count_if(F.col("target") == 1).alias("positive_count"),
        F.count_if(F.col("target") == 0).alias("negative_count"))
    if reasons is None:
        return per.withColumn("skipped", F.lit(None).cast("string"))
    skipped = reasons.where(F.col("reason").isNotNull()).select(F.col("key").alias("source_dataset"), F.col("reason").alias("skipped"))
    return per.join(skipped, "source_dataset", "full").na.fill(0, ["row_count", "positive_count", "negative_count"])
