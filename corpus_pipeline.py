"""The corpus pipeline: stages over ``documents``, each written as Parquet and read again as the next one's input."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from telemill.llm import decontaminate, encode, exact_dedup, near_dedup, packing, quality, staging


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    model = quality.train(spark, docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.keep_good(docs, model)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the row with the largest doc_id stays, and once where it is repeated."""
    return exact_dedup.drop_copies(docs, repeats=False)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by similarity, the one with the smallest doc_id stays."""
    return near_dedup.drop_near_copies(spark, docs)


def clean_of_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth of the words lies in benchmark windows."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The remaining documents as pieces of training sequences."""
    out = packing.pack(spark, docs, encode.tokenizer_path("byte_bpe_50k.json"))
    return out.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


STAGES = [("quality classifier", good_documents), ("exact dedup", exact_copies), ("near dedup", near_copies),
          ("benchmark decontamination", clean_of_benchmark), ("packing", packed)]

#: No SQL: a trained classifier, a tokenizer and a packing plan are not expressible.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over the documents table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, function in STAGES[:-1]:
        docs = staging.stage(spark, function(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
