"""Tables cut off from their lineage: written to the shared folder named by ``spark.checkpoint.dir`` and read again."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from ..session import checkpoint_dir

#: Rows of an Arrow batch: bounds what a Python task holds at once, as documents may be long.
ARROW_ROWS = 1000


def stage(spark: SparkSession, df: DataFrame, *, compression: str = "zstd", partition_by: tuple[str, ...] = ()) -> DataFrame:
    """``df`` as a written table: later reads cost a scan, and lost executors cost no recomputation."""
    path = f"{checkpoint_dir(spark).rstrip('/')}/telemill-{uuid.uuid4().hex}"
    df.write.option("compression", compression).partitionBy(*partition_by).parquet(path)
    return spark.read.schema(df.schema).parquet(path).select(*[f"`{c}`" for c in df.columns])


def batches(spark: SparkSession) -> SparkSession:
    """The session with Arrow batches of bounded size."""
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", None) != str(ARROW_ROWS):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    return spark
