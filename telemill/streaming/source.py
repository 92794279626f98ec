"""Streaming sources and sinks for telemetry."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader
from pyspark.sql.streaming import StreamingQuery

CLOSING = "2100-01-01 00:00:00"


class StepReader(SimpleDataSourceStreamReader):
    """Step numbers in order, so many a micro-batch; the offset is the first step not yet read."""

    def __init__(self, first: int, last: int, per_trigger: int):
        self.first, self.last, self.per_trigger = first, last, per_trigger

    def initialOffset(self) -> dict:
        return {"step": self.first}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        end = {"step": min(start["step"] + self.per_trigger, self.last + 1)}
        return self.readBetweenOffsets(start, end), end

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        return iter([(k,) for k in range(start["step"], end["step"])])

    def commit(self, end: dict) -> None:
        """Steps are numbers, nothing is held for them."""


class StepSource(DataSource):
    """The streaming source ``telemill_steps``: options ``first``, ``last`` and ``per_trigger``."""

    @classmethod
    def name(cls) -> str:
        return "telemill_steps"

    def schema(self) -> str:
        return "step long"

    def simpleStreamReader(self, schema) -> StepReader:
        o = self.options
        return StepReader(int(o.get("first", 0)), int(o["last"]), int(o.get("per_trigger", 1)))


def stream_table(table: DataFrame, steps: int = 8, per_trigger: int = 1, delay: str = "10 minutes", time: str = "timestamp",
                 seq: str | None = "seq", close: bool = True) -> DataFrame:
    """A stored table as a watermarked stream in the order of time, without writing it anew.

    The table's span of time is cut into ``steps`` of equal width and each micro-batch brings the rows of the next
    ``per_trigger`` of them. The source itself hands out step numbers only, with offsets, so a query that is started
    again goes on where it stopped; the rows of a step come from a scan of the table, which no shuffle follows. With
    ``close`` a last row at the far end of time (``seq`` -1, otherwise NULL) moves the watermark past all others. Rows
    without a time are in no step.
    """
    spark = table.sparkSession
    spark.dataSource.register(StepSource)
    moment = F.unix_micros(F.col(time).cast("timestamp"))
    lo, hi = table.agg(F.min(moment), F.max(moment)).first()
    lo, width = lo or 0, max(1, ((hi or 0) - (lo or 0)) // steps + 1)
    rows = table.withColumn(time, F.col(time).cast("timestamp")).withColumn("_step", F.floor((moment - F.lit(lo)) / F.lit(width)).cast("long"))
    last = steps - 1
    if close:
        last = steps
        blanks = {c: F.lit(None).cast(kind) for c, kind in rows.dtypes}
        blanks |= {time: F.lit(CLOSING).cast("timestamp"), "_step": F.lit(last).cast("long")} | ({seq: F.lit(-1).cast(dict(rows.dtypes)[seq])} if seq else {})
        rows = rows.unionByName(spark.range(1).select(*[v.alias(c) for c, v in blanks.items()]))
    numbers = spark.readStream.format("telemill_steps").options(first=0, last=last, per_trigger=per_trigger).load()
    joined = rows.join(F.broadcast(numbers), rows["_step"] == numbers["step"])  # per_trigger numbers
    return joined.select(*[rows[c] for c in table.columns]).withWatermark(time, delay)


def stream_files(spark: SparkSession, folder: str, schema, files_per_batch: int = 1, delay: str = "10 minutes",
                 time: str = "timestamp") -> DataFrame:
    """Parquet files appearing in a folder as a watermarked stream, a few files per micro-batch."""
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)
    return rows.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, delay)


def write_stream(df: DataFrame, path: str, checkpoint: str, name: str | None = None) -> StreamingQuery:
    """Append a stream to a Parquet table, micro-batch after micro-batch."""
    writer = df.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint)
    return (writer.queryName(name) if name else writer).start(path)


def finish(query: StreamingQuery) -> StreamingQuery:
    """Let a query work through all present input, and stop it."""
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    return query


def drain(df: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Run a stream over all present input and read its result table."""
    finish(write_stream(df, path, checkpoint))
    return df.sparkSession.read.schema(df.schema).parquet(path)


def late_rows(query: StreamingQuery) -> int:
    """Rows a query has dropped for arriving behind the watermark."""
    return sum(int(op.get("numRowsDroppedByWatermark", 0)) for p in query.recentProgress for op in p["stateOperators"])
