"""Readers for telemetry files, and the registry of known datasets."""

from __future__ import annotations

import os
from collections.abc import Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions import as_timestamp
from ..operators.cleaning import WELL_COLUMNS, adopt_export, map_columns

FORMATS = {".csv": "csv", ".txt": "csv", ".parquet": "parquet"}


def is_missing(exc: AnalysisException) -> bool:
    """Whether a read failed because its path does not exist."""
    return exc.getCondition() == "PATH_NOT_FOUND"


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """A CSV file or folder with a header; a missing path raises ``FileNotFoundError``."""
    reader = spark.read.option("header", True)
    reader = reader.schema(schema) if schema else reader.option("inferSchema", True)
    try:
        return reader.csv(path)
    except AnalysisException as exc:
        if is_missing(exc):
            raise FileNotFoundError(path) from exc
        raise


def read_table(spark: SparkSession, path: str, rows: int | None = None, schema: T.StructType | str | None = None) -> DataFrame:
    """Read by file extension; other extensions raise ``ValueError``. ``rows`` is a preview limit."""
    kind = FORMATS.get(os.path.splitext(path.rstrip("/"))[1].lower())
    if kind is None:
        raise ValueError(f"Unsupported dataset file type: {path}")
    df = read_csv(spark, path, schema) if kind == "csv" else spark.read.parquet(path)
    return df if rows is None else df.limit(rows)


def tagged(df: DataFrame) -> DataFrame:
    return df.select("*", F.col("_metadata.file_name").alias("source_file"))


def read_csv_files(spark: SparkSession, paths: list[str]) -> DataFrame:
    """CSV files of one header in one scan."""
    return spark.read.option("header", True).option("inferSchema", True).option("enforceSchema", False).csv(paths)


def csv_headers(spark: SparkSession, folder: str, glob: str, recursive: bool = False) -> list[list[str]]:
    """The files matching a pattern, grouped by their header line; empty files are passed over.

    Headers are read by Spark, one line per file; the driver sees paths and header texts alone.
    """
    lines = spark.read.option("pathGlobFilter", glob).option("recursiveFileLookup", recursive).text(folder)
    first = lines.select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("at"))
    first = first.where("at = 0").withColumn("n", F.monotonically_increasing_id())
    heads = first.groupBy("path").agg(F.min_by("value", "n").alias("head"))
    groups = heads.groupBy("head").agg(F.sort_array(F.collect_list("path")).alias("paths")).orderBy("head").collect()
    return [[url_decoded(p) for p in r["paths"]] for r in groups]


def url_decoded(path: str) -> str:
    """A path as readers take it, from the escaped form that file metadata has."""
    from urllib.parse import unquote

    return unquote(path)


def read_matching(spark: SparkSession, folder: str, globs: Sequence[str] = ("*.csv",), recursive: bool = False) -> DataFrame | None:
    """All files of a folder matching the patterns, tagged with ``source_file``; one scan per pattern and CSV header.

    Differing columns are aligned by name. Patterns of unknown type are passed over; ``None`` if nothing is left.
    """
    parts = []
    for glob in globs:
        kind = FORMATS.get(os.path.splitext(glob)[1].lower())
        if kind is None:
            continue
        reader = spark.read.option("pathGlobFilter", glob).option("recursiveFileLookup", recursive)
        if kind == "csv":
            parts += [tagged(read_csv_files(spark, paths)) for paths in csv_headers(spark, folder, glob, recursive)]
        else:
            parts.append(tagged(reader.option("mergeSchema", True).parquet(folder)))
    if not parts:
        return None
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out


def read_wells(spark: SparkSession, folder: str, files_per_label: DataFrame | None = None) -> DataFrame:
    """Well files laid out as ``<folder>/<label>/<well>.parquet`` in one scan, labelled from their paths.

    With ``files_per_label`` (from :func:`sample_files`, as many paths as its quota allows) only those files are opened.
    """
    reader = spark.read.option("mergeSchema", True)
    if files_per_label is not None:
        paths = [r["path"] for r in files_per_label.select("path").orderBy("path").collect()]
        if not paths:
            return read_wells(spark, folder).limit(0)
        df = reader.parquet(*paths)
    else:
        df = reader.option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").parquet(folder)
    wanted = [c for c in df.columns if c in WELL_COLUMNS or c in ("timestamp", "seq")]
    df = df.select(*[F.col(f"`{c}`") for c in wanted], F.col("_metadata.file_path").alias("_path"))
    df = df.where(~F.contains("_path", F.lit("folds")))
    df = df.withColumns({
        "event_dir": F.regexp_extract("_path", r"([^/]+)/[^/]+$", 1),
        "well_id": F.regexp_extract("_path", r"([^/]+)\.parquet$", 1),
    })
    return df.withColumn("scenario_id", F.concat_ws("_", "event_dir", "well_id")).drop("_path")


def list_files(spark: SparkSession, folder: str, glob: str = "*.parquet") -> DataFrame:
    """Paths below a folder, without reading the files' contents."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(folder)
    return files.select("path", "length").where(~F.contains("path", F.lit("folds")))


def sample_files(files: DataFrame, max_files: int) -> DataFrame:
    """The first files by name of each label directory, an equal number each, at least one."""
    files = files.withColumn("event_dir", F.regexp_extract("path", r"([^/]+)/[^/]+$", 1))
    counts = files.agg(F.struct(F.count(F.lit(1)).alias("n"), F.countDistinct("event_dir").alias("dirs"))).scalar()
    w = Window.partitionBy("event_dir").orderBy("path")
    ranked = files.withColumns({"_c": counts, "_k": F.row_number().over(w)})
    each = F.greatest(F.lit(1), F.floor(F.lit(max_files) / F.col("_c.dirs")))
    return ranked.where((F.col("_c.n") <= max_files) | (F.col("_k") <= each)).drop("_c", "_k")


def read_export(spark: SparkSession, path: str, source: str) -> DataFrame:
    """A processed telemetry CSV, back-filled to the full schema and tagged with its source."""
    return adopt_export(read_csv(spark, path), source)


def read_summaries(spark: SparkSession, paths: str | Sequence[str], schema: T.StructType | str) -> DataFrame:
    """JSON summaries with their path, each file once."""
    df = spark.read.schema(schema).option("multiLine", True).json(list(paths) if not isinstance(paths, str) else paths)
    return df.select("*", F.col("_metadata.file_path").alias("path")).dropDuplicates(["path"])


REGISTRY_SCHEMA = (
    "key string, phase int, telemetry_compatible boolean, live_training_eligible boolean, "
    "risk_model_eligible boolean, target string, folder string, file_globs array<string>, recursive boolean, "
    "column_map map<string, array<string>>"
)


class Registry:
    """Datasets described by configuration: where they lie, how their columns map, what they may be used for."""

    def __init__(self, datasets: Mapping[str, Mapping]):
        self._datasets = {k: dict(v) for k, v in datasets.items()}

    def get(self, key: str) -> dict:
        if key not in self._datasets:
            raise KeyError(f"Dataset '{key}' not found. Available: {sorted(self._datasets)}")
        return {"key": key, **self._datasets[key]}

    def phase(self, phase: int) -> list[dict]:
        return [self.get(k) for k, v in self._datasets.items() if v.get("phase") == phase]

    def table(self, spark: SparkSession) -> DataFrame:
        """The registry as a small table for joins and filters."""
        rows = []
        for k, v in self._datasets.items():
            aliases = {c: [a] if isinstance(a, str) else list(a) for c, a in (v.get("column_map") or {}).items() if a}
            rows.append((k, v.get("phase"), bool(v.get("telemetry_compatible")), bool(v.get("live_training_eligible")),
                         bool(v.get("risk_model_eligible")), v.get("target"), v.get("folder"),
                         list(v.get("file_globs") or ["*.csv"]), bool(v.get("recursive")), aliases))
        return spark.createDataFrame(rows, REGISTRY_SCHEMA)

    def skip_reasons(self, spark: SparkSession) -> DataFrame:
        """Why a dataset cannot train live models; NULL where it can."""
        return self.table(spark).select("key", F.when(~F.col("telemetry_compatible"), "not_telemetry_compatible")
                                        .when(~F.col("live_training_eligible"), "not_live_training_eligible").alias("reason"))

    def load(self, spark: SparkSession, key: str) -> DataFrame | None:
        """Raw files of a dataset, mapped to canonical columns and tagged with its name."""
        meta = self.get(key)
        try:
            df = read_matching(spark, meta["folder"], meta.get("file_globs") or ["*.csv"], bool(meta.get("recursive")))
        except AnalysisException as exc:
            if is_missing(exc):
                return None
            raise
        if df is None:
            return None
        df = map_columns(df, meta.get("column_map") or {})
        if "timestamp" in df.columns:
            df = df.withColumn("timestamp", as_timestamp("timestamp"))
        return df.withColumn("dataset_name", F.lit(key))
