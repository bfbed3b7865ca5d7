"""Reading and writing tables, splits, metrics and fitted parameters."""

from __future__ import annotations

import re
import tempfile
import uuid
import warnings

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .spec import DatasetSpec


def read_table(spark: SparkSession, path: str | list[str], spec: DatasetSpec | None = None) -> DataFrame:
    """CSV or Parquet (by extension of the first path) under a spec; several paths are read as one table.

    CSV: any single-character separator, leading blanks are ignored, names may be supplied for files
    without a header, and every listed token is null.  NaN is null everywhere.
    """
    spec = spec or DatasetSpec()
    paths = [path] if isinstance(path, str) else list(path)
    if paths[0].rstrip("/").endswith(".parquet"):
        df = spark.read.parquet(*paths)
    else:
        reader = spark.read.option("sep", spec.sep).option("header", spec.header).option("ignoreLeadingWhiteSpace", True)
        df = reader.csv(paths)
        if spec.names:
            df = df.toDF(*spec.names)
        if spec.na_values:
            df = df.select(*[F.when(~F.col(c).isin(spec.na_values), F.col(c)).alias(c) for c in df.columns])
        df = df.withColumns({c: F.col(c).try_cast("double") for c in spec.continuous if c in df.columns})
    return nan_to_null(df)


def nan_to_null(df: DataFrame) -> DataFrame:
    return df.select(*[F.when(~F.isnan(c), F.col(c)).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes])


def write_table(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """CSV with a header if the path ends in .csv, else Parquet."""
    if path.endswith(".csv"):
        df.write.mode(mode).option("header", True).csv(path)
    else:
        df.write.mode(mode).parquet(path)


def scratch_folder(spark: SparkSession, label: str) -> str:
    """A new folder under ``spark.checkpoint.dir``, which driver and executors share; local sessions may go without that setting."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("on a cluster spark.checkpoint.dir has to name a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="loomtab-")
    return f"{root.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def write_split(df: DataFrame, path: str, split: str = "split") -> None:
    df.write.mode("overwrite").partitionBy(split).parquet(path)


def read_split(spark: SparkSession, path: str, value: str, split: str = "split") -> DataFrame:
    """One part of a split table; only its folder is read."""
    return spark.read.parquet(path).where(F.col(split) == value).drop(split)


def write_metrics(metrics: DataFrame, path: str) -> None:
    """Long metrics, JSON lines if the path ends in .json, else CSV."""
    if path.endswith(".json"):
        metrics.write.mode("overwrite").json(path)
    else:
        metrics.write.mode("overwrite").option("header", True).csv(path)


def read_experiments(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Fold metrics of many experiments; the folder's name is the experiment."""
    df = spark.read.option("header", True).option("inferSchema", True).csv(paths)
    return df.withColumn("experiment", F.element_at(F.split(F.input_file_name(), "/"), -2))


def params_checksum(params: DataFrame) -> DataFrame:
    """One row: the SHA-256 of the sorted rows of a parameter table (its size is that of the schema's)."""
    row = F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in params.columns])
    return params.agg(F.sha2(F.array_join(F.array_sort(F.collect_list(row)), "\x1e"), 256).alias("checksum"))


def save_params(params: DataFrame, path: str) -> None:
    params.write.mode("overwrite").parquet(f"{path}/params")
    params_checksum(params).write.mode("overwrite").json(f"{path}/checksum")


def load_params(spark: SparkSession, path: str) -> DataFrame:
    """Parameters whose checksum still holds; a missing checksum is a warning, another one an error."""
    params = spark.read.parquet(f"{path}/params")
    try:
        told = spark.read.json(f"{path}/checksum").first()["checksum"]
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(e):
            raise
        warnings.warn("no checksum beside the parameters", stacklevel=2)
        return params
    if params_checksum(params).first()["checksum"] != told:
        raise ValueError("the parameters don't have their checksum")
    return params
