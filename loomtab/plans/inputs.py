"""Queries that write tables in other formats and read them back."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import profile
from ..sources import io
from ..sources.spec import DatasetSpec
from .registry import query, table

_HOLED = """SELECT CAST(c_custkey AS DOUBLE) AS c_custkey, CASE WHEN c_custkey % 7 <> 0 THEN c_acctbal END AS c_acctbal,
    CASE WHEN c_mktsegment <> 'MACHINERY' THEN c_mktsegment END AS c_mktsegment FROM customer"""


def _holed(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    token = F.when(F.col("c_custkey") % 7 == 0, "unknown").otherwise(F.col("c_acctbal").cast("string"))
    return c.select("c_custkey", token.alias("c_acctbal"), F.when(F.col("c_mktsegment") == "MACHINERY", "?").otherwise(F.col("c_mktsegment")).alias("c_mktsegment"))


@query(_HOLED, "c_custkey c_acctbal")
def csv_scan(spark, sf_dir):
    """A CSV with a header and two tokens for missing values."""
    path = io.scratch_folder(spark, "scan") + ".csv"
    io.write_table(_holed(spark, sf_dir), path)
    return io.read_table(spark, path, DatasetSpec(continuous=["c_custkey", "c_acctbal"], categorical=["c_mktsegment"], na_values=["?", "unknown"]))


@query(_HOLED, "c_custkey c_acctbal")
def csv_scan_headerless(spark, sf_dir):
    """Two files without a header, with another separator and blanks after it, read as one table under supplied names."""
    paths = []
    for part in (0, 1):
        paths.append(io.scratch_folder(spark, "headerless") + ".csv")
        half = _holed(spark, sf_dir).where(F.col("c_custkey") % 2 == part)
        half.select(F.concat_ws("; ", *half.columns).alias("line")).write.text(paths[-1])
    spec = DatasetSpec(continuous=["c_custkey", "c_acctbal"], categorical=["c_mktsegment"], sep=";", header=False, names=["c_custkey", "c_acctbal", "c_mktsegment"], na_values=["?", "unknown"])
    return io.read_table(spark, paths, spec)


@query("SELECT o_orderstatus, count(*) AS n FROM orders WHERE o_orderkey % 5 < 4 GROUP BY o_orderstatus")
def split_sink(spark, sf_dir):
    """A table written by split; only the training folder is read back."""
    path = io.scratch_folder(spark, "split")
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    io.write_split(o.withColumn("split", F.when(F.col("o_orderkey") % 5 < 4, "train").otherwise("test")), path)
    return io.read_split(spark, path, "train").groupBy("o_orderstatus").agg(F.count("*").alias("n"))


@query(
    "SELECT 'p' || CAST(o_custkey % 2 AS VARCHAR) AS experiment, CAST(o_custkey % 5 AS INT) AS fold, o_orderpriority AS metric, avg(o_totalprice) AS value FROM orders GROUP BY ALL",
    "value:4",
)
def experiments_read(spark, sf_dir):
    """Fold metrics of two experiments, each written as CSV into its own folder and read back together."""
    root, paths = io.scratch_folder(spark, "experiments"), []
    o = table(spark, sf_dir, "orders")
    for k in (0, 1):
        folds = o.where(F.col("o_custkey") % 2 == k).groupBy((F.col("o_custkey") % 5).cast("int").alias("fold"), F.col("o_orderpriority").alias("metric")).agg(F.avg("o_totalprice").alias("value"))
        paths.append(f"{root}/p{k}")
        io.write_metrics(folds, paths[-1])
    return io.read_experiments(spark, paths)


@query("SELECT count(*) AS rows, count(*) FILTER (c_custkey % 9 <> 0 AND c_custkey % 11 <> 0) AS kept FROM customer")
def finite_filter(spark, sf_dir):
    """Rows whose values are numbers: neither null, NaN nor infinite."""
    c = table(spark, sf_dir, "customer")
    odd = c.withColumn("x", F.when(F.col("c_custkey") % 9 == 0, float("inf")).when(F.col("c_custkey") % 11 == 0, float("nan")).otherwise(F.col("c_acctbal")))
    return odd.agg(F.count("*").alias("rows")).join(F.broadcast(profile.finite(odd, ["x"]).agg(F.count("*").alias("kept"))))
