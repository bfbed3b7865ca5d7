"""Queries that compare models over blocks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import compare
from .registry import query, table

_S = "(SELECT CAST(o_custkey % 7 AS INT) AS block, o_orderpriority AS model, avg(o_totalprice) AS score FROM orders GROUP BY ALL)"
_RANKS = f"(SELECT block, model, score, rank() OVER (PARTITION BY block ORDER BY score DESC) + (count(*) OVER (PARTITION BY block, score) - 1) / 2 AS rank FROM {_S})"
_CHI = f"""SELECT k, n, (12 / (k * n * (k + 1)) * ss - 3 * n * (k + 1)) / (1 - t / (n * k * (k * k - 1))) AS chi2 FROM (
    SELECT sum(s * s) AS ss, count(*) AS k, max(n) AS n FROM (SELECT model, sum(rank) AS s, count(*) AS n FROM {_RANKS} GROUP BY model)),
    (SELECT sum(c * c * c - c) AS t FROM (SELECT count(*) AS c FROM {_RANKS} GROUP BY block, score))"""
# five models: four degrees of freedom, whose tail is closed
_P = "exp(-chi2 / 2) * (1 + chi2 / 2)"


def _scores(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy((F.col("o_custkey") % 7).cast("int").alias("block"), F.col("o_orderpriority").alias("model")).agg(F.avg("o_totalprice").alias("score"))


@query(f"SELECT *, {_P} AS p_value FROM ({_CHI})", "chi2 p_value")
def friedman(spark, sf_dir):
    return compare.friedman(_scores(spark, sf_dir))


@query(f"SELECT model, avg(rank) AS mean_rank, count(*) AS n FROM {_RANKS} GROUP BY model", "mean_rank")
def mean_ranks(spark, sf_dir):
    return compare.mean_ranks(_scores(spark, sf_dir))


@query(
    f"""SELECT a.model AS model_a, b.model AS model_b, abs(a.r - b.r) AS rank_gap, 2.727774 * sqrt(5 * 6 / (6.0 * 7)) AS critical_difference, abs(a.r - b.r) <= 2.727774 * sqrt(5 * 6 / (6.0 * 7)) AS same_group
    FROM (SELECT model, avg(rank) AS r FROM {_RANKS} GROUP BY model) a JOIN (SELECT model, avg(rank) AS r FROM {_RANKS} GROUP BY model) b ON a.model < b.model""",
    "rank_gap critical_difference:4",
)
def nemenyi_gaps(spark, sf_dir):
    return compare.nemenyi(_scores(spark, sf_dir)).drop("p_value")


@query()
def nemenyi(spark, sf_dir):
    return compare.nemenyi(_scores(spark, sf_dir))


@query(
    f"""SELECT chi2, {_P} AS p_value, (SELECT model FROM {_RANKS} GROUP BY model ORDER BY avg(rank), model LIMIT 1) AS best,
    (SELECT model FROM {_RANKS} GROUP BY model ORDER BY avg(rank) DESC, model DESC LIMIT 1) AS worst FROM ({_CHI})""",
    "chi2 p_value",
)
def compare_models(spark, sf_dir):
    return compare.compare_models(_scores(spark, sf_dir)).drop("significant_pairs", "summary")


_G = """(SELECT o_orderstatus AS "group", 'mean' AS metric, CAST(o_custkey % 6 AS INT) AS block, o_orderpriority AS model, avg(o_totalprice) AS score FROM orders GROUP BY ALL
    UNION ALL SELECT o_orderstatus, 'max', CAST(o_custkey % 6 AS INT), o_orderpriority, max(o_totalprice) FROM orders GROUP BY ALL)"""
_GR = f"""(SELECT *, rank() OVER (PARTITION BY "group", metric, block ORDER BY score DESC) + (count(*) OVER (PARTITION BY "group", metric, block, score) - 1) / 2 AS rank FROM {_G})"""


@query(
    f"""SELECT "group", metric, k, n, chi2, {_P} AS p_value, {_P} < 0.05 AS significant FROM (
    SELECT "group", metric, k, n, (12 / (k * n * (k + 1)) * ss - 3 * n * (k + 1)) / (1 - t / (n * k * (k * k - 1))) AS chi2 FROM (
        SELECT "group", metric, sum(s * s) AS ss, count(*) AS k, max(n) AS n FROM (SELECT "group", metric, model, sum(rank) AS s, count(*) AS n FROM {_GR} GROUP BY ALL) GROUP BY ALL)
    JOIN (SELECT "group", metric, sum(c * c * c - c) AS t FROM (SELECT "group", metric, count(*) AS c FROM {_GR} GROUP BY "group", metric, block, score) GROUP BY ALL) USING ("group", metric))""",
    "chi2 p_value",
)
def group_significance(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    by = [F.col("o_orderstatus").alias("group"), (F.col("o_custkey") % 6).cast("int").alias("block"), F.col("o_orderpriority").alias("model")]
    both = o.groupBy(*by).agg(F.avg("o_totalprice").alias("mean"), F.max("o_totalprice").alias("max"))
    return compare.group_significance(both.unpivot(["group", "block", "model"], ["mean", "max"], "metric", "score"))


@query(
    """SELECT "group", count(*) AS rows FROM (
        SELECT DISTINCT o_orderstatus AS "group", o_custkey % 6 AS block, o_orderpriority AS model, 'own' AS source FROM orders
        UNION ALL SELECT DISTINCT g, o_custkey % 6, o_orderpriority, 'baseline' FROM orders, (VALUES ('O'), ('P')) AS t(g) WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT')
    GROUP BY 1"""
)
def baseline_import(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    s = o.groupBy(F.col("o_orderstatus").alias("group"), (F.col("o_custkey") % 6).cast("int").alias("block"), F.col("o_orderpriority").alias("model")).agg(F.avg("o_totalprice").alias("score"))
    return compare.with_baseline(s, "group", "F", ["1-URGENT"], ["O", "P"]).groupBy("group").agg(F.count("*").alias("rows"))
