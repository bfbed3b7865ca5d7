"""Queries over the profiles of columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import assoc, dist, profile
from .associations import _V3, VIF_SQL
from .distances import _K2
from .registry import KINDS, NUMBERS, long_sql, query, table

_HOLES = "(SELECT CASE WHEN l_orderkey % 7 = 0 THEN NULL ELSE l_quantity END AS l_quantity, CASE WHEN l_partkey % 5 = 0 THEN NULL ELSE l_discount END AS l_discount, CASE WHEN l_orderkey % 7 = 0 OR l_suppkey % 3 = 0 THEN NULL ELSE l_tax END AS l_tax, l_returnflag FROM lineitem)"


def _holes(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    hole = lambda c, when: F.when(~F.expr(when), F.col(c)).alias(c)
    return li.select(hole("l_quantity", "l_orderkey % 7 = 0"), hole("l_discount", "l_partkey % 5 = 0"), hole("l_tax", "l_orderkey % 7 = 0 OR l_suppkey % 3 = 0"), "l_returnflag")


_DESCRIBE = f"""SELECT col, count(x) AS count, avg(x) AS mean, stddev_samp(x) AS std, min(x) AS min,
    quantile_cont(x, 0.25) AS q25, quantile_cont(x, 0.5) AS median, quantile_cont(x, 0.75) AS q75, max(x) AS max,
    skewness(x) AS skew, kurtosis(x) AS kurtosis, quantile_cont(x, 0.75) - quantile_cont(x, 0.25) AS iqr,
    max(x) - min(x) AS range, count(*) FILTER (x = 0) AS zero_count, count(*) FILTER (x = 0) / count(*) AS zero_ratio
    FROM ({long_sql(NUMBERS, 'lineitem')}) GROUP BY col"""


@query(_DESCRIBE, "mean:4 std:4 min q25 median q75 max skew kurtosis iqr range zero_ratio")
def describe_continuous(spark, sf_dir):
    return profile.describe_continuous(table(spark, sf_dir, "lineitem"), NUMBERS)


_FREQ = "SELECT col, value, count(*) AS n, count(*) / sum(count(*)) OVER (PARTITION BY col) AS share FROM ({long}) GROUP BY col, value"
_CATS = ["o_orderstatus", "o_orderpriority"]


def freq_sql(cols: list[str], source: str) -> str:
    return _FREQ.format(long=long_sql(cols, source, value="value", kind="VARCHAR"))


@query(
    f"""SELECT col, CAST(sum(n) AS BIGINT) AS count, count(*) AS cardinality, max(value) FILTER (rank = 1) AS mode, max(n) AS mode_freq,
    max(share) AS mode_pct, abs(sum(-share * log2(share))) AS entropy,
    string_agg(value || '=' || n, ';' ORDER BY rank) FILTER (rank <= 20) AS top_values
    FROM (SELECT *, row_number() OVER (PARTITION BY col ORDER BY n DESC, value) AS rank FROM ({freq_sql(_CATS, 'orders')})) GROUP BY col""",
    "mode_pct entropy",
)
def describe_categorical(spark, sf_dir):
    return profile.describe_categorical(table(spark, sf_dir, "orders"), _CATS)


@query(
    f"""SELECT value, n, share, max(n) OVER () / min(n) OVER () AS imbalance_ratio, abs(sum(-share * log2(share)) OVER ()) AS entropy
    FROM ({freq_sql(['c_mktsegment'], 'customer')})""",
    "share imbalance_ratio entropy",
)
def class_balance(spark, sf_dir):
    return profile.class_balance(table(spark, sf_dir, "customer"), "c_mktsegment")


_HOLED = ["l_quantity", "l_discount", "l_tax", "l_returnflag"]


@query(
    " UNION ALL ".join(f"SELECT '{c}' AS col, count(*) - count({c}) AS missing, round(100.0 * (count(*) - count({c})) / count(*), 4) AS missing_pct FROM {_HOLES}" for c in _HOLED)
    + f" UNION ALL SELECT '*', {' + '.join(f'count(*) - count({c})' for c in _HOLED)}, round(100.0 * ({' + '.join(f'count(*) - count({c})' for c in _HOLED)}) / (4 * count(*)), 4) FROM {_HOLES}",
    "missing_pct:3",
)
def missing_profile(spark, sf_dir):
    return profile.missing_profile(_holes(spark, sf_dir), _HOLED)


@query(
    " UNION ALL ".join(
        f"SELECT '{a}' AS col_i, '{b}' AS col_j, corr(CAST({a} IS NULL AS INT), CAST({b} IS NULL AS INT)) AS corr FROM {_HOLES}" for a, b in (("l_quantity", "l_discount"), ("l_quantity", "l_tax"), ("l_discount", "l_tax"))
    ),
    "corr",
)
def nullity_corr(spark, sf_dir):
    return profile.nullity_correlation(_holes(spark, sf_dir), ["l_quantity", "l_discount", "l_tax", "l_returnflag"])


_KEYS = ["l_partkey", "l_quantity"]


@query(
    "SELECT CAST(sum(n) AS BIGINT) AS rows, CAST(sum(n - 1) AS BIGINT) AS duplicates, 100.0 * sum(n - 1) / sum(n) AS duplicate_pct FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_partkey, l_quantity)",
    "duplicate_pct",
)
def duplicates(spark, sf_dir):
    return profile.duplicates(table(spark, sf_dir, "lineitem"), _KEYS)


@query(
    f"""SELECT col, count(*) AS cardinality, count(*) FILTER (share < 0.01) AS rare_count,
    coalesce(array_to_string(list_slice(list(value ORDER BY value) FILTER (share < 0.01), 1, 20), ';'), '') AS rare_values
    FROM ({freq_sql(['p_brand', 'p_type', 'p_size'], 'part')}) GROUP BY col"""
)
def cardinality(spark, sf_dir):
    return profile.cardinality(table(spark, sf_dir, "part"), ["p_brand", "p_type", "p_size"])


_OUT = ["o_totalprice", "o_custkey"]


def _outlier_sql(bounds: str) -> str:
    long = long_sql(_OUT, "orders")
    return f"""SELECT col, any_value(lower) AS lower, any_value(upper) AS upper, count(*) FILTER (x < lower OR x > upper) AS outliers,
        100.0 * count(*) FILTER (x < lower OR x > upper) / (SELECT count(*) FROM orders) AS outlier_pct
        FROM ({long}) JOIN ({bounds.format(long=long)}) USING (col) GROUP BY col"""


@query(_outlier_sql("SELECT col, quantile_cont(x, 0.25) - 0.5 * (quantile_cont(x, 0.75) - quantile_cont(x, 0.25)) AS lower, quantile_cont(x, 0.75) + 0.5 * (quantile_cont(x, 0.75) - quantile_cont(x, 0.25)) AS upper FROM ({long}) GROUP BY col"), "lower:3 upper:3 outlier_pct")
def outliers_iqr(spark, sf_dir):
    return profile.outliers_iqr(table(spark, sf_dir, "orders"), _OUT, 0.5)


@query(_outlier_sql("SELECT col, avg(x) - 1.5 * stddev_samp(x) AS lower, avg(x) + 1.5 * stddev_samp(x) AS upper FROM ({long}) GROUP BY col"), "lower:3 upper:3 outlier_pct")
def outliers_zscore(spark, sf_dir):
    return profile.outliers_zscore(table(spark, sf_dir, "orders"), _OUT, 1.5)


_MAD = "SELECT col, any_value(med) - 1.0 * median(abs(x - med)) / 0.6745 AS lower, any_value(med) + 1.0 * median(abs(x - med)) / 0.6745 AS upper FROM ({long}) JOIN (SELECT col, median(x) AS med FROM ({long}) GROUP BY col) USING (col) GROUP BY col"


@query(_outlier_sql(_MAD), "lower:3 upper:3 outlier_pct")
def outliers_mad(spark, sf_dir):
    return profile.outliers_mad(table(spark, sf_dir, "orders"), _OUT, 1.0)


@query(
    """SELECT o_orderkey, coalesce(o_totalprice < m - 1.5 * s OR o_totalprice > m + 1.5 * s, false) AS o_totalprice_outlier
    FROM orders, (SELECT avg(o_totalprice) AS m, stddev_samp(o_totalprice) AS s FROM orders)"""
)
def outlier_mask(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    return profile.outlier_mask(o, ["o_totalprice"], profile.zscore_bounds(o, ["o_totalprice"], 1.5)).drop("o_totalprice")


@query(
    f"""SELECT col, CASE WHEN abs(skewness(x)) > 1.5 AND min(x) >= 0 THEN 'log1p' WHEN min(x) < 0 THEN 'standard' ELSE 'minmax' END AS scaling,
    CASE WHEN abs(skewness(x)) > 1 THEN 'median' ELSE 'mean' END AS imputation, CAST(NULL AS VARCHAR) AS encoding
    FROM ({long_sql(['c_acctbal', 'c_custkey'], 'customer')}) GROUP BY col
    UNION ALL SELECT col, NULL, 'mode', CASE WHEN count(*) <= 10 THEN 'onehot' ELSE 'label' END
    FROM ({freq_sql(['c_mktsegment', 'c_nationkey'], 'customer')}) GROUP BY col"""
)
def strategy_advice(spark, sf_dir):
    return profile.strategy_advice(table(spark, sf_dir, "customer"), ["c_acctbal", "c_custkey"], ["c_mktsegment", "c_nationkey"])


@query(
    f"""SELECT (SELECT count(*) FROM ({_DESCRIBE}) WHERE zero_ratio > 0.05) AS zero_inflated,
    (SELECT count(*) FROM ({_K2.format(long=long_sql(_V3, "lineitem"))}) WHERE NOT normal) AS not_normal, (SELECT count(*) FROM ({VIF_SQL}) WHERE vif > 5) AS collinear,
    (SELECT count(*) FROM (SELECT col FROM ({freq_sql(KINDS, 'lineitem')}) GROUP BY col HAVING count(*) FILTER (share < 0.01) > 0)) AS with_rare_values"""
)
def key_numbers(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    zero = profile.describe_continuous(li, NUMBERS).agg(F.count_if(F.col("zero_ratio") > 0.05).alias("zero_inflated"))
    odd = dist.normality(li, _V3).agg(F.count_if(~F.col("normal")).alias("not_normal"))
    tied = assoc.vif(li, _V3).agg(F.count_if(F.col("vif") > 5).alias("collinear"))
    rare = profile.cardinality(li, KINDS).agg(F.count_if(F.col("rare_count") > 0).alias("with_rare_values"))
    return zero.join(odd).join(tied).join(rare)  # one row each


@query("SELECT count(*) AS rows, 6 AS columns, count(*) - count(value) + count(*) - count(props) + count(*) - count(event_type) AS nulls, 'bigint=2;double=1;string=2;timestamp_ntz=1' AS types FROM events")
def table_summary(spark, sf_dir):
    return profile.summary(table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp_ntz").alias("ts"), "user_id", "event_type", "value", "props"))


@query(
    """SELECT count(*) AS rows, count(*) FILTER (l_quantity >= 50) AS at_least, count(*) FILTER (l_quantity >= 50) / count(*) AS at_least_share,
    count(*) FILTER (l_quantity = 1) AS equal, count(*) FILTER (l_quantity = 1) / count(*) AS equal_share FROM lineitem""",
    "at_least_share equal_share",
)
def extreme_scan(spark, sf_dir):
    return profile.value_share(table(spark, sf_dir, "lineitem"), "l_quantity", 50, 1)


@query(f"SELECT o_orderstatus, o_orderpriority, avg(o_totalprice) AS score FROM orders GROUP BY ALL", "score:4")  # noqa: F541
def pivoted_mean(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy("o_orderstatus", "o_orderpriority").agg(F.avg("o_totalprice").alias("score"))


@query(f"SELECT count(*) AS columns, sum(CASE WHEN normal THEN 1 ELSE 0 END) AS normal FROM (SELECT col, false AS normal FROM ({long_sql(NUMBERS[:2], 'lineitem')}) GROUP BY col)")
def normality_count(spark, sf_dir):
    return dist.normality(table(spark, sf_dir, "lineitem"), NUMBERS[:2]).agg(F.count("*").alias("columns"), F.count_if("normal").cast("decimal(38,0)").alias("normal"))

