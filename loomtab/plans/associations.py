"""Queries over associations between columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import assoc, knn_information
from .registry import KINDS, NUMBERS, halves, query, table

_PAIRS = assoc.all_pairs(NUMBERS)


@query(" UNION ALL ".join(f"SELECT '{a}' AS col_i, '{b}' AS col_j, corr({a}, {b}) AS corr FROM lineitem" for a, b in _PAIRS), "corr")
def pearson(spark, sf_dir):
    return assoc.pearson(table(spark, sf_dir, "lineitem"), _PAIRS)


def _spearman_sql(a: str, b: str) -> str:
    rank = lambda c: f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2"
    return f"SELECT '{a}' AS col_i, '{b}' AS col_j, corr(ra, rb) AS spearman FROM (SELECT {rank(a)} AS ra, {rank(b)} AS rb FROM lineitem WHERE {a} IS NOT NULL AND {b} IS NOT NULL)"


@query(" UNION ALL ".join(_spearman_sql(a, b) for a, b in _PAIRS[:3]), "spearman")
def spearman(spark, sf_dir):
    return assoc.spearman(table(spark, sf_dir, "lineitem"), _PAIRS[:3])


_LI = KINDS + ["l_linenumber"]
_CAT = assoc.all_pairs(_LI)
_CELLS = """SELECT '{a}' AS col_i, '{b}' AS col_j, CAST({a} AS VARCHAR) AS a, CAST({b} AS VARCHAR) AS b, count(*) AS n,
    sum(count(*)) OVER (PARTITION BY {a}) AS na, sum(count(*)) OVER (PARTITION BY {b}) AS nb, sum(count(*)) OVER () AS total
    FROM {t} WHERE {a} IS NOT NULL AND {b} IS NOT NULL GROUP BY {a}, {b}"""


def cells(pairs, t="lineitem"):
    return " UNION ALL ".join(_CELLS.format(a=a, b=b, t=t) for a, b in pairs)


def v_sql(pairs, t="lineitem", chi2="greatest(n * (s - 1), 0)"):
    return f"""SELECT col_i, col_j, CASE WHEN least(r, k) = 1 OR under <= 0 THEN 0.0 ELSE sqrt(phi / under) END AS cramers_v FROM (
        SELECT *, greatest(0, {chi2} / n - (k - 1) * (r - 1) / (n - 1)) AS phi,
               least(k - pow(k - 1, 2) / (n - 1), r - pow(r - 1, 2) / (n - 1)) - 1 AS under FROM (
            SELECT col_i, col_j, max(total) AS n, sum(n / na * n / nb) AS s, count(DISTINCT a) AS r, count(DISTINCT b) AS k,
                   sum(pow(greatest(abs(n - na * nb / total) - least(0.5, abs(n - na * nb / total)), 0), 2) / (na * nb / total)) AS y,
                   count(*) AS seen
            FROM ({cells(pairs, t)}) GROUP BY col_i, col_j))"""


@query(v_sql(_CAT), "cramers_v")
def cramers_v(spark, sf_dir):
    return assoc.cramers_v(table(spark, sf_dir, "lineitem"), _CAT)


_TWO = "(SELECT l_linestatus, CASE WHEN l_quantity > 25 THEN 'many' ELSE 'few' END AS amount, l_returnflag FROM lineitem)"
_TWO_PAIRS = [("l_linestatus", "amount"), ("l_returnflag", "amount")]


@query(v_sql(_TWO_PAIRS, _TWO, "CASE WHEN r = 2 AND k = 2 THEN y ELSE greatest(n * (s - 1), 0) END"), "cramers_v")
def cramers_v_yates(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").withColumn("amount", F.when(F.col("l_quantity") > 25, "many").otherwise("few"))
    return assoc.cramers_v(li, _TWO_PAIRS, yates=True)


_ETA = [(c, x) for c in KINDS for x in NUMBERS]


def eta_sql(pairs, t="lineitem"):
    return " UNION ALL ".join(
        f"""SELECT '{c}' AS col_i, '{x}' AS col_j, CASE WHEN any_value(t) > 0 THEN sqrt(sum(n * pow(m - mean, 2)) / any_value(t)) ELSE 0 END AS eta
        FROM (SELECT {c}, count(*) AS n, avg({x}) AS m FROM {t} GROUP BY {c}),
             (SELECT avg({x}) AS mean, var_pop({x}) * count(*) AS t FROM {t})"""
        for c, x in pairs
    )


@query(eta_sql(_ETA), "eta")
def corr_ratio(spark, sf_dir):
    return assoc.correlation_ratio(table(spark, sf_dir, "lineitem"), _ETA)


_INFO = "SELECT col_i, col_j, greatest(sum(n / total * log2(n * total / (na * nb))), 0) AS mi, abs(sum(-n / total * log2(na / total))) AS hi, abs(sum(-n / total * log2(nb / total))) AS hj FROM ({cells}) GROUP BY col_i, col_j"


@query(f"SELECT col_i, col_j, CASE WHEN hi + hj > 0 THEN 2 * mi / (hi + hj) ELSE 0 END AS theils_u FROM ({_INFO.format(cells=cells(_CAT))})", "theils_u")
def theils_u(spark, sf_dir):
    return assoc.theils_u(table(spark, sf_dir, "lineitem"), _CAT)


_BINNED = "(SELECT l_returnflag, l_linestatus, least(floor((l_quantity - lo) / ((hi - lo) / 10)), 9) AS l_quantity FROM lineitem, (SELECT min(l_quantity) AS lo, max(l_quantity) AS hi FROM lineitem))"
_MI = [("l_returnflag", "l_linestatus"), ("l_returnflag", "l_quantity")]


@query(f"SELECT col_i, col_j, mi, CASE WHEN col_j = 'l_quantity' THEN 'binned' ELSE 'plug-in' END AS estimator FROM ({_INFO.format(cells=cells(_MI, _BINNED))})", "mi")
def mutual_info(spark, sf_dir):
    return assoc.mutual_information(table(spark, sf_dir, "lineitem"), _MI, ["l_quantity"])


_RANK = [("l_linestatus", "l_returnflag"), ("l_quantity", "l_returnflag"), ("l_linenumber", "l_returnflag")]
_BINNED2 = _BINNED.replace("SELECT l_returnflag", "SELECT l_linenumber, l_returnflag")


@query(
    f"""SELECT col_i AS feature, mi, CASE WHEN col_i = 'l_quantity' THEN 'binned' ELSE 'plug-in' END AS estimator,
    CASE WHEN mi > 0.3 THEN 'strong' WHEN mi > 0.15 THEN 'medium' ELSE 'weak' END AS strength, row_number() OVER (ORDER BY mi DESC, col_i) AS rank
    FROM ({_INFO.format(cells=cells(_RANK, _BINNED2))})""",
    "mi",
)
def mi_ranking(spark, sf_dir):
    return assoc.mi_ranking(table(spark, sf_dir, "lineitem"), [a for a, _ in _RANK], "l_returnflag", ["l_quantity"])


@query(
    """SELECT greatest(sum(n / t * log2(n * nz / (xz * yz))), 0) AS cmi FROM (
        SELECT *, sum(n) OVER (PARTITION BY x, z) AS xz, sum(n) OVER (PARTITION BY y, z) AS yz, sum(n) OVER (PARTITION BY z) AS nz, sum(n) OVER () AS t
        FROM (SELECT l_returnflag AS x, l_linestatus AS y, l_linenumber AS z, count(*) AS n FROM lineitem GROUP BY ALL))""",
    "cmi",
)
def cond_mutual_info(spark, sf_dir):
    return assoc.conditional_mutual_information(table(spark, sf_dir, "lineitem"), "l_returnflag", "l_linestatus", "l_linenumber")


# neighbours by comparing all rows; psi(n) of whole numbers by harmonic sums
_PSI = "(CASE WHEN {0} > 1 THEN list_sum(list_transform(range(1, CAST({0} AS BIGINT)), lambda i: 1.0::DOUBLE / i)) ELSE 0.0 END - 0.5772156649015329)"
_KNN2 = f"""SELECT 'c_acctbal' AS col_i, 'spend' AS col_j, greatest(0, {_PSI.format("any_value(n)")} + {_PSI.format("3")} - avg({_PSI.format("cx")}) - avg({_PSI.format("cy")})) / ln(2) AS mi, 'neighbours' AS estimator FROM (
    SELECT a.i, any_value(a.n) AS n, count(*) FILTER (abs(b.x - a.x) < r - 1e-12 * (abs(a.x) + r) OR b.x = a.x) AS cx, count(*) FILTER (abs(b.y - a.y) < r - 1e-12 * (abs(a.y) + r) OR b.y = a.y) AS cy
    FROM (SELECT a.i, a.x, a.y, any_value(a.n) AS n, list_sort(list(greatest(abs(b.x - a.x), abs(b.y - a.y))))[4] AS r FROM p a, p b GROUP BY a.i, a.x, a.y) a, p b GROUP BY a.i)"""
_KNN1 = f"""SELECT 'c_acctbal' AS col_i, 'c_mktsegment' AS col_j, greatest(0, {_PSI.format("any_value(n)")} + avg({_PSI.format("kk")}) - avg({_PSI.format("size")}) - avg({_PSI.format("m")})) / ln(2) AS mi, 'neighbours' AS estimator FROM (
    SELECT a.i, any_value(a.n) AS n, any_value(kk) AS kk, any_value(size) AS size, count(*) FILTER (abs(b.x - a.x) < r - 1e-12 * (abs(a.x) + r) OR b.x = a.x) AS m
    FROM (SELECT a.i, a.x, any_value(a.n) AS n, count(*) AS size, least(3, count(*) - 1) AS kk, list_sort(list(abs(b.x - a.x)))[least(3, count(*) - 1) + 1] AS r FROM p a JOIN p b USING (g) GROUP BY a.i, a.x) a, p b GROUP BY a.i)"""


@query(
    f"""WITH s AS (SELECT o_custkey AS i, sum(CAST(o_totalprice AS DOUBLE)) AS spend FROM orders GROUP BY o_custkey),
    t AS (SELECT c_custkey AS i, CAST(c_acctbal AS DOUBLE) AS x, round(spend) AS y, c_mktsegment AS g FROM customer JOIN s ON c_custkey = i),
    p AS (SELECT i, x / stddev_pop(x) OVER () AS x, y / stddev_pop(y) OVER () AS y, g, count(*) OVER () AS n FROM t)
    {_KNN2} UNION ALL {_KNN1}""",
    "mi:5",
)
def mi_neighbours(spark, sf_dir):
    """Information between balance, spending and segment of customers, by nearest neighbours."""
    spend = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.round(F.sum(F.col("o_totalprice").cast("double"))).alias("spend"))
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal", "c_mktsegment").join(spend, "c_custkey")
    return knn_information.neighbour_information(c, [("c_acctbal", "spend"), ("c_acctbal", "c_mktsegment")], ["c_acctbal", "spend"], ["c_custkey"], jitter=0)


_V3 = ["l_quantity", "l_extendedprice", "l_discount"]
_R3 = "(SELECT corr(l_quantity, l_extendedprice) AS a, corr(l_quantity, l_discount) AS b, corr(l_extendedprice, l_discount) AS c FROM lineitem)"
_DET = "(1 + 2 * a * b * c - a * a - b * b - c * c)"


VIF_SQL = f"SELECT 'l_quantity' AS col, (1 - c * c) / {_DET} AS vif FROM {_R3} UNION ALL SELECT 'l_extendedprice', (1 - b * b) / {_DET} FROM {_R3} UNION ALL SELECT 'l_discount', (1 - a * a) / {_DET} FROM {_R3}"


@query(VIF_SQL, "vif")
def vif(spark, sf_dir):
    return assoc.vif(table(spark, sf_dir, "lineitem"), _V3)


@query(f"SELECT 'l_quantity' AS col_i, 'l_extendedprice' AS col_j, (a - b * c) / sqrt((1 - b * b) * (1 - c * c)) AS partial_corr FROM {_R3}", "partial_corr")
def partial_corr(spark, sf_dir):
    return assoc.partial_correlation(table(spark, sf_dir, "lineitem"), "l_quantity", "l_extendedprice", ["l_discount"])


def matrix_sql(t="lineitem"):
    return (
        " UNION ALL ".join(f"SELECT '{a}' AS col_i, '{b}' AS col_j, 'pearson' AS kind, corr({a}, {b}) AS value FROM {t}" for a, b in _PAIRS)
        + f" UNION ALL SELECT col_i, col_j, 'cramers_v', cramers_v FROM ({v_sql([tuple(KINDS)], t)})"
        + f" UNION ALL SELECT col_i, col_j, 'eta', eta FROM ({eta_sql(_ETA, t)})"
    )


@query(matrix_sql(), "value")
def assoc_matrix(spark, sf_dir):
    return assoc.association_matrix(table(spark, sf_dir, "lineitem"), NUMBERS, KINDS)


_REAL, _SYNTH = ("(SELECT * FROM lineitem WHERE l_orderkey % 2 = 0)", "(SELECT * FROM lineitem WHERE l_orderkey % 2 = 1)")
_OVERLAY = f"SELECT col_i, col_j, kind, r.value AS real, s.value AS synth, abs(r.value - s.value) AS diff FROM ({matrix_sql(_REAL)}) r JOIN ({matrix_sql(_SYNTH)}) s USING (col_i, col_j, kind)"


@query(_OVERLAY, "real synth diff")
def corr_overlay(spark, sf_dir):
    return assoc.correlation_overlay(*halves(spark, sf_dir), NUMBERS, KINDS)


@query(f"SELECT avg(diff) AS corr_difference FROM ({_OVERLAY})", "corr_difference")
def corr_difference(spark, sf_dir):
    return assoc.correlation_difference(*halves(spark, sf_dir), NUMBERS, KINDS)
