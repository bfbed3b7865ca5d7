"""Queries over distances and tests between two tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import dist
from .registry import KINDS, NUMBERS, SRC, halves, long_sql, query, table

_X = NUMBERS[:3]


def gap_sql(cols, source=SRC):
    """ECDF gaps of both sources at every distinct value."""
    return f"""SELECT *, sum(nr) OVER w / tr - sum(ns) OVER w / ts AS gap, lead(x) OVER w AS next FROM (
        SELECT *, sum(nr) OVER (PARTITION BY col) AS tr, sum(ns) OVER (PARTITION BY col) AS ts FROM (
            SELECT col, x, count(*) FILTER (src = 'real') AS nr, count(*) FILTER (src = 'synth') AS ns
            FROM ({long_sql(cols, source, 'src')}) GROUP BY col, x))
        WINDOW w AS (PARTITION BY col ORDER BY x)"""


def w1_sql(cols=_X, source=SRC):
    return f"""SELECT col, sum(abs(gap) * (next - x)) / (max(x) FILTER (nr > 0) - min(x) FILTER (nr > 0)) AS wasserstein
        FROM ({gap_sql(cols, source)}) GROUP BY col"""


def jsd_sql(cols=KINDS, source=SRC):
    return f"""SELECT col, greatest(sum(CASE WHEN p > 0 THEN p * log2(p / ((p + q) / 2)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(q / ((p + q) / 2)) ELSE 0 END) / 2, 0) AS js_divergence FROM (
        SELECT col, value, count(*) FILTER (src = 'real') / sum(count(*) FILTER (src = 'real')) OVER (PARTITION BY col) AS p,
               count(*) FILTER (src = 'synth') / sum(count(*) FILTER (src = 'synth')) OVER (PARTITION BY col) AS q
        FROM ({long_sql(cols, source, 'src', 'value', 'VARCHAR')}) GROUP BY col, value) GROUP BY col"""


@query(w1_sql(), "wasserstein")
def wasserstein(spark, sf_dir):
    return dist.wasserstein(*halves(spark, sf_dir), _X)


@query(jsd_sql(), "js_divergence")
def js_divergence(spark, sf_dir):
    return dist.js_divergence(*halves(spark, sf_dir), KINDS)


def hist_sql(cols, bins, source=SRC):
    return f"""SELECT g.col, g.bin, g.lo, g.width, coalesce(nr, 0) AS nr, coalesce(ns, 0) AS ns FROM
        (SELECT col, lo, width, unnest(range({bins})) AS bin FROM (SELECT col, min(x) AS lo, (max(x) - min(x)) / {bins} AS width FROM ({long_sql(cols, source, 'src')}) GROUP BY col)) g
        LEFT JOIN (SELECT col, least(floor((x - lo) / width), {bins - 1}) AS bin, count(*) FILTER (src = 'real') AS nr, count(*) FILTER (src = 'synth') AS ns
            FROM ({long_sql(cols, source, 'src')}) JOIN (SELECT col, min(x) AS lo, (max(x) - min(x)) / {bins} AS width FROM ({long_sql(cols, source, 'src')}) GROUP BY col) USING (col)
            GROUP BY 1, 2) h ON g.col = h.col AND g.bin = h.bin"""


def hist_jsd_sql(cols, source):
    return f"""SELECT col, sum(p * ln(p / ((p + q) / 2)) + q * ln(q / ((p + q) / 2))) / 2 AS histogram_jsd FROM (
        SELECT col, p / sum(p) OVER (PARTITION BY col) AS p, q / sum(q) OVER (PARTITION BY col) AS q FROM (
            SELECT col, nr / sum(nr) OVER (PARTITION BY col) + 1e-10 AS p, ns / sum(ns) OVER (PARTITION BY col) + 1e-10 AS q
            FROM ({hist_sql(cols, 50, source)}))) GROUP BY col"""


@query(hist_jsd_sql(["l_extendedprice", "l_quantity"], SRC), "histogram_jsd")
def histogram_jsd(spark, sf_dir):
    return dist.histogram_jsd(*halves(spark, sf_dir), ["l_extendedprice", "l_quantity"])


@query(f"SELECT col, max(abs(gap)) AS ks FROM ({gap_sql(_X)}) GROUP BY col", "ks")
def ks_statistic(spark, sf_dir):
    return dist.ks_test(*halves(spark, sf_dir), _X).select("col", "ks")


_EN = "(max(tr) * max(ts) / (max(tr) + max(ts)))"
_P = f"least(1, greatest(0, 2 * list_sum(list_transform(range(1, 101), lambda j: (CASE WHEN j % 2 = 1 THEN 1 ELSE -1 END) * exp(-2.0 * j * j * {_EN} * pow(max(abs(gap)), 2))))))"


@query(f"SELECT col, max(abs(gap)) AS ks, {_P} AS p_value FROM ({gap_sql(_X)}) GROUP BY col", "ks p_value")
def ks_test(spark, sf_dir):
    return dist.ks_test(*halves(spark, sf_dir), _X, exact_up_to=0)


@query(
    """WITH RECURSIVE v AS (SELECT CAST(s_acctbal AS DOUBLE) AS x, s_suppkey % 2 = 0 AS real FROM supplier),
    n AS (SELECT count(*) FILTER (real) AS n1, count(*) FILTER (NOT real) AS n2 FROM v),
    e AS (SELECT max(abs(n2 * f - n1 * g)) AS far FROM (SELECT DISTINCT x, count(*) FILTER (real) OVER w AS f, count(*) FILTER (NOT real) OVER w AS g FROM v WINDOW w AS (ORDER BY x)), n),
    walk AS (
        SELECT 0 AS s, list_transform(range(0, n1 + 1), lambda i: 0.0::DOUBLE) AS q, n1, n2, far FROM n, e
        UNION ALL
        SELECT s + 1, list_transform(range(0, n1 + 1), lambda i: CASE WHEN s + 1 - i < 0 OR s + 1 - i > n2 THEN 0.0 WHEN abs(i * n2 - (s + 1 - i) * n1) >= far THEN 1.0
            ELSE (CASE WHEN i > 0 THEN q[i] * i ELSE 0.0 END + q[i + 1] * (s + 1 - i)) / (s + 1) END), n1, n2, far FROM walk WHERE s < n1 + n2)
    SELECT 's_acctbal' AS col, far / (n1 * n2) AS ks, q[n1 + 1] AS p_value FROM walk WHERE s = n1 + n2""",
    "ks p_value",
)
def ks_exact(spark, sf_dir):
    """The exact p-value on a small table, by counting lattice paths."""
    s = table(spark, sf_dir, "supplier")
    return dist.ks_test(s.where("s_suppkey % 2 = 0"), s.where("s_suppkey % 2 = 1"), ["s_acctbal"])


def chi2_sql(cols=KINDS, source=SRC):
    cell = "pow(abs({n} - e) - CASE WHEN k = 2 THEN least(0.5, abs({n} - e)) ELSE 0 END, 2) / e"
    a, b = cell.format(n="a").replace("e)", "(a + b) * ta / (ta + tb))").replace("/ e", "/ ((a + b) * ta / (ta + tb))"), cell.format(n="b").replace("e)", "(a + b) * tb / (ta + tb))").replace("/ e", "/ ((a + b) * tb / (ta + tb))")
    return f"""SELECT col, sum({a} + {b}) AS chi2, CAST(max(k) - 1 AS DOUBLE) AS dof FROM (
        SELECT *, sum(a) OVER (PARTITION BY col) AS ta, sum(b) OVER (PARTITION BY col) AS tb, count(*) OVER (PARTITION BY col) AS k FROM (
            SELECT col, value, count(*) FILTER (src = 'real') AS a, count(*) FILTER (src = 'synth') AS b FROM ({long_sql(cols, source, 'src', 'value', 'VARCHAR')}) GROUP BY col, value)) GROUP BY col"""


@query(chi2_sql(), "chi2 dof")
def chi2_homogeneity(spark, sf_dir):
    return dist.chi2_homogeneity(*halves(spark, sf_dir), KINDS).drop("p_value")


@query(
    f"""SELECT col, 'ks' AS test, ks AS statistic FROM (SELECT col, max(abs(gap)) AS ks FROM ({gap_sql(_X)}) GROUP BY col)
    UNION ALL SELECT col, 'chi2', chi2 FROM ({chi2_sql()})""",
    "statistic",
)
def covariate_shift(spark, sf_dir):
    return dist.covariate_shift(*halves(spark, sf_dir), _X, KINDS).select("col", "test", "statistic")


# survival of chi-square with 2 degrees of freedom, and with 1 by Simpson's rule over the error function
_CHI = """CASE WHEN dof = 2 THEN exp(-chi2 / 2) ELSE 1 - 2 / sqrt(pi()) * sqrt(chi2 / 2) / 600 * list_sum(list_transform(range(0, 201),
    lambda i: (CASE WHEN i IN (0, 200) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) * exp(-pow(sqrt(chi2 / 2) * i / 200, 2)))) END"""


@query(
    f"""SELECT *, p_value < 0.05 AS shifted FROM (SELECT col, 'ks' AS test, max(abs(gap)) AS statistic, {_P} AS p_value FROM ({gap_sql(_X)}) GROUP BY col
    UNION ALL SELECT col, 'chi2', chi2, {_CHI} FROM ({chi2_sql()}))""",
    "statistic p_value",
)
def covariate_shift_verdicts(spark, sf_dir):
    return dist.covariate_shift(*halves(spark, sf_dir), _X, KINDS, exact_up_to=0)


_K2 = """SELECT col, z1 * z1 + z2 * z2 AS k2, exp(-(z1 * z1 + z2 * z2) / 2) AS p_value, exp(-(z1 * z1 + z2 * z2) / 2) >= 0.05 AS normal FROM (
    SELECT col, asinh(y / sqrt(2 / (w2 - 1))) / sqrt(0.5 * ln(w2)) AS z1,
        ((1 - 2 / (9 * a)) - sign(1 + x * sqrt(2 / (a - 4))) * pow((1 - 2 / a) / abs(1 + x * sqrt(2 / (a - 4))), 1.0 / 3)) / sqrt(2 / (9 * a)) AS z2 FROM (
    SELECT *, 6 + 8 / s * (2 / s + sqrt(1 + 4 / (s * s))) AS a FROM (
    SELECT col, g1 * sqrt((n + 1) * (n + 3) / (6 * (n - 2))) AS y,
        sqrt(2 * (3 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9)) - 1)) - 1 AS w2,
        (b2 - 3 * (n - 1) / (n + 1)) / sqrt(24 * n * (n - 2) * (n - 3) / ((n + 1) * (n + 1) * (n + 3) * (n + 5))) AS x,
        6 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * sqrt(6 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3))) AS s FROM (
    SELECT col, n, skewness * (n - 2) / sqrt(n * (n - 1)) AS g1, (kurtosis * (n - 2) * (n - 3) / (n - 1) - 6) / (n + 1) + 3 AS b2 FROM (
    SELECT col, CAST(count(x) AS DOUBLE) AS n, skewness(x) AS skewness, kurtosis(x) AS kurtosis FROM ({long}) GROUP BY col)))))"""


@query(_K2.format(long=long_sql(["c_acctbal", "c_custkey"], "customer")), "k2:3 p_value")
def normality_k2(spark, sf_dir):
    return dist.normality(table(spark, sf_dir, "customer"), ["c_acctbal", "c_custkey"])


_KDE = """WITH v AS (SELECT CAST(p_retailprice AS DOUBLE) AS x FROM part), a AS (SELECT count(*) AS n, min(x) AS lo, max(x) AS hi, 1.06 * stddev_samp(x) * pow(count(*), -0.2) AS h FROM v),
    c AS (SELECT x, count(*) AS m FROM v GROUP BY x),
    f AS (SELECT i, sum(m * exp(-pow((lo + i * (hi - lo) / 99 - x) / h, 2) / 2)) / any_value(n * h) AS f FROM c, a, (SELECT unnest(range(100)) AS i) GROUP BY i),
    p AS (SELECT *, lag(f) OVER (ORDER BY i) AS b, lead(f) OVER (ORDER BY i) AS e, max(f) OVER () AS top FROM f),
    t AS (SELECT p.i, p.f AS peak, p.top, (SELECT max(j.i) FROM f j WHERE j.i < p.i AND j.f > p.f) AS l, (SELECT min(j.i) FROM f j WHERE j.i > p.i AND j.f > p.f) AS r FROM p WHERE f > b AND f > e),
    m AS (SELECT t.*, (SELECT min(j.f) FROM f j WHERE j.i < t.i AND j.i > coalesce(t.l, -1)) AS ml, (SELECT min(j.f) FROM f j WHERE j.i > t.i AND j.i < coalesce(t.r, 100)) AS mr FROM t)
    SELECT 'p_retailprice' AS col, greatest(count(*), 1) AS modes FROM m WHERE peak - greatest(ml, mr) >= 0.01 * top"""


@query(_KDE)
def kde_modes(spark, sf_dir):
    return dist.kde_modes(table(spark, sf_dir, "part"), ["p_retailprice"], 100)


_TESTS = "(SELECT o_orderpriority || o_orderstatus AS test, exp(-count(*) / 100.0) AS p_value FROM orders GROUP BY 1)"


def _tests(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return o.groupBy(F.concat("o_orderpriority", "o_orderstatus").alias("test")).agg(F.exp(-F.count("*") / 100.0).alias("p_value"))


@query(f"SELECT *, least(p_value * count(*) OVER (), 1) AS adjusted FROM {_TESTS}", "p_value:9 adjusted:9")
def p_adjust_bonferroni(spark, sf_dir):
    return dist.adjust_p(_tests(spark, sf_dir), "bonferroni")


def _bh_sql(factor):
    return f"""SELECT test, p_value, least(min(raw) OVER (ORDER BY r DESC ROWS UNBOUNDED PRECEDING), 1) AS adjusted FROM (
        SELECT *, p_value * n / r * {factor} AS raw FROM (SELECT *, row_number() OVER (ORDER BY p_value) AS r, count(*) OVER () AS n FROM {_TESTS}))"""


@query(_bh_sql("1"), "p_value:9 adjusted:9")
def p_adjust_bh(spark, sf_dir):
    return dist.adjust_p(_tests(spark, sf_dir), "bh")


@query(_bh_sql("(SELECT sum(1.0 / i) FROM (SELECT unnest(range(1, 16)) AS i) WHERE i <= n)"), "p_value:9 adjusted:9")
def p_adjust_by(spark, sf_dir):
    return dist.adjust_p(_tests(spark, sf_dir), "by")


@query(f"SELECT avg(d) AS fidelity_score FROM (SELECT wasserstein AS d FROM ({w1_sql()}) UNION ALL SELECT js_divergence FROM ({jsd_sql()}))", "fidelity_score")
def mean_distance(spark, sf_dir):
    return dist.mean_distance(*halves(spark, sf_dir), _X, KINDS)


def _candidate_sql(k):
    src = f"(SELECT *, CASE WHEN l_orderkey % 5 = 0 THEN 'real' ELSE 'synth' END AS src FROM lineitem WHERE l_orderkey % 5 = 0 OR l_orderkey % 5 = {k})"
    d = f"(SELECT avg(d) FROM (SELECT wasserstein AS d FROM ({w1_sql(_X, src)}) UNION ALL SELECT js_divergence FROM ({jsd_sql(KINDS, src)})))"
    return f"SELECT {k} AS candidate, {d} AS fidelity, (SELECT avg(CASE WHEN l_quantity >= 10 THEN 0.0 ELSE 1.0 END) FROM lineitem WHERE l_orderkey % 5 = {k}) AS violation_rate"


@query(
    f"SELECT *, row_number() OVER (ORDER BY objective, candidate) AS rank FROM (SELECT *, 0.7 * fidelity + 0.3 * violation_rate AS objective FROM ({' UNION ALL '.join(_candidate_sql(k) for k in range(1, 5))}))",
    "fidelity violation_rate objective",
)
def candidate_ranking(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").withColumn("candidate", (F.col("l_orderkey") % 5).cast("int"))
    return dist.rank_candidates(li.where("candidate = 0"), li.where("candidate > 0"), "candidate", _X, KINDS, ~(F.col("l_quantity") >= 10))


