"""Queries over splits, nearest neighbours and learning."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import compare, privacy, split, utility
from .registry import query, table

_KEY = ["o_orderkey"]


@query("SELECT split, count(*) AS n FROM (SELECT CASE WHEN row_number() OVER (ORDER BY o_orderkey) <= floor(0.8 * count(*) OVER ()) THEN 'train' ELSE 'test' END AS split FROM orders) GROUP BY split")
def split_80_20(spark, sf_dir):
    return split.split_share(table(spark, sf_dir, "orders"), _KEY).groupBy("split").agg(F.count("*").alias("n"))


@query("SELECT o_orderstatus, split, count(*) AS n FROM (SELECT o_orderstatus, CASE WHEN row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) <= floor(0.8 * count(*) OVER (PARTITION BY o_orderstatus)) THEN 'train' ELSE 'test' END AS split FROM orders) GROUP BY ALL")
def stratified_split(spark, sf_dir):
    return split.stratified_split(table(spark, sf_dir, "orders"), _KEY, "o_orderstatus").groupBy("o_orderstatus", "split").agg(F.count("*").alias("n"))


@query("SELECT o_orderkey, CASE WHEN row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) <= floor(0.8 * count(*) OVER (PARTITION BY o_orderstatus)) THEN 'train' ELSE 'test' END AS split FROM orders")
def stratified_split_by_key(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    return split.stratified_split(o, _KEY, "o_orderstatus", order=[F.col("o_orderkey")]).select("o_orderkey", "split")


@query("SELECT o_orderstatus, CAST((row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) - 1) % 5 AS INT) AS fold, o_orderkey FROM orders")
def kfold(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    return split.kfold(o, _KEY, 5, ["o_orderstatus"], order=[F.col("o_orderkey")]).select("o_orderstatus", "fold", "o_orderkey")


@query("SELECT least(1000, count(*)) AS n, least(1000, count(DISTINCT o_orderkey)) AS keys FROM orders")
def sample_exact(spark, sf_dir):
    return split.sample_exact(table(spark, sf_dir, "orders"), _KEY, 1000).agg(F.count("*").alias("n"), F.countDistinct("o_orderkey").alias("keys"))


@query(
    """SELECT 'o_orderstatus' AS col, o_orderstatus AS value, true AS even, (SELECT count(*) FROM orders) AS drawn, 0 AS strangers FROM orders GROUP BY o_orderstatus
    UNION ALL SELECT 'o_orderpriority', o_orderpriority, true, (SELECT count(*) FROM orders), 0 FROM orders GROUP BY o_orderpriority"""
)
def balanced_resample(spark, sf_dir):
    """Draws per category: as many as an even draw gives, within five standard errors; and drawn rows that don't hold their category."""
    o = table(spark, sf_dir, "orders")
    cols = ["o_orderstatus", "o_orderpriority"]
    n = o.count()
    drawn = split.balanced_resample(o, _KEY, cols, n).join(o.select(*_KEY, *cols), _KEY)
    own = F.when(F.col("col") == cols[0], F.col(cols[0])).otherwise(F.col(cols[1]))
    each = drawn.groupBy("col", "value").agg(F.count("*").alias("n"), F.count_if(own != F.col("value")).cast("int").alias("strangers"))
    sizes = o.agg(*[F.count_distinct(c).alias(c) for c in cols])
    met = each.join(F.broadcast(sizes)).join(F.broadcast(each.agg(F.sum("n").alias("drawn"))))
    even = n / (2 * F.when(F.col("col") == cols[0], F.col(cols[0])).otherwise(F.col(cols[1])))
    return met.select("col", "value", (F.abs(F.col("n") - even) < 5 * F.sqrt(even)).alias("even"), "drawn", "strangers")


@query("SELECT o_orderkey, CASE WHEN row_number() OVER (ORDER BY o_orderkey) <= floor(0.8 * count(*) OVER ()) THEN 'train' ELSE 'test' END AS split FROM orders")
def split_by_key(spark, sf_dir):
    """Which rows the training part holds, in the order of a key."""
    o = table(spark, sf_dir, "orders").select("o_orderkey")
    return split.split_share(o, _KEY, order=[F.col("o_orderkey")]).select("o_orderkey", "split")


@query(
    """SELECT 'o_orderstatus' AS col, o_orderstatus AS value, true AS by_log, (SELECT count(*) FROM orders) AS drawn FROM orders GROUP BY o_orderstatus"""
)
def log_frequency_resample(spark, sf_dir):
    """Draws per category by the logarithm of its frequency, within five standard errors."""
    o = table(spark, sf_dir, "orders")
    n = o.count()
    each = split.balanced_resample(o, _KEY, ["o_orderstatus"], n, log_frequency=True).groupBy("col", "value").agg(F.count("*").alias("n"))
    sizes = o.groupBy(F.col("o_orderstatus").alias("value")).agg(F.log1p(F.count("*")).alias("w"))
    whole = sizes.agg(F.sum("w").alias("all")).join(F.broadcast(each.agg(F.sum("n").alias("drawn"))))
    met = each.join(F.broadcast(sizes), "value").join(F.broadcast(whole))
    want = n * F.col("w") / F.col("all")
    return met.select("col", "value", (F.abs(F.col("n") - want) < 5 * F.sqrt(want)).alias("by_log"), "drawn")


# vectors: accounts scaled by fixed numbers; customers by key % 5 are the real, held-out and synthetic rows
def _accounts(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    return c.select(F.col("c_custkey").alias("id"), F.array(F.col("c_acctbal") / 1000, F.col("c_nationkey").cast("double")).alias("features"))


def _parts(spark, sf_dir):
    a = _accounts(spark, sf_dir)
    return a.where("id % 5 < 2"), a.where("id % 5 = 2"), a.where("id % 5 > 2")


_V = "(SELECT c_custkey AS id, c_acctbal / 1000 AS a, CAST(c_nationkey AS DOUBLE) AS b FROM customer)"


def near_sql(q, base):
    return f"""SELECT id, d[1] AS d1, d[2] AS d2 FROM (SELECT q.id, list_slice(list_sort(list(sqrt(pow(q.a - r.a, 2) + pow(q.b - r.b, 2)))), 1, 2) AS d
        FROM (SELECT * FROM {_V} WHERE {q}) q, (SELECT * FROM {_V} WHERE {base}) r GROUP BY q.id)"""


TRAIN, HOLD, SYN = "id % 5 < 2", "id % 5 = 2", "id % 5 > 2"
DCR = f"SELECT id, d1 AS dcr, CASE WHEN d2 = 0 THEN 1 ELSE d1 / d2 END AS nndr FROM ({near_sql(SYN, TRAIN)})"


@query(DCR, "dcr nndr")
def dcr_nndr(spark, sf_dir):
    train, _, synth = _parts(spark, sf_dir)
    return privacy.dcr_nndr(train, synth)


@query(DCR, "dcr nndr")
def dcr_nndr_pruned(spark, sf_dir):
    """The same by cells of a tree, asked for by name."""
    train, _, synth = _parts(spark, sf_dir)
    return privacy.dcr_nndr(train, synth, mode="pruned")


@query(
    """SELECT (SELECT count(*) FROM customer WHERE c_custkey % 5 > 2) AS queries, (SELECT count(*) FROM customer WHERE c_custkey % 5 > 2) AS answered, 0 AS too_near, true AS recall_reached"""
)
def dcr_approximate(spark, sf_dir):
    """Neighbours from buckets against the exact ones: all queries answered, none nearer than it is, and 0.9 of the nearest found."""
    train, _, synth = _parts(spark, sf_dir)
    exact, rough = privacy.nearest_two(synth, train), privacy.nearest_two(synth, train, mode="approximate").select("id", F.col("d1").alias("r1"), F.col("d2").alias("r2"))
    met = exact.join(rough, "id", "left")
    right = sum((F.abs(F.col(a) - F.col(b)) < 1e-9).cast("double") for a, b in (("d1", "r1"), ("d2", "r2"))) / 2
    return met.agg(
        F.count("*").alias("queries"), F.count("r1").alias("answered"), F.count_if((F.col("r1") < F.col("d1") - 1e-9) | (F.col("r2") < F.col("d2") - 1e-9)).cast("int").alias("too_near"), (F.avg(right) >= 0.9).alias("recall_reached")
    )


@query(f"SELECT avg(dcr) AS dcr_mean, min(dcr) AS dcr_min, avg(nndr) AS nndr_mean, min(nndr) AS nndr_min FROM ({DCR})", "dcr_mean dcr_min nndr_mean nndr_min")
def dcr_summary(spark, sf_dir):
    train, _, synth = _parts(spark, sf_dir)
    return privacy.dcr_summary(train, synth)


@query(
    f"""SELECT any_value(t) AS threshold, 100.0 * avg(CASE WHEN d1 < t THEN 1.0 ELSE 0.0 END) AS leakage_pct
    FROM ({near_sql(SYN, TRAIN)}), (SELECT greatest(quantile_cont(d1, 0.05), 1e-8) AS t FROM ({near_sql(HOLD, TRAIN)}))""",
    "threshold leakage_pct",
)
def leakage(spark, sf_dir):
    return privacy.leakage(*_parts(spark, sf_dir))


SCORES = f"(SELECT -d1 AS s, 1 AS y FROM ({near_sql(TRAIN, SYN)}) UNION ALL SELECT -d1, 0 FROM ({near_sql(HOLD, SYN)}))"


def auc_sql(source):
    return f"""SELECT (sum(r) FILTER (y = 1) - p * (p + 1) / 2) / (p * (n - p)) FROM (
        SELECT *, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2 AS r, sum(y) OVER () AS p, count(*) OVER () AS n FROM {source}) GROUP BY p, n"""


@query(f"SELECT ({auc_sql(SCORES)}) AS mia_auc", "mia_auc:5")
def mia_auc(spark, sf_dir):
    return privacy.mia_auc(*_parts(spark, sf_dir))


@query(f"SELECT ({auc_sql("(SELECT l_quantity AS s, CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END AS y FROM lineitem)")}) AS auc", "auc")
def auc(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select("l_quantity", (F.col("l_linestatus") == "O").cast("int").alias("y"))
    return privacy.auc(li, "l_quantity", "y")


@query(
    f"""SELECT CAST(least(floor((dcr - lo) / ((hi - lo) / 20)), 19) AS BIGINT) AS bin, count(*) AS n, any_value(t) AS threshold FROM ({DCR}), (SELECT min(dcr) AS lo, max(dcr) AS hi FROM ({DCR})),
    (SELECT greatest(quantile_cont(d1, 0.05), 1e-8) AS t FROM ({near_sql(HOLD, TRAIN)})) GROUP BY 1""",
    "threshold",
)
def dcr_hist(spark, sf_dir):
    train, hold, synth = _parts(spark, sf_dir)
    return privacy.distance_histogram(privacy.dcr_nndr(train, synth), threshold=privacy.leakage_threshold(train, hold))


_PRED = "(SELECT l_returnflag AS y, CASE WHEN l_quantity > 33 THEN 'R' WHEN l_quantity > 16 THEN 'N' ELSE 'A' END AS p FROM lineitem)"


@query(
    f"""SELECT 'accuracy' AS metric, avg(CASE WHEN y = p THEN 1.0 ELSE 0.0 END) AS value FROM {_PRED} UNION ALL SELECT 'auc', 0.5
    UNION ALL SELECT 'f1_macro', avg(2.0 * tp / (ny + np)) FROM (SELECT l, (SELECT count(*) FROM {_PRED} WHERE y = l AND p = l) AS tp, (SELECT count(*) FROM {_PRED} WHERE y = l) AS ny, (SELECT count(*) FROM {_PRED} WHERE p = l) AS np
        FROM (SELECT y AS l FROM {_PRED} UNION SELECT p FROM {_PRED}))""",
    "value",
)
def confusion_scores(spark, sf_dir):
    q = F.col("l_quantity")
    p = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("y"), F.when(q > 33, "R").when(q > 16, "N").otherwise("A").alias("prediction"))
    return utility.classification_scores(p)


_REG = "(SELECT l_extendedprice AS y, l_quantity * 1500 AS p FROM lineitem)"


@query(f"SELECT 'mse' AS metric, avg(pow(y - p, 2)) AS value FROM {_REG} UNION ALL SELECT 'mae', avg(abs(y - p)) FROM {_REG} UNION ALL SELECT 'r2', 1 - avg(pow(y - p, 2)) / var_pop(y) FROM {_REG}", "value:2")
def regression_scores(spark, sf_dir):
    return utility.regression_scores(table(spark, sf_dir, "lineitem").select(F.col("l_extendedprice").alias("y"), (F.col("l_quantity") * 1500).alias("prediction")))


@query(
    """SELECT col, kind OR n <= 10 AS classification FROM (
    SELECT 'l_returnflag' AS col, true AS kind, count(DISTINCT l_returnflag) AS n FROM lineitem UNION ALL SELECT 'l_quantity', false, count(DISTINCT l_quantity) FROM lineitem
    UNION ALL SELECT 'l_linenumber', false, count(DISTINCT l_linenumber) FROM lineitem UNION ALL SELECT 'l_suppkey', true, count(*) FROM lineitem)"""
)
def task_detection(spark, sf_dir):
    """Whether a target is a class: a string, declared so, or of few distinct values."""
    li = table(spark, sf_dir, "lineitem")
    found = [(c, utility.is_classification(li, c, ["l_suppkey"])) for c in ("l_returnflag", "l_quantity", "l_linenumber", "l_suppkey")]
    return spark.createDataFrame(found, "col string, classification boolean")


_XY = "(SELECT c_custkey, CASE WHEN c_custkey % 7 <> 0 THEN c_acctbal END AS c_acctbal, CASE WHEN c_custkey % 5 <> 0 THEN c_mktsegment END AS c_mktsegment, CASE WHEN c_custkey % 3 <> 0 THEN CAST(c_nationkey AS DOUBLE) END AS c_nationkey FROM customer)"


@query(
    f"""SELECT coalesce(c_acctbal, 0) AS c_acctbal, coalesce(c_mktsegment, 'missing') AS c_mktsegment, coalesce(c_nationkey, (SELECT quantile_cont(c_nationkey, 0.5) FROM {_XY})) AS y FROM {_XY}""",
    "c_acctbal y",
)
def learning_table(spark, sf_dir):
    """Features and target as models get them: numbers without nulls, missing categories named, the target filled."""
    c, k = table(spark, sf_dir, "customer"), F.col("c_custkey")
    holed = c.select("c_custkey", F.when(k % 7 != 0, F.col("c_acctbal")).alias("c_acctbal"), F.when(k % 5 != 0, F.col("c_mktsegment")).alias("c_mktsegment"), F.when(k % 3 != 0, F.col("c_nationkey").cast("double")).alias("c_nationkey"))
    return utility.prepared(holed, ["c_acctbal", "c_nationkey"], ["c_mktsegment"], "c_nationkey", False)


_OLS = """(SELECT regr_slope(l_extendedprice, l_quantity) AS a, regr_intercept(l_extendedprice, l_quantity) AS b FROM lineitem WHERE l_orderkey % 4 {0})"""
_R2 = "(SELECT 1 - avg(pow(l_extendedprice - a * l_quantity - b, 2)) / var_pop(l_extendedprice) FROM lineitem, {0} WHERE l_orderkey % 4 = 2)"


@query(
    f"SELECT 'linear' AS model, 'TRTR' AS regime, 'r2' AS metric, {_R2.format(_OLS.format('< 2'))} AS value, 'ok' AS status UNION ALL SELECT 'linear', 'TSTR', 'r2', {_R2.format(_OLS.format('= 3'))}, 'ok'",
    "value:3",
)
def linear_scores(spark, sf_dir):
    """The linear model against least squares; an identifier that tells too much is left out by name."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_quantity", "l_extendedprice", F.col("l_extendedprice").cast("double").alias("leak"))
    part = lambda *k: li.where((F.col("l_orderkey") % 4).isin(*k))
    s = utility.evaluate_utility(part(0, 1), part(2), part(3), "l_extendedprice", ["l_quantity", "leak"], [], exclude=["leak"], models=("linear",))
    return s.where("metric = 'r2'")


def _learning(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal", "c_nationkey", "c_mktsegment", (F.col("c_acctbal") > 4000).cast("string").alias("rich"))
    return c.where("c_custkey % 4 < 2"), c.where("c_custkey % 4 = 2"), c.where("c_custkey % 4 = 3")


@query()
def tstr_trtr(spark, sf_dir):
    train, test, synth = _learning(spark, sf_dir)
    return utility.evaluate_utility(train, test, synth, "rich", ["c_acctbal", "c_nationkey"], ["c_mktsegment"])


@query()
def utility_drop(spark, sf_dir):
    train, test, synth = _learning(spark, sf_dir)
    s = utility.evaluate_utility(train, test, synth, "c_acctbal", ["c_nationkey"], ["c_mktsegment"])
    return utility.utility_drop(s)


@query()
def aia(spark, sf_dir):
    train, test, _ = _learning(spark, sf_dir)
    return utility.attribute_inference(train, test, "c_mktsegment", ["c_acctbal", "c_nationkey"], [])


@query()
def cv_probe(spark, sf_dir):
    train, _, _ = _learning(spark, sf_dir)
    return utility.cross_validated(train.withColumn("fold", (F.col("c_custkey") % 3).cast("int")), "rich", ["c_acctbal"], [])


_FOLDS = "(SELECT CAST(o_custkey % 5 AS INT) AS fold, o_orderpriority AS metric, avg(o_totalprice) AS value FROM orders GROUP BY ALL)"


@query(f"SELECT metric, avg(value) AS mean, stddev_samp(value) AS std, count(*) AS folds FROM {_FOLDS} GROUP BY metric", "mean:4 std:4")
def fold_aggregate(spark, sf_dir):
    folds = table(spark, sf_dir, "orders").groupBy((F.col("o_custkey") % 5).cast("int").alias("fold"), F.col("o_orderpriority").alias("metric")).agg(F.avg("o_totalprice").alias("value"))
    return compare.fold_aggregate(folds, ["metric"]).drop("values")


@query("SELECT o_orderstatus AS experiment, fold, count(DISTINCT metric) AS metrics, CAST('inf' AS DOUBLE) AS epsilon, 42 + fold AS seed FROM (SELECT o_orderstatus, CAST(o_custkey % 5 AS INT) AS fold, o_orderpriority AS metric FROM orders) GROUP BY o_orderstatus, fold")
def experiment_summary(spark, sf_dir):
    folds = table(spark, sf_dir, "orders").groupBy(F.col("o_orderstatus").alias("experiment"), (F.col("o_custkey") % 5).cast("int").alias("fold"), F.col("o_orderpriority").alias("metric")).agg(F.avg("o_totalprice").alias("value"))
    return compare.experiment_ledger(folds.withColumn("epsilon", F.lit(None).cast("double")))
