"""Queries over the audit suite and the data behind its charts."""

from __future__ import annotations

from pyspark.ml.classification import DecisionTreeClassifier
from pyspark.sql import functions as F

from ..operators import audit, rules
from .associations import eta_sql, matrix_sql
from .distances import hist_sql, jsd_sql, w1_sql
from .privacies import DCR, HOLD, SCORES, SYN, TRAIN, auc_sql, near_sql
from .registry import KINDS, NUMBERS, SRC, halves, query, table

_X = NUMBERS[:3]
_GRADES = f"""SELECT 'wasserstein' AS metric, col AS "column", wasserstein AS value, CASE WHEN wasserstein < 0.05 THEN 'Good' WHEN wasserstein < 0.15 THEN 'Moderate' ELSE 'Poor' END AS grade FROM ({w1_sql()})
    UNION ALL SELECT 'js_divergence', col, js_divergence, CASE WHEN js_divergence < 0.03 THEN 'Good' WHEN js_divergence < 0.08 THEN 'Moderate' ELSE 'Poor' END FROM ({jsd_sql()})"""


@query(_GRADES, "value")
def fidelity_grades(spark, sf_dir):
    return audit.fidelity_grades(*halves(spark, sf_dir), _X, KINDS)


_R, _S = ("(SELECT * FROM lineitem WHERE l_orderkey % 2 = 0)", "(SELECT * FROM lineitem WHERE l_orderkey % 2 = 1)")
_CORR = f"""SELECT avg(abs(r.value - s.value)) AS v FROM ({matrix_sql(_R)}) r JOIN ({matrix_sql(_S)}) s USING (col_i, col_j, kind) WHERE col_i <> 'l_tax' AND col_j <> 'l_tax'"""


@query(
    f"""SELECT 'fidelity' AS section, metric, "column", value FROM ({_GRADES}) UNION ALL SELECT 'fidelity', 'corr_difference', '*', v FROM ({_CORR})
    UNION ALL SELECT 'rules', 'mape', 'l_extendedprice/' || src, avg(abs(l_extendedprice - l_quantity * 1500) / (l_quantity * 1500)) FROM {SRC} GROUP BY src""",
    "value",
)
def audit_report(spark, sf_dir):
    real, synth = halves(spark, sf_dir)
    return audit.run_audit(real, synth, real, real, _X, KINDS, formulas={"l_extendedprice": "l_quantity * 1500"})


# the audit of customers: training, held-out and synthetic rows by key, as in the privacy queries
_AX, _AK = ["c_acctbal", "c_nationkey"], ["c_mktsegment"]
_CUST = "(SELECT *, CASE WHEN c_custkey % 5 < 2 THEN 'real' ELSE 'synth' END AS src FROM customer WHERE c_custkey % 5 <> 2)"


def _pairs_by(t):
    return f"""SELECT 'n' AS k, corr(c_acctbal, c_nationkey) AS value FROM {t}
        UNION ALL SELECT 'a', eta FROM ({eta_sql([('c_mktsegment', 'c_acctbal')], t)}) UNION ALL SELECT 'b', eta FROM ({eta_sql([('c_mktsegment', 'c_nationkey')], t)})"""


_CUST_DIFF = f"SELECT avg(abs(r.value - s.value)) AS v FROM ({_pairs_by('(SELECT * FROM customer WHERE c_custkey % 5 < 2)')}) r JOIN ({_pairs_by('(SELECT * FROM customer WHERE c_custkey % 5 > 2)')}) s USING (k)"
_LEAK = f"(SELECT 100.0 * avg(CASE WHEN d1 < t THEN 1.0 ELSE 0.0 END) FROM ({near_sql(SYN, TRAIN)}), (SELECT greatest(quantile_cont(d1, 0.05), 1e-8) AS t FROM ({near_sql(HOLD, TRAIN)})))"
_LINES = f"""SELECT 'fidelity' AS section, 'wasserstein' AS metric, col AS "column", wasserstein AS value FROM ({w1_sql(_AX, _CUST)})
    UNION ALL SELECT 'fidelity', 'js_divergence', col, js_divergence FROM ({jsd_sql(_AK, _CUST)})
    UNION ALL SELECT 'fidelity', 'corr_difference', '*', v FROM ({_CUST_DIFF})
    UNION ALL SELECT 'privacy', m, '*', v FROM (UNPIVOT (SELECT avg(dcr) AS dcr_mean, min(dcr) AS dcr_min, avg(nndr) AS nndr_mean, min(nndr) AS nndr_min FROM ({DCR})) ON dcr_mean, dcr_min, nndr_mean, nndr_min INTO NAME m VALUE v)
    UNION ALL SELECT 'privacy', 'leakage_pct', '*', {_LEAK} UNION ALL SELECT 'privacy', 'mia_auc', '*', ({auc_sql(SCORES)})"""
_STATUS = """CASE WHEN metric = 'wasserstein' THEN CASE WHEN value < 0.05 THEN 'Good' WHEN value < 0.15 THEN 'Moderate' ELSE 'Poor' END
    WHEN metric = 'js_divergence' THEN CASE WHEN value < 0.03 THEN 'Good' WHEN value < 0.08 THEN 'Moderate' ELSE 'Poor' END
    WHEN metric = 'leakage_pct' THEN CASE WHEN value < 1 THEN 'Good' WHEN value < 5 THEN 'Moderate' ELSE 'Poor' END
    WHEN metric = 'mia_auc' THEN CASE WHEN value <= 0.65 THEN 'Good' WHEN value < 0.8 THEN 'Moderate' ELSE 'Poor' END END"""


# models that SQL can say: a tree over the segments predicts each one's commoner class, a tree without splits the commoner class of all
def _trees(classification, classes, rows, trees, seed):
    tree = lambda depth: DecisionTreeClassifier(labelCol="label", maxDepth=depth)
    return {"random_forest": tree(10), "gradient_boosting": tree(8), "linear": tree(0)}


def _told_sql(regime, by):
    """Predictions of the held-out customers by the commoner class of ``by`` among the regime's rows."""
    rich = "2 * count(*) FILTER (c_acctbal > 4000)"
    # a tie goes to the class that is commoner in both regimes together
    tie = f"(SELECT {rich} > count(*) FROM customer WHERE c_custkey % 5 <> 2)"
    commoner = f"SELECT {by} AS k, CASE WHEN {rich} = count(*) THEN {tie} ELSE {rich} > count(*) END AS told FROM customer WHERE c_{regime} GROUP BY {by}"
    where = {"TRTR": "custkey % 5 < 2", "TSTR": "custkey % 5 > 2"}[regime]
    commoner = commoner.replace(f"c_{regime}", f"c_{where}")
    return f"SELECT c_acctbal > 4000 AS y, told AS p FROM customer c JOIN ({commoner}) m ON m.k = {by.replace('c_', 'c.c_')} WHERE c_custkey % 5 = 2"


def _score_sql(regime, by):
    return f"""SELECT avg(CASE WHEN y = p THEN 1.0 ELSE 0.0 END) AS accuracy, (SELECT avg(f) FROM (
        SELECT l, coalesce(2.0 * count(*) FILTER (y = l AND p = l) / nullif(count(*) FILTER (y = l) + count(*) FILTER (p = l), 0), 0) AS f
        FROM ({_told_sql(regime, by)}), (VALUES (true), (false)) AS v(l) GROUP BY l HAVING count(*) FILTER (y = l) + count(*) FILTER (p = l) > 0)) AS f1_macro FROM ({_told_sql(regime, by)})"""


_MODELS = {"random_forest": "c_mktsegment", "gradient_boosting": "c_mktsegment", "linear": "(c_custkey * 0)"}
_F1 = {(regime, model): f"(SELECT f1_macro FROM ({_score_sql(regime, by)}))" for regime in ("TRTR", "TSTR") for model, by in _MODELS.items()}


def _customer_audit(spark, sf_dir, target=None, **how):
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal", F.col("c_nationkey").cast("double").alias("c_nationkey"), "c_mktsegment")
    c = c.withColumn("rich", (F.col("c_acctbal") > 4000).cast("string"))
    train, test, synth = c.where("c_custkey % 5 < 2"), c.where("c_custkey % 5 = 2"), c.where("c_custkey % 5 > 2")
    vectors = lambda d: d.select(F.col("c_custkey").alias("id"), F.array(F.col("c_acctbal") / 1000, F.col("c_nationkey")).alias("features"))
    return audit.run_audit(train, synth, train, test, _AX, _AK, vectorizer=vectors, target=target, trees=100, **how)


@query(f"SELECT *, {_STATUS} AS status FROM ({_LINES})", "value:5")
def audit_status(spark, sf_dir):
    return audit.with_status(_customer_audit(spark, sf_dir))


@query(
    f"""SELECT avg(value) FILTER (metric = 'js_divergence') AS avg_js, avg(value) FILTER (metric = 'wasserstein') AS avg_wasserstein, max(value) FILTER (metric = 'corr_difference') AS corr_diff,
    max(value) FILTER (metric = 'dcr_mean') AS dcr_mean, max(value) FILTER (metric = 'leakage_pct') AS dcr_leakage_pct, max(value) FILTER (metric = 'mia_auc') AS mia_auc,
    {", ".join(f"{_F1[r, m]} AS {r.lower()}_{k}_f1" for r in ("TSTR", "TRTR") for k, m in zip(("rf", "gb", "lr"), _MODELS))} FROM ({_LINES})""",
    "avg_js avg_wasserstein corr_diff dcr_mean dcr_leakage_pct mia_auc:5 tstr_rf_f1 tstr_gb_f1 tstr_lr_f1 trtr_rf_f1 trtr_gb_f1 trtr_lr_f1",
)
def fold_metrics(spark, sf_dir):
    """All twelve numbers; the models are trees over one category, whose predictions SQL can say."""
    return audit.fold_metrics(_customer_audit(spark, sf_dir, "rich", exclude=_AX, estimators=_trees))


@query(
    " UNION ALL ".join(f"SELECT '{m}' AS model, {_F1['TRTR', m]} - {_F1['TSTR', m]} AS drop" for m in _MODELS).join(("SELECT *, CASE WHEN drop < 0.05 THEN 'Good' WHEN drop < 0.15 THEN 'Moderate' ELSE 'Poor' END AS grade FROM (", ")")),
    "drop",
)
def utility_grades(spark, sf_dir):
    """What each model loses by learning from synthetic rows, graded."""
    lines = _customer_audit(spark, sf_dir, "rich", exclude=_AX, estimators=_trees).where("metric = 'drop/f1_macro'")
    return audit.grade_utility(lines.select(F.col("column").alias("model"), F.col("value").alias("drop")))


@query()
def full_audit(spark, sf_dir):
    """All sections with a status per line; the models' scores have no SQL."""
    return audit.with_status(_customer_audit(spark, sf_dir, "rich"))


@query(f"""SELECT domain, grade FROM (SELECT CASE WHEN js < 0.05 AND w1 < 0.05 AND corr < 0.1 THEN 'GREEN' WHEN js >= 0.15 OR w1 >= 0.15 THEN 'RED' ELSE 'YELLOW' END AS f,
        CASE WHEN leak < 1 AND mia <= 0.65 THEN 'GREEN' WHEN leak >= 5 OR mia >= 0.8 THEN 'RED' ELSE 'YELLOW' END AS p
    FROM (SELECT avg(value) FILTER (metric = 'js_divergence') AS js, avg(value) FILTER (metric = 'wasserstein') AS w1, max(value) FILTER (metric = 'corr_difference') AS corr,
        max(value) FILTER (metric = 'leakage_pct') AS leak, max(value) FILTER (metric = 'mia_auc') AS mia FROM ({_LINES}))),
    LATERAL (SELECT 'fidelity' AS domain, f AS grade UNION ALL SELECT 'privacy', p UNION ALL
        SELECT 'utility', CASE WHEN d < 0.05 THEN 'GREEN' WHEN d < 0.15 THEN 'YELLOW' ELSE 'RED' END FROM (SELECT ({" + ".join(f"{_F1['TRTR', m]} - {_F1['TSTR', m]}" for m in _MODELS)}) / 3 AS d))""")
def domain_grades(spark, sf_dir):
    return audit.domains_of(_customer_audit(spark, sf_dir, "rich", exclude=_AX, estimators=_trees))


@query(f"""SELECT src, mape, CASE WHEN mape <= 0.15 THEN 'Good' ELSE 'Poor' END AS grade FROM (SELECT src, avg(abs(l_extendedprice - l_quantity * 1500) / (l_quantity * 1500)) AS mape FROM {SRC} GROUP BY src)""", "mape")
def formula_grades(spark, sf_dir):
    real, synth = halves(spark, sf_dir)
    return audit.grade_formulas(rules.formula_audit(real, synth, "l_extendedprice", "l_quantity * 1500")).select("src", "mape", "grade")


@query(f"SELECT col, bin, nr / (sum(nr) OVER (PARTITION BY col) * width) AS real, ns / (sum(ns) OVER (PARTITION BY col) * width) AS synth FROM ({hist_sql(['l_quantity', 'l_extendedprice'], 20)})", "real:9 synth:9")
def overlay_hist(spark, sf_dir):
    return audit.overlay_histogram(*halves(spark, sf_dir), ["l_quantity", "l_extendedprice"])


@query(
    """SELECT * FROM (SELECT 'p_brand' AS col, p_brand AS value, count(*) FILTER (p_partkey % 2 = 0) / sum(count(*) FILTER (p_partkey % 2 = 0)) OVER () AS real,
    count(*) FILTER (p_partkey % 2 = 1) / sum(count(*) FILTER (p_partkey % 2 = 1)) OVER () AS synth, row_number() OVER (ORDER BY count(*) FILTER (p_partkey % 2 = 0) DESC, p_brand) AS rank FROM part GROUP BY p_brand) WHERE rank <= 10""",
    "real synth",
)
def overlay_top10(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return audit.overlay_top(p.where("p_partkey % 2 = 0"), p.where("p_partkey % 2 = 1"), ["p_brand"])
