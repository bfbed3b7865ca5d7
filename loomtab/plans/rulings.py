"""Queries over declared domains and rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import dist, rules
from ..sources.spec import DatasetSpec
from .distances import hist_jsd_sql
from .registry import query, table

_SPEC = DatasetSpec(continuous=["l_quantity", "l_returnflag", "l_weight"], categorical=["l_linestatus"], target="l_returnflag")
_BOUNDS = {"l_quantity": (5.0, 45.0), "l_extendedprice": (10_000.0, 80_000.0)}
_DOMAINS = {"l_returnflag": ["A", "N"], "l_linestatus": ["O", "F"]}
# a rule on holes too: l_tax is null for every seventh order
_T = "(SELECT * REPLACE (CASE WHEN l_orderkey % 7 = 0 THEN NULL ELSE l_tax END AS l_tax) FROM lineitem)"
_RULES = rules.rules(["l_quantity >= 5", "l_discount <= l_tax", "l_linenumber != 3", "l_absent > 1"])
_MASKS = ["coalesce(NOT (l_quantity >= 5), true)", "coalesce(NOT (l_discount <= l_tax), true)", "coalesce(NOT (l_linenumber <> 3), false)", "false"]
_ANY = " OR ".join(_MASKS)


def _holed(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").withColumn("l_tax", F.when(F.col("l_orderkey") % 7 != 0, F.col("l_tax")))


@query("SELECT * FROM (VALUES ('l_quantity', true, 'ok'), ('l_returnflag', true, 'not numeric'), ('l_weight', false, 'missing column'), ('l_linestatus', true, 'ok')) AS t(col, present, status)")
def schema_check(spark, sf_dir):
    return rules.schema_check(table(spark, sf_dir, "lineitem"), _SPEC)


@query(" UNION ALL ".join(f"SELECT '{c}' AS col, count(*) FILTER ({c} < {lo}) AS under, count(*) FILTER ({c} > {hi}) AS over, 100.0 * count(*) FILTER ({c} < {lo} OR {c} > {hi}) / count(*) AS outside_pct FROM lineitem" for c, (lo, hi) in _BOUNDS.items()), "outside_pct")
def bounds_audit(spark, sf_dir):
    return rules.bounds_audit(table(spark, sf_dir, "lineitem"), _BOUNDS)


@query(
    " UNION ALL ".join(
        f"""SELECT '{c}' AS col, count(*) FILTER ({c} NOT IN ({", ".join(f"'{v}'" for v in d)})) AS invalid, 100.0 * count(*) FILTER ({c} NOT IN ({", ".join(f"'{v}'" for v in d)})) / count(*) AS invalid_pct,
        coalesce(string_agg(DISTINCT {c}, ';' ORDER BY {c}) FILTER ({c} NOT IN ({", ".join(f"'{v}'" for v in d)})), '') AS samples FROM lineitem"""
        for c, d in _DOMAINS.items()
    ),
    "invalid_pct",
)
def domain_audit(spark, sf_dir):
    return rules.domain_audit(table(spark, sf_dir, "lineitem"), _DOMAINS).withColumn("invalid", F.col("invalid").cast("long"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, greatest(least(l_quantity, 45), 5) AS l_quantity, CASE WHEN l_returnflag IN ('A', 'N') THEN l_returnflag ELSE 'A' END AS l_returnflag FROM lineitem", "l_quantity")
def audit_correct(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_returnflag")
    return rules.audit_and_correct(li, DatasetSpec(bounds={"l_quantity": (5.0, 45.0)}, domains={"l_returnflag": ["A", "N"]}))


@query(f"SELECT avg(CASE WHEN {_ANY} THEN 1.0 ELSE 0.0 END) AS violation_rate FROM {_T}", "violation_rate")
def violation_rate(spark, sf_dir):
    return rules.violation_rate(_holed(spark, sf_dir), _RULES)


@query(" UNION ALL ".join(f"SELECT '{r.name}' AS rule, count(*) FILTER ({m}) AS violations, count(*) FILTER ({m}) / count(*) AS rate FROM {_T}" for r, m in zip(_RULES, _MASKS)), "rate")
def violation_by_rule(spark, sf_dir):
    return rules.violations_by_rule(_holed(spark, sf_dir), _RULES)


_FIX = rules.rules(["l_quantity >= 5", "l_discount <= l_tax"])
_FIXED = """(SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_quantity < 5 THEN 5 ELSE l_quantity END AS l_quantity,
    CASE WHEN l_discount > l_tax THEN l_tax ELSE l_discount END AS l_discount, l_tax FROM """ + _T + ")"


@query(f"SELECT * FROM {_FIXED}", "l_quantity l_discount l_tax")
def clamp_correction(spark, sf_dir):
    return rules.clamp_correction(_holed(spark, sf_dir), _FIX).select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_discount", "l_tax")


@query(
    f"""SELECT count(*) AS rows, count(*) FILTER (coalesce(NOT (l_quantity >= 5), true) OR coalesce(NOT (l_discount <= l_tax), true)) AS before,
    (SELECT count(*) FROM {_FIXED} WHERE l_tax IS NULL) AS after FROM {_T}"""
)
def correction_summary(spark, sf_dir):
    return rules.correction_summary(_holed(spark, sf_dir), _FIX)


@query(
    f"""SELECT src, avg(abs(l_extendedprice - e) / abs(e)) AS mape, avg(CASE WHEN abs(l_extendedprice - e) / abs(e) > 0.15 THEN 1.0 ELSE 0.0 END) AS violation_rate,
    count(*) AS n_valid, count(*) AS n_total
    FROM (SELECT l_extendedprice, l_quantity * p_retailprice AS e, CASE WHEN l_orderkey % 2 = 0 THEN 'real' ELSE 'synth' END AS src FROM lineitem JOIN part ON l_partkey = p_partkey) GROUP BY src""",
    "mape violation_rate",
)
def formula_mape(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return rules.formula_audit(li.where("l_orderkey % 2 = 0"), li.where("l_orderkey % 2 = 1"), "l_extendedprice", "l_quantity * p_retailprice")


_OVER = f"(SELECT l_quantity, l_discount, 'real' AS src FROM {_T} UNION ALL SELECT l_quantity, l_discount, 'synth' FROM {_FIXED})"


@query(hist_jsd_sql(["l_quantity", "l_discount"], _OVER), "histogram_jsd")
def overcorrection_jsd(spark, sf_dir):
    raw = _holed(spark, sf_dir)
    return dist.histogram_jsd(raw, rules.clamp_correction(raw, _FIX), ["l_quantity", "l_discount"])


_GAPS = {"l_quantity >= 5": "greatest(5 - l_quantity, 0)", "l_discount <= l_tax": "greatest(l_discount - l_tax, 0)", "l_linenumber != 3": "greatest(1.0 - abs(l_linenumber - 3.0), 0)"}


@query(
    " UNION ALL ".join(f"SELECT '{r}' AS rule, avg(coalesce({g}, 0)) AS penalty FROM {_T}" for r, g in _GAPS.items()) + f" UNION ALL SELECT '*', {' + '.join(f'avg(coalesce({g}, 0))' for g in _GAPS.values())} FROM {_T}",
    "penalty",
)
def hinge_penalty(spark, sf_dir):
    return rules.hinge_penalty(_holed(spark, sf_dir), _RULES[:3])


@query("SELECT avg(CASE WHEN (CASE WHEN l_quantity > 25 THEN 'O' ELSE 'F' END) = l_linestatus THEN 1.0 ELSE 0.0 END) AS accuracy FROM lineitem", "accuracy")
def rule_accuracy(spark, sf_dir):
    return rules.rule_accuracy(table(spark, sf_dir, "lineitem"), F.when(F.col("l_quantity") > 25, "O").otherwise("F"), F.col("l_linestatus"))


@query("SELECT count(*) AS rows, CAST(0 AS BIGINT) AS violating FROM orders")
def correct_by_resample(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus")
    rule = rules.rules(["o_totalprice >= 50000"])
    done = rules.correct_by_resampling(o, o, rule, "o_orderkey")
    return done.agg(F.count("*").alias("rows"), F.count_if(rules.any_violated(done, rule)).alias("violating"))
