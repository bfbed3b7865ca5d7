"""Registered queries against their SQL on the smallest tables, and plans that gather no column in one task."""

import glob
import math
import os

import duckdb
import pytest

from loomtab.plans import registry

SOME = ["fidelity_grades", "describe_continuous", "describe_categorical", "cramers_v", "spearman", "violation_by_rule", "pipeline_encode", "kfold", "dcr_nndr", "friedman", "histogram_jsd", "overlay_top10", "csv_scan", "csv_scan_headerless", "experiments_read", "audit_status", "fold_metrics", "auc", "candidate_ranking"]


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 4) + 0.0
    return v if v is None or isinstance(v, (str, bool)) else round(float(v), 4) + 0.0 if isinstance(v, (int,)) or type(v).__name__ == "Decimal" else v


@pytest.mark.parametrize("name", SOME)
def test_against_sql(spark, sf, duck, name):
    df = registry.queries()[name](spark, sf)
    cols = sorted(df.columns)
    cur = duck.execute(registry.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols
    want = sorted((tuple(norm(r[names.index(c)]) for c in cols) for r in cur.fetchall()), key=repr)
    assert sorted((tuple(norm(r[c]) for c in cols) for r in df.collect()), key=repr) == want


@pytest.mark.parametrize("name", ["auc", "spearman", "describe_continuous", "outliers_mad", "candidate_ranking", "kfold", "stratified_split_by_key", "cond_mutual_info", "cardinality", "class_balance", "ks_statistic"])
def test_plans_gather_no_column_in_one_task(spark, sf, name):
    """Windows go over ranges of values, or over tables as small as the schema."""
    plan = registry.queries()[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    for line in plan.splitlines():
        if "Window [" in line and "row_number" not in line:
            assert any(x in line for x in ("_part", "part#", "sum(_", "sum(pr", "sum(ps", "lead(first", "[0]", ", 0]")), line
    assert "percentile(" not in plan


def test_every_sql_has_its_query():
    assert set(registry.oracle_sql()) <= set(registry.queries())
    assert len(registry.queries()) > 90


def test_import_needs_no_session():
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = "import __spark_entry__ as e; assert len(e.queries()) > 90"
    subprocess.run([sys.executable, "-c", code], cwd=root, check=True, timeout=120)


def test_stateless_operators_run_on_streams(spark, sf, tmp_path):
    from loomtab.operators import prep, rules

    table = spark.read.parquet(f"{sf}/lineitem.parquet").select("l_orderkey", "l_quantity", "l_returnflag")
    table.write.parquet(str(tmp_path / "in"))
    fitted = prep.Preprocessor(["l_quantity"], ["l_returnflag"]).fit(table)
    stream = spark.readStream.schema(table.schema).parquet(str(tmp_path / "in"))
    done = fitted.transform(rules.clamp_correction(stream, rules.rules(["l_quantity >= 5"])))
    q = done.writeStream.format("memory").queryName("encoded").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("encoded").count() == table.count()
