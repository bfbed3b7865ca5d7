"""Small literal tables with known results for the table operators."""

import math

import pytest
from pyspark.sql import functions as F

from loomtab.functions import stats
from loomtab.operators import assoc, audit, compare, dist, prep, privacy, profile, rules, split, synth, utility
from loomtab.plans import registry
from loomtab.sources import io
from loomtab.sources.spec import DatasetSpec


def frame(spark, schema, *rows):
    return spark.createDataFrame(list(rows), schema)


def column(spark, name, kind, values):
    return spark.createDataFrame([(v,) for v in values], f"{name} {kind}")


def value(df):
    return df.first()[0]


def test_wasserstein(spark):
    a = column(spark, "x", "double", [1.0, 2.0, 3.0])
    assert dist.wasserstein(a, a, ["x"]).first().wasserstein == 0
    assert dist.wasserstein(a, column(spark, "x", "double", [2.0, 3.0, 4.0]), ["x"]).first().wasserstein == pytest.approx(0.5)
    one = column(spark, "x", "double", [5.0, 5.0])
    assert dist.wasserstein(one, column(spark, "x", "double", [7.0]), ["x"]).first().wasserstein == pytest.approx(2.0)
    assert dist.wasserstein(a, a.limit(0), ["x"]).first().wasserstein is None
    assert dist.wasserstein(a, a.limit(0), ["x"], 1.0).first().wasserstein == 1


def test_js_divergence(spark):
    a = column(spark, "c", "string", ["a", "a", "b"])
    assert dist.js_divergence(a, a, ["c"]).first().js_divergence == 0
    assert 0 < dist.js_divergence(a, column(spark, "c", "string", ["b", "b", "a"]), ["c"]).first().js_divergence <= 1
    assert dist.js_divergence(a, a.limit(0), ["c"]).first().js_divergence == 1
    assert dist.js_divergence(a.limit(0), a.limit(0), ["c"]).first().js_divergence is None


def test_histogram_jsd(spark):
    a = column(spark, "x", "double", [float(i) for i in range(1, 101)])
    b = column(spark, "x", "double", [float(i) for i in range(1000, 1100)])
    assert abs(dist.histogram_jsd(a, a, ["x"]).first().histogram_jsd) < 1e-6
    assert dist.histogram_jsd(a, b, ["x"]).first().histogram_jsd > 0.3


def test_association(spark):
    t = frame(spark, "x string, y string, z string, c string, m double, k double", ("yes", "high", "yes", "a", 1.0, 5.0), ("yes", "high", "no", "a", 1.0, 5.0), ("no", "low", "yes", "b", 10.0, 5.0), ("no", "low", "no", "b", 10.0, 5.0))
    v = {(r.col_i, r.col_j): r.cramers_v for r in assoc.cramers_v(t, [("x", "y"), ("z", "y")]).collect()}
    assert v["x", "y"] == pytest.approx(1.0) and v["z", "y"] == 0
    e = {r.col_j: r.eta for r in assoc.correlation_ratio(t, [("c", "m"), ("c", "k")]).collect()}
    assert e["m"] == pytest.approx(1.0) and e["k"] == 0
    assert assoc.theils_u(t, [("x", "y")]).first().theils_u == pytest.approx(1.0)
    assert assoc.pearson(t, [("m", "k")]).first().corr is None


def test_imputer_round_trip(spark):
    t = frame(spark, "age double, salary double, gender string", (18.0, 1000.0, "male"), (None, 2000.0, "female"), (30.0, None, "male"), (40.0, 4000.0, None))
    p = prep.Preprocessor(["age", "salary"], ["gender"]).fit(t)
    rows = p.impute(t).collect()
    assert rows[1].age == 30 and rows[2].salary == 2000 and rows[3].gender == "male"
    assert [rows[1].age_is_missing, rows[0].age_is_missing] == [1.0, 0.0]
    assert [tuple(r) for r in p.unimpute(p.impute(t)).collect()] == [tuple(r) for r in t.collect()]
    assert [tuple(r) for r in p.inverse(p.transform(t), order=t.columns).collect()] == [tuple(r) for r in t.collect()]


def test_encoder(spark):
    t = frame(spark, "color string, city string", ("red", "Hanoi"), ("blue", "Saigon"), ("red", "DaNang"), ("blue", "Hanoi"))
    p = prep.Preprocessor([], ["color", "city"], cap=2, scale_labels=False).fit(t)
    enc = p.encode(t)
    assert set(enc.columns) == {"color_red", "color_blue", "city"}
    assert [tuple(r) for r in p.decode(enc).select("color", "city").collect()] == [tuple(r) for r in t.collect()]
    odd = p.encode(frame(spark, "color string, city string", ("green", "Hanoi"), ("blue", "HaiPhong")))
    first, second = odd.collect()
    assert first.color_red == first.color_blue == 0 and second.city == 3
    assert p.decode(odd).collect()[0].color is None
    strict = prep.Preprocessor([], ["city"], cap=1, unknown="error").fit(t)
    with pytest.raises(Exception, match="unknown category"):
        strict.encode(frame(spark, "city string", ("HaiPhong",))).collect()
    with pytest.raises(ValueError):
        prep.Preprocessor([], [], scaling="other")


def test_scalers(spark):
    t = column(spark, "x", "double", [10.0, 20.0, 30.0])
    assert [r.x for r in prep.Preprocessor(["x"], []).fit(t).scale(t).collect()] == [0, 0.5, 1]
    z = [r.x for r in prep.Preprocessor(["x"], [], scaling="standard").fit(t).scale(t).collect()]
    assert z == pytest.approx([-1, 0, 1])
    u = column(spark, "x", "double", [0.0, 9.0, 99.0])
    p = prep.Preprocessor(["x"], [], scaling="log1p").fit(u)
    assert [r.x for r in p.scale(u).collect()] == pytest.approx([0, 0.5, 1])
    assert [r.x for r in p.unscale(p.scale(u)).collect()] == pytest.approx([0, 9, 99])


def test_params_integrity(spark, tmp_path):
    t = frame(spark, "x double, c string", (1.0, "a"), (2.0, "b"))
    p = prep.Preprocessor(["x"], ["c"]).fit(t)
    io.save_params(p.params_table(spark), str(tmp_path))
    loaded = prep.Preprocessor(["x"], ["c"]).load(io.load_params(spark, str(tmp_path)))
    assert loaded.transform(t).collect() == p.transform(t).collect()
    p.params_table(spark).limit(2).write.mode("overwrite").parquet(f"{tmp_path}/params")
    with pytest.raises(ValueError):
        io.load_params(spark, str(tmp_path))


def test_rules(spark):
    t = frame(spark, "age long, monthly double, total double", (25, 50.0, 500.0), (17, 80.0, 200.0), (30, 100.0, 50.0), (15, 120.0, 1000.0), (40, 60.0, 300.0))
    adult = rules.rules(["age >= 18"])
    assert [r[0] for r in t.select(rules.any_violated(t, adult)).collect()] == [False, True, False, True, False]
    assert value(rules.violation_rate(t, adult)) == pytest.approx(0.4)
    fixed = rules.clamp_correction(t, rules.rules(["age >= 18", "total >= monthly"]))
    assert value(rules.violation_rate(fixed, adult)) == 0 and fixed.collect()[2].total == 100
    assert value(rules.violation_rate(t, rules.rules(["absent > 1"]))) == 0
    assert value(rules.violation_rate(t.limit(0), adult)) == 0
    assert rules.Rule.parse("col_ge_10 >= 100").left == "col_ge_10"
    with pytest.raises(ValueError):
        rules.Rule.parse("col>=10")
    nulls = column(spark, "age", "long", [None, 20])
    assert value(rules.violation_rate(nulls, adult)) == 0.5
    assert value(rules.violation_rate(nulls, adult, null_violates=False)) == 0


def test_validation_and_correction(spark):
    spec = DatasetSpec(continuous=["age"], categorical=["c"], bounds={"age": (17, 90)}, domains={"c": ["a", "b"]})
    t = frame(spark, "age double, c string", (10.0, "a"), (105.0, "z"), (None, None))
    assert rules.validate(t, spec)
    with pytest.raises(ValueError, match="missing"):
        rules.validate(t.drop("c"), spec)
    assert [tuple(r) for r in rules.audit_and_correct(t, spec).collect()] == [(17.0, "a"), (90.0, "a"), (None, None)]
    assert rules.domain_audit(t, spec.domains).first().invalid == 1
    with pytest.raises(ValueError):
        DatasetSpec.from_dict({"nothing": 1})


def test_resampling_corrects_every_row(spark):
    given = rules.rules(["x >= 10"])
    t = spark.range(9000).select(F.col("id").alias("k"), F.when(F.col("id") % 1000 == 0, 10.0 + F.col("id")).otherwise(1.0).alias("x"))
    done = rules.correct_by_resampling(t, t, given, "k")
    assert [r.k for r in done.orderBy("k").collect()] == list(range(9000))
    assert done.where(rules.any_violated(done, given)).count() == 0
    assert rules.correct_by_resampling(t, t.where("k = 5000"), given, "k").where("x < 10").count() == 0
    left = rules.correct_by_resampling(t, t.where("x < 10"), given, "k")
    assert left.count() == 9000 and left.where("x < 10").count() == 0


def test_neighbours(spark):
    t = frame(spark, "id long, features array<double>", (1, [1.0, 0.0]), (2, [0.0, 1.0]))
    assert [(r.dcr, r.nndr) for r in privacy.dcr_nndr(t, t).collect()] == [(0, 0), (0, 0)]
    assert value(privacy.mia_auc(t, t, t)) == 0.5
    s = frame(spark, "s double, y int", (0.1, 0), (0.4, 0), (0.35, 1), (0.8, 1))
    assert value(privacy.auc(s, "s", "y")) == pytest.approx(0.75)


def test_blocks_give_the_same_neighbours(spark):
    t = spark.range(200).select("id", F.array(F.rand(1), F.rand(2), F.rand(3)).alias("features")).persist()
    a = {r.id: (r.dcr, r.nndr) for r in privacy.dcr_nndr(t.where("id < 100"), t.where("id >= 100")).collect()}
    b = {r.id: (r.dcr, r.nndr) for r in privacy.dcr_nndr(t.where("id < 100"), t.where("id >= 100"), block=7).collect()}
    assert a.keys() == b.keys() and all(a[k] == pytest.approx(b[k]) for k in a)


def test_model_comparison(spark):
    clear = [(f"f{i}", m, base + 0.001 * i) for i in range(10) for m, base in (("a", 0.5), ("b", 0.7), ("c", 0.9))]
    s = spark.createDataFrame(clear, "block string, model string, score double")
    assert compare.friedman(s).first().p_value < 0.05
    best = compare.compare_models(s).first()
    assert (best.best, best.worst) == ("c", "a")
    flat = [(f"f{i}", m, v) for i, row in enumerate([(0.5, 0.55, 0.45), (0.55, 0.45, 0.5), (0.45, 0.5, 0.55), (0.5, 0.55, 0.45), (0.55, 0.45, 0.5)]) for m, v in zip("abc", row)]
    assert compare.friedman(spark.createDataFrame(flat, "block string, model string, score double")).first().p_value > 0.05
    with pytest.raises(Exception, match="at least 3"):
        compare.friedman(s.where("model <> 'a'")).collect()
    assert compare.critical_difference(3, 10) == pytest.approx(1.048, abs=1e-3)
    assert stats.studentized_range_sf(3.314, 3) == pytest.approx(0.05, abs=1e-4)
    assert stats.chi2_sf(3.841459, 1) == pytest.approx(0.05, abs=1e-6)


def test_grades(spark):
    m = frame(spark, "metric string, value double", ("wasserstein", 0.02), ("wasserstein", 0.12), ("js_divergence", 0.01), ("js_divergence", None))
    assert [r[0] for r in m.select(audit.grade_column()).collect()] == ["Good", "Moderate", "Good", "UNKNOWN"]


def test_splits_do_not_depend_on_partitions(spark):
    t = spark.range(1000).select("id", (F.col("id") % 3).alias("c"))
    one = {r.id: r.split for r in split.stratified_split(t, ["id"], "c").collect()}
    two = {r.id: r.split for r in split.stratified_split(t.repartition(17), ["id"], "c").collect()}
    assert one == two and sum(v == "train" for v in one.values()) == 267 + 266 + 266
    folds = split.kfold(t, ["id"], 5).groupBy("fold").count().collect()
    assert sorted((r.fold, r["count"]) for r in folds) == [(k, 200) for k in range(5)]
    even = split.balanced_resample(t, ["id"], ["c"], 3000).groupBy("value").count().collect()
    assert all(850 < r["count"] < 1150 for r in even)


def test_copula_keeps_margins_and_dependence(spark):
    t = spark.range(3000).select((F.col("id") % 100).cast("double").alias("a"), ((F.col("id") % 100) * 2 + F.col("id") % 7).cast("double").alias("b"), F.when(F.col("id") % 4 == 0, "x").otherwise("y").alias("c"))
    s = synth.synthesize(t, 3000, ["a", "b"], ["c"])
    assert max(r.wasserstein for r in dist.wasserstein(t, s, ["a", "b"]).collect()) < 0.05
    assert assoc.pearson(s, [("a", "b")]).first().corr > 0.9
    assert s.collect() == synth.synthesize(t.repartition(5), 3000, ["a", "b"], ["c"]).collect()
    with pytest.warns(UserWarning):
        synth.synthesize(t, 10, ["a"], ["c"], condition=("c", "nothing"))
    noisy = synth.noisy_marginals(t, {"c": ["x", "y", "z"]}, seed=1)
    assert noisy.count() == 3 and noisy.first().sigma > 0


def test_utility_tasks(spark):
    t = spark.range(120).select((F.col("id") % 10).cast("double").alias("f"), F.when(F.col("id") % 2 == 0, "u").otherwise("v").alias("g"), (F.col("id") % 2).alias("y"), (F.col("id") % 10 * 3.0 + F.col("id") % 40).alias("z"))
    s = utility.evaluate_utility(t, t, t, "y", ["f"], ["g"], models=("random_forest",), trees=3)
    assert {(r.regime, r.metric) for r in s.collect()} == {(a, b) for a in ("TRTR", "TSTR") for b in ("accuracy", "f1_macro", "auc")}
    s = utility.evaluate_utility(t, t, t, "z", ["f"], ["g"], models=("linear",), trees=3)
    assert {r.metric for r in s.collect()} == {"mse", "mae", "r2"}


def test_a_failing_fit_is_a_row(spark):
    """One of three models fails; the others' scores and the audit's other lines are there all the same."""
    from pyspark.ml.classification import DecisionTreeClassifier, NaiveBayes

    t = spark.range(120).select(F.col("id"), (F.col("id") % 10).cast("double").alias("f"), F.when(F.col("id") % 2 == 0, "u").otherwise("v").alias("g"), F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("y"))

    def three(*_):
        tree = lambda: DecisionTreeClassifier(labelCol="label", maxDepth=2)
        # standardised numbers are negative, which this model rejects
        return {"random_forest": tree(), "gradient_boosting": NaiveBayes(labelCol="label"), "linear": tree()}

    s = utility.evaluate_utility(t, t, t, "y", ["f"], ["g"], estimators=three)
    got = s.collect()
    bad = [r for r in got if r.status != "ok"]
    assert {(r.model, r.regime, r.metric, r.value) for r in bad} == {("gradient_boosting", x, None, None) for x in ("TRTR", "TSTR")}
    assert len(got) == 2 * 2 * 3 + 2
    drops = {r.model: r.drop for r in utility.utility_drop(s).collect()}
    assert set(drops) == {"random_forest", "linear", "*"}
    lines = audit.with_status(audit.run_audit(t, t, t, t, ["f"], ["g"], target="y", estimators=three)).where("section = 'utility'").collect()
    assert {r.metric: r.status for r in lines if r.column == "gradient_boosting"} == {"TRTR/fit": "UNKNOWN", "TSTR/fit": "UNKNOWN"}
    assert {r.status for r in lines if r.metric == "drop/f1_macro"} == {"Good"}


def test_models_rows_are_dealt(spark, monkeypatch):
    """What a model is fitted on comes in partitions of bounded size, whatever those of the table are."""
    from pyspark.ml.regression import LinearRegression

    monkeypatch.setattr(utility, "TASK_ROWS", 100)
    sizes = []

    class Seen(LinearRegression):
        def fit(self, dataset, params=None):
            sizes.extend(r["n"] for r in dataset.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect())
            return super().fit(dataset, params)

    t = spark.range(1000).coalesce(1).select(F.col("id").cast("double").alias("x"), (F.col("id") % 50 * 2.0).alias("y"))
    s = utility.evaluate_utility(t, t, None, "y", ["x"], [], estimators=lambda *_: {"linear": Seen(labelCol="y")})
    assert {r.status for r in s.collect()} == {"ok"}
    assert sum(sizes) == 1000 and max(sizes) <= 110


def test_least_squares_go_over_rows_as_they_are(spark, monkeypatch):
    """A whole target needs no median, and a fit of one pass no copy of its rows; a target with holes is filled as before."""
    from pyspark.sql.classic.dataframe import DataFrame

    asked, real = [], utility.exact_quantiles
    monkeypatch.setattr(utility, "exact_quantiles", lambda *a: asked.append(a) or real(*a))
    monkeypatch.setattr(DataFrame, "cache", lambda self: pytest.fail("a copy of the rows"))
    t = spark.range(200).select(F.col("id").cast("double").alias("x"), (F.col("id") * 2.0 + 1).alias("y"), F.when(F.col("id") != 7, F.col("id") * 1.0).alias("z"))
    r2 = lambda target: {r.value for r in utility.evaluate_utility(t, t, t, target, ["x"], [], models=("linear",)).where("metric = 'r2'").collect()}
    assert all(v > 0.99 for v in r2("y")) and not asked
    assert all(0.9 < v < 1 for v in r2("z")) and len(asked) == 3
    assert utility.prepared(t, ["x"], [], "z", False).where("x = 7").first()["y"] == 100.0


def test_pairs_are_counted_in_as_many_tasks_as_they_ask_for(spark, monkeypatch):
    """Zeros of both signs are one value, incomplete pairs don't count, and the ranks' correlation is that of SQL."""
    import duckdb

    monkeypatch.setattr(assoc, "PAIR_ROWS", 500)
    x = F.when(F.col("id") % 17 > 0, (F.col("id") * 37 % 101 - 50).cast("double") * 0.5)
    t = spark.range(2000).select("id", F.when(F.col("id") % 5 == 0, -0.0 * F.col("id")).otherwise(x).alias("x"), F.when(F.col("id") % 3 == 0, float("nan")).otherwise(F.col("id") * 11 % 29 - 14.0).alias("y"))
    counts = assoc.pair_counts(t, [("x", "y"), ("id", "x")])
    assert counts.rdd.getNumPartitions() == 8
    assert counts.groupBy("pair", "x", "y").count().where("count > 1").isEmpty()
    local = t.toPandas()  # noqa: F841
    rank = lambda c: f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2"
    for r in assoc.spearman(t, [("x", "y"), ("id", "x")]).collect():
        a, b = r.col_i, r.col_j
        rows = f"(SELECT {a} + 0.0 AS a, {b} + 0.0 AS b FROM local WHERE NOT isnan({a}::DOUBLE) AND NOT isnan({b}::DOUBLE) AND {a} IS NOT NULL AND {b} IS NOT NULL)"
        want = duckdb.sql(f"SELECT corr(ra, rb) FROM (SELECT {rank('a')} AS ra, {rank('b')} AS rb FROM {rows})").fetchall()[0][0]
        assert r.spearman == pytest.approx(want, abs=1e-9)


def test_few_values_first_and_more_later(spark):
    t = spark.range(5000).select(F.when(F.col("id") < 4000, F.col("id") % 3).otherwise(F.col("id")).alias("late"), (F.col("id") % 10).alias("ten"), F.when(F.col("id") % 11 > 0, F.col("id") % 11).alias("holed"))
    assert [utility.is_classification(t.coalesce(1), c, []) for c in t.columns] == [False, True, False]


@pytest.mark.parametrize("name, trees, models", [("tstr_trtr", 100, 3), ("utility_drop", 100, 3), ("aia", 50, 1), ("cv_probe", 50, 1)])
def test_registered_models_are_whole(spark, sf, monkeypatch, name, trees, models):
    class Asked(Exception):
        pass

    def asked(*args, models=utility.MODELS, trees=100, **others):
        raise Asked(trees, len(models))

    monkeypatch.setattr(utility, "evaluate_utility", asked)
    with pytest.raises(Asked) as found:
        registry.queries()[name](spark, sf)
    assert found.value.args == (trees, models)


def test_csv_scan(spark, tmp_path):
    (tmp_path / "t.csv").write_text("1, a, ?\n2, unknown, 3.5\n")
    spec = DatasetSpec(continuous=["n", "m"], categorical=["c"], header=False, names=["n", "c", "m"], na_values=["?", "unknown"])
    assert [tuple(r) for r in io.read_table(spark, str(tmp_path / "t.csv"), spec).orderBy("n").collect()] == [(1.0, "a", None), (2.0, None, 3.5)]
    df = frame(spark, "x long, split string", (1, "train"), (2, "test"))
    io.write_split(df, str(tmp_path / "s"))
    assert [r.x for r in io.read_split(spark, str(tmp_path / "s"), "test").collect()] == [2]


def test_ks_exact_is_enumeration():
    """All orders of up to 10 values counted one by one, and sizes up to 30 a side against whole numbers of paths."""
    from fractions import Fraction
    from itertools import combinations
    from math import comb

    from loomtab.functions.stats import kolmogorov_exact_sf, kolmogorov_sf

    for n1, n2 in ((1, 1), (1, 5), (3, 4), (5, 5), (4, 6), (2, 7)):
        gaps = []
        for first in combinations(range(n1 + n2), n1):
            i = worst = 0
            for s in range(1, n1 + n2 + 1):
                i += s - 1 in first
                worst = max(worst, abs(i * n2 - (s - i) * n1))
            gaps.append(worst)
        for far in sorted(set(gaps)):
            assert kolmogorov_exact_sf(far / (n1 * n2), n1, n2) == pytest.approx(sum(g >= far for g in gaps) / len(gaps), abs=1e-12)
    for n1, n2 in ((30, 30), (30, 17), (21, 28)):
        for far in (n1 * n2 // 5, n1 * n2 // 3, n1 * n2 // 2):
            inside = {0: 1}
            for s in range(1, n1 + n2 + 1):
                inside = {i: inside.get(i, 0) + inside.get(i - 1, 0) for i in range(max(0, s - n2), min(n1, s) + 1) if abs(i * n2 - (s - i) * n1) < far}
            want = 1 - Fraction(inside.get(n1, 0), comb(n1 + n2, n1))
            assert kolmogorov_exact_sf(far / (n1 * n2), n1, n2) == pytest.approx(float(want), rel=1e-9)
    assert kolmogorov_exact_sf(0.05, 2000, 1500) == pytest.approx(kolmogorov_sf(0.05, 2000, 1500), rel=0.1)


def test_adjusted_p(spark):
    p = column(spark, "p_value", "double", [0.01, 0.02, 0.03, 0.5])
    assert [r.adjusted for r in dist.adjust_p(p, "bh").orderBy("p_value").collect()] == pytest.approx([0.04, 0.04, 0.04, 0.5])
    assert [r.adjusted for r in dist.adjust_p(p, "bonferroni").orderBy("p_value").collect()] == pytest.approx([0.04, 0.08, 0.12, 1.0])


def test_profiles(spark):
    t = column(spark, "x", "double", [0.0, 1.0, 2.0, 3.0, 100.0, math.nan, None])
    r = profile.describe_continuous(t, ["x"]).first()
    assert (r["count"], r.median, r.zero_count) == (5, 2.0, 1)
    assert profile.outliers_iqr(t, ["x"]).first().outliers == 1
    same = column(spark, "x", "double", [1.0, 1.0])
    assert profile.outliers_zscore(same, ["x"]).first().outliers == 0
    assert profile.outliers_mad(same, ["x"]).first().outliers == 0


def test_running_sums_and_quantiles(spark):
    import numpy as np

    from loomtab.operators import running

    rng = np.random.default_rng(1)
    x = {"a": rng.integers(0, 40, 700).astype(float), "b": rng.normal(0, 5, 301), "c": np.array([3.0])}
    df = spark.createDataFrame([(k, float(v)) for k, xs in x.items() for v in xs], "g string, x double").repartition(7)
    counts = df.groupBy("g", "x").agg(F.count("*").alias("n"))
    for r in running.sums_below(counts, ["g"], "x", {"n": "below"}).collect():
        assert r.below == (x[r.g] < r.x).sum()
    q = (0.9, 0.05, 0.5, 1.0, 0.0, 0.333)
    for r in running.exact_quantiles(df, ["g"], q).collect():
        assert np.allclose(r.q, np.quantile(x[r.g], q))
    assert running.exact_quantiles(df.where("g = 'a'"), [], (0.5,)).first().q == [np.median(x["a"])]
    assert running.exact_quantiles(df.limit(0), ["g"], q).count() == 0


def test_status_and_fold_metrics(spark):
    lines = [("fidelity", "wasserstein", "x", 0.2), ("fidelity", "js_divergence", "k", 0.01), ("fidelity", "js_divergence", "m", 0.05), ("fidelity", "corr_difference", "*", 0.3), ("rules", "mape", "r/synth", 0.2)]
    lines += [("privacy", "dcr_mean", "*", 1.5), ("privacy", "leakage_pct", "*", 6.0), ("privacy", "mia_auc", "*", 0.7), ("utility", "TSTR/f1_macro", "random_forest", 0.6), ("utility", "TRTR/f1_macro", "random_forest", 0.7)]
    lines += [("utility", "TSTR/r2", "linear", 0.3), ("utility", "TRTR/r2", "linear", 0.32), ("utility", "drop/f1_macro", "random_forest", 0.1), ("privacy", "nndr_mean", "*", 0.4), ("fidelity", "wasserstein", "y", None)]
    df = spark.createDataFrame(lines, "section string, metric string, column string, value double")
    told = {(r.metric, r.column): r.status for r in audit.with_status(df).collect()}
    assert told["wasserstein", "x"] == "Poor" and told["js_divergence", "k"] == "Good" and told["js_divergence", "m"] == "Moderate"
    assert told["mape", "r/synth"] == "Poor" and told["leakage_pct", "*"] == "Poor" and told["mia_auc", "*"] == "Moderate"
    assert told["drop/f1_macro", "random_forest"] == "Moderate" and told["wasserstein", "y"] == "UNKNOWN" and told["nndr_mean", "*"] is None
    row = audit.fold_metrics(df).first().asDict()
    assert len(row) == 12 and row["avg_js"] == pytest.approx(0.03) and row["tstr_rf_f1"] == 0.6 and row["trtr_lr_f1"] == 0.32 and row["tstr_gb_f1"] is None
    assert {r.domain: r.grade for r in audit.domains_of(df).collect()} == {"fidelity": "RED", "privacy": "RED", "utility": "YELLOW"}


def test_missing_values_are_part_of_drawn_rows(spark):
    df = spark.range(3000).select(F.when(F.col("id") % 3 > 0, F.col("id").cast("double")).alias("x"), F.when(F.col("id") % 3 > 0, F.concat(F.lit("k"), F.col("id") % 2)).alias("k"))
    from loomtab.operators import synth

    got = synth.synthesize(df, 3000, ["x"], ["k"]).agg(F.avg(F.col("x").isNull().cast("double")).alias("x"), F.avg(F.col("k").isNull().cast("double")).alias("k"), F.avg((F.col("x").isNull() & F.col("k").isNull()).cast("double")).alias("both")).first()
    assert abs(got.x - 1 / 3) < 0.05 and abs(got.k - 1 / 3) < 0.05 and got.both > 0.25


def test_names_with_spaces_in_rules():
    r = rules.Rule.parse("total charge >= monthly charge")
    assert (r.left, r.op, r.right) == ("total charge", ">=", "monthly charge")
    with pytest.raises(ValueError):
        rules.Rule.parse("total>=3")


def test_noisy_tables_feed_draws(spark):
    """Each pair is released once within the budget, over its whole public domain; with a large budget drawn pairs follow the real ones."""
    import numpy as np

    t = spark.range(20_000).select(F.when(F.col("id") % 4 == 0, "x").otherwise("y").alias("a"), (F.when(F.col("id") % 4 == 0, 2.0).otherwise(7.0) + F.col("id") % 3).alias("b"), F.when(F.col("id") % 5 == 0, "p").otherwise("q").alias("c"), F.lit("odd").alias("d"))
    tree = synth.NoisyTree({"a": ["x", "y", "never"], "c": ["p", "q"], "d": ["other"]}, {"b": (0, 10)}, bins=5, epsilon=1.0, seed=3).fit(t)
    rows = tree.released.collect()
    assert len(rows) == 3 * 2 + 3 * 1 + 3 * 5 + 2 * 1 + 2 * 5 + 1 * 5
    assert sum({(r.col_i, r.col_j): r.epsilon for r in rows}.values()) == pytest.approx(1.0)
    assert sum({(r.col_i, r.col_j): r.delta for r in rows}.values()) == pytest.approx(1e-6)
    assert min(r.noisy_count for r in rows) >= 0 and {r.sigma for r in rows} == {synth.noise_scale(1 / 6, 1e-6 / 6)}
    assert ("a", "b") in tree.tree or ("b", "a") in tree.tree  # the pair that tells most of each other
    assert [c for _, c in tree.tree][0] == "a" and sorted(c for _, c in tree.tree) == ["a", "b", "c", "d"]
    drawn = tree.sample(spark, 5000)
    assert drawn.count() == 5000 and drawn.collect() == tree.sample(spark, 5000).collect()
    far = {(r.col_i, r.col_j): r.distance for r in tree.distances(t, drawn).collect()}
    assert far["a", "b"] < 0.1 and far["a", "c"] < 0.1
    assert drawn.agg(F.min("b"), F.max("b")).first()[0] >= 0 and {r.d for r in drawn.select("d").distinct().collect()} == {"other"}
    tree.tables["a", "c"] = np.zeros((3, 2))
    assert tree.information("a", "c") == 0.0
    with pytest.raises(ValueError):
        synth.NoisyTree({"a": ["x"]}).fit(t)


def test_level_densities_have_one_mode(spark):
    """Evenly spread values: rounding errors of the sums make no modes; two far heaps, each level between two points, are two."""
    rows = spark.range(60_000).select(*[((F.col("id") % 1000) * (1 + k / 7) + 900).alias(f"c{k}") for k in range(8)])
    assert {r.modes for r in dist.kde_modes(rows, rows.columns, 100).collect()} == {1}
    heaps = spark.range(4000).select(F.when(F.col("id") % 2 == 0, F.col("id") % 500).otherwise(3000 + F.col("id") % 500).cast("double").alias("x"))
    assert [r.modes for r in dist.kde_modes(heaps, ["x"], 100).collect()] == [2]


def test_infer_spec_counts_in_bounded_tasks(spark, monkeypatch):
    """Distinct values as count(DISTINCT) has them, in as many partitions as the rows ask for."""
    k = F.col("id")
    t = spark.range(2000).select("id", F.when(k % 3 > 0, F.when(k % 5 == 0, -0.0).when(k % 5 == 1, 0.0).when(k % 5 == 2, float("nan")).otherwise(k / 7)).alias("x"), F.when(k % 2 == 0, "often").otherwise(k.cast("string")).alias("s"), F.lit(None).cast("string").alias("none"), (k % 4 == 0).alias("b"))
    monkeypatch.setattr(audit, "DISTINCT_ROWS", 500)
    done = audit.infer_spec(t)
    want = t.agg(*[F.count_distinct(F.col(c)).alias(c) for c in t.columns]).first().asDict()
    assert {r.col: r.distinct for r in done.collect()} == want
    plan = done._jdf.queryExecution().executedPlan().toString()
    assert ", 20), REPARTITION_BY_NUM" in plan and "count(distinct" not in plan
