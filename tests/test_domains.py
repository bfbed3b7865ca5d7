"""Columns with many categories: numbered, encoded, decoded and drawn by joins."""

import pytest
from pyspark.sql import functions as F

from loomtab.operators import dist, domains, prep, running, synth


def people(spark, n, categories):
    """A third of the rows hold one category; the others spread over the rest, some are null."""
    name = F.concat(F.lit("n"), F.lpad((F.col("id") % categories).cast("string"), 7, "0"))
    return spark.range(n).select("id", F.when(F.col("id") % 97 == 5, None).when(F.col("id") % 3 == 0, "hot").otherwise(name).alias("name"), (F.col("id") % 7).cast("double").alias("x"))


def test_in_order(spark):
    t = spark.range(5000).select((F.col("id") * 7919 % 5003).alias("v"), F.lit(2).alias("w")).repartition(6)
    got = running.in_order(t, [F.desc("v")], {"w": "before"}).orderBy("at").collect()
    assert [r.at for r in got] == list(range(5000)) and [r.v for r in got] == sorted((r.v for r in got), reverse=True)
    assert [r.before for r in got] == [2 * i for i in range(5000)]
    assert running.in_order(t.limit(0), [F.col("v")], {}).count() == 0


def test_a_million_categories_encode_and_decode(spark, monkeypatch):
    collected = []
    plain = prep.kept_table
    monkeypatch.setattr(prep, "kept_table", lambda df, label: collected.append(label) or plain(df, label))
    t = people(spark, 1_600_000, 1_500_000)
    fitted = prep.Preprocessor([], ["name"], encoding="label").fit(t)
    assert len(fitted.params) < 10 and fitted.entries.count() > 980_000 > domains.BROADCAST_ROWS
    done = fitted.encode(fitted.impute(t))
    assert done.agg(F.min("name"), F.max("name")).first()[0] >= 0
    back = fitted.unimpute(fitted.decode(done)).select("id", F.col("name").alias("back"))
    assert t.join(back, "id").where(~F.col("name").eqNullSafe(F.col("back"))).count() == 0
    assert back.count() == 1_600_000


@pytest.mark.parametrize("broadcast", [10, 10_000])
@pytest.mark.parametrize("unknown", ["ignore", "error"])
def test_large_columns_agree_with_small_ones(spark, monkeypatch, broadcast, unknown):
    """The same numbers and values as with collected categories, unseen ones included; parameters load again."""
    monkeypatch.setattr(domains, "BROADCAST_ROWS", broadcast)
    monkeypatch.setattr(domains, "HOT", 3)
    t = people(spark, 600, 90)
    new = t.limit(20).unionByName(spark.createDataFrame([(1000, "never seen" if unknown == "ignore" else "hot", 1.0), (1001, None, None)], t.schema))
    small = prep.Preprocessor(["x"], ["name"], encoding="label", unknown=unknown).fit(t)
    large = prep.Preprocessor(["x"], ["name"], encoding="label", unknown=unknown, large=5).fit(t)
    again = prep.Preprocessor(["x"], ["name"], encoding="label", unknown=unknown).load(large.params_table(spark))
    want = {r.id: r for r in small.transform(new).collect()}
    for p in (large, again):
        assert {r.id: r.asDict() for r in p.transform(new).collect()} == {k: r.asDict() for k, r in want.items()}
        assert {r.id: r.asDict() for r in p.inverse(p.transform(new)).collect()} == {r.id: r.asDict() for r in small.inverse(small.transform(new)).collect()}
    if unknown == "error":
        with pytest.raises(Exception, match="unknown category"):
            large.transform(new.withColumn("name", F.lit("never seen"))).collect()
    assert small.layout() == large.layout()
    with pytest.raises(ValueError):
        prep.Preprocessor([], ["name"], encoding="onehot", large=5).fit(t)


@pytest.mark.parametrize("broadcast", [10, 10_000])
def test_copula_with_many_categories(spark, monkeypatch, broadcast):
    """Margins of drawn rows come from the same cumulative shares as with collected categories."""
    monkeypatch.setattr(domains, "BROADCAST_ROWS", broadcast)
    t = people(spark, 4000, 200)
    a = synth.Copula(["x"], ["name"]).fit(t).sample(spark, 3000)
    b = synth.Copula(["x"], ["name"], large=20).fit(t).sample(spark, 3000)
    both = a.join(b.select("row_id", F.col("name").alias("other"), F.col("x").alias("x2")), "row_id")
    assert both.count() == 3000
    assert both.where(~F.col("name").eqNullSafe(F.col("other"))).count() <= 3  # shares differ by rounding at most
    hot = b.where("name = 'hot'").count() / 3000
    assert abs(hot - t.where("name = 'hot'").count() / 4000) < 0.03


def test_draws_are_compiled_and_nulls_take_no_part(spark):
    """The JVM compiles no method above 8,000 bytes; scores of missing numbers don't tell of other columns."""
    t = spark.range(4000).select(F.when(F.col("id") % 4 > 0, F.col("id") % 1000).cast("double").alias("x"), (F.col("id") % 1000).cast("double").alias("y"), (F.col("id") % 4 > 0).cast("string").alias("c"))
    model = synth.Copula(["x", "y"], ["c"]).fit(t)
    assert model.factor[1, 0] > 0.99  # y is x where x is known
    drawn = model.sample(spark, 1000)
    code = spark._jvm.org.apache.spark.sql.execution.debug.__getattr__("package$").__getattr__("MODULE$").codegenStringSeq(drawn._jdf.queryExecution().executedPlan())
    assert all(code.apply(i)._3().maxMethodCodeSize() <= 8000 for i in range(code.size()))
    assert 150 < drawn.where("x IS NULL").count() < 350


def test_ranges_are_those_of_the_edges(spark):
    values = spark.range(3000).select(F.when(F.col("id") % 50 > 0, F.pmod(F.xxhash64("id"), F.lit(700)) / 7.0).alias("x"), (F.col("id") % 2).alias("g"))
    got = running.in_ranges(values.unionByName(spark.createDataFrame([(float("nan"), 0), (5.0, 7), (None, 8)], "x double, g long")), ["g"], "x").collect()
    edges = {r.g: r.e for r in values.groupBy("g").agg(F.percentile_approx("x", [i / 64 for i in range(1, 64)], 1000).alias("e")).collect()}
    for r in got:
        assert r.part == (-1 if r.x is None else 64 if r.x != r.x else sum(e < r.x for e in edges.get(r.g, [])))


def test_distances_make_their_tables_once(spark):
    made = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            made.add(b.num_rows)
            yield b

    t = spark.range(500).select(F.col("id").cast("double").alias("x"))
    far = dist.wasserstein(t.mapInArrow(counted, "x double"), t.select((F.col("x") + 5).alias("x")), ["x"]).collect()
    assert abs(far[0].wasserstein - 5 / 499) < 1e-12 and made.value == 500
