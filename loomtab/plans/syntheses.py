"""Queries that synthesise tables; what they give is checked by the distances of the library."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from ..operators import assoc, audit, dist, profile, rules, synth
from ..operators.domains import kept_table
from ..sources.spec import DatasetSpec
from .registry import KINDS, query, table

_X = ["l_quantity", "l_extendedprice", "l_discount"]


@query()
def synthesize(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    return synth.synthesize(li, li.count(), _X, KINDS)


@query(
    f"""SELECT 'l_returnflag=' || l_returnflag AS part, (SELECT count(*) FROM lineitem) AS rows, true AS inside, true AS near FROM lineitem GROUP BY l_returnflag
    UNION ALL SELECT 'l_linestatus=' || l_linestatus, (SELECT count(*) FROM lineitem), true, true FROM lineitem GROUP BY l_linestatus
    UNION ALL SELECT c, (SELECT count(*) FROM lineitem), true, true FROM (VALUES ('l_quantity'), ('l_extendedprice'), ('l_discount'), ('l_quantity~l_extendedprice'), ('l_quantity~l_discount'), ('l_extendedprice~l_discount')) AS v(c)"""
)
def synthesize_close(spark, sf_dir):
    """Drawn rows against real ones: each category's share within 0.02, each number inside the real range with a distance under 0.03, each correlation within 0.05."""
    li = table(spark, sf_dir, "lineitem")
    n = li.count()
    drawn = kept_table(synth.synthesize(li, n, _X, KINDS), "drawn")
    shares = lambda d, name: profile.frequencies(d, KINDS).select(F.concat_ws("=", "col", "value").alias("part"), F.col("share").alias(name))
    kinds = shares(li, "p").join(shares(drawn, "q"), "part", "full").select("part", (F.col("p").isNotNull() & F.col("q").isNotNull()).alias("inside"), (F.abs(F.col("p") - F.col("q")) < 0.02).alias("near"))
    ends = lambda d, a, b: d.select(*_X).unpivot([], _X, "part", "x").groupBy("part").agg(F.min("x").alias(a), F.max("x").alias(b))
    spans = ends(li, "a", "b").join(ends(drawn, "c", "d"), "part").select("part", ((F.col("c") >= F.col("a")) & (F.col("d") <= F.col("b"))).alias("inside"))
    numbers = spans.join(dist.wasserstein(li, drawn, _X).withColumnRenamed("col", "part"), "part").select("part", "inside", (F.col("wasserstein") < 0.03).alias("near"))
    pairs = assoc.all_pairs(_X)
    both = assoc.pearson(li, pairs).join(assoc.pearson(drawn, pairs).withColumnRenamed("corr", "other"), ["col_i", "col_j"])
    tied = both.select(F.concat_ws("~", "col_i", "col_j").alias("part"), F.lit(True).alias("inside"), (F.abs(F.col("corr") - F.col("other")) < 0.05).alias("near"))
    return kinds.unionByName(numbers).unionByName(tied).select("part", F.lit(n).alias("rows"), "inside", "near")


@query("SELECT 'A' AS l_returnflag, count(*) AS n FROM lineitem")
def synthesize_conditional(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    done = synth.synthesize(li, li.count(), _X, KINDS, condition=("l_returnflag", "A"))
    return done.groupBy("l_returnflag").agg(F.count("*").alias("n"))


@query("SELECT fold, count(*) * 2 AS n FROM (SELECT unnest(range(3)) AS fold, l_orderkey % 3 AS own FROM lineitem) WHERE own <> fold GROUP BY fold".replace("count(*) * 2", "count(*)"))
def synthesize_folds(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").withColumn("fold", (F.col("l_orderkey") % 3).cast("int"))
    return synth.synthesize_folds(li, "fold", 3, _X[:2], KINDS[:1]).groupBy(F.col("fold").cast("long").alias("fold")).agg(F.count("*").alias("n"))


_DOMAINS = {"l_returnflag": ["A", "N", "R", "X"], "l_linestatus": ["F", "O"]}


@query()
def noisy_marginals(spark, sf_dir):
    return synth.noisy_marginals(table(spark, sf_dir, "lineitem"), _DOMAINS, seed=7)


_TREE = synth.NoisyTree({"l_returnflag": ["A", "N", "R"], "l_linestatus": ["F", "O"]}, {"l_quantity": (1, 51), "l_extendedprice": (0, 110000)}, bins=10, seed=11)


@query(
    """SELECT col_i, col_j, round(1.0 / 6, 9) AS epsilon, round(1e-6 / 6, 12) AS delta, cells, (SELECT count(*) FROM lineitem) AS rows, true AS close FROM (VALUES
    ('l_returnflag', 'l_linestatus', 6), ('l_returnflag', 'l_quantity', 30), ('l_returnflag', 'l_extendedprice', 30), ('l_linestatus', 'l_quantity', 20), ('l_linestatus', 'l_extendedprice', 20), ('l_quantity', 'l_extendedprice', 100)) AS v(col_i, col_j, cells)""",
    "epsilon delta:12",
)
def noisy_synthesis(spark, sf_dir):
    """Rows drawn from noisy pair tables alone: each table's budget and cells, and whether the drawn pairs are as the real ones.

    Close: within 0.08, or 0.15 for the pair of two numbers, of half the summed differences of shares, given the noise at this budget.
    """
    li = table(spark, sf_dir, "lineitem")
    fitted = replace(_TREE).fit(li)
    n = li.count()
    far = fitted.distances(li, fitted.sample(spark, n)).drop("parent_of")
    cells = fitted.released.groupBy("col_i", "col_j").agg(F.count("*").cast("int").alias("cells"))
    limit = F.when(F.col("col_i") == "l_quantity", 0.15).otherwise(0.08)
    return far.join(F.broadcast(cells), ["col_i", "col_j"]).select("col_i", "col_j", "epsilon", "delta", "cells", F.lit(n).alias("rows"), (F.col("distance") < limit).alias("close"))


@query()
def noisy_synthesis_distances(spark, sf_dir):
    """The same with the tree's edges and the distances themselves, which depend on the noise."""
    li = table(spark, sf_dir, "lineitem")
    fitted = replace(_TREE).fit(li)
    return fitted.distances(li, fitted.sample(spark, li.count()))


_SPEC = DatasetSpec(continuous=_X, categorical=KINDS, bounds={"l_quantity": (2, 45), "l_discount": (0.01, 0.09)}, domains={"l_returnflag": ["A", "N"]})


@query(
    """SELECT count(*) AS rows, 0 AS violations, 2.0 AS least, 45.0 AS most, 'A,N' AS flags, string_agg(DISTINCT l_linestatus, ',' ORDER BY l_linestatus) AS statuses,
    true AS spread_kept FROM lineitem""",
    "least most",
)
def synth_then_audit(spark, sf_dir):
    """Drawn, corrected by rules, bounds and domains, then audited: nothing is left outside, and what no bound touches keeps its distribution."""
    li = table(spark, sf_dir, "lineitem")
    given = rules.rules(["l_extendedprice >= l_quantity"])
    fixed = synth.synthesize_corrected(li, li.count(), _SPEC, given)
    flags = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")  # noqa: E731  # as many as the domain has
    found = fixed.agg(F.count("*").alias("rows"), F.count_if(rules.any_violated(fixed, given)).cast("int").alias("violations"), F.min("l_quantity").alias("least"), F.max("l_quantity").alias("most"), flags("l_returnflag").alias("flags"), flags("l_linestatus").alias("statuses"))
    far = dist.wasserstein(li, fixed, ["l_extendedprice"]).select((F.col("wasserstein") < 0.02).alias("spread_kept"))
    return found.join(F.broadcast(far))


@query(
    """SELECT 'both' AS part, count(*) AS rows, true AS close FROM customer UNION ALL SELECT 'balance', count(*), true FROM customer UNION ALL SELECT 'segment', count(*), true FROM customer""",
)
def synthesize_missing(spark, sf_dir):
    """Nulls of a number and of a category that come together in the source come together in the drawn rows."""
    c = table(spark, sf_dir, "customer")
    hole = F.col("c_nationkey") < 8
    source = c.select(F.when(~hole, F.col("c_acctbal")).alias("c_acctbal"), F.when(~hole, F.col("c_mktsegment")).alias("c_mktsegment"), "c_nationkey")
    drawn = synth.synthesize(source, c.count(), ["c_acctbal", "c_nationkey"], ["c_mktsegment"])
    gone = {"balance": F.col("c_acctbal").isNull(), "segment": F.col("c_mktsegment").isNull(), "both": F.col("c_acctbal").isNull() & F.col("c_mktsegment").isNull()}
    share = lambda d: d.agg(F.count("*").alias("rows"), *[F.avg(v.cast("double")).alias(k) for k, v in gone.items()])
    a, b = share(source).unpivot(["rows"], list(gone), "part", "told"), share(drawn).unpivot(["rows"], list(gone), "part", "got")
    return a.join(b.drop("rows"), "part").select("part", "rows", (F.abs(F.col("told") - F.col("got")) < 0.1).alias("close"))


@query()
def synthetic_report(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    return audit.fidelity_grades(li, synth.synthesize(li, li.count(), _X, KINDS), _X, KINDS)
