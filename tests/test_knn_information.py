"""Mutual information by neighbours against a brute force over all rows."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomtab.operators import knn_information as knn


def psi(m):
    return -0.5772156649015329 + sum(1 / i for i in range(1, int(m)))


def around(v, c, r):
    return max(int(((np.abs(v - c) < r - 1e-12 * (abs(c) + r)) | (v == c)).sum()), 1)


def brute_two(x, y, k=3):
    total = 0.0
    for a, b in zip(x, y):
        r = np.sort(np.maximum(np.abs(x - a), np.abs(y - b)))[k]
        total += psi(around(x, a, r)) + psi(around(y, b, r))
    return max(0.0, psi(len(x)) + psi(k) - total / len(x)) / math.log(2)


def brute_class(x, g, k=3):
    keep = np.array([(g == v).sum() > 1 for v in g])
    x, g = x[keep], g[keep]
    total = 0.0
    for a, c in zip(x, g):
        own = x[g == c]
        kk = min(k, len(own) - 1)
        r = np.sort(np.abs(own - a))[kk]
        total += psi(kk) - psi(len(own)) - psi(around(x, a, r))
    return max(0.0, psi(len(x)) + total / len(x)) / math.log(2)


@pytest.mark.parametrize("rows", [64, 2048])
def test_two_numbers_are_brute_force(spark, monkeypatch, rows):
    """2,000 rows, some of them repeated, in one rectangle and in many."""
    monkeypatch.setattr(knn, "CELL_ROWS", rows)
    rng = np.random.default_rng(2)
    x = rng.normal(0, 1, 2000)
    y = 0.8 * x + rng.normal(0, 0.5, 2000)
    x[:50], y[:50] = x[0], y[0]
    x[60:90] = x[60]
    got = knn.two_numbers(spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y)], "x double, y double").repartition(3)).first().mi
    assert got == pytest.approx(brute_two(x, y), abs=1e-9) and got > 0.5


def test_number_and_category_is_brute_force(spark):
    rng = np.random.default_rng(3)
    g = rng.choice(["a", "b", "c", "hot"], 2000, p=[0.1, 0.1, 0.1, 0.7])
    x = rng.normal(0, 1, 2000) + np.where(g == "hot", 0, 3)
    x[:100] = 1.25
    g[0], g[1], g[2] = "alone", "two", "two"
    got = knn.number_and_category(spark.createDataFrame([(str(c), float(a)) for a, c in zip(x, g)], "g string, x double").repartition(3)).first().mi
    assert got == pytest.approx(brute_class(x, g), abs=1e-9) and got > 0.2


def test_pairs_of_all_kinds(spark):
    """Nulls are left out by pair, independent columns tell next to nothing, copies of a column much, and jitter parts repeated values."""
    t = spark.range(1500).select("id", F.when(F.col("id") % 50 > 0, F.rand(1)).alias("u"), F.rand(2).alias("v"), F.round(F.rand(3) * 5).alias("w"), F.when(F.rand(4) > 0.5, "p").otherwise("q").alias("s"))
    t = t.withColumn("copy", F.col("w") * 2)
    t.cache()
    got = {(r.col_i, r.col_j): (r.mi, r.estimator) for r in knn.neighbour_information(t, [("u", "v"), ("u", "s"), ("w", "copy"), ("s", "s")], ["u", "v", "w", "copy"], ["id"]).collect()}
    assert got["u", "v"][0] < 0.1 and got["u", "s"][0] < 0.1 and got["w", "copy"][0] > 1.5
    assert got["s", "s"][1] == "plug-in" and got["u", "v"][1] == "neighbours"
    few = knn.neighbour_information(t.limit(0), [("u", "v"), ("u", "s")], ["u", "v"], ["id"]).collect()
    assert [r.mi for r in few] == [0.0, 0.0]
