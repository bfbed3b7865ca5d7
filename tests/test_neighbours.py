"""Exact neighbours with pivots and approximate ones with projections, against all pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomtab.operators import audit, neighbours, privacy

SCHEMA = "id long, features array<double>"


def clustered(seed, n, dim=6, clusters=12):
    rng = np.random.default_rng(seed)
    centres = np.random.default_rng(99).normal(0, 20, (clusters, dim))
    return centres[rng.integers(0, clusters, n)] + rng.normal(0, 1, (n, dim))


def table(spark, x, first=0):
    return spark.createDataFrame([(first + i, r) for i, r in enumerate(x.tolist())], SCHEMA)


def brute(q, b, keep=2):
    d = np.sqrt(((q[:, None, :] - b[None, :, :]) ** 2).sum(2))
    return np.sort(d, axis=1)[:, :keep]


@pytest.mark.parametrize("most", [1, 20, 512])
def test_pruned_is_exact(spark, most):
    q, b = clustered(1, 300), clustered(2, 700)
    b[:200] = b[0]  # a vector of many copies, which queries have too
    q[:60] = b[0]
    got = {r.id: (r.d1, r.d2) for r in neighbours.nearest_pruned(table(spark, q, 5000), table(spark, b), most=most, block=64).collect()}
    want = brute(q, b)
    assert len(got) == 300
    for i, w in enumerate(want):
        assert got[5000 + i] == pytest.approx(tuple(w), abs=1e-9)


def test_pruned_meets_fewer_pairs(spark):
    """On clustered rows far cells never meet; on one cluster they all may."""
    q, b = table(spark, clustered(3, 400)), table(spark, clustered(4, 3000))
    r = neighbours.meetings(q, b).first()
    assert (r.queries, r.base) == (400, 3000) and r.met < 0.1


@pytest.mark.parametrize("n", [500, 2000, 8000])
def test_approximate_recall(spark, n):
    """Of the exact two nearest, at least 0.9 are found, at three sizes; distances are never below the exact ones."""
    q, b = clustered(5, 200, 8), clustered(6, n, 8)
    got = {r.id: (r.d1, r.d2) for r in neighbours.nearest_approximate(table(spark, q), table(spark, b)).collect()}
    want = brute(q, b)
    found = np.array([got[i] for i in range(200)])
    assert (found >= want - 1e-9).all()
    recall = (found <= want + 1e-9).mean()
    print(f"recall at {n}: {recall:.3f}")
    assert recall >= 0.9


def test_rows_without_enough_neighbours(spark):
    """One base row, null and broken vectors, empty tables, and far queries that no bucket answers."""
    one = table(spark, np.array([[1.0, 2.0]]))
    odd = spark.createDataFrame([(1, [1.0, 2.0]), (2, None), (3, [float("nan"), 1.0]), (4, [1e9, -1e9]), (None, [1.0, 3.0])], SCHEMA)
    for near in (neighbours.nearest_pruned, neighbours.nearest_approximate):
        got = {r.id: (r.d1, r.d2) for r in near(odd, one).collect()}
        assert set(got) == {1, 4} and got[1] == (0.0, None) and got[4][0] > 1e9
        assert near(odd.limit(0), one).count() == 0
        assert near(odd, one.limit(0)).count() == 0


def test_modes_of_the_audit(spark):
    q, b = table(spark, clustered(7, 150, 3)), table(spark, clustered(8, 400, 3))
    want = {r.id: (round(r.dcr, 9), round(r.nndr, 9)) for r in privacy.dcr_nndr(b, q).collect()}
    got = {r.id: (round(r.dcr, 9), round(r.nndr, 9)) for r in privacy.dcr_nndr(b, q, mode="pruned").collect()}
    assert got == want
    some = privacy.dcr_nndr(b, q, max_samples=50)
    assert some.count() == 50 and some.where(F.col("dcr") < 0).count() == 0
    with pytest.raises(ValueError):
        privacy.nearest_two(q, b, mode="guess")


def test_pairs_of_a_query_do_not_grow(spark, monkeypatch):
    """Plane vectors: a query meets the same few hundred rows in a table of any size; by default no blocks meet pairwise."""
    monkeypatch.setattr(privacy, "_blocked", None)
    few = table(spark, np.array([[0.0, 1.0], [2.0, 1.0], [9.0, 9.0]]))
    assert {(r.id, r.d1, r.d2) for r in privacy.nearest_two(few.where("id = 0"), few.where("id > 0")).collect()} == {(0, 2.0, 145**0.5)}
    at = lambda seed: F.array(*[F.pmod(F.xxhash64("id", F.lit(seed + j)), F.lit(10**6)) / 1000 for j in (0, 1)])
    q = spark.range(1000).select("id", at(1).alias("features"))
    for n in (40_000, 400_000):
        r = neighbours.meetings(q, spark.range(n).select("id", at(3).alias("features"))).first()
        assert r.met * r.base < 1000


def test_far_from_the_origin(spark):
    """Distances far smaller than the vectors: products of whole vectors would lose them."""
    rng = np.random.default_rng(3)
    q, b = 1e8 + rng.integers(0, 4000, (200, 2)) / 64, 1e8 + rng.integers(0, 4000, (900, 2)) / 64
    got = {r.id: (r.d1, r.d2) for r in privacy.nearest_two(table(spark, q), table(spark, b)).collect()}
    want = brute(q, b)
    assert all(got[i] == pytest.approx(tuple(w), abs=1e-9) for i, w in enumerate(want))


def test_crowded_cells(spark, monkeypatch):
    """Queries that all look into one cell are dealt to several tasks; a cell without rows, one id of two vectors, one kept row."""
    monkeypatch.setattr(neighbours, "QUERIES", 50)
    b = np.array([[float(i % 3), float(i)] for i in range(300)])
    q = np.concatenate([np.full((1, 2), -50.0) - np.arange(400)[:, None] / 7, [[1.0, 150.5]]])
    near = spark.createDataFrame([(7 if i == 400 else i, r) for i, r in enumerate(q.tolist())], SCHEMA)
    got = neighbours.nearest_pruned(near, table(spark, b), block=20).collect()
    assert np.allclose(sorted((r.d1, r.d2) for r in got), sorted(brute(q, b).tolist()), rtol=0, atol=1e-9)
    one = {r.id: r.d1 for r in privacy.nearest_two(near.where("id > 7"), table(spark, b), keep=1).collect()}
    assert all(one[i] == pytest.approx(brute(q, b)[i][0], abs=1e-9) for i in range(8, 400))


def test_audit_meets_the_same_rows_once(spark, monkeypatch):
    """Distances of synthetic to training rows serve the summary and the leakage."""
    asked = []
    real = privacy.nearest_two
    monkeypatch.setattr(privacy, "nearest_two", lambda q, b, *a, **how: asked.append((q, b)) or real(q, b, *a, **how))
    rows = [spark.range(k, 240, 3).select("id", (F.col("id") * 7 % 31).cast("double").alias("x"), (F.col("id") % 2).cast("string").alias("c")) for k in range(3)]
    train, test, synth = rows
    vectors = lambda d: d.select("id", F.array("x", F.col("id") / 100).alias("features"))
    lines = {r["metric"] for r in audit.run_audit(train, synth, train, test, ["x"], ["c"], vectorizer=vectors).collect()}
    assert {"dcr_mean", "leakage_pct", "mia_auc"} <= lines and len(asked) == 4


@pytest.mark.parametrize("metric", ["euclidean", "chebyshev"])
def test_groups_are_streamed_row_by_row(spark, monkeypatch, metric):
    """Workers get rows, not blocks of them, and partitions follow the rows; groups of any size on either side have all their nearest."""
    from pyspark.sql.classic.dataframe import DataFrame

    monkeypatch.setattr(neighbours, "QUERIES", 30)
    monkeypatch.setattr(neighbours, "DEALT", 100)
    seen, real = [], DataFrame.mapInArrow
    monkeypatch.setattr(DataFrame, "mapInArrow", lambda self, *a, **how: seen.append(self) or real(self, *a, **how))
    rng = np.random.default_rng(11)
    side = lambda n, key: [(int(k), i, r, 1) for i, (k, r) in enumerate(zip(key, rng.normal(0, 1, (n, 3)).tolist()))]
    q, b = side(200, np.where(np.arange(200) < 120, 0, 1 + np.arange(200) % 5)), side(300, np.where(np.arange(300) < 170, 0, 2 + np.arange(300) % 5))
    schema = "key long, id long, v array<double>, copies long"
    got = {}
    for r in neighbours.best_in_groups(spark.createDataFrame(q, schema), spark.createDataFrame(b, schema), "key", 3, metric, block=40).collect():
        got.setdefault(r.id, []).append((r.d, r.hit))
    far = lambda u, v: (np.linalg.norm if metric == "euclidean" else lambda x: np.abs(x).max())(np.subtract(u, v))
    for key, i, u, _ in q:
        want = sorted((far(u, v), j) for k, j, v, _ in b if k == key)[:3]
        assert [(round(d, 9), j) for d, j in sorted(got.get(i, []))[:3]] == [(round(d, 9), j) for d, j in want]
    assert seen[0].rdd.getNumPartitions() >= 5
    seen.clear()
    neighbours.nearest_approximate(table(spark, clustered(1, 50)), table(spark, clustered(2, 400))).collect()
    assert seen and all(not t.startswith("array") or c == "v" for d in seen for c, t in d.dtypes)
