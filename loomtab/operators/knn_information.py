"""Mutual information of columns with numbers, by nearest neighbours instead of bins.

Two numbers: each row's distance to its k-th neighbour, as the larger of both scaled differences, says
how many values to count around it on each axis.  A number and a category: the distance is to the k-th
neighbour of the same category, and the count goes over all categories.  Two categories: plug-in.

Neighbours of a pair of numbers come from rectangles of about equally many rows: a row meets its own
rectangle, and then those that the square of its distance reaches.  Neighbours within a category, being
on one axis, are found by rank.  Counts are differences of running numbers in ranges of values, so that
no task gathers a column.

Values are scaled by their standard deviation.  ``jitter`` adds noise of that relative size, drawn from
the row's key, which tells apart values that come often, as counts of equal values would say little.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.stats import digamma, normal_quantile
from .assoc import Pairs, information
from .domains import kept_table
from .neighbours import best_in_groups
from .profile import number
from .running import sums_below

#: Rows of a rectangle, and ranges of an axis at most.
CELL_ROWS, MOST_RANGES = 2048, 512
#: A count goes to just short of a row's distance, which its neighbour itself lies at.
SHORT = 1e-12


def _scaled(df: DataFrame, col: str, key: list[str], jitter: float, seed: int) -> Column:
    """``col`` over its standard deviation (1 for constants), with jitter."""
    x = number(col)
    spread, size = df.agg(F.stddev_pop(x), F.avg(F.abs(x))).first()
    spread = spread or 1.0
    out = x / spread
    if jitter:
        u = (F.pmod(F.xxhash64(*key, F.lit(f"{col}-{seed}")), F.lit(1 << 52)) + 0.5) / float(1 << 52)
        out = out + normal_quantile(u) * (jitter * max(1.0, (size or 0.0) / spread))
    return out


# --- the distance to the k-th neighbour ------------------------------------------------------------


def _kth(hits: Column, k: Column) -> Column:
    """Of sorted (d, copies): the distance at which k rows are reached; the largest if there are fewer."""
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0.0).alias("d"))
    step = lambda a, h: F.struct((a["n"] + h["copies"]).alias("n"), F.when(a["n"] < k, h["d"]).otherwise(a["d"]).alias("d"))
    return F.aggregate(hits, start, step)["d"]


def _rectangles(points: DataFrame, rows: int) -> tuple[list[float], list[list[float]]]:
    """Edges on the first axis, and for each of its ranges the edges on the second: at most MOST_RANGES squared numbers."""
    ranges = max(1, min(math.ceil(math.sqrt(rows / CELL_ROWS)), MOST_RANGES))
    if ranges == 1:
        return [], [[]]
    fractions = F.lit([i / ranges for i in range(1, ranges)])
    x, y = (F.col("v")[i] for i in (0, 1))
    first = sorted(set(points.agg(F.percentile_approx(x, fractions, 20 * ranges)).first()[0]))
    slab = F.size(F.filter(F.lit(first), lambda e: e <= x))
    found = {r["s"]: sorted(set(r["e"])) for r in points.groupBy(slab.alias("s")).agg(F.percentile_approx(y, fractions, 20 * ranges).alias("e")).collect()}
    return first, [found.get(s, []) for s in range(len(first) + 1)]


def _in_rectangles(points: DataFrame, first: list[float], second: list[list[float]]) -> DataFrame:
    xs, ys = np.array(first), [np.array(e) for e in second]
    base = np.concatenate([[0], np.cumsum([len(e) + 1 for e in ys])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = batch.column(1).flatten().to_numpy().reshape(-1, 2)
            slab = np.searchsorted(xs, v[:, 0], "right")
            cell = np.zeros(len(v), np.int64)
            for s in np.unique(slab):
                at = slab == s
                cell[at] = base[s] + np.searchsorted(ys[s], v[at, 1], "right")
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell)], ["id", "v", "copies", "cell"])

    return points.mapInArrow(run, "id long, v array<double>, copies long, cell long")


def _reached(points: DataFrame, first: list[float], second: list[list[float]]) -> DataFrame:
    """(id, v, copies, cell): the other rectangles that a point's square, of half width ``r``, touches."""
    xs, ys = np.array(first), [np.array(e) for e in second]
    base = np.concatenate([[0], np.cumsum([len(e) + 1 for e in ys])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = batch.column(1).flatten().to_numpy().reshape(-1, 2)
            home, r = batch.column(3).to_numpy(), batch.column(4).to_numpy(zero_copy_only=False).astype(float)
            r = np.where(np.isnan(r), np.inf, r)
            left, right = np.searchsorted(xs, v[:, 0] - r, "left"), np.searchsorted(xs, v[:, 0] + r, "right")
            rows, cells = [], []
            for s in range(len(ys)):
                at = np.flatnonzero((left <= s) & (s <= right))
                low, high = np.searchsorted(ys[s], v[at, 1] - r[at], "left"), np.searchsorted(ys[s], v[at, 1] + r[at], "right")
                n = high - low + 1
                row = np.repeat(at, n)
                cell = base[s] + np.repeat(low, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                rows.append(row), cells.append(cell)
            row, cell = np.concatenate(rows), np.concatenate(cells)
            away = cell != home[row]
            take = pa.array(row[away])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), batch.column(2).take(take), pa.array(cell[away])], ["id", "v", "copies", "cell"])

    return points.select("id", "v", "copies", "cell", "r").mapInArrow(run, "id long, v array<double>, copies long, cell long")


def pair_gaps(rows: DataFrame, k: int) -> DataFrame:
    """(x, y, copies, r) of distinct points: the distance, as the larger difference of both axes, to the k-th other row."""
    points = rows.groupBy("x", "y").agg(F.count("*").alias("copies")).select(F.monotonically_increasing_id().alias("id"), F.array("x", "y").alias("v"), "copies")
    points = kept_table(points, "points")
    first, second = _rectangles(points, points.count())
    placed = kept_table(_in_rectangles(points, first, second), "placed")
    own = kept_table(best_in_groups(placed, placed, "cell", k + 1, "chebyshev"), "own-cells")
    listed = lambda near: near.groupBy("id").agg(F.sort_array(F.collect_set(F.struct("d", "hit", "copies"))).alias("h"))
    # a point is its own first hit, so the k-th other row is the one after
    reach = listed(own).select("id", F.when(F.aggregate("h", F.lit(0).cast("long"), lambda a, h: a + h["copies"]) > k, _kth(F.col("h"), F.lit(k + 1))).alias("r"))
    away = kept_table(_reached(placed.join(reach, "id"), first, second), "reached")
    near = own.unionByName(best_in_groups(away, placed, "cell", k + 1, "chebyshev"))
    found = listed(near).select("id", _kth(F.col("h"), F.lit(k + 1)).alias("r"))
    return points.join(found, "id").select(F.col("v")[0].alias("x"), F.col("v")[1].alias("y"), "copies", "r")


def class_gaps(rows: DataFrame, k: int) -> DataFrame:
    """(g, x, copies, kk, size, r) of a category's distinct values: the distance to the k-th (kk-th, in small categories) other row of it."""
    counts = kept_table(rows.groupBy("g", "x").agg(F.count("*").alias("copies"), F.lit(1).alias("one")), "class-values")
    placed = kept_table(sums_below(counts, ["g"], "x", {"one": "at"}), "ranked-values")
    offsets = F.explode(F.array(*[F.lit(i) for i in range(-k, k + 1)]))
    asked = placed.select("g", "x", "at", offsets.alias("o")).withColumn("to", F.col("at") + F.col("o"))
    there = placed.select(F.col("g").alias("g2"), F.col("at").alias("to2"), F.col("x").alias("x2"), "copies")
    met = asked.join(there, (F.col("g") == F.col("g2")) & (F.col("to") == F.col("to2")))
    # at most 2 k + 1 values
    hits = met.groupBy("g", "x").agg(F.sort_array(F.collect_list(F.struct(F.abs(F.col("x2") - F.col("x")).alias("d"), "copies"))).alias("h"))
    sizes = counts.groupBy("g").agg(F.sum("copies").alias("size")).where("size > 1")
    found = hits.join(placed.select("g", "x", "copies"), ["g", "x"]).join(F.broadcast(sizes) if sizes.count() <= 100_000 else sizes, "g")
    found = found.withColumn("kk", F.least(F.lit(k), F.col("size") - 1))
    return found.select("g", "x", "copies", "kk", "size", _kth(F.col("h"), F.col("kk") + 1).alias("r"))


def counted_around(rows: DataFrame, centres: DataFrame, value: str, name: str) -> DataFrame:
    """``centres`` with the number of ``rows`` whose ``value`` lies nearer than r to theirs; those with an equal value always count."""
    short = F.col("r") - SHORT * (F.abs(value) + F.col("r"))
    asked = kept_table(centres.withColumn("_lo", F.col(value) - short).withColumn("_hi", F.col(value) + short), "centres")
    held = rows.groupBy(F.col(value).alias("v")).agg(F.count("*").alias("n"))
    marks = held.unionByName(asked.select(F.explode(F.array("_lo", "_hi")).alias("v"), F.lit(0).cast("long").alias("n"))).groupBy("v").agg(F.sum("n").alias("n"))
    below = kept_table(sums_below(marks, [], "v", {"n": "below"}), "below")
    at = lambda c: below.select(F.col("v").alias(f"{c}v"), F.col("below").alias(f"{c}n"), F.col("n").alias(f"{c}c"))
    lo, hi, own = at("l"), at("h"), at("o")
    met = asked.join(lo, F.col("_lo") == F.col("lv")).join(hi, F.col("_hi") == F.col("hv")).join(own, F.col(value) == F.col("ov"))
    return met.select(*centres.columns, F.greatest(F.col("hn") - F.col("ln"), F.col("oc")).alias(name))


# --- the estimates ---------------------------------------------------------------------------------


def two_numbers(rows: DataFrame, k: int = 3) -> DataFrame:
    """One row, mi in bits, from rows (x, y)."""
    rows = kept_table(rows, "pairs")
    gaps = counted_around(rows, counted_around(rows, pair_gaps(rows, k), "x", "cx"), "y", "cy")
    mean = lambda c: F.sum(F.col("copies") * digamma(F.col(c))) / F.sum("copies")
    n = F.sum("copies")
    value = digamma(n.cast("double")) + digamma(F.lit(float(k))) - mean("cx") - mean("cy")
    return gaps.agg(F.when(n > k, F.greatest(value / math.log(2), F.lit(0.0))).otherwise(0.0).alias("mi"))


def number_and_category(rows: DataFrame, k: int = 3) -> DataFrame:
    """One row, mi in bits, from rows (g, x); categories of one row are left out."""
    rows = kept_table(rows, "classed")
    several = kept_table(rows.groupBy("g").agg(F.count("*").alias("n")).where("n > 1").select("g"), "several")
    rows = rows.join(several, "g", "left_semi")
    gaps = counted_around(rows, class_gaps(rows, k), "x", "m")
    mean = lambda c: F.sum(F.col("copies") * digamma(F.col(c))) / F.sum("copies")
    value = digamma(F.sum("copies").cast("double")) + mean("kk") - mean("size") - mean("m")
    return gaps.agg(F.when(F.count_distinct("g") > 1, F.greatest(value / math.log(2), F.lit(0.0))).otherwise(0.0).alias("mi"))


def neighbour_information(df: DataFrame, pairs: Pairs, continuous: list[str], key: list[str], k: int = 3, jitter: float = 1e-10, seed: int = 42) -> DataFrame:
    """(col_i, col_j, mi, estimator) in bits on complete pairs; ``key`` names columns that tell rows apart, for the jitter."""
    out = None
    for a, b in pairs:
        kinds = [c in continuous for c in (a, b)]
        if not any(kinds):
            one, how = information(df, [(a, b)]).select("mi"), "plug-in"
        elif all(kinds):
            full = df.where(number(a).isNotNull() & number(b).isNotNull())
            one, how = two_numbers(full.select(_scaled(full, a, key, jitter, seed).alias("x"), _scaled(full, b, key, jitter, seed).alias("y")), k), "neighbours"
        else:
            x, g = (a, b) if kinds[0] else (b, a)
            full = df.where(number(x).isNotNull() & F.col(g).isNotNull())
            one, how = number_and_category(full.select(F.col(g).cast("string").alias("g"), _scaled(full, x, key, jitter, seed).alias("x")), k), "neighbours"
        one = one.select(F.lit(a).alias("col_i"), F.lit(b).alias("col_j"), "mi", F.lit(how).alias("estimator"))
        out = one if out is None else out.unionByName(one)
    return out
