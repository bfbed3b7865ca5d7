"""Synthesis: a Gaussian copula with empirical margins, conditional draws and noisy margins."""

from __future__ import annotations

import math
import warnings
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.stats import normal_distributions, normal_quantiles
from ..sources.spec import DatasetSpec
from .domains import dictionary, drawn, kept_table, looked_up
from .profile import frequencies, long_numbers, number
from .rules import Rule, audit_and_correct, clamp_correction
from .running import exact_quantiles

KNOTS = 201
_MOMENTS = ("n", "a", "b", "aa", "bb", "ab")


def _floats(x: pa.Array) -> np.ndarray:
    """Numbers as doubles, NaN for null."""
    return x.cast(pa.float64()).to_numpy(zero_copy_only=False)


def _uniform(salt: int, seed: int, key: str = "row_id") -> Column:
    """A draw in (0, 1) that depends on the row's id only."""
    return (F.pmod(F.xxhash64(F.col(key), F.lit(seed), F.lit(salt)), F.lit(1 << 52)) + 0.5) / float(1 << 52)


@dataclass
class Copula:
    """Margins as quantile and share tables, dependence as correlations of normal scores.

    What the driver holds is as small as the schema: KNOTS numbers per continuous column, the
    categories, and a k x k matrix.  Columns of more than ``large`` categories keep theirs in a table
    (see ``domains``), whose shares drawn numbers meet in an interval join.
    """

    continuous: list[str]
    categorical: list[str]
    exact: bool = True
    quantiles: dict[str, list[float]] = field(default_factory=dict)
    shares: dict[str, list[tuple[str, float]]] = field(default_factory=dict)
    missing: dict[str, float] = field(default_factory=dict)
    factor: np.ndarray | None = None
    integers: set[str] = field(default_factory=set)
    large: int = 10_000
    entries: DataFrame | None = None
    big: list[str] = field(default_factory=list)

    def fit(self, df: DataFrame) -> Copula:
        probs = F.array(*[F.lit(i / (KNOTS - 1)) for i in range(KNOTS)])
        cols = [*self.continuous, *self.categorical]
        got = df.agg(F.count("*"), *[F.avg(self.absent(c).cast("double")) for c in cols]).first()[1:]
        self.missing = {c: v or 0.0 for c, v in zip(cols, got)}
        if self.exact:
            # counted once, as the quantiles need the counts several times
            counts = kept_table(long_numbers(df, self.continuous).groupBy("col", "x").agg(F.count("*").alias("n")), "counts") if self.continuous else None
            q = exact_quantiles(counts, ["col"], tuple(i / (KNOTS - 1) for i in range(KNOTS)), weight="n") if counts is not None else None
            found = {r["col"]: r["q"] for r in q.collect()} if q else {}  # KNOTS numbers for each column
        else:
            found = dict(zip(self.continuous, df.agg(F.count("*"), *[F.percentile_approx(number(c), probs, 100_000) for c in self.continuous]).first()[1:]))
        self.quantiles = {c: [float(v) for v in found[c]] if found.get(c) else [0.0] for c in self.continuous}
        self.integers = {c for c, t in df.dtypes if c in self.continuous and t in ("tinyint", "smallint", "int", "bigint")}
        if self.categorical:
            f = kept_table(frequencies(df, self.categorical), "frequencies")
            self.big = [r["col"] for r in f.groupBy("col").count().where(F.col("count") > self.large).collect()]
            found: dict[str, list[tuple[str, float]]] = {c: [] for c in self.categorical if c not in self.big}
            for r in f.where(~F.col("col").isin(self.big)).collect():  # at most ``large`` categories of each column
                found[r["col"]].append((r["value"], r["share"]))
            self.shares = {c: sorted(v, key=lambda x: (-x[1], x[0])) for c, v in found.items()}
            self.entries = dictionary(f.where(F.col("col").isin(self.big))) if self.big else None
        self.factor = self._correlation(df)
        return self

    def scored(self, c: str, batch: pa.RecordBatch) -> np.ndarray:
        """Normal scores of a column: by places among the quantiles, or of the categories' middles; NaN where it has no value."""
        if c in self.quantiles:
            x, knots = _floats(batch.column(c)), np.array(self.quantiles[c])
            u = (np.searchsorted(knots, x, "left") + np.searchsorted(knots, x, "right")) / (2.0 * len(knots))
            return np.where(np.isnan(x), np.nan, normal_quantiles(np.clip(u, 0.5 / KNOTS, 1 - 0.5 / KNOTS)))
        if c in self.big:
            return normal_quantiles(np.clip(_floats(batch.column(c)), 1e-6, 1 - 1e-6))
        shares = np.array([share for _, share in self.shares[c]] or [0.0])
        middles = normal_quantiles(np.clip(np.cumsum(shares) - shares / 2, 1e-6, 1 - 1e-6))
        at = pc.index_in(batch.column(c), pa.array([v for v, _ in self.shares[c]], pa.string()))
        found = middles[at.fill_null(0).to_numpy(zero_copy_only=False)]
        return np.where(np.isnan(_floats(at)), np.nan, found)

    def absent(self, c: str) -> Column:
        return number(c).isNull() if c in self.continuous else F.col(c).isNull()

    def holed(self) -> list[str]:
        """Columns with nulls: whether a value is missing is a variable of its own, dependent on the others."""
        return [c for c in [*self.continuous, *self.categorical] if self.missing[c] > 0]

    def _correlation(self, df: DataFrame) -> np.ndarray:
        kept, holed = [*self.continuous, *self.categorical], self.holed()
        k = len(kept) + len(holed)
        for c in self.big:
            middles = self.entries.where(F.col("col") == c).withColumn("middle", (F.col("low") + F.col("n") / 2) / F.col("all"))
            df = looked_up(df.withColumn(c, F.col(c).cast("string")), middles, c, "value", "middle", f"_{c}_middle")
        own = [(number(c) if c in self.continuous else F.col(f"`_{c}_middle`") if c in self.big else F.col(c).cast("string")).alias(c) for c in kept]
        model = replace(self, entries=None)  # what tasks need, without the table

        def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """Per pair of variables: rows that have both, and sums of the scores, their squares and products over these."""
            sums = np.zeros((6, k, k))
            for batch in batches:
                scores = [model.scored(c, batch) for c in kept]
                for c in holed:
                    m = model.missing[c]
                    gone, here = normal_quantiles(np.clip(np.array([m / 2, (1 + m) / 2]), 1e-6, 1 - 1e-6))
                    scores.append(np.where(batch.column(c).is_null().to_numpy(zero_copy_only=False), gone, here))
                z = np.column_stack(scores)
                had = (~np.isnan(z)).astype(float)
                z = np.nan_to_num(z)
                sums += np.stack([had.T @ had, z.T @ had, had.T @ z, (z * z).T @ had, had.T @ (z * z), z.T @ z])
            i, j = np.tril_indices(k, -1)
            yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), *[pa.array(s[i, j]) for s in sums]], names=["i", "j", *_MOMENTS])

        m = np.eye(k)
        if k > 1:
            parts = df.select(*own).mapInArrow(moments, "i long, j long, " + ", ".join(f"{s} double" for s in _MOMENTS))
            for r in parts.groupBy("i", "j").agg(*[F.sum(s).alias(s) for s in _MOMENTS]).collect():  # one row for each pair
                if r["n"]:
                    a, b, aa, bb, ab = (r[s] / r["n"] for s in _MOMENTS[1:])
                    va, vb = aa - a * a, bb - b * b
                    # scores are about 1 in size; below this a variance is what rounding leaves of a constant
                    m[r["i"], r["j"]] = m[r["j"], r["i"]] = (ab - a * b) / math.sqrt(va * vb) if va > 1e-12 * aa and vb > 1e-12 * bb else 0.0
        values, vectors = np.linalg.eigh(m)
        fixed = (vectors * np.maximum(values, 1e-6)) @ vectors.T
        scale = np.sqrt(np.diag(fixed))
        return np.linalg.cholesky(fixed / np.outer(scale, scale))

    def sample(self, spark, n: int, seed: int = 42) -> DataFrame:
        """n rows, each from its own id: the same rows however they are partitioned."""
        cols, holed = [*self.continuous, *self.categorical], self.holed()
        k = len(cols) + len(holed)
        model = replace(self, entries=None)  # what tasks need, without the table
        kinds = {c: "double" if c in self.big else "string" if c in self.categorical else "bigint" if c in self.integers else "double" for c in cols}

        def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                scores = [normal_quantiles(batch.column(i + 1).to_numpy()) for i in range(k)]
                shares = [normal_distributions(sum((scores[j] * model.factor[i, j] for j in range(i + 1)), np.zeros(batch.num_rows))) for i in range(k)]
                gone = {c: pa.array(shares[i] < model.missing[c]) for i, c in enumerate(holed, len(cols))}
                out = [pa.array(shares[i]) if c in model.big else model.valued(c, shares[i]) for i, c in enumerate(cols)]
                out = [pc.if_else(gone[c], pa.scalar(None, v.type), v) if c in gone and c not in model.big else v for c, v in zip(cols, out)]
                flags = [gone[c] for c in holed if c in model.big]
                yield pa.RecordBatch.from_arrays([batch.column(0), *out, *flags], names=names)

        flags = [f"_{c}_gone" for c in holed if c in self.big]
        names = ["row_id", *[f"_{c}_share" if c in self.big else c for c in cols], *flags]
        kind = ["bigint", *[kinds[c] for c in cols], *["boolean"] * len(flags)]
        base = spark.range(n).select(F.col("id").alias("row_id"), *[_uniform(i, seed, "id").alias(f"v{i}") for i in range(k)])
        base = base.mapInArrow(draw, ", ".join(f"`{a}` {t}" for a, t in zip(names, kind)))
        for c in cols:
            if c in self.big:
                base = drawn(base, self.entries.where(F.col("col") == c), f"_{c}_share", f"_{c}_drawn")
        value = lambda c: F.col(f"`{c}`") if c not in self.big else F.when(~F.col(f"`_{c}_gone`"), F.col(f"`_{c}_drawn`")) if c in holed else F.col(f"`_{c}_drawn`")
        return base.select("row_id", *[value(c).alias(c) for c in cols])

    def valued(self, c: str, u: np.ndarray) -> pa.Array:
        """The column's values at places ``u``, from 0 to 1, of its margin."""
        if c in self.quantiles:
            knots = np.array(self.quantiles[c])
            last = len(knots) - 1
            at = u * last
            below = np.minimum(np.floor(at), max(last - 1, 0)).astype(int)
            lo, hi = knots[below], knots[np.minimum(below + 1, last)]
            x = lo + (hi - lo) * (at - below)
            return pa.array(np.rint(x).astype(np.int64) if c in self.integers else x)
        if not self.shares[c]:
            return pa.nulls(len(u), pa.string())
        ends = np.cumsum([share for _, share in self.shares[c]])
        at = np.minimum(np.searchsorted(ends, u, "right"), len(ends) - 1)
        return pa.array([v for v, _ in self.shares[c]], pa.string()).take(pa.array(at))


def synthesize(df: DataFrame, n: int, continuous: list[str], categorical: list[str], seed: int = 42, condition: tuple[str, str] | None = None, exact: bool = True) -> DataFrame:
    """n synthetic rows; with a condition (column, value) those of the rows that meet it.

    An unknown column or a value that no row has is a warning, and the draw is unconditional.
    """
    source = df
    if condition:
        col, value = condition
        met = df.where(F.col(col).cast("string") == value) if col in df.columns else None
        if met is None or not met.limit(1).count():
            warnings.warn(f"no row has {col} = {value}; drawing without a condition", stacklevel=2)
        else:
            source = met
    return Copula(continuous, categorical, exact).fit(source).sample(df.sparkSession, n, seed)


def synthesize_corrected(df: DataFrame, n: int, spec: DatasetSpec, rule_list: list[Rule], seed: int = 42) -> DataFrame:
    """n synthetic rows that keep the rules and the declared bounds and domains: drawn, clamped to the rules, then to the bounds."""
    drawn = synthesize(df, n, spec.continuous, spec.categorical, seed)
    return audit_and_correct(clamp_correction(drawn, rule_list), spec)


def synthesize_folds(df: DataFrame, fold: str, folds: int, continuous: list[str], categorical: list[str], seed: int = 42) -> DataFrame:
    """Per fold, as many synthetic rows as the fold's training part has, fitted on that part."""
    sizes = {r[fold]: r["n"] for r in df.groupBy(fold).agg(F.count("*").alias("n")).collect()}
    out = None
    for k in range(folds):
        train = df.where(F.col(fold) != k)
        part = synthesize(train, sum(sizes.values()) - sizes.get(k, 0), continuous, categorical, seed + k).withColumn(fold, F.lit(k))
        out = part if out is None else out.unionByName(part)
    return out


def noise_scale(epsilon: float, delta: float, sensitivity: float = 1.0) -> float:
    """Standard deviation of the Gaussian mechanism, for epsilon up to 1."""
    if not 0 < epsilon <= 1:
        raise ValueError("epsilon must be in (0, 1]")
    return sensitivity * math.sqrt(2 * math.log(1.25 / delta)) / epsilon


def noisy_marginals(df: DataFrame, domains: dict[str, list[str]], epsilon: float = 1.0, delta: float = 1e-6, seed: int | None = None) -> DataFrame:
    """Differentially private counts of each column over its public domain, clipped at 0, with shares.

    The budget is split evenly over the columns and reported with each count.
    """
    each = epsilon / len(domains)
    sigma = noise_scale(each, delta / len(domains))
    spark = df.sparkSession
    grid = spark.createDataFrame([(c, v) for c, values in domains.items() for v in values], "col string, value string")
    counts = frequencies(df, list(domains)).select("col", "value", "n")
    noise = F.randn(seed) if seed is not None else F.randn()
    noisy = grid.join(counts, ["col", "value"], "left").select("col", "value", F.greatest(F.coalesce("n", F.lit(0)) + sigma * noise, F.lit(0.0)).alias("noisy_count"))
    from pyspark.sql import Window as W

    total = F.sum("noisy_count").over(W.partitionBy("col"))
    return noisy.select("col", "value", "noisy_count", F.when(total > 0, F.col("noisy_count") / total).otherwise(0.0).alias("share"), F.lit(each).alias("epsilon"), F.lit(delta / len(domains)).alias("delta"), F.lit(sigma).alias("sigma"))


# --- noisy tables that feed draws -------------------------------------------------------------------


@dataclass
class NoisyTree:
    """Rows drawn from noisy tables only: pair tables, a tree of the strongest pairs, draws down the tree.

    ``domains`` are the public categories of each column; numbers are binned between public ``bounds``.
    Each pair of columns is released once, as counts of its whole domain with Gaussian noise; the budget
    is split evenly over the pairs.  Everything after that reads the released tables and costs no budget:
    clipping at 0, the information between the two columns of a pair, the maximum spanning tree by it, and
    each column's shares given its parent's value.  What the driver holds are tables over public domains.
    """

    domains: dict[str, list[str]]
    bounds: dict[str, tuple[float, float]] = field(default_factory=dict)
    bins: int = 16
    epsilon: float = 1.0
    delta: float = 1e-6
    seed: int | None = None
    released: DataFrame | None = None
    tree: list[tuple[str | None, str]] = field(default_factory=list)
    tables: dict[tuple[str, str], np.ndarray] = field(default_factory=dict)

    @property
    def columns(self) -> list[str]:
        return [*self.domains, *self.bounds]

    def values(self, c: str) -> list[str]:
        return self.domains[c] if c in self.domains else [str(i) for i in range(self.bins)]

    def category(self, c: str) -> Column:
        """A column's value as a category of its public domain; values outside a number's bounds count at its ends, others not at all."""
        if c in self.domains:
            return F.col(c).cast("string")
        lo, hi = self.bounds[c]
        at = F.floor((number(c) - lo) / ((hi - lo) / self.bins))
        return F.least(F.greatest(at, F.lit(0)), F.lit(self.bins - 1)).cast("string")

    def pairs(self) -> list[tuple[str, str]]:
        return [(a, b) for i, a in enumerate(self.columns) for b in self.columns[i + 1 :]]

    def budget(self) -> tuple[float, float]:
        """Epsilon and delta of each released table; their sums over all pairs are the whole."""
        n = len(self.pairs())
        return self.epsilon / n, self.delta / n

    def fit(self, df: DataFrame) -> NoisyTree:
        if len(self.columns) < 2:
            raise ValueError("pairs need two columns at least")
        epsilon, delta = self.budget()
        sigma = noise_scale(epsilon, delta)
        spark = df.sparkSession
        coded = df.select(*[self.category(c).alias(f"c{i}") for i, c in enumerate(self.columns)])
        place = {c: i for i, c in enumerate(self.columns)}
        both = F.explode(F.array(*[F.struct(F.lit(a).alias("col_i"), F.lit(b).alias("col_j"), F.col(f"c{place[a]}").alias("a"), F.col(f"c{place[b]}").alias("b")) for a, b in self.pairs()]))
        counts = coded.select(both.alias("p")).select("p.*").groupBy("col_i", "col_j", "a", "b").agg(F.count("*").alias("n"))
        # every cell of the public domain gets noise, whether a row has it or not
        sides = spark.createDataFrame([(c, self.values(c)) for c in self.columns], "col string, value array<string>")
        named = spark.createDataFrame(self.pairs(), "col_i string, col_j string")
        grid = named.join(F.broadcast(sides.select(F.col("col").alias("col_i"), F.explode("value").alias("a"))), "col_i").join(F.broadcast(sides.select(F.col("col").alias("col_j"), F.explode("value").alias("b"))), "col_j")
        noise = F.randn(self.seed) if self.seed is not None else F.randn()
        noisy = grid.join(counts, ["col_i", "col_j", "a", "b"], "left").select("col_i", "col_j", "a", "b", F.greatest(F.coalesce("n", F.lit(0)) + sigma * noise, F.lit(0.0)).alias("noisy_count"))
        # written once: a second draw of noise over the same counts would spend the budget again
        self.released = kept_table(noisy.withColumns({"epsilon": F.lit(epsilon), "delta": F.lit(delta), "sigma": F.lit(sigma)}), "noisy-pairs")
        spots = {c: {v: i for i, v in enumerate(self.values(c))} for c in self.columns}
        self.tables = {(a, b): np.zeros((len(spots[a]), len(spots[b]))) for a, b in self.pairs()}
        for r in self.released.collect():  # the public domain's cells
            self.tables[r["col_i"], r["col_j"]][spots[r["col_i"]][r["a"]], spots[r["col_j"]][r["b"]]] = r["noisy_count"]
        self.tree = self._spanning()
        return self

    def table(self, a: str, b: str) -> np.ndarray:
        return self.tables[a, b] if (a, b) in self.tables else self.tables[b, a].T

    def information(self, a: str, b: str) -> float:
        """Bits that a released table says its columns tell of each other."""
        t = self.table(a, b)
        if t.sum() <= 0:
            return 0.0
        p = t / t.sum()
        free = p.sum(1, keepdims=True) * p.sum(0, keepdims=True)
        told = p > 0
        return float((p[told] * np.log2(p[told] / free[told])).sum())

    def _spanning(self) -> list[tuple[str | None, str]]:
        """(parent, column) from the first column on, each next by the strongest pair with one that is there."""
        out, left = [(None, self.columns[0])], self.columns[1:]
        while left:
            a, b = max(((a, b) for _, a in out for b in left), key=lambda p: self.information(*p))
            out.append((a, b))
            left.remove(b)
        return out

    @staticmethod
    def _cumulative(counts: np.ndarray) -> list[float]:
        total = counts.sum()
        shares = counts / total if total > 0 else np.full(len(counts), 1 / len(counts))
        return np.cumsum(shares).tolist()

    def sample(self, spark, n: int, seed: int = 42) -> DataFrame:
        """n rows, each from its own id: a root's value by its shares, then each column's given its parent's value."""
        df = spark.range(n).select(F.col("id").alias("row_id"))
        for k, (parent, c) in enumerate(self.tree):
            u = _uniform(k, seed)
            if parent is None:
                other = self.tree[1][1]
                ends = F.lit(self._cumulative(self.table(c, other).sum(1)))
            else:
                rows = [self._cumulative(r) for r in self.table(parent, c)]
                # one short list for each of the parent's public values
                ends = F.get(F.array(*[F.lit(r) for r in rows]), F.col(f"_{parent}"))
            last = len(self.values(c)) - 1
            df = df.withColumn(f"_{c}", F.least(F.size(F.filter(ends, lambda e: e <= u)), F.lit(last)))
        out = []
        for k, c in enumerate(self.columns):
            if c in self.domains:
                out.append(F.get(F.lit(self.domains[c]), F.col(f"_{c}")).alias(c))
            else:
                lo, hi = self.bounds[c]
                out.append((lo + (F.col(f"_{c}") + _uniform(1000 + k, seed)) * ((hi - lo) / self.bins)).alias(c))
        return df.select("row_id", *out)

    def distances(self, real: DataFrame, drawn: DataFrame) -> DataFrame:
        """(col_i, col_j, parent_of, epsilon, delta, distance): per pair, half the summed differences of the shares of real and drawn rows.

        ``parent_of``: the tree's edge, if the pair is one.  Reads the real rows, so it is a report for who may see them.
        """
        def shares(df: DataFrame, name: str) -> DataFrame:
            coded = df.select(*[self.category(c).alias(f"c{i}") for i, c in enumerate(self.columns)])
            place = {c: i for i, c in enumerate(self.columns)}
            both = F.explode(F.array(*[F.struct(F.lit(a).alias("col_i"), F.lit(b).alias("col_j"), F.col(f"c{place[a]}").alias("a"), F.col(f"c{place[b]}").alias("b")) for a, b in self.pairs()]))
            counts = coded.select(both.alias("p")).select("p.*").groupBy("col_i", "col_j", "a", "b").agg(F.count("*").alias("n"))
            totals = counts.groupBy("col_i", "col_j").agg(F.sum("n").alias("all"))
            return counts.join(F.broadcast(totals), ["col_i", "col_j"]).select("col_i", "col_j", "a", "b", (F.col("n") / F.col("all")).alias(name))

        met = shares(real, "p").join(shares(drawn, "q"), ["col_i", "col_j", "a", "b"], "full")
        gaps = met.groupBy("col_i", "col_j").agg((F.sum(F.abs(F.coalesce("p", F.lit(0.0)) - F.coalesce("q", F.lit(0.0)))) / 2).alias("distance"))
        edges = real.sparkSession.createDataFrame([(*((p, c) if (p, c) in self.tables else (c, p)), f"{p}>{c}") for p, c in self.tree if p], "col_i string, col_j string, parent_of string")
        epsilon, delta = self.budget()
        return gaps.join(F.broadcast(edges), ["col_i", "col_j"], "left").select("col_i", "col_j", "parent_of", F.lit(epsilon).alias("epsilon"), F.lit(delta).alias("delta"), "distance")
