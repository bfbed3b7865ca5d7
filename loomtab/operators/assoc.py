"""Association between columns: correlations, contingency measures, information."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.stats import correlation
from .domains import kept_table
from .profile import number
from .running import sums_below

Pairs = list[tuple[str, str]]

#: Pairs of numbers that a task of a count gets.
PAIR_ROWS = 2_000_000


def all_pairs(cols: list[str]) -> Pairs:
    return [(a, b) for i, a in enumerate(cols) for b in cols[i + 1 :]]


def _named(wide: DataFrame, pairs: Pairs, value: str) -> DataFrame:
    parts = F.split("pair", "\t")
    return wide.unpivot([], [f"`{a}\t{b}`" for a, b in pairs], "pair", value).select(parts[0].alias("col_i"), parts[1].alias("col_j"), value)


def pearson(df: DataFrame, pairs: Pairs) -> DataFrame:
    """Correlation on the rows where both are numbers; null for constants."""
    wide = df.agg(*[correlation(number(a), number(b)).alias(f"{a}\t{b}") for a, b in pairs])
    return _named(wide, pairs, "corr").withColumn("corr", F.when(~F.isnan("corr"), F.col("corr")))


def average_ranks(df: DataFrame, by: list[str], value: str, name: str = "rank") -> DataFrame:
    """(by..., value, n, rank): ranks of distinct values with ties averaged.

    Values are counted first, so the running sum goes over distinct values only.
    """
    counts = df.groupBy(*by, value).agg(F.count("*").alias("n"))
    return sums_below(counts, by, value, {"n": "_below"}).withColumn(name, F.col("_below") + (F.col("n") + 1) / 2).drop("_below")


def pair_counts(df: DataFrame, pairs: Pairs) -> DataFrame:
    """(pair, x, y, m): how often two numbers come together in the columns of the pair with that place.

    They are counted within batches first, so that frequent ones aren't one task's; then they meet in as many
    partitions as keep each at about PAIR_ROWS.
    """
    cols = list(dict.fromkeys(c for p in pairs for c in p))
    places = [(cols.index(a), cols.index(b)) for a, b in pairs]

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, (a, b) in enumerate(places):
                both = pa.table([batch.column(a), batch.column(b)], ["x", "y"]).drop_null()
                n = both.group_by(["x", "y"]).aggregate([([], "count_all")]).combine_chunks()
                if n.num_rows:
                    found = [n.column(c).combine_chunks() for c in ("x", "y", "count_all")]
                    yield pa.RecordBatch.from_arrays([pa.array([i] * n.num_rows, pa.int32()), *found], names=["pair", "x", "y", "m"])

    # of both zeros one
    values = df.select(*[(number(c) + 0.0).alias(f"c{i}") for i, c in enumerate(cols)]).mapInArrow(counted, "pair int, x double, y double, m long")
    parts = max(1, -(-df.count() * len(pairs) // PAIR_ROWS))
    return values.repartition(parts, "pair", "x", "y").groupBy("pair", "x", "y").agg(F.sum("m").alias("m"))


def spearman(df: DataFrame, pairs: Pairs) -> DataFrame:
    """Rank correlation on complete pairs, all pairs in one job."""
    rows = kept_table(pair_counts(df, pairs), "pairs")
    ranks = {}
    for v in ("x", "y"):
        counts = rows.groupBy("pair", v).agg(F.sum("m").alias("n"))
        ranked = sums_below(counts, ["pair"], v, {"n": "below"})
        ranks[v] = ranked.select(F.col("pair").alias(f"p{v}"), F.col(v).alias(f"v{v}"), (F.col("below") + (F.col("n") + 1) / 2).alias(f"r{v}"))
    met = rows.join(ranks["x"], (F.col("pair") == F.col("px")) & (F.col("x") == F.col("vx"))).join(ranks["y"], (F.col("pair") == F.col("py")) & (F.col("y") == F.col("vy")))
    m, a, b = F.col("m"), F.col("rx"), F.col("ry")
    s = met.groupBy("pair").agg(F.sum("m").alias("n"), *[F.sum(m * e).alias(k) for k, e in (("a", a), ("b", b), ("aa", a * a), ("bb", b * b), ("ab", a * b))])
    n = F.col("n")
    top = n * F.col("ab") - F.col("a") * F.col("b")
    under = F.sqrt((n * F.col("aa") - F.col("a") ** 2) * (n * F.col("bb") - F.col("b") ** 2))
    name = lambda side: F.get(F.array(*[F.lit(p[side]) for p in pairs]), F.col("pair"))
    return s.select(name(0).alias("col_i"), name(1).alias("col_j"), F.when(under > 0, top / under).alias("spearman"))


def contingency(df: DataFrame, pairs: Pairs) -> DataFrame:
    """(col_i, col_j, a, b, n) counts of all pairs of values, with both marginals and the total, in one job."""
    both = F.explode(F.array(*[F.struct(F.lit(a).alias("col_i"), F.lit(b).alias("col_j"), F.col(a).cast("string").alias("a"), F.col(b).cast("string").alias("b")) for a, b in pairs]))
    cells = df.select(both.alias("p")).select("p.*").where("a IS NOT NULL AND b IS NOT NULL").groupBy("col_i", "col_j", "a", "b").agg(F.count("*").alias("n"))
    by = ["col_i", "col_j"]
    return cells.withColumns({"na": F.sum("n").over(W.partitionBy(*by, "a")), "nb": F.sum("n").over(W.partitionBy(*by, "b")), "total": F.sum("n").over(W.partitionBy(*by))})


def cramers_v(df: DataFrame, pairs: Pairs, yates: bool = False) -> DataFrame:
    """Bias-corrected Cramer's V; with Yates' correction on 2 x 2 tables if asked."""
    c = contingency(df, pairs)
    by = ["col_i", "col_j"]
    n = F.col("total").cast("double")
    base = c.groupBy(*by).agg(
        F.max("total").alias("total"),
        F.sum(F.col("n") / F.col("na") * F.col("n") / F.col("nb")).alias("s"),
        F.countDistinct("a").alias("r"),
        F.countDistinct("b").alias("k"),
        # 2 x 2: all cells have the same distance |n - e| from expectation; any observed one tells it
        F.max(F.abs(F.col("n") - F.col("na") * F.col("nb") / F.col("total"))).alias("gap"),
        F.max("na").alias("ma"),
        F.max("nb").alias("mb"),
    )
    chi2 = F.greatest(n * (F.col("s") - 1), F.lit(0.0))
    if yates:
        left = F.greatest(F.col("gap") - F.least(F.lit(0.5), F.col("gap")), F.lit(0.0))
        e = lambda x, y: x * y / n
        ma, mb = F.col("ma"), F.col("mb")
        inverse = 1 / e(ma, mb) + 1 / e(ma, n - mb) + 1 / e(n - ma, mb) + 1 / e(n - ma, n - mb)
        chi2 = F.when((F.col("r") == 2) & (F.col("k") == 2), left * left * inverse).otherwise(chi2)
    r, k = F.col("r"), F.col("k")
    phi = F.greatest(F.lit(0.0), chi2 / n - (k - 1) * (r - 1) / (n - 1))
    under = F.least(k - (k - 1) ** 2 / (n - 1), r - (r - 1) ** 2 / (n - 1)) - 1
    v = F.when((n <= 1) | (F.least(r, k) == 1) | (under <= 0), 0.0).otherwise(F.sqrt(phi / under))
    return base.select(*by, v.alias("cramers_v"))


def correlation_ratio(df: DataFrame, pairs: Pairs) -> DataFrame:
    """Eta of (category, number) pairs; 0 without variation."""
    both = F.explode(F.array(*[F.struct(F.lit(c).alias("col_i"), F.lit(x).alias("col_j"), F.col(c).cast("string").alias("g"), number(x).alias("x")) for c, x in pairs]))
    rows = df.select(both.alias("p")).select("p.*").where("g IS NOT NULL AND x IS NOT NULL")
    levels = rows.groupBy("col_i", "col_j", "g").agg(F.count("*").alias("n"), F.avg("x").alias("m"), F.var_pop("x").alias("v"))
    w = W.partitionBy("col_i", "col_j")
    centred = levels.withColumn("mean", F.sum(F.col("n") * F.col("m")).over(w) / F.sum("n").over(w))
    s = centred.groupBy("col_i", "col_j").agg(F.sum(F.col("n") * (F.col("m") - F.col("mean")) ** 2).alias("between"), F.sum(F.col("n") * F.col("v")).alias("within"))
    total = F.col("between") + F.col("within")
    return s.select("col_i", "col_j", F.when(total > 0, F.sqrt(F.col("between") / total)).otherwise(0.0).alias("eta"))


def information(df: DataFrame, pairs: Pairs) -> DataFrame:
    """Entropies of both columns and their mutual information, in bits, on complete pairs."""
    c = contingency(df, pairs)
    p, pa, pb = F.col("n") / F.col("total"), F.col("na") / F.col("total"), F.col("nb") / F.col("total")
    return c.groupBy("col_i", "col_j").agg(
        F.greatest(F.sum(p * F.log2(p / (pa * pb))), F.lit(0.0)).alias("mi"),
        F.abs(F.sum(-p * F.log2(pa))).alias("hi"),
        F.abs(F.sum(-p * F.log2(pb))).alias("hj"),
    )


def theils_u(df: DataFrame, pairs: Pairs) -> DataFrame:
    """Symmetric uncertainty 2 MI / (Hx + Hy)."""
    h = F.col("hi") + F.col("hj")
    return information(df, pairs).select("col_i", "col_j", F.when(h > 0, 2 * F.col("mi") / h).otherwise(0.0).alias("theils_u"))


def binned(df: DataFrame, cols: list[str], bins: int = 10) -> DataFrame:
    """``df`` with numbers replaced by equal-width bin numbers (range found in one job)."""
    lows = df.agg(*[F.min(number(c)).alias(f"lo{i}") for i, c in enumerate(cols)], *[F.max(number(c)).alias(f"hi{i}") for i, c in enumerate(cols)]).first()
    out = {}
    for i, c in enumerate(cols):
        lo, hi = lows[f"lo{i}"], lows[f"hi{i}"]
        width = (hi - lo) / bins if lo is not None and hi > lo else None
        out[c] = F.lit(None).cast("long") if lo is None else F.when(number(c).isNotNull(), F.lit(0).cast("long")) if width is None else F.least(F.floor((number(c) - lo) / width), F.lit(bins - 1))
    return df.withColumns(out)


def mutual_information(df: DataFrame, pairs: Pairs, continuous: list[str] | None = None, bins: int = 10) -> DataFrame:
    """Plug-in mutual information in bits; continuous columns are binned, which the output names."""
    cols = continuous or []
    own = binned(df, cols, bins) if cols else df
    mixed = F.col("col_i").isin(cols) | F.col("col_j").isin(cols) if cols else F.lit(False)
    return information(own, pairs).select("col_i", "col_j", "mi", F.when(mixed, F.lit("binned")).otherwise("plug-in").alias("estimator"))


def mi_ranking(df: DataFrame, features: list[str], target: str, continuous: list[str] | None = None, bins: int = 10) -> DataFrame:
    mi = mutual_information(df, [(f, target) for f in features], continuous, bins)
    strength = F.when(F.col("mi") > 0.3, "strong").when(F.col("mi") > 0.15, "medium").otherwise("weak")
    return mi.select(F.col("col_i").alias("feature"), "mi", "estimator", strength.alias("strength"), F.row_number().over(W.orderBy(F.desc("mi"), "col_i")).alias("rank"))


def conditional_mutual_information(df: DataFrame, x: str, y: str, z: str) -> DataFrame:
    """I(X;Y|Z) in bits by plug-in entropies, all four from one pass; under 10 complete rows it is 0."""
    cells = df.select(*[F.col(c).cast("string").alias(k) for c, k in ((x, "x"), (y, "y"), (z, "z"))]).dropna().groupBy("x", "y", "z").agg(F.count("*").alias("n"))
    t = cells
    for keys, name in ((["x", "z"], "xz"), (["y", "z"], "yz"), (["z"], "nz")):
        t = t.join(cells.groupBy(*keys).agg(F.sum("n").alias(name)), keys)
    t = t.join(F.broadcast(cells.agg(F.sum("n").alias("total"))))
    v = F.sum(F.col("n") / F.col("total") * F.log2(F.col("n") * F.col("nz") / (F.col("xz") * F.col("yz"))))
    return t.agg(F.when(F.max("total") >= 10, F.greatest(v, F.lit(0.0))).otherwise(0.0).alias("cmi"))


def correlation_matrix(df: DataFrame, cols: list[str]) -> tuple[np.ndarray, int]:
    """Correlations on complete rows, and how many there are; k x k numbers reach the driver."""
    rows = df.select(*[number(c).alias(c) for c in cols]).dropna()
    pairs = all_pairs(cols)
    got = rows.agg(F.count("*"), *[correlation(F.col(a), F.col(b)) for a, b in pairs]).first()
    m = np.eye(len(cols))
    for (a, b), v in zip(pairs, got[1:]):
        i, j = cols.index(a), cols.index(b)
        m[i, j] = m[j, i] = np.nan if v is None else v
    return m, got[0]


def vif(df: DataFrame, cols: list[str]) -> DataFrame:
    """Variance inflation factor per column: the diagonal of the inverse correlation matrix."""
    spark = df.sparkSession
    m, n = correlation_matrix(df, cols)
    if n < 10 or len(cols) < 2:
        values = [1.0] * len(cols)
    else:
        try:
            values = [float(v) for v in np.diag(np.linalg.inv(np.nan_to_num(m)))]
        except np.linalg.LinAlgError:
            values = [float("inf")] * len(cols)
    return spark.createDataFrame(list(zip(cols, values)), "col string, vif double")


def partial_correlation(df: DataFrame, a: str, b: str, given: list[str]) -> DataFrame:
    m, n = correlation_matrix(df, [a, b, *given])
    value = 0.0
    if n >= 10:
        p = np.linalg.pinv(np.nan_to_num(m))
        value = float(-p[0, 1] / np.sqrt(p[0, 0] * p[1, 1]))
    return df.sparkSession.createDataFrame([(a, b, value)], "col_i string, col_j string, partial_corr double")


def association_matrix(df: DataFrame, continuous: list[str], categorical: list[str]) -> DataFrame:
    """(col_i, col_j, kind, value): Pearson, Cramer's V and eta of all pairs, three batched jobs."""
    parts = []
    if len(continuous) > 1:
        parts.append(pearson(df, all_pairs(continuous)).select("col_i", "col_j", F.lit("pearson").alias("kind"), F.col("corr").alias("value")))
    if len(categorical) > 1:
        parts.append(cramers_v(df, all_pairs(categorical)).select("col_i", "col_j", F.lit("cramers_v").alias("kind"), F.col("cramers_v").alias("value")))
    if continuous and categorical:
        parts.append(correlation_ratio(df, [(c, x) for c in categorical for x in continuous]).select("col_i", "col_j", F.lit("eta").alias("kind"), F.col("eta").alias("value")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def correlation_overlay(real: DataFrame, synth: DataFrame, continuous: list[str], categorical: list[str]) -> DataFrame:
    """Both tables' associations side by side, with the absolute difference."""
    a, b = association_matrix(real, continuous, categorical), association_matrix(synth, continuous, categorical)
    keys = ["col_i", "col_j", "kind"]
    return a.withColumnRenamed("value", "real").join(b.withColumnRenamed("value", "synth"), keys).withColumn("diff", F.abs(F.col("real") - F.col("synth")))


def correlation_difference(real: DataFrame, synth: DataFrame, continuous: list[str], categorical: list[str]) -> DataFrame:
    return correlation_overlay(real, synth, continuous, categorical).agg(F.avg("diff").alias("corr_difference"))
