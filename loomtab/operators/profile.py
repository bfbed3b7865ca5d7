"""Profiles of columns: all columns in one job, results in long form."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.stats import correlation
from .domains import kept_table
from .running import exact_quantiles


def number(col: str | Column) -> Column:
    """The value as double; what isn't a number, and NaN, is null."""
    x = (F.col(col) if isinstance(col, str) else col).try_cast("double")
    return F.when(~F.isnan(x), x)


def finite(df: DataFrame, cols: list[str]) -> DataFrame:
    """The rows whose values in ``cols`` are all numbers, neither NaN nor infinite."""
    good = lambda x: F.coalesce(F.abs(x) < F.lit(float("inf")), F.lit(False))
    return df.where(reduce(lambda a, b: a & b, [good(number(c)) for c in cols]))


def long_numbers(df: DataFrame, cols: list[str], keep: list[str] | None = None) -> DataFrame:
    """(keep..., col, x) with the non-null numbers of all columns."""
    keep = keep or []
    picked = df.select(*keep, *[number(c).alias(c) for c in cols])
    return picked.unpivot([F.col(k) for k in keep], cols, "col", "x").where("x IS NOT NULL")


def long_values(df: DataFrame, cols: list[str], keep: list[str] | None = None) -> DataFrame:
    """(keep..., col, value) with the non-null values of all columns as strings."""
    keep = keep or []
    picked = df.select(*keep, *[F.col(c).cast("string").alias(c) for c in cols])
    return picked.unpivot([F.col(k) for k in keep], cols, "col", "value").where("value IS NOT NULL")


def skew_unbiased(x: str = "x") -> Column:
    n = F.count(x).cast("double")
    return F.when(n > 2, F.skewness(x) * F.sqrt(n * (n - 1)) / (n - 2))


def kurtosis_unbiased(x: str = "x") -> Column:
    n = F.count(x).cast("double")
    return F.when(n > 3, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.kurtosis(x) + 6))


def quantiles(rows: DataFrame, by: list[str], exact: bool, *q: float) -> DataFrame:
    """(by..., q): quantiles of x, exact by counted values, or approximate in one pass."""
    if exact:
        return exact_quantiles(rows, by, q)
    return rows.groupBy(*by).agg(F.percentile_approx("x", F.array(*[F.lit(v) for v in q]), 100_000).alias("q"))


def describe_continuous(df: DataFrame, cols: list[str], exact: bool = True) -> DataFrame:
    """count, mean, std, min, quartiles, max, skew, kurtosis, iqr, range, zero_count, zero_ratio per column."""
    rows = long_numbers(df, cols)
    out = rows.groupBy("col").agg(
        F.count("x").alias("count"),
        F.avg("x").alias("mean"),
        F.stddev_samp("x").alias("std"),
        F.min("x").alias("min"),
        F.max("x").alias("max"),
        skew_unbiased().alias("skew"),
        kurtosis_unbiased().alias("kurtosis"),
        F.count_if(F.col("x") == 0).alias("zero_count"),
    )
    out = out.join(F.broadcast(quantiles(rows, ["col"], exact, 0.25, 0.5, 0.75)), "col")
    q = F.col("q")
    return out.select(
        "col", "count", "mean", "std", "min", q[0].alias("q25"), q[1].alias("median"), q[2].alias("q75"), "max", "skew", "kurtosis",
        (q[2] - q[0]).alias("iqr"), (F.col("max") - F.col("min")).alias("range"), "zero_count", (F.col("zero_count") / F.col("count")).alias("zero_ratio"),
    )


def frequencies(df: DataFrame, cols: list[str], keep: list[str] | None = None) -> DataFrame:
    """(keep..., col, value, n, share): the one table that all categorical profiles read."""
    by = [*(keep or []), "col"]
    counts = long_values(df, cols, keep).groupBy(*by, "value").agg(F.count("*").alias("n"))
    return counts.join(counts.groupBy(*by).agg(F.sum("n").alias("_all")), by).select(*by, "value", "n", (F.col("n") / F.col("_all")).alias("share"))


def listed(ranked: DataFrame, top: int, text: Column, name: str) -> DataFrame:
    """(col, name): the first ``top`` texts per column by ``rank``, joined; the rest is cut before anything is gathered."""
    first = ranked.where(F.col("rank") <= top)
    return first.groupBy("col").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", text.alias("t")))), lambda s: s["t"]), ";").alias(name))


def entropy(share: str = "share") -> Column:
    """Shannon entropy in bits of the shares of a group."""
    return F.abs(F.sum(-F.col(share) * F.log2(share)))


def describe_categorical(df: DataFrame, cols: list[str], top: int = 20) -> DataFrame:
    """count, cardinality, mode (ties: smallest), its frequency and share, entropy, top values per column."""
    counted = frequencies(df, cols)
    ranked = counted.withColumn("rank", F.row_number().over(W.partitionBy("col").orderBy(F.desc("n"), "value")))
    stats = counted.groupBy("col").agg(F.sum("n").alias("count"), F.count("*").alias("cardinality"), F.max("n").alias("mode_freq"), F.max("share").alias("mode_pct"), entropy().alias("entropy"))
    mode = ranked.where("rank = 1").select("col", F.col("value").alias("mode"))
    tops = listed(ranked, top, F.concat_ws("=", "value", "n"), "top_values")
    return stats.join(F.broadcast(mode), "col").join(F.broadcast(tops), "col").select("col", "count", "cardinality", "mode", "mode_freq", "mode_pct", "entropy", "top_values")


def class_balance(df: DataFrame, target: str) -> DataFrame:
    """Per class its count and share; with the majority/minority ratio and the entropy of the target."""
    f = frequencies(df, [target])
    whole = f.agg((F.max("n") / F.min("n")).alias("imbalance_ratio"), entropy().alias("entropy"))
    return f.join(F.broadcast(whole)).select("value", "n", "share", "imbalance_ratio", "entropy")


def missing_profile(df: DataFrame, cols: list[str]) -> DataFrame:
    """Nulls and their percentage per column, with the table's totals as column '*'."""
    flags = [F.count_if(F.col(c).isNull()).alias(c) for c in cols]
    wide = df.agg(F.count("*").alias("rows"), *flags)
    each = wide.unpivot(["rows"], cols, "col", "missing")
    total = wide.select("rows", F.lit("*").alias("col"), reduce(lambda a, b: a + b, [F.col(c) for c in cols]).alias("missing"))
    cells = F.when(F.col("col") == "*", F.col("rows") * len(cols)).otherwise(F.col("rows"))
    return each.unionByName(total).select("col", "missing", F.bround(100.0 * F.col("missing") / cells, 4).alias("missing_pct"))


def nullity_correlation(df: DataFrame, cols: list[str]) -> DataFrame:
    """Correlation of the null flags of each pair of columns that have nulls."""
    flag = {c: F.col(c).isNull().cast("double") for c in cols}
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i + 1 :]]
    wide = df.agg(*[correlation(flag[a], flag[b]).alias(f"{a}\t{b}") for a, b in pairs])
    named = wide.unpivot([], [f"`{a}\t{b}`" for a, b in pairs], "pair", "corr").where("corr IS NOT NULL AND NOT isnan(corr)")
    parts = F.split("pair", "\t")
    return named.select(parts[0].alias("col_i"), parts[1].alias("col_j"), "corr")


def duplicates(df: DataFrame, subset: list[str] | None = None) -> DataFrame:
    """Rows beyond the first of each group of equal rows (null equals null), and their percentage."""
    keys = subset or df.columns
    groups = df.groupBy(*keys).agg(F.count("*").alias("n"))
    return groups.agg(F.sum("n").alias("rows"), F.sum(F.col("n") - 1).alias("duplicates"), (100.0 * F.sum(F.col("n") - 1) / F.sum("n")).alias("duplicate_pct"))


def cardinality(df: DataFrame, cols: list[str], rare: float = 0.01, most: int = 20) -> DataFrame:
    """Distinct values and rare ones (share below ``rare``, at most ``most`` of them named) per column."""
    f = frequencies(df, cols)
    is_rare = F.col("share") < rare
    counts = f.groupBy("col").agg(F.count("*").alias("cardinality"), F.count_if(is_rare).alias("rare_count"))
    ranked = f.where(is_rare).withColumn("rank", F.row_number().over(W.partitionBy("col").orderBy("value")))
    return counts.join(F.broadcast(listed(ranked, most, F.col("value"), "rare_values")), "col", "left").na.fill("", ["rare_values"])


def _flagged(df: DataFrame, cols: list[str], bounds: DataFrame) -> DataFrame:
    """Counts of values outside [lower, upper] per column; percentages are of all rows."""
    rows = df.select(F.count("*").alias("rows"))
    x = df.select(*[number(c).alias(c) for c in cols]).unpivot([], cols, "col", "x")
    # one row per column of bounds and one of the row count: as small as the schema
    met = x.join(F.broadcast(bounds), "col")
    counted = met.groupBy("col").agg(F.first("lower").alias("lower"), F.first("upper").alias("upper"), F.count_if((F.col("x") < F.col("lower")) | (F.col("x") > F.col("upper"))).alias("outliers"))
    return counted.join(F.broadcast(rows)).select("col", "lower", "upper", "outliers", (100.0 * F.col("outliers") / F.col("rows")).alias("outlier_pct"))


def iqr_bounds(df: DataFrame, cols: list[str], multiplier: float = 1.5, exact: bool = True) -> DataFrame:
    q = quantiles(long_numbers(df, cols), ["col"], exact, 0.25, 0.75)
    step = multiplier * (F.col("q")[1] - F.col("q")[0])
    return q.select("col", (F.col("q")[0] - step).alias("lower"), (F.col("q")[1] + step).alias("upper"))


def zscore_bounds(df: DataFrame, cols: list[str], threshold: float = 3.0) -> DataFrame:
    s = long_numbers(df, cols).groupBy("col").agg(F.avg("x").alias("m"), F.coalesce(F.stddev_samp("x"), F.lit(0.0)).alias("s"))
    none = F.col("s") == 0
    return s.select("col", F.when(~none, F.col("m") - threshold * F.col("s")).alias("lower"), F.when(~none, F.col("m") + threshold * F.col("s")).alias("upper"))


def mad_bounds(df: DataFrame, cols: list[str], threshold: float = 3.5, exact: bool = True) -> DataFrame:
    x = long_numbers(df, cols)
    if exact:  # values are counted once; both medians go over the counts
        x = kept_table(x.groupBy("col", "x").agg(F.count("*").alias("n")), "value-counts")
    median = lambda rows, by: exact_quantiles(rows, by, (0.5,), weight="n") if exact else quantiles(rows, by, False, 0.5)
    med = median(x, ["col"]).select("col", F.col("q")[0].alias("med"))
    away = x.join(F.broadcast(med), "col").select("col", "med", F.abs(F.col("x") - F.col("med")).alias("x"), *(["n"] if exact else []))
    mad = median(away, ["col", "med"]).select("col", "med", F.col("q")[0].alias("mad"))
    half = F.when(F.col("mad") != 0, threshold * F.col("mad") / 0.6745)
    return mad.select("col", (F.col("med") - half).alias("lower"), (F.col("med") + half).alias("upper"))


def outliers_iqr(df: DataFrame, cols: list[str], multiplier: float = 1.5, exact: bool = True) -> DataFrame:
    return _flagged(df, cols, iqr_bounds(df, cols, multiplier, exact))


def outliers_zscore(df: DataFrame, cols: list[str], threshold: float = 3.0) -> DataFrame:
    return _flagged(df, cols, zscore_bounds(df, cols, threshold))


def outliers_mad(df: DataFrame, cols: list[str], threshold: float = 3.5, exact: bool = True) -> DataFrame:
    return _flagged(df, cols, mad_bounds(df, cols, threshold, exact))


def outlier_mask(df: DataFrame, cols: list[str], bounds: DataFrame) -> DataFrame:
    """``df`` with a boolean <col>_outlier per column; the bounds are one row per column."""
    known = {r["col"]: (r["lower"], r["upper"]) for r in bounds.collect()}
    flags = {}
    for c in cols:
        low, high = known.get(c, (None, None))
        x = number(c)
        flags[f"{c}_outlier"] = F.lit(False) if low is None else F.coalesce((x < low) | (x > high), F.lit(False))
    return df.withColumns(flags)


def strategy_advice(df: DataFrame, continuous: list[str], categorical: list[str], onehot_cap: int = 10) -> DataFrame:
    """Advised scaling and imputation of numbers, and encoding of categories."""
    d = describe_continuous(df, continuous)
    scaling = F.when((F.abs("skew") > 1.5) & (F.col("min") >= 0), "log1p").when(F.col("min") < 0, "standard").otherwise("minmax")
    numbers = d.select("col", scaling.alias("scaling"), F.when(F.abs("skew") > 1, "median").otherwise("mean").alias("imputation"), F.lit(None).cast("string").alias("encoding"))
    kinds = frequencies(df, categorical).groupBy("col").agg(F.count("*").alias("k"))
    return numbers.unionByName(kinds.select("col", F.lit(None).cast("string").alias("scaling"), F.lit("mode").alias("imputation"), F.when(F.col("k") <= onehot_cap, "onehot").otherwise("label").alias("encoding")))


def summary(df: DataFrame) -> DataFrame:
    """Rows, columns, nulls, and columns per type."""
    nulls = reduce(lambda a, b: a + b, [F.count_if(F.col(c).isNull()) for c in df.columns])
    kinds: dict[str, int] = {}
    for _, t in df.dtypes:
        kinds[t] = kinds.get(t, 0) + 1
    told = ";".join(f"{k}={v}" for k, v in sorted(kinds.items()))
    return df.agg(F.count("*").alias("rows"), F.lit(len(df.columns)).alias("columns"), nulls.alias("nulls"), F.lit(told).alias("types"))


def value_share(df: DataFrame, col: str, at_least: float, equal: float) -> DataFrame:
    """Count and share of rows at or above a value, and equal to one."""
    x = number(col)
    n = F.count("*")
    high, same = F.count_if(x >= at_least), F.count_if(x == equal)
    return df.agg(n.alias("rows"), high.alias("at_least"), (high / n).alias("at_least_share"), same.alias("equal"), (same / n).alias("equal_share"))
