"""Distances between two tables' columns, and hypothesis tests.

Every operator takes both tables; they are united under ``src`` ('real' and 'synth') and all columns
go through one job.  Running sums go over distinct values, never over rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.stats import chi2_p, ks_p
from .domains import kept_table
from .profile import frequencies, long_numbers, number, skew_unbiased  # noqa: F401
from .running import in_ranges, sums_below


def united(real: DataFrame, synth: DataFrame) -> DataFrame:
    return real.withColumn("src", F.lit("real")).unionByName(synth.withColumn("src", F.lit("synth")), allowMissingColumns=True)


def ecdf_gaps(real: DataFrame, synth: DataFrame, cols: list[str]) -> DataFrame:
    """(col, x, nr, ns, gap, next): both distribution functions' difference at each distinct value.

    A first sum per range of values keeps the running sum from gathering a whole column in one task.  The counts are
    written, as three steps need them and tables may be dear to make.
    """
    rows = long_numbers(united(real, synth), cols, ["src"])
    return gaps(kept_table(rows.groupBy("col", "x").agg(F.count_if(F.col("src") == "real").alias("nr"), F.count_if(F.col("src") == "synth").alias("ns")), "counts"), ["col"])


def gaps(counts: DataFrame, by: list[str]) -> DataFrame:
    """(by..., x, nr, ns, tr, ts, gap, next) from the counts (by..., x, nr, ns) of distinct values."""
    placed = in_ranges(counts, by, "x")
    parts = placed.groupBy(*by, "part").agg(F.sum("nr").alias("pr"), F.sum("ns").alias("ps"), F.min("x").alias("first"))
    w = W.partitionBy(*by).orderBy("part")
    all_of = W.partitionBy(*by)
    before = parts.select(*by, "part", (F.sum("pr").over(w) - F.col("pr")).alias("br"), (F.sum("ps").over(w) - F.col("ps")).alias("bs"), F.sum("pr").over(all_of).alias("tr"), F.sum("ps").over(all_of).alias("ts"), F.lead("first").over(w).alias("next_first"))
    inner = W.partitionBy(*by, "part").orderBy("x")
    met = placed.join(F.broadcast(before), [*by, "part"])
    fr = (F.col("br") + F.sum("nr").over(inner)) / F.nullif("tr", F.lit(0))
    fs = (F.col("bs") + F.sum("ns").over(inner)) / F.nullif("ts", F.lit(0))
    return met.select(*by, "x", "nr", "ns", "tr", "ts", (fr - fs).alias("gap"), F.coalesce(F.lead("x").over(inner), "next_first").alias("next"))


def wasserstein(real: DataFrame, synth: DataFrame, cols: list[str], on_empty: float | None = None) -> DataFrame:
    """Wasserstein-1 per column after scaling by the real range; ``on_empty`` (null: none) if a side has no values."""
    g = ecdf_gaps(real, synth, cols)
    s = g.groupBy("col").agg(
        F.sum(F.abs("gap") * (F.col("next") - F.col("x"))).alias("w"),
        F.min(F.when(F.col("nr") > 0, F.col("x"))).alias("lo"),
        F.max(F.when(F.col("nr") > 0, F.col("x"))).alias("hi"),
        F.max("tr").alias("tr"),
        F.max("ts").alias("ts"),
    )
    width = F.col("hi") - F.col("lo")
    value = F.when((F.col("tr") == 0) | (F.col("ts") == 0), F.lit(on_empty)).otherwise(F.coalesce("w", F.lit(0.0)) / F.when(width > 0, width).otherwise(1.0))
    return s.select("col", value.cast("double").alias("wasserstein"))


def js_divergence(real: DataFrame, synth: DataFrame, cols: list[str], on_empty: float | None = None) -> DataFrame:
    """Jensen-Shannon divergence, base 2; one side empty: 1, both: ``on_empty``."""
    f = frequencies(united(real, synth), cols, ["src"])
    a = f.where("src = 'real'").select("col", "value", F.col("share").alias("p"))
    b = f.where("src = 'synth'").select("col", "value", F.col("share").alias("q"))
    both = a.join(b, ["col", "value"], "full_outer").na.fill(0.0, ["p", "q"])
    p, q = F.col("p"), F.col("q")
    m = (p + q) / 2
    term = F.when(p > 0, p * F.log2(p / m)).otherwise(0.0) + F.when(q > 0, q * F.log2(q / m)).otherwise(0.0)
    s = both.groupBy("col").agg((F.sum(term) / 2).alias("d"), F.sum("p").alias("sp"), F.sum("q").alias("sq"))
    found = s.select("col", F.when((F.col("sp") == 0) | (F.col("sq") == 0), 1.0).otherwise(F.greatest("d", F.lit(0.0))).alias("js_divergence"))
    asked = real.sparkSession.createDataFrame([(c,) for c in cols], "col string")
    return F.broadcast(asked).join(found, "col", "left").select("col", F.coalesce("js_divergence", F.lit(on_empty).cast("double")).alias("js_divergence"))


def histogram_counts(real: DataFrame, synth: DataFrame, cols: list[str], bins: int) -> DataFrame:
    """(col, bin, lo, width, nr, ns) over shared equal-width bins, empty ones included."""
    rows = long_numbers(united(real, synth), cols, ["src"])
    span = rows.groupBy("col").agg(F.min("x").alias("lo"), F.max("x").alias("hi")).withColumn("width", (F.col("hi") - F.col("lo")) / bins)
    met = rows.join(F.broadcast(span), "col").where("width > 0")
    counts = met.groupBy("col", F.least(F.floor((F.col("x") - F.col("lo")) / F.col("width")), F.lit(bins - 1)).alias("bin")).agg(F.count_if(F.col("src") == "real").alias("nr"), F.count_if(F.col("src") == "synth").alias("ns"))
    grid = span.select("col", "lo", "width", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(bins - 1).cast("long"))).alias("bin"))
    return grid.join(counts, ["col", "bin"], "left").na.fill(0, ["nr", "ns"])


def histogram_jsd(real: DataFrame, synth: DataFrame, cols: list[str], bins: int = 50) -> DataFrame:
    """Divergence of shared histograms, natural log, smoothed by 1e-10; constants: 0."""
    h = histogram_counts(real, synth, cols, bins)
    w = W.partitionBy("col")
    tr, ts = F.sum("nr").over(w), F.sum("ns").over(w)
    shares = h.select("col", "width", tr.alias("tr"), ts.alias("ts"), (F.col("nr") / F.when(tr > 0, tr) + 1e-10).alias("p"), (F.col("ns") / F.when(ts > 0, ts) + 1e-10).alias("q"))
    tot = shares.withColumns({"p": F.col("p") / F.sum("p").over(w), "q": F.col("q") / F.sum("q").over(w)})
    m = (F.col("p") + F.col("q")) / 2
    d = F.sum(F.col("p") * F.ln(F.col("p") / m) + F.col("q") * F.ln(F.col("q") / m)) / 2
    return tot.groupBy("col").agg(F.when((F.max("tr") > 0) & (F.max("ts") > 0) & (F.max("width") > 0), d).otherwise(0.0).alias("histogram_jsd"))


#: Values of a side up to which the KS test's p-value is exact by default; beyond, it is asymptotic.
KS_EXACT = 10_000


def ks_test(real: DataFrame, synth: DataFrame, cols: list[str], exact_up_to: int = KS_EXACT) -> DataFrame:
    """Two-sample Kolmogorov-Smirnov statistic and its p-value: exact if both sides have at most ``exact_up_to`` values, else asymptotic."""
    s = ecdf_gaps(real, synth, cols).groupBy("col").agg(F.max(F.abs("gap")).alias("ks"), F.max("tr").alias("n1"), F.max("ts").alias("n2"))
    return s.select("col", "ks", ks_p("ks", F.col("n1").cast("double"), F.col("n2").cast("double"), exact_up_to).alias("p_value"))


def chi2_homogeneity(real: DataFrame, synth: DataFrame, cols: list[str]) -> DataFrame:
    """Chi-square of a column's categories against the source (Yates on 2 x 2), degrees of freedom and p."""
    f = frequencies(united(real, synth), cols, ["src"]).groupBy("col", "value").agg(F.sum(F.when(F.col("src") == "real", F.col("n")).otherwise(0)).alias("a"), F.sum(F.when(F.col("src") == "synth", F.col("n")).otherwise(0)).alias("b"))
    w = W.partitionBy("col")
    t = f.withColumns({"ta": F.sum("a").over(w), "tb": F.sum("b").over(w), "k": F.count("*").over(w)})
    total, row = F.col("ta") + F.col("tb"), F.col("a") + F.col("b")
    terms = []
    for n, tn in (("a", "ta"), ("b", "tb")):
        e = row * F.col(tn) / total
        gap = F.abs(F.col(n) - e)
        gap = F.when(F.col("k") == 2, gap - F.least(F.lit(0.5), gap)).otherwise(gap)
        terms.append(F.when(e > 0, gap * gap / e).otherwise(0.0))
    s = t.groupBy("col").agg(F.sum(terms[0] + terms[1]).alias("chi2"), (F.max("k") - 1).cast("double").alias("dof"))
    return s.select("col", "chi2", "dof", chi2_p("chi2", "dof").alias("p_value"))


def covariate_shift(train: DataFrame, test: DataFrame, continuous: list[str], categorical: list[str], alpha: float = 0.05, exact_up_to: int = KS_EXACT) -> DataFrame:
    ks = ks_test(train, test, continuous, exact_up_to).select("col", F.lit("ks").alias("test"), F.col("ks").alias("statistic"), "p_value")
    chi = chi2_homogeneity(train, test, categorical).select("col", F.lit("chi2").alias("test"), F.col("chi2").alias("statistic"), "p_value")
    return ks.unionByName(chi).withColumn("shifted", F.col("p_value") < alpha)


def normality(df: DataFrame, cols: list[str], alpha: float = 0.05) -> DataFrame:
    """D'Agostino-Pearson K2 per column; null under 8 values or without variation."""
    s = long_numbers(df, cols).groupBy("col").agg(F.count("x").cast("double").alias("n"), F.skewness("x").alias("g1"), (F.kurtosis("x") + 3).alias("b2"))
    n, g1, b2 = F.col("n"), F.col("g1"), F.col("b2")
    y = g1 * F.sqrt((n + 1) * (n + 3) / (6 * (n - 2)))
    beta = 3 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9))
    w2 = F.sqrt(2 * (beta - 1)) - 1
    z1 = F.asinh(y / F.sqrt(2 / (w2 - 1))) / F.sqrt(0.5 * F.ln(w2))
    e = 3 * (n - 1) / (n + 1)
    v = 24 * n * (n - 2) * (n - 3) / ((n + 1) * (n + 1) * (n + 3) * (n + 5))
    x = (b2 - e) / F.sqrt(v)
    sk = 6 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * F.sqrt(6 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3)))
    a = 6 + 8 / sk * (2 / sk + F.sqrt(1 + 4 / (sk * sk)))
    d = 1 + x * F.sqrt(2 / (a - 4))
    z2 = ((1 - 2 / (9 * a)) - F.signum(d) * F.pow((1 - 2 / a) / F.abs(d), F.lit(1 / 3))) / F.sqrt(2 / (9 * a))
    k2 = F.when(n >= 8, z1 * z1 + z2 * z2)
    out = s.select("col", k2.alias("k2"))
    return out.select("col", F.when(~F.isnan("k2"), F.col("k2")).alias("k2")).select("col", "k2", F.exp(-F.col("k2") / 2).alias("p_value"), (F.exp(-F.col("k2") / 2) >= alpha).alias("normal"))


#: Digits to which densities are told apart, as parts of the highest.
LEVEL = 10


def kde_modes(df: DataFrame, cols: list[str], grid: int = 500, prominence: float = 0.01) -> DataFrame:
    """Modes of a Gaussian kernel density on a grid; under 10 values or constant: 1.

    The density is exact: each distinct value, counted, adds to each point of the grid, and the sums are begun where the
    values are, so the work grows with the distinct values and only sums of the grid are shuffled.
    """
    x = long_numbers(df, cols)
    about = x.groupBy("col").agg(F.count("x").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi"), F.stddev_samp("x").alias("s"))
    about = about.withColumn("h", 1.06 * F.col("s") * F.pow(F.col("n").cast("double"), F.lit(-0.2)))
    # one row for each column
    placed = x.groupBy("col", "x").agg(F.count("*").alias("m")).join(F.broadcast(about.select("col", "n", "lo", "hi", "h")), "col")
    counts = placed.where("h > 0 AND n >= 10 AND hi > lo")
    step = (F.col("hi") - F.col("lo")) / (grid - 1)
    points = F.explode(F.sequence(F.lit(0), F.lit(grid - 1))).alias("i")
    dens = counts.select("col", "x", "m", "lo", "h", step.alias("step"), "n", points)
    u = (F.col("lo") + F.col("i") * F.col("step") - F.col("x")) / F.col("h")
    f = dens.groupBy("col", "i").agg((F.sum(F.col("m") * F.exp(-u * u / 2)) / F.max(F.col("n") * F.col("h"))).alias("f"))
    # sums of doubles depend on their order: what differs by no more than that is level, and a level stretch is one point
    w = W.partitionBy("col").orderBy("i")
    f = f.withColumn("f", F.round(F.col("f") / F.max("f").over(W.partitionBy("col")), LEVEL))
    steps = f.withColumn("before", F.lag("f").over(w)).where("before IS NULL OR before <> f")
    peaks = steps.withColumns({"before": F.lag("f").over(w), "after": F.lead("f").over(w)})
    tops = peaks.where("f > before AND f > after").select("col", "i", F.col("f").alias("peak"), F.lit(1.0).alias("top"))
    # prominence: the higher of the lowest points between the peak and a higher point on each side
    every = f.select(F.col("col").alias("c"), F.col("i").alias("j"), F.col("f").alias("g"))
    met = tops.join(every, F.col("col") == F.col("c"))
    left_stop = F.max(F.when((F.col("j") < F.col("i")) & (F.col("g") > F.col("peak")), F.col("j")))
    right_stop = F.min(F.when((F.col("j") > F.col("i")) & (F.col("g") > F.col("peak")), F.col("j")))
    stops = met.groupBy("col", "i", "peak", "top").agg(left_stop.alias("l"), right_stop.alias("r"))
    lows = stops.join(every, F.col("col") == F.col("c")).groupBy("col", "i", "peak", "top").agg(
        F.min(F.when((F.col("j") < F.col("i")) & (F.col("j") > F.coalesce("l", F.lit(-1))), F.col("g"))).alias("ml"),
        F.min(F.when((F.col("j") > F.col("i")) & (F.col("j") < F.coalesce("r", F.lit(grid))), F.col("g"))).alias("mr"),
    )
    good = lows.where(F.col("peak") - F.greatest("ml", "mr") >= prominence * F.col("top")).groupBy("col").agg(F.count("*").alias("modes"))
    return about.select("col").join(good, "col", "left").select("col", F.greatest(F.coalesce("modes", F.lit(1)), F.lit(1)).alias("modes"))


def adjust_p(df: DataFrame, method: str = "bh", p: str = "p_value") -> DataFrame:
    """Adds ``adjusted``: Bonferroni, Benjamini-Hochberg or Benjamini-Yekutieli, over one table of tests."""
    every = W.partitionBy(F.lit(1))
    n = F.count(F.lit(1)).over(every)
    if method == "bonferroni":
        return df.withColumn("adjusted", F.least(F.col(p) * n, F.lit(1.0)))
    if method not in ("bh", "by"):
        raise ValueError(f"unknown method {method}")
    ranked = df.withColumns({"_rank": F.row_number().over(every.orderBy(p)), "_n": n})
    factor = F.aggregate(F.sequence(F.lit(1), F.col("_n").cast("int")), F.lit(0.0), lambda acc, i: acc + 1 / i) if method == "by" else F.lit(1.0)
    raw = F.col(p) * F.col("_n") / F.col("_rank") * factor
    back = every.orderBy(F.desc("_rank")).rowsBetween(W.unboundedPreceding, 0)
    return ranked.withColumn("_raw", raw).withColumn("adjusted", F.least(F.min("_raw").over(back), F.lit(1.0))).drop("_rank", "_n", "_raw")


def mean_distance(real: DataFrame, synth: DataFrame, continuous: list[str], categorical: list[str]) -> DataFrame:
    """Mean of all columns' Wasserstein and Jensen-Shannon distances; none: 1."""
    w = wasserstein(real, synth, continuous, 1.0).select(F.col("wasserstein").alias("d"))
    j = js_divergence(real, synth, categorical, 0.0).select(F.col("js_divergence").alias("d"))
    return w.unionByName(j).agg(F.coalesce(F.avg("d"), F.lit(1.0)).alias("fidelity_score"))


def wasserstein_to(base: DataFrame, rows: DataFrame) -> DataFrame:
    """(_key, col, w): Wasserstein-1 of each key's values (_key, col, x, ns) from those of ``base`` (col, x, nr).

    Between two neighbouring values of a key its distribution function is a constant g, and the base's, F,
    rises, so it crosses g once, at F's quantile of g.  On both sides the integral of the difference
    is told by the integral of F at the ends, I(t) = sum of (t - x) / N over the base's x below t.  So
    only I at a key's values, and I and the place of the crossings, are looked up, by running sums.
    """
    sized = base.withColumn("nx", F.col("nr") * F.col("x"))
    totals = sized.groupBy("col").agg(F.sum("nr").alias("N"), F.min("x").alias("first"), F.max("x").alias("last"), F.sum("nx").alias("S"))
    kept = kept_table(sums_below(sized.withColumn("one", F.lit(1)), ["col"], "x", {"nr": "below", "one": "at"}), "base-values")
    # each key's running share, and the next value of the same key
    placed = kept_table(sums_below(rows.withColumn("one", F.lit(1)), ["_key", "col"], "x", {"ns": "sb", "one": "k"}), "key-values")
    sizes = placed.groupBy("_key", "col").agg(F.sum("ns").alias("M"))
    after = placed.select("_key", "col", (F.col("k") - 1).alias("k"), F.col("x").alias("b"))
    spans = placed.join(after, ["_key", "col", "k"], "left").join(sizes, ["_key", "col"]).join(F.broadcast(totals), "col")
    spans = spans.select("_key", "col", F.col("x").alias("a"), "b", ((F.col("sb") + F.col("ns")) / F.col("M")).alias("g"), "N", "first", "last", "S", (F.col("sb") == 0).alias("begins"))
    spans = kept_table(spans.withColumn("need", F.ceil(F.round(F.col("g") * F.col("N"), 6))), "spans")
    # the base's value at which F reaches g: the first whose running number, itself included, is need or more
    levels = kept.select("col", (F.col("below") + F.col("nr")).cast("double").alias("m"), F.lit(1).alias("one"))
    marks = levels.unionByName(spans.select("col", F.col("need").cast("double").alias("m"), F.lit(0).alias("one"))).groupBy("col", "m").agg(F.sum("one").alias("one"))
    reached = sums_below(marks, ["col"], "m", {"one": "at"}).select("col", F.col("m").alias("need"), "at")
    crossing = kept.select("col", "at", F.col("x").alias("c"))
    met = spans.withColumn("need", F.col("need").cast("double")).join(reached, ["col", "need"]).join(crossing, ["col", "at"], "left")
    cut = F.least(F.greatest(F.coalesce("c", F.col("last")), F.col("a")), F.col("b"))
    met = kept_table(met.select("_key", "col", "a", "b", "g", "N", "first", "last", "S", "begins", cut.alias("c")), "crossings")
    # I at a, b and c
    asked = met.select("col", F.explode(F.array_distinct(F.array_compact(F.array("a", "b", "c")))).alias("x")).distinct()
    marks = sized.select("col", "x", "nr", "nx").unionByName(asked.select("col", "x", F.lit(0).cast("long").alias("nr"), F.lit(0.0).alias("nx"))).groupBy("col", "x").agg(F.sum("nr").alias("nr"), F.sum("nx").alias("nx"))
    told = kept_table(sums_below(marks, ["col"], "x", {"nr": "n", "nx": "s"}).select("col", "x", (F.col("n") * F.col("x") - F.col("s")).alias("i")), "integrals")
    for name in ("a", "b", "c"):
        met = met.join(told.select("col", F.col("x").alias(name), F.col("i").alias(f"i{name}")), ["col", name], "left")
    inside = F.col("g") * (2 * F.col("c") - F.col("a") - F.col("b")) + (F.col("ia") + F.col("ib") - 2 * F.col("ic")) / F.col("N")
    # before the key's first value g is 0, after its last F has (last - b) left to rise
    head = F.when(F.col("begins"), F.col("ia") / F.col("N")).otherwise(0.0)
    tail = F.when(F.col("b").isNull(), F.greatest(F.col("last") - F.col("a"), F.lit(0.0)) - F.when(F.col("last") > F.col("a"), (F.col("N") * F.col("last") - F.col("S") - F.col("ia")) / F.col("N")).otherwise(0.0)).otherwise(0.0)
    return met.groupBy("_key", "col").agg(F.sum(F.coalesce(inside, F.lit(0.0)) + head + tail).alias("w"))


def rank_candidates(real: DataFrame, candidates: DataFrame, key: str, continuous: list[str], categorical: list[str], violated, weight: float = 0.7) -> DataFrame:
    """Candidate tables under ``key`` by weight * distance + (1 - weight) * violation rate, all in one job.

    Candidates meet the real table's running numbers at their own values only: what is summed grows with the
    real values plus the candidates' values, not with their product.
    """
    rate = candidates.groupBy(key).agg(F.coalesce(F.avg(F.coalesce(violated, F.lit(False)).cast("double")), F.lit(0.0)).alias("violation_rate"))
    rows = long_numbers(candidates.withColumn("_key", F.col(key)), continuous, ["_key"]).groupBy("_key", "col", "x").agg(F.count("*").alias("ns"))
    keys = rate.select(F.col(key).alias("_key"))
    base = long_numbers(real, continuous).groupBy("col", "x").agg(F.count("*").alias("nr"))
    w1 = wasserstein_to(base, rows)
    about = base.groupBy("col").agg((F.max("x") - F.min("x")).alias("width"))
    scaled = w1.join(F.broadcast(about), "col").select("_key", (F.col("w") / F.nullif("width", F.lit(0.0))).alias("d"))
    f = frequencies(candidates.withColumn("_key", F.col(key)), categorical, ["_key"]).select("_key", "col", "value", F.lit(0.0).alias("p"), F.col("share").alias("q"))
    g = frequencies(real, categorical).select("col", "value", F.col("share").alias("p"))
    m = (F.col("p") + F.col("q")) / 2
    # categories that only the real table has say p each, so a candidate's sum of them is what its own leave of 1
    both = f.drop("p").join(g, ["col", "value"], "left").withColumn("p", F.coalesce("p", F.lit(0.0)))
    term = F.when(F.col("p") > 0, F.col("p") * F.log2(F.col("p") / m)).otherwise(0.0) + F.when(F.col("q") > 0, F.col("q") * F.log2(F.col("q") / m)).otherwise(0.0)
    own = both.groupBy("_key", "col").agg(F.sum(term).alias("t"), F.sum("p").alias("met"))
    # rows as many as candidates by columns; a candidate without values of a column has all of it left
    columns = real.sparkSession.createDataFrame([(c,) for c in categorical], "col string") if categorical else None
    some = g.groupBy("col").agg(F.lit(True).alias("some"))
    whole = keys.join(F.broadcast(columns)).join(F.broadcast(some), "col", "left").join(own, ["_key", "col"], "left") if categorical else None
    left = F.when(F.col("some"), F.greatest(1 - F.coalesce("met", F.lit(0.0)), F.lit(0.0))).otherwise(0.0)
    jsd = whole.where("some OR t IS NOT NULL").select("_key", ((F.coalesce("t", F.lit(0.0)) + left) / 2).alias("d")) if categorical else scaled.limit(0)
    fidelity = scaled.unionByName(jsd).groupBy(F.col("_key").alias(key)).agg(F.coalesce(F.avg("d"), F.lit(1.0)).alias("fidelity"))
    out = fidelity.join(rate, key).withColumn("objective", weight * F.col("fidelity") + (1 - weight) * F.col("violation_rate"))
    return out.withColumn("rank", F.row_number().over(W.orderBy("objective", key)))
