"""The audit of a synthetic table: metrics in long form, grades, and the data behind charts."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import assoc, dist, privacy, utility
from .domains import kept_table
from .profile import frequencies

#: Values that a task of a distinct count holds.
DISTINCT_ROWS = 1_000_000


def metric(section: str, name: str, df: DataFrame, value: str, column: str | None = None) -> DataFrame:
    return df.select(F.lit(section).alias("section"), F.lit(name).alias("metric"), (F.col(column) if column else F.lit("*")).alias("column"), F.col(value).cast("double").alias("value"))


def fidelity_metrics(real: DataFrame, synth: DataFrame, continuous: list[str], categorical: list[str]) -> DataFrame:
    out = metric("fidelity", "wasserstein", dist.wasserstein(real, synth, continuous), "wasserstein", "col")
    out = out.unionByName(metric("fidelity", "js_divergence", dist.js_divergence(real, synth, categorical), "js_divergence", "col"))
    return out.unionByName(metric("fidelity", "corr_difference", assoc.correlation_difference(real, synth, continuous, categorical), "corr_difference"))


def grade_column() -> Column:
    """Per column: Wasserstein .05/.15, Jensen-Shannon .03/.08."""
    v = F.col("value")
    bad = v.isNull() | F.isnan(v)
    w = F.when(bad, "UNKNOWN").when(v < 0.05, "Good").when(v < 0.15, "Moderate").otherwise("Poor")
    j = F.when(bad, "UNKNOWN").when(v < 0.03, "Good").when(v < 0.08, "Moderate").otherwise("Poor")
    return F.when(F.col("metric") == "wasserstein", w).when(F.col("metric") == "js_divergence", j)


def fidelity_grades(real: DataFrame, synth: DataFrame, continuous: list[str], categorical: list[str]) -> DataFrame:
    """(metric, column, value, grade) for every column."""
    out = metric("fidelity", "wasserstein", dist.wasserstein(real, synth, continuous), "wasserstein", "col")
    out = out.unionByName(metric("fidelity", "js_divergence", dist.js_divergence(real, synth, categorical), "js_divergence", "col"))
    return out.select("metric", "column", "value", grade_column().alias("grade"))


def domain_grades(summary: DataFrame) -> DataFrame:
    """One row of averages (js, w1, corr, leakage, mia, drop) to one grade per domain; unknown for missing ones."""
    js, w1, corr, leak, mia, drop = (F.col(c) for c in ("js", "w1", "corr", "leakage", "mia", "drop"))
    unknown = lambda *c: F.greatest(*[(x.isNull() | F.isnan(x)).cast("int") for x in c]) == 1
    fidelity = F.when(unknown(js, w1), "UNKNOWN").when((js < 0.05) & (w1 < 0.05) & (corr < 0.1), "GREEN").when((js >= 0.15) | (w1 >= 0.15), "RED").otherwise("YELLOW")
    private = F.when(unknown(leak, mia), "UNKNOWN").when((leak < 1) & (mia <= 0.65), "GREEN").when((leak >= 5) | (mia >= 0.8), "RED").otherwise("YELLOW")
    one = F.coalesce(drop, F.lit(None).cast("double"))
    useful = F.when(one.isNull() | F.isnan(one), "UNKNOWN").when(one < 0.05, "GREEN").when(one < 0.15, "YELLOW").otherwise("RED")
    return summary.select(fidelity.alias("fidelity"), private.alias("privacy"), useful.alias("utility")).unpivot([], ["fidelity", "privacy", "utility"], "domain", "grade")


def grade_formulas(audit: DataFrame, tolerance: float = 0.15) -> DataFrame:
    return audit.withColumn("grade", F.when(F.col("mape").isNull() | F.isnan("mape"), "UNKNOWN").when(F.col("mape") <= tolerance, "Good").otherwise("Poor"))


def grade_utility(drops: DataFrame) -> DataFrame:
    return drops.withColumn("grade", F.when(F.col("drop").isNull() | F.isnan("drop"), "UNKNOWN").when(F.col("drop") < 0.05, "Good").when(F.col("drop") < 0.15, "Moderate").otherwise("Poor"))


def run_audit(real: DataFrame, synth: DataFrame, train: DataFrame, test: DataFrame, continuous: list[str], categorical: list[str], vectorizer=None, target: str | None = None, sensitive: str | None = None, formulas: dict[str, str] | None = None, trees: int = 20, exclude: list[str] | None = None, estimators=None) -> DataFrame:
    """All sections in one long table (section, metric, column, value).

    ``vectorizer``: function from a table to (id, features), for the privacy section; without it that
    section is left out, as is utility without a target.  A model that fails is a line without a value,
    and the audit goes on.  ``exclude`` and ``estimators`` go to ``evaluate_utility``.
    """
    from .rules import formula_audit

    out = fidelity_metrics(real, synth, continuous, categorical)
    for result, expression in (formulas or {}).items():
        f = formula_audit(real, synth, result, expression).withColumn("what", F.concat_ws("/", F.lit(result), "src"))
        out = out.unionByName(metric("rules", "mape", f, "mape", "what"))
    if vectorizer:
        vt, vh, vs = vectorizer(train), vectorizer(test), vectorizer(synth)
        near = privacy.nearest_two(vs, vt)
        d = kept_table(privacy.dcr_summary(vt, vs, near=near), "distances")
        for c in ("dcr_mean", "dcr_min", "nndr_mean", "nndr_min"):
            out = out.unionByName(metric("privacy", c, d, c))
        out = out.unionByName(metric("privacy", "leakage_pct", privacy.leakage(vt, vh, vs, near), "leakage_pct"))
        out = out.unionByName(metric("privacy", "mia_auc", privacy.mia_auc(vt, vh, vs), "mia_auc"))
    if target:
        s = utility.evaluate_utility(train, test, synth, target, continuous, categorical, exclude=exclude, trees=trees, estimators=estimators)
        out = out.unionByName(s.select(F.lit("utility").alias("section"), F.concat_ws("/", "regime", F.coalesce("metric", F.lit("fit"))).alias("metric"), F.col("model").alias("column"), "value"))
        drops = utility.utility_drop(s).where("model <> '*'")
        out = out.unionByName(drops.select(F.lit("utility").alias("section"), F.concat(F.lit("drop/"), F.col("metric")).alias("metric"), F.col("model").alias("column"), F.col("drop").alias("value")))
    if sensitive:
        a = utility.attribute_inference(synth, test, sensitive, continuous, categorical, trees)
        out = out.unionByName(a.select(F.lit("privacy").alias("section"), F.concat(F.lit("aia_"), F.col("metric")).alias("metric"), F.lit(sensitive).alias("column"), "value"))
    return out


def with_status(audit: DataFrame, tolerance: float = 0.15) -> DataFrame:
    """An audit's lines with the status of each: Good, Moderate or Poor, UNKNOWN without a value, null where nothing is graded.

    Distances per column as in ``grade_column``, formulas by their tolerance, leakage at 1 and 5 %,
    membership at .65 and .8, utility by the drop from real to synthetic training at .05 and .15.
    """
    v, m = F.col("value"), F.col("metric")
    step = lambda good, bad: F.when(v < good, "Good").when(v < bad, "Moderate").otherwise("Poor")
    told = (
        F.when(m == "mape", F.when(v <= tolerance, "Good").otherwise("Poor"))
        .when(m == "leakage_pct", step(1, 5))
        .when(m == "mia_auc", F.when(v <= 0.65, "Good").when(v < 0.8, "Moderate").otherwise("Poor"))
        .when(m.startswith("drop/"), step(0.05, 0.15))
        .when(m.endswith("/fit"), F.lit("UNKNOWN"))
        .otherwise(grade_column())
    )
    return audit.withColumn("status", F.when(told.isNotNull() & (v.isNull() | F.isnan(v)), "UNKNOWN").otherwise(told))


def fold_metrics(audit: DataFrame, by: list[str] | None = None) -> DataFrame:
    """One row (per ``by``, such as a fold) of an audit's twelve scalars; what it doesn't hold is null.

    Means of the columns' distances, the correlation difference, mean distance to the closest record,
    leakage, membership AUC, and per model f1_macro (r2 in regressions) of both regimes.
    """
    of = lambda metric, column=None: F.avg(F.when((F.col("metric") == metric) & (F.lit(True) if column is None else F.col("column") == column), F.col("value")))
    models = {"rf": "random_forest", "gb": "gradient_boosting", "lr": "linear"}
    scores = {f"{regime.lower()}_{short}_f1": F.coalesce(of(f"{regime}/f1_macro", model), of(f"{regime}/r2", model)) for regime in ("TSTR", "TRTR") for short, model in models.items()}
    wanted = {"avg_js": of("js_divergence"), "avg_wasserstein": of("wasserstein"), "corr_diff": of("corr_difference"), "dcr_mean": of("dcr_mean"), "dcr_leakage_pct": of("leakage_pct"), "mia_auc": of("mia_auc")}
    return audit.groupBy(*(by or [])).agg(*[c.alias(name) for name, c in (wanted | scores).items()])


def domains_of(audit: DataFrame) -> DataFrame:
    """The grades of the three domains from an audit's lines."""
    s = fold_metrics(audit)
    lost = [F.col(f"trtr_{k}_f1") - F.col(f"tstr_{k}_f1") for k in ("rf", "gb", "lr")]
    known = F.filter(F.array(*lost), lambda x: x.isNotNull())
    drop = F.when(F.size(known) > 0, F.aggregate(known, F.lit(0.0), lambda a, x: a + x) / F.size(known))
    return domain_grades(s.select(F.col("avg_js").alias("js"), F.col("avg_wasserstein").alias("w1"), F.col("corr_diff").alias("corr"), F.col("dcr_leakage_pct").alias("leakage"), F.col("mia_auc").alias("mia"), drop.alias("drop")))


def overlay_histogram(real: DataFrame, synth: DataFrame, cols: list[str], bins: int = 20) -> DataFrame:
    """(col, bin, real, synth): densities over shared bins."""
    h = dist.histogram_counts(real, synth, cols, bins)
    w = W.partitionBy("col")
    density = lambda c: F.col(c) / (F.sum(c).over(w) * F.col("width"))
    return h.select("col", "bin", density("nr").alias("real"), density("ns").alias("synth"))


def overlay_top(real: DataFrame, synth: DataFrame, cols: list[str], top: int = 10) -> DataFrame:
    """(col, value, real, synth): shares of the values that are most frequent in the real table."""
    a = frequencies(real, cols).select("col", "value", F.col("share").alias("real"))
    b = frequencies(synth, cols).select("col", "value", F.col("share").alias("synth"))
    both = a.join(b, ["col", "value"], "full_outer").na.fill(0.0, ["real", "synth"])
    ranked = both.withColumn("rank", F.row_number().over(W.partitionBy("col").orderBy(F.desc("real"), "value")))
    return ranked.where(F.col("rank") <= top)


def histogram_2d(df: DataFrame, x: str, y: str, bins: int = 10) -> DataFrame:
    """Counts over a grid of equal-width bins of two columns."""
    b = assoc.binned(df.select(x, y), [x, y], bins)
    return b.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(F.col(x).alias("bx"), F.col(y).alias("by")).agg(F.count("*").alias("n"))


def distinct_counts(df: DataFrame, cols: list[str]) -> DataFrame:
    """(col, d): how many values other than null each column has, exactly.

    Values are counted within batches first, so that a frequent one isn't one task's; then they meet in as many
    partitions as keep each at about DISTINCT_ROWS.
    """

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c, values in zip(cols, batch.columns):
                own = pc.drop_null(pc.unique(values))
                yield pa.RecordBatch.from_arrays([pa.array([c] * len(own), pa.string()), own], names=["col", "value"])

    def text(c: str, kind: str):
        # of floats, both zeros are one value
        return (F.hex(c) if kind == "binary" else (F.col(c) + F.lit(0).cast(kind) if kind in ("float", "double") else F.col(c)).cast("string")).alias(c)

    kinds = dict(df.dtypes)
    values = df.select(*[text(c, kinds[c]) for c in cols]).mapInArrow(counted, "col string, value string")
    parts = max(1, -(-df.count() * len(cols) // DISTINCT_ROWS))
    return values.repartition(parts, "col", "value").groupBy("col", "value").agg(F.lit(1).alias("one")).groupBy("col").agg(F.count("*").alias("d"))


def infer_spec(df: DataFrame, few: int = 10) -> DataFrame:
    """(col, role, distinct, min, max): role by type and number of distinct values; identifiers have as many as rows."""
    used = [c for c, t in df.dtypes if t not in ("timestamp", "date")]
    aggs = [F.struct(F.count(c).alias("n"), F.min(F.col(c).try_cast("double")).alias("lo"), F.max(F.col(c).try_cast("double")).alias("hi"), F.count(F.col(c).try_cast("double")).alias("num")).alias(c) for c in used]
    s = df.agg(*aggs).unpivot([], used, "col", "s").join(distinct_counts(df, used), "col", "left").na.fill(0, ["d"])
    d, n, num = F.col("d"), F.col("s.n"), F.col("s.num")
    whole = F.create_map(*[F.lit(x) for c, t in df.dtypes if c in used for x in (c, t in ("string", "int", "bigint", "smallint"))])
    role = F.when((d == n) & (n > few) & F.element_at(whole, F.col("col")), "identifier").when((num < n) | (d <= few), "categorical").otherwise("continuous")
    return s.select("col", role.alias("role"), d.alias("distinct"), F.col("s.lo").alias("min"), F.col("s.hi").alias("max"))


def mask_identifiers(df: DataFrame, cols: list[str], salt: str = "") -> DataFrame:
    """Identifiers replaced by salted SHA-256 tokens; null stays null."""
    return df.withColumns({c: F.sha2(F.concat(F.lit(salt), F.col(c).cast("string")), 256) for c in cols})


def generalize(df: DataFrame, widths: dict[str, float], dates: dict[str, str] | None = None) -> DataFrame:
    """Numbers floored to multiples of a width, dates truncated to a unit."""
    out = {c: F.floor(F.col(c) / w) * w for c, w in widths.items()}
    return df.withColumns(out | {c: F.date_trunc(u, F.col(c)) for c, u in (dates or {}).items()})
