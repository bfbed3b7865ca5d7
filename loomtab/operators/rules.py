"""Declared domains and rules: validation, audits, correction."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.spec import DatasetSpec
from .profile import listed, number

_RULE = re.compile(r"^\s*(\S(?:.*?\S)?)\s+(>=|<=|==|!=|>|<)\s+(\S(?:.*\S)?)\s*$")
#: Values that a domain always allows.
ALWAYS = ("Unknown", "missing")


@dataclass(frozen=True)
class Rule:
    """``left op right``: a column against a column or a number."""

    left: str
    op: str
    right: str | float

    @classmethod
    def parse(cls, text: str) -> Rule:
        found = _RULE.match(text)
        if not found:
            raise ValueError(f"not a rule (spaces belong around the operator): {text!r}")
        left, op, right = found.groups()
        try:
            return cls(left, op, float(right))
        except ValueError:
            return cls(left, op, right)

    @property
    def name(self) -> str:
        right = f"{self.right:g}" if isinstance(self.right, float) else self.right
        return f"{self.left} {self.op} {right}"

    def sides(self, df: DataFrame) -> tuple[Column, Column] | None:
        needed = [self.left, *([self.right] if isinstance(self.right, str) else [])]
        if any(c not in df.columns for c in needed):
            return None
        return number(self.left), F.lit(self.right) if isinstance(self.right, float) else number(self.right)

    def violated(self, df: DataFrame, null_violates: bool = True) -> Column:
        """Boolean, never null; a missing column violates nothing.

        By default a null side violates every comparison but ``!=``.
        """
        both = self.sides(df)
        if both is None:
            return F.lit(False)
        a, b = both
        holds = {">=": a >= b, "<=": a <= b, ">": a > b, "<": a < b, "==": a == b, "!=": a != b}[self.op]
        return F.coalesce(~holds, F.lit(null_violates and self.op != "!="))

    def gap(self, df: DataFrame) -> Column:
        """How far a row is from holding the rule, at least 0."""
        both = self.sides(df)
        if both is None:
            return F.lit(0.0)
        a, b = both
        away = {">=": b - a, ">": b - a, "<=": a - b, "<": a - b, "==": F.abs(a - b), "!=": 1.0 - F.abs(a - b)}[self.op]
        return F.greatest(away, F.lit(0.0))

    def corrected(self, df: DataFrame) -> Column | None:
        """The left column with violations moved to the boundary; nulls stay but for ``== number``."""
        both = self.sides(df)
        if both is None:
            return None
        a, b = both
        kept = F.when(a.isNull() | b.isNull(), F.when(a.isNull() & F.lit(self.op == "==" and isinstance(self.right, float)), b).otherwise(a))
        if self.op in (">=", ">"):
            return kept.otherwise(F.greatest(a, b))
        if self.op in ("<=", "<"):
            return kept.otherwise(F.least(a, b))
        if self.op == "==":
            return kept.otherwise(b)
        return kept.when(F.abs(a - b) < 1e-6, a + 1e-3).otherwise(a)


def rules(texts: list[str]) -> list[Rule]:
    return [Rule.parse(t) for t in texts]


def any_violated(df: DataFrame, given: list[Rule], null_violates: bool = True) -> Column:
    return reduce(lambda a, b: a | b, [r.violated(df, null_violates) for r in given], F.lit(False))


def violation_rate(df: DataFrame, given: list[Rule], null_violates: bool = True) -> DataFrame:
    return df.agg(F.coalesce(F.avg(any_violated(df, given, null_violates).cast("double")), F.lit(0.0)).alias("violation_rate"))


def violations_by_rule(df: DataFrame, given: list[Rule], null_violates: bool = True) -> DataFrame:
    """One row per rule: its violations and their rate, all from one pass."""
    wide = df.agg(F.count("*").alias("rows"), *[F.count_if(r.violated(df, null_violates)).alias(r.name) for r in given])
    out = wide.unpivot(["rows"], [f"`{r.name}`" for r in given], "rule", "violations")
    return out.select("rule", "violations", F.coalesce(F.try_divide(F.col("violations"), F.col("rows")), F.lit(0.0)).alias("rate"))


def clamp_correction(df: DataFrame, given: list[Rule], passes: int = 3) -> DataFrame:
    """Rules applied one after the other, ``passes`` times, as one projection chain without an action."""
    for _ in range(passes):
        for r in given:
            fixed = r.corrected(df)
            if fixed is not None:
                kind = df.schema[r.left].dataType
                df = df.withColumn(r.left, F.when(r.violated(df), fixed.cast(kind)).otherwise(F.col(r.left)))
    return df


def correction_summary(df: DataFrame, given: list[Rule], passes: int = 3) -> DataFrame:
    """Rows that violate any rule before and after correction."""
    before = df.agg(F.count("*").alias("rows"), F.count_if(any_violated(df, given)).alias("before"))
    fixed = clamp_correction(df, given, passes)
    return before.join(F.broadcast(fixed.agg(F.count_if(any_violated(fixed, given)).alias("after"))))


def correct_by_resampling(df: DataFrame, pool: DataFrame, given: list[Rule], key: str, seed: int = 42) -> DataFrame:
    """Violating rows get the columns of rule-abiding pool rows; both sides are dealt by ranks within hash buckets.

    A bucket's clean rows are dealt again where it has more violating ones, and a bucket without any
    takes the next one's; what an empty pool leaves is clamped.
    """
    good = pool.where(~any_violated(pool, given))
    marked = df.withColumn("_bad", any_violated(df, given))
    per = 4096
    buckets = max(1, -(-marked.where("_bad").count() // per))
    deal = lambda d, k: d.withColumns({"_bucket": F.pmod(F.xxhash64(k, F.lit(seed)), F.lit(buckets))})
    order = W.partitionBy("_bucket").orderBy(F.xxhash64(key, F.lit(seed)), key)
    bad = deal(marked.where("_bad"), key).withColumn("_rank", F.row_number().over(order))
    spare = deal(good, key).withColumn("_rank", F.row_number().over(order))
    cols = [c for c in df.columns if c != key]
    # one row a bucket: where its rows come from, and how many clean rows are there
    clean = {r["_bucket"]: r["count"] for r in spare.groupBy("_bucket").count().collect()}
    if not clean:
        return marked.where("NOT _bad").select(df.columns).unionByName(clamp_correction(bad.select(df.columns), given))
    source, lent = min(clean), []
    for bucket in reversed(range(buckets)):
        source = bucket if bucket in clean else source
        lent.append((bucket, source, clean[source]))
    lent = df.sparkSession.createDataFrame(lent, "_bucket long, _source long, _clean long")
    bad = bad.join(F.broadcast(lent), "_bucket").withColumn("_rank", (F.pmod(F.col("_rank") - 1, F.col("_clean")) + 1).cast("int"))
    taken = spare.select(F.col("_bucket").alias("_source"), "_rank", *[F.col(c).alias(f"_{c}") for c in cols])
    met = bad.join(taken, ["_source", "_rank"])
    fixed = met.select(*[F.col(c) if c == key else F.col(f"_{c}").alias(c) for c in df.columns])
    return marked.where("NOT _bad").select(df.columns).unionByName(fixed)


def hinge_penalty(df: DataFrame, given: list[Rule]) -> DataFrame:
    """Mean gap of each rule, and their sum as rule '*'."""
    wide = df.agg(*[F.coalesce(F.avg(r.gap(df)), F.lit(0.0)).alias(r.name) for r in given])
    total = reduce(lambda a, b: a + b, [F.col(f"`{r.name}`") for r in given])
    return wide.withColumn("*", total).unpivot([], [*[f"`{r.name}`" for r in given], "`*`"], "rule", "penalty")


def formula_audit(real: DataFrame, synth: DataFrame, result: str, expression: str, tolerance: float = 0.15) -> DataFrame:
    """``result = expression`` on both tables: MAPE, share over tolerance, rows that count and all rows."""
    both = real.withColumn("src", F.lit("real")).unionByName(synth.withColumn("src", F.lit("synth")))
    expected, actual = F.expr(expression).try_cast("double"), number(result)
    away = F.abs(actual - expected) / F.abs(expected)
    ok = F.coalesce((expected != 0) & actual.isNotNull(), F.lit(False))
    return both.groupBy("src").agg(
        F.avg(F.when(ok, away)).alias("mape"),
        F.avg(F.when(ok, (away > tolerance).cast("double"))).alias("violation_rate"),
        F.count_if(ok).alias("n_valid"),
        F.count("*").alias("n_total"),
    )


def schema_check(df: DataFrame, spec: DatasetSpec) -> DataFrame:
    """One row per declared column: present, and for continuous ones whether any value is a number."""
    spark = df.sparkSession
    present = [c for c in spec.columns if c in df.columns]
    counts = df.agg(*[F.count(c).alias(f"n{i}") for i, c in enumerate(present)], *[F.count(number(c)).alias(f"g{i}") for i, c in enumerate(present)]).first()
    rows = []
    for c in spec.columns:
        i = present.index(c) if c in present else None
        bad = i is not None and c in spec.continuous and counts[f"n{i}"] > 0 and counts[f"g{i}"] == 0
        rows.append((c, i is not None, "missing column" if i is None else "not numeric" if bad else "ok"))
    return spark.createDataFrame(rows, "col string, present boolean, status string")


def validate(df: DataFrame, spec: DatasetSpec, raise_error: bool = True) -> bool:
    bad = [r for r in schema_check(df, spec).collect() if r["status"] != "ok"]
    if bad and raise_error:
        raise ValueError("; ".join(f"{r['col']}: {r['status']}" for r in bad))
    return not bad


def bounds_audit(df: DataFrame, bounds: dict[str, tuple[float, float]]) -> DataFrame:
    """Values under and over each column's bounds; percentages are of all rows."""
    known = {c: b for c, b in bounds.items() if c in df.columns and None not in b}
    aggs = [F.struct(F.count_if(number(c) < lo).alias("under"), F.count_if(number(c) > hi).alias("over")).alias(c) for c, (lo, hi) in known.items()]
    wide = df.agg(F.count("*").alias("rows"), *aggs)
    out = wide.unpivot(["rows"], list(known), "col", "s")
    pct = lambda n: 100.0 * n / F.col("rows")
    return out.select("col", F.col("s.under").alias("under"), F.col("s.over").alias("over"), pct(F.col("s.under") + F.col("s.over")).alias("outside_pct"))


def domain_audit(df: DataFrame, domains: dict[str, list[str]], samples: int = 5) -> DataFrame:
    """Values outside each column's domain: count, percentage of all rows, up to ``samples`` of them."""
    cols = [c for c in domains if c in df.columns]
    picked = df.select(*[F.col(c).cast("string").alias(c) for c in cols])
    counts = picked.unpivot([], cols, "col", "value").groupBy("col", "value").agg(F.count("*").alias("n"))
    allowed = F.lit(False)
    for c in cols:
        allowed = allowed | ((F.col("col") == c) & F.col("value").isin([*domains[c], *ALWAYS]))
    bad = ~allowed & F.col("value").isNotNull()
    found = counts.groupBy("col").agg(F.sum(F.when(bad, F.col("n")).otherwise(0)).alias("invalid"), (100.0 * F.sum(F.when(bad, F.col("n")).otherwise(0)) / F.sum("n")).alias("invalid_pct"))
    ranked = counts.where(bad).withColumn("rank", F.row_number().over(W.partitionBy("col").orderBy("value")))
    return found.join(F.broadcast(listed(ranked, samples, F.col("value"), "samples")), "col", "left").na.fill("", ["samples"])


def audit_and_correct(df: DataFrame, spec: DatasetSpec) -> DataFrame:
    """Numbers clamped to their bounds (either may be absent), values outside a domain set to its first."""
    out = {}
    for c, (lo, hi) in spec.bounds.items():
        if c in df.columns:
            x = F.col(c)
            if lo is not None:
                x = F.when(x.isNotNull(), F.greatest(x, F.lit(lo).cast(df.schema[c].dataType)))
            if hi is not None:
                x = F.when(x.isNotNull(), F.least(x, F.lit(hi).cast(df.schema[c].dataType)))
            out[c] = x
    for c, values in spec.domains.items():
        if c in df.columns and values:
            v = F.col(c).cast("string")
            out[c] = F.when(v.isNull() | v.isin([*values, *ALWAYS]), v).otherwise(F.lit(values[0]))
    return df.withColumns(out)


def rule_accuracy(df: DataFrame, predicted: Column, actual: Column) -> DataFrame:
    """How often a single rule tells the class."""
    return df.agg(F.avg((predicted == actual).cast("double")).alias("accuracy"))
