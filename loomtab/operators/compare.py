"""Comparing models over blocks (folds, datasets): ranks, Friedman, Nemenyi.

Scores are long: (block, model, score), possibly under further keys; matrices stay as small as
blocks x models.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.stats import chi2_p, nemenyi_p, nemenyi_q, studentized_range_quantile


def mean_scores(scores: DataFrame, by: list[str]) -> DataFrame:
    return scores.groupBy(*by).agg(F.avg("score").alias("score"))


def complete_blocks(scores: DataFrame, keys: list[str]) -> DataFrame:
    """The scores of blocks that have one for every model of their group."""
    clean = scores.where("score IS NOT NULL AND NOT isnan(score)")
    models = clean.groupBy(*keys, F.lit(0).alias("_one")).agg(F.countDistinct("model").alias("_k"))
    have = clean.groupBy(*keys, "block").agg(F.countDistinct("model").alias("_have"))
    full = have.withColumn("_one", F.lit(0)).join(models, [*keys, "_one"]).where("_have = _k").select(*keys, "block", "_k")
    return clean.join(full, [*keys, "block"])


def block_ranks(scores: DataFrame, keys: list[str] | None = None, higher_is_better: bool = True) -> DataFrame:
    """(keys..., block, model, score, rank): rank 1 is best, ties averaged."""
    keys = keys or []
    w = W.partitionBy(*keys, "block")
    order = F.desc("score") if higher_is_better else F.asc("score")
    ties = F.count("*").over(W.partitionBy(*keys, "block", "score"))
    return complete_blocks(scores, keys).withColumn("rank", F.rank().over(w.orderBy(order)) + (ties - 1) / 2)


def friedman(scores: DataFrame, keys: list[str] | None = None, higher_is_better: bool = True, require: bool = True) -> DataFrame:
    """Tie-corrected Friedman statistic per group: needs 3 models and 3 complete blocks (else an error, or null)."""
    keys = keys or []
    r = block_ranks(scores, keys, higher_is_better)
    ties = r.groupBy(*keys, "block", "score").agg(F.count("*").alias("t")).groupBy(*keys, F.lit(0).alias("_g")).agg(F.sum(F.col("t") * F.col("t") * F.col("t") - F.col("t")).alias("ties"))
    sums = r.groupBy(*keys, "model").agg(F.sum("rank").alias("s"), F.countDistinct("block").alias("n"))
    total = sums.groupBy(*keys, F.lit(0).alias("_g")).agg(F.sum(F.col("s") * F.col("s")).alias("ss"), F.count("*").alias("k"), F.max("n").alias("n"))
    k, n = F.col("k").cast("double"), F.col("n").cast("double")
    raw = 12 / (k * n * (k + 1)) * F.col("ss") - 3 * n * (k + 1)
    fix = 1 - F.col("ties") / (n * k * (k * k - 1))
    enough = (k >= 3) & (n >= 3)
    value = F.when(enough, F.when(fix > 0, raw / fix).otherwise(0.0))
    if require:
        value = F.when(enough, value).otherwise(F.raise_error(F.lit("at least 3 models and 3 complete blocks are needed")).cast("double"))
    out = total.join(ties, [*keys, "_g"]).select(*keys, "k", "n", value.alias("chi2"))
    return out.withColumn("p_value", F.coalesce(chi2_p("chi2", F.col("k").cast("double") - 1), F.lit(1.0)))


def mean_ranks(scores: DataFrame, keys: list[str] | None = None, higher_is_better: bool = True) -> DataFrame:
    return block_ranks(scores, keys, higher_is_better).groupBy(*(keys or []), "model").agg(F.avg("rank").alias("mean_rank"), F.count("*").alias("n"))


def critical_difference(k: int, n: int, alpha: float = 0.05) -> float:
    return studentized_range_quantile(alpha, k) / 2**0.5 * (k * (k + 1) / (6 * n)) ** 0.5


def nemenyi(scores: DataFrame, keys: list[str] | None = None, alpha: float = 0.05, higher_is_better: bool = True) -> DataFrame:
    """Per pair of models: rank gap, p-value, critical difference, and whether they are together in a group."""
    keys = keys or []
    m = mean_ranks(scores, keys, higher_is_better).withColumn("k", F.count("*").over(W.partitionBy(*keys, F.lit(0))))
    a = m.select(*keys, F.col("model").alias("model_a"), F.col("mean_rank").alias("ra"), "k", "n")
    b = m.select(*keys, F.col("model").alias("model_b"), F.col("mean_rank").alias("rb"))
    pairs = (a.join(b, keys) if keys else a.join(b)).where("model_a < model_b")
    unit = F.sqrt(F.col("k") * (F.col("k") + 1) / (6 * F.col("n")))
    gap = F.abs(F.col("ra") - F.col("rb"))
    cd = nemenyi_q(F.col("k").cast("double"), F.lit(alpha)) * unit
    return pairs.select(*keys, "model_a", "model_b", gap.alias("rank_gap"), nemenyi_p(gap / unit, F.col("k").cast("double")).alias("p_value"), cd.alias("critical_difference"), (gap <= cd).alias("same_group"))


def compare_models(scores: DataFrame, alpha: float = 0.05, higher_is_better: bool = True) -> DataFrame:
    """One row: statistic, p, best and worst model, significant pairs, and a sentence."""
    f = friedman(scores, None, higher_is_better)
    m = mean_ranks(scores, None, higher_is_better).agg(F.min_by("model", F.struct("mean_rank", "model")).alias("best"), F.max_by("model", F.struct("mean_rank", "model")).alias("worst"))
    p = nemenyi(scores, None, alpha, higher_is_better).where(F.col("p_value") < alpha).agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws("-", "model_a", "model_b"))), ";").alias("significant_pairs"))
    said = F.when(F.col("p_value") < alpha, F.concat(F.lit("models differ; best is "), F.col("best"))).otherwise("no significant difference")
    return f.join(F.broadcast(m)).join(F.broadcast(p)).select("chi2", "p_value", "best", "worst", "significant_pairs", said.alias("summary"))


def with_baseline(scores: DataFrame, group: str, baseline_group: str, baseline_models: list[str], into: list[str]) -> DataFrame:
    """The scores, plus the baseline models of one group relabelled into each of the other groups."""
    own = scores.where((F.col(group) == baseline_group) & F.col("model").isin(baseline_models))
    copies = own.withColumn(group, F.explode(F.array(*[F.lit(g) for g in into])))
    return scores.unionByName(copies)


def group_significance(scores: DataFrame, group: str = "group", alpha: float = 0.05) -> DataFrame:
    """Friedman per (group, metric), on the groups that have enough models and blocks."""
    return friedman(scores, [group, "metric"], True, require=False).where("chi2 IS NOT NULL").withColumn("significant", F.col("p_value") < alpha)


def fold_aggregate(folds: DataFrame, by: list[str]) -> DataFrame:
    """Mean and sample deviation of a fold metric, and its values in fold order; NaN is left out."""
    good = folds.where("value IS NOT NULL AND NOT isnan(value)")
    values = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("fold", "value"))), lambda s: F.bround(s["value"], 4).cast("string")), ";")
    return good.groupBy(*by).agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"), F.count("*").alias("folds"), values.alias("values"))


def experiment_ledger(folds: DataFrame, base_seed: int = 42) -> DataFrame:
    """One row per experiment and fold: its seed, and epsilon (infinite without privacy)."""
    return folds.groupBy("experiment", "fold").agg(F.count("*").alias("metrics"), F.coalesce(F.max("epsilon"), F.lit(float("inf"))).alias("epsilon")).withColumn("seed", F.lit(base_seed) + F.col("fold"))
