"""Splits and samples that depend on keys, not on partitions: the same rows whatever the layout."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from .running import in_ranges


def hashed(*keys: str, seed: int = 42) -> Column:
    return F.xxhash64(*keys, F.lit(seed))


def _ranks(df: DataFrame, keys: list[str], by: list[str], seed: int, order: list[Column] | None) -> DataFrame:
    """``df`` with _rank (from 0) and _size within groups ``by``, in hash order.

    Ranks are built from counts per hash range, so that a class of any size spreads over partitions.
    """
    own = order or [hashed(*keys, seed=seed), *[F.col(k) for k in keys]]
    marked = df.withColumn("_h", own[0])
    if not order:
        marked = marked.withColumn("_part", F.shiftrightunsigned(F.col("_h"), 48).cast("int").bitwiseXOR(F.lit(1 << 15)))
    elif isinstance(marked.schema["_h"].dataType, NumericType):
        marked = in_ranges(marked, [], "_h", "_part")
    else:  # other orders have no ranges to sum first
        marked = marked.withColumn("_part", F.lit(0))
    groups = [*[F.coalesce(F.col(c).cast("string"), F.lit("\x00")).alias(f"_g{i}") for i, c in enumerate(by)]]
    marked = marked.select("*", *groups)
    names = [f"_g{i}" for i in range(len(by))]
    counts = marked.groupBy(*names, "_part").agg(F.count("*").alias("_n"))
    w = W.partitionBy(*names) if names else W.partitionBy(F.lit(1))
    base = counts.select(*names, "_part", (F.sum("_n").over(w.orderBy("_part")) - F.col("_n")).alias("_base"), F.sum("_n").over(w).alias("_size"))
    inner = W.partitionBy(*names, "_part").orderBy("_h", *own[1:])
    met = marked.withColumn("_in", F.row_number().over(inner) - 1).join(F.broadcast(base) if not names else base, [*names, "_part"])
    return met.withColumn("_rank", F.col("_base") + F.col("_in")).drop("_h", "_part", "_in", "_base", *names)


def split_share(df: DataFrame, keys: list[str], share: float = 0.8, by: list[str] | None = None, seed: int = 42, order: list[Column] | None = None) -> DataFrame:
    """Adds split: 'train' for the first ``share`` of each group (exactly floor(share * n)), else 'test'."""
    ranked = _ranks(df, keys, by or [], seed, order)
    return ranked.withColumn("split", F.when(F.col("_rank") < F.floor(F.lit(share) * F.col("_size")), "train").otherwise("test")).drop("_rank", "_size")


def stratified_split(df: DataFrame, keys: list[str], target: str, share: float = 0.8, seed: int = 42, order: list[Column] | None = None) -> DataFrame:
    """Split by class if there are at most 20 classes of at least 2 rows each; else at random."""
    classes = df.groupBy(target).count().limit(21).collect()
    good = len(classes) <= 20 and min((r["count"] for r in classes), default=0) >= 2
    return split_share(df, keys, share, [target] if good else None, seed, order)


def kfold(df: DataFrame, keys: list[str], k: int = 5, by: list[str] | None = None, seed: int = 42, order: list[Column] | None = None) -> DataFrame:
    """Adds fold (0 to k - 1), even within each group."""
    return _ranks(df, keys, by or [], seed, order).withColumn("fold", (F.col("_rank") % k).cast("int")).drop("_rank", "_size")


def sample_exact(df: DataFrame, keys: list[str], n: int, seed: int = 42) -> DataFrame:
    """Exactly n rows (or all), those whose keys hash lowest."""
    return df.orderBy(hashed(*keys, seed=seed), *keys).limit(n)


def balanced_resample(df: DataFrame, keys: list[str], cols: list[str], n: int, seed: int = 42, log_frequency: bool = False) -> DataFrame:
    """n rows drawn so that each draw picks a column evenly, then one of its categories, then a row of it.

    Categories are even, or weighted by the log of their frequency.  The draws are spread over
    partitions; rows meet them by their rank within the category.
    """
    values = df.select(*keys, *cols).unpivot([F.col(k) for k in keys], cols, "col", "value").where("value IS NOT NULL")
    ranked = _ranks(values, keys, ["col", "value"], seed, None).withColumnRenamed("_size", "_n")
    cats = values.groupBy("col", "value").agg(F.count("*").alias("n"))
    weight = F.log1p("n") if log_frequency else F.lit(1.0)
    w = W.partitionBy("col")
    cats = cats.withColumn("w", weight)
    cats = cats.withColumns({"hi": F.sum("w").over(w.orderBy("value")) / F.sum("w").over(w)})
    cats = cats.withColumn("lo", F.coalesce(F.lag("hi").over(w.orderBy("value")), F.lit(0.0)))
    unit = lambda salt: F.pmod(F.xxhash64(F.col("draw"), F.lit(seed), F.lit(salt)), F.lit(1 << 52)) / float(1 << 52)
    names = F.array(*[F.lit(c) for c in cols])
    draws = df.sparkSession.range(n).withColumnRenamed("id", "draw").select("draw", F.element_at(names, (F.floor(unit(1) * len(cols)) + 1).cast("int")).alias("col"), unit(2).alias("u"), unit(3).alias("v"))
    # the categories are as few as the declared domains
    met = draws.join(F.broadcast(cats.select("col", "value", "lo", "hi", "n")), "col").where("u >= lo AND u < hi")
    picked = met.select("draw", "col", "value", F.floor(F.col("v") * F.col("n")).alias("_rank"))
    return picked.join(ranked, ["col", "value", "_rank"]).select("draw", "col", "value", *keys)
