"""Running sums, ranks and exact quantiles of columns of any size.

A group's distinct values are cut into ranges at approximate quantiles.  The ranges are summed first;
within a range a window adds the rest, so that no task gathers a whole column.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.io import scratch_folder

#: Ranges of a group's values, and how many of them are told apart together.
RANGES, BLOCK = 64, 8


def in_order(rows: DataFrame, order: list[Column], sums: dict[str, str], index: str = "at") -> DataFrame:
    """``rows`` with their place in ``order`` (from 0) and, per column of ``sums``, its sum over the rows before; any type has an order.

    Rows are range-partitioned and sorted, and written with their partition and place; partitions are summed
    first, and what lies before a partition is added to what lies before a row in it.
    """
    path = scratch_folder(rows.sparkSession, "in-order")
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    dealt.withColumn("_mark", F.monotonically_increasing_id()).write.parquet(path)
    placed = rows.sparkSession.read.parquet(path).withColumn("_part", F.shiftright("_mark", 33))
    parts = placed.groupBy("_part").agg(F.count("*").alias("_rows"), *[F.sum(c).alias(f"_{out}") for c, out in sums.items()])
    w = W.partitionBy(F.lit(0)).orderBy("_part")  # one row for each partition of the shuffle
    before = parts.select("_part", (F.sum("_rows").over(w) - F.col("_rows")).alias("_rows"), *[(F.sum(f"_{out}").over(w) - F.col(f"_{out}")).alias(f"_{out}") for out in sums.values()])
    inner = W.partitionBy("_part").orderBy("_mark")
    met = placed.join(F.broadcast(before), "_part")
    place = F.col("_rows") + F.col("_mark").bitwiseAND(F.lit((1 << 33) - 1))
    return met.select(*rows.columns, place.alias(index), *[(F.col(f"_{out}") + F.sum(c).over(inner) - F.col(c)).alias(out) for c, out in sums.items()])


def in_ranges(counts: DataFrame, by: list[str], value: str, name: str = "part") -> DataFrame:
    """``counts`` with the number of its value's range; nulls and NaN, being last or first, have a range of their own."""
    x = F.col(value).cast("double")
    fractions = F.array(*[F.lit(i / RANGES) for i in range(1, RANGES)])
    edges = counts.groupBy(*by).agg(F.percentile_approx(F.when(~F.isnan(x), x), fractions, 1000).alias("_edges"))
    # RANGES - 1 numbers for each group of ``by``, which are names of columns and the like
    met = counts.join(F.broadcast(edges), by) if by else counts.join(F.broadcast(edges))
    # edges below a value: whole blocks of BLOCK by their last ones, then those of the next block
    below = lambda edges: F.size(F.filter(edges, lambda e: e < x))
    blocks = below(F.array(*[F.get("_edges", F.lit(i)) for i in range(BLOCK - 1, RANGES - 1, BLOCK)]))
    met = met.withColumn("_blocks", F.when(F.col("_edges").isNotNull(), blocks))
    own = F.col("_blocks") * BLOCK + below(F.slice("_edges", F.col("_blocks") * BLOCK + 1, BLOCK - 1))
    part = F.when(x.isNull(), -1).when(F.isnan(x), RANGES).otherwise(F.coalesce(own, F.lit(0)))
    return met.withColumn(name, part.cast("int")).drop("_edges", "_blocks")


def sums_below(counts: DataFrame, by: list[str], value: str, sums: dict[str, str]) -> DataFrame:
    """``counts`` (one row per ``by`` and value) with, per column of ``sums``, under the given name, its sum over smaller values."""
    placed = in_ranges(counts, by, value, "_part")
    parts = placed.groupBy(*by, "_part").agg(*[F.sum(c).alias(f"_{out}") for c, out in sums.items()])
    w = W.partitionBy(*by, F.lit(0)).orderBy("_part")  # RANGES + 2 rows for each group
    before = parts.select(*by, "_part", *[(F.sum(f"_{out}").over(w) - F.col(f"_{out}")).alias(f"_{out}") for out in sums.values()])
    inner = W.partitionBy(*by, "_part").orderBy(value)
    met = placed.join(F.broadcast(before), [*by, "_part"])
    return met.select(*counts.columns, *[(F.col(f"_{out}") + F.sum(c).over(inner) - F.col(c)).alias(out) for c, out in sums.items()])


def exact_quantiles(rows: DataFrame, by: list[str], q: tuple[float, ...], x: str = "x", weight: str | None = None) -> DataFrame:
    """(by..., q): the interpolated quantiles of each group's values, in the order of ``q``; a row counts once, or ``weight`` times."""
    counts = rows.where(F.col(x).isNotNull()).groupBy(*by, x).agg((F.sum(weight) if weight else F.count("*")).alias("_n"))
    placed = in_ranges(counts, by, x, "_part")
    parts = placed.groupBy(*by, "_part").agg(F.sum("_n").alias("_size"))
    group = W.partitionBy(*by, F.lit(0))  # RANGES + 2 rows each
    before = parts.select(*by, "_part", "_size", (F.sum("_size").over(group.orderBy("_part")) - F.col("_size")).alias("_before"), F.sum("_size").over(group).alias("_all"))
    # a quantile concerns the rows at its place, rounded down and up: first which ranges, then which values hold them
    held = lambda p, low, size: ((F.col("_all") - 1) * p > low - 1) & ((F.col("_all") - 1) * p < low + size)
    grid = F.array(*[F.lit(float(p)) for p in sorted(set(q))])
    before = before.withColumn("_grid", F.filter(grid, lambda p: held(p, F.col("_before"), F.col("_size")))).where(F.size("_grid") > 0).drop("_size")
    inner = W.partitionBy(*by, "_part").orderBy(x)
    met = placed.join(F.broadcast(before), [*by, "_part"]).withColumn("_low", F.col("_before") + F.sum("_n").over(inner) - F.col("_n"))
    low, end, at = F.col("_low"), F.col("_low") + F.col("_n"), (F.col("_all") - 1) * F.col("p")
    each = met.select(*by, x, "_low", "_n", "_all", F.explode(F.filter("_grid", lambda p: held(p, low, F.col("_n")))).alias("p"))
    has = lambda i: (i >= low) & (i < end)
    ends = each.groupBy(*by, "p").agg(F.max(F.when(has(F.floor(at)), F.col(x))).alias("a"), F.max(F.when(has(F.ceil(at)), F.col(x))).alias("b"), F.max(at).alias("at"))
    value = F.when(F.col("a") == F.col("b"), F.col("a")).otherwise((F.ceil("at") - F.col("at")) * F.col("a") + (F.col("at") - F.floor("at")) * F.col("b"))
    known = F.map_from_entries(F.collect_list(F.struct("p", value.cast("double").alias("v"))))  # as many as ``q`` has
    return ends.groupBy(*by).agg(known.alias("_known")).select(*by, F.array(*[F.element_at("_known", F.lit(float(p))) for p in q]).alias("q"))
