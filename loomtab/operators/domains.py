"""Large domains: categories that stay a table, numbered and looked up by joins.

A dictionary has a row for each category of a column: col, ord (its place in the order of values), value,
n (rows that hold it), low and all (rows of more frequent categories, and of all).  Nothing of it is collected but
the ``HOT`` most frequent categories of a column, whose rows meet them by broadcast, so that a category
that a third of all rows hold isn't one task's; the other rows meet the dictionary in a join that is
broadcast only if it was counted to be small.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.io import scratch_folder
from .running import in_order

#: Most frequent categories that are met by broadcast; rows up to which a whole dictionary is broadcast.
HOT, BROADCAST_ROWS = 1000, 200_000


def kept_table(df: DataFrame, label: str) -> DataFrame:
    """``df``, written into the shared folder and read again."""
    path = scratch_folder(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dictionary(counts: DataFrame) -> DataFrame:
    """The dictionary of (col, value, n), one row for each category."""
    named = in_order(counts.select("col", "value", "n"), [F.col("col"), F.col("value")], {}, "ord")
    shared = in_order(named, [F.col("col"), F.desc("n"), F.col("value")], {"n": "low"}, "_at")
    # one row for each column
    first = shared.groupBy("col").agg(F.min("ord").alias("_ord"), F.min("low").alias("_low"), F.sum("n").alias("all"))
    met = shared.join(F.broadcast(first), "col")
    return kept_table(met.select("col", (F.col("ord") - F.col("_ord")).alias("ord"), "value", "n", (F.col("low") - F.col("_low")).alias("low"), "all"), "dictionary")


def hottest(entries: DataFrame) -> DataFrame:
    """The HOT most frequent categories of a dictionary of one column."""
    return entries.orderBy(F.desc("n"), "ord").limit(HOT)


def looked_up(df: DataFrame, entries: DataFrame, on: str, key: str, take: str, name: str) -> DataFrame:
    """``df`` with ``name``: the ``take`` of the entry whose ``key`` equals its column ``on``; null if there is none."""
    own = entries.select(F.col(key).alias("_key"), F.col(take).alias(name), F.lit(True).alias("_known"))
    if entries.count() <= BROADCAST_ROWS:
        return df.join(F.broadcast(own), F.col(f"`{on}`") == F.col("_key"), "left").drop("_key", "_known")
    hot = F.broadcast(kept_table(hottest(entries).select(F.col(key).alias("_key"), F.col(take).alias(name), F.lit(True).alias("_known")), "hot"))
    often = df.join(hot, F.col(f"`{on}`") == F.col("_key"))
    # null keys need no join and would all go to one task
    rest = df.where(F.col(f"`{on}`").isNotNull()).join(hot.select("_key"), F.col(f"`{on}`") == F.col("_key"), "left_anti")
    seldom = rest.join(own.hint("shuffle_hash"), F.col(f"`{on}`") == F.col("_key"), "left")
    none = df.where(F.col(f"`{on}`").isNull()).withColumn(name, F.lit(None).cast(dict(own.dtypes)[name]))
    return often.drop("_key", "_known").unionByName(seldom.drop("_key", "_known")).unionByName(none)


def drawn(df: DataFrame, entries: DataFrame, on: str, name: str) -> DataFrame:
    """``df`` with ``name``: the category in whose part of the shares (the frequent first) the column ``on``, from 0 to below 1, falls.

    Shares are cut into as many cells as there are categories; a category lies in each cell that its part
    touches.  A cell's categories and draws meet by an equi-join, and inside it by their places.
    """
    cells = max(1, entries.count())
    low, high = F.col("low") / F.col("all"), (F.col("low") + F.col("n")) / F.col("all")
    at = lambda u: F.least(F.floor(u * cells), F.lit(cells - 1))
    parts = entries.select(low.alias("_low"), high.alias("_high"), F.col("value").alias(name), F.explode(F.sequence(at(low), at(high))).alias("_cell")).where("_low < _high")
    parts = kept_table(parts, "shares")
    asked = df.withColumn("_of", at(F.col(on)))
    small = parts.count() <= BROADCAST_ROWS
    met = asked.join(F.broadcast(parts) if small else parts, (F.col("_of") == F.col("_cell")) & (F.col(on) >= F.col("_low")) & ((F.col(on) < F.col("_high")) | (F.col("_high") >= 1)), "left")
    return met.drop("_of", "_cell", "_low", "_high")
