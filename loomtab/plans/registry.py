"""All registered queries of the table operators and the SQL that DuckDB checks them with.

A query's doubles are rounded on both sides: to six places, or to as many as ``digits`` names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]

_found: dict[str, tuple[Query, str | None]] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame, digits: dict[str, int]) -> DataFrame:
    return df.select(*[(F.round(F.col(f"`{c}`"), digits.get(c, 6)) + 0.0).alias(c) if t == "double" else F.col(f"`{c}`") for c, t in df.dtypes])


def query(sql: str | None = None, doubles: str = ""):
    """Register a function of (spark, sf_dir) under its name.

    ``doubles``: the double columns of the SQL, each with its digits if they aren't six ("mean:4 std").
    """
    digits = {c: int(n or 6) for c, _, n in (d.partition(":") for d in doubles.split())}

    def take(f: Query) -> Query:
        own = sql
        if sql and digits:
            own = f"SELECT * REPLACE ({', '.join(f'round({c}, {n}) + 0.0 AS {c}' for c, n in digits.items())}) FROM ({sql})"
        _found[f.__name__] = (lambda spark, sf_dir: rounded(f(spark, sf_dir), digits), own)
        return f

    return take


def _load() -> None:
    from . import associations, audits, comparisons, distances, inputs, preparation, privacies, profiles, rulings, syntheses  # noqa: F401


def queries() -> dict[str, Query]:
    _load()
    return {k: f for k, (f, _) in _found.items()}


def oracle_sql() -> dict[str, str]:
    _load()
    return {k: s for k, (_, s) in _found.items() if s}


# --- fragments ---

NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
KINDS = ["l_returnflag", "l_linestatus"]


def long_sql(cols: list[str], source: str, keep: str = "", value: str = "x", kind: str = "DOUBLE") -> str:
    """Union of all columns of ``source`` as (keep, col, value), nulls left out."""
    lead = f"{keep}, " if keep else ""
    return " UNION ALL ".join(f"SELECT {lead}'{c}' AS col, CAST({c} AS {kind}) AS {value} FROM {source} WHERE {c} IS NOT NULL" for c in cols)


def halves(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """lineitem by the parity of its order: the real and the synthetic table."""
    li = table(spark, sf_dir, "lineitem")
    return li.where("l_orderkey % 2 = 0"), li.where("l_orderkey % 2 = 1")


SRC = "(SELECT *, CASE WHEN l_orderkey % 2 = 0 THEN 'real' ELSE 'synth' END AS src FROM lineitem)"
