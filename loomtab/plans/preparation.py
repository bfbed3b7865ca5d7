"""Queries over imputing, encoding, scaling and their inverses."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import audit, prep
from ..sources.io import params_checksum
from .registry import query, table

_T = """(SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_totalprice END AS price,
    CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_orderpriority END AS priority, o_orderstatus AS status FROM orders)"""


def _orders(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return o.select(
        "o_orderkey",
        F.when(F.col("o_orderkey") % 7 != 0, F.col("o_totalprice")).alias("price"),
        F.when(F.col("o_orderkey") % 11 != 0, F.col("o_orderpriority")).alias("priority"),
        F.col("o_orderstatus").alias("status"),
    )


def _fitted(spark, sf_dir, **how):
    o = _orders(spark, sf_dir)
    return o, prep.Preprocessor(["price"], ["priority", "status"], **how).fit(o)


_MODE = f"(SELECT priority FROM {_T} WHERE priority IS NOT NULL GROUP BY priority ORDER BY count(*) DESC, priority LIMIT 1)"
_MEDIAN = f"(SELECT median(price) FROM {_T})"
_IMPUTED = f"""(SELECT o_orderkey, coalesce(price, {_MEDIAN}) AS price, coalesce(priority, {_MODE}) AS priority, status,
    CASE WHEN price IS NULL THEN 1.0 ELSE 0.0 END AS price_is_missing, CASE WHEN priority IS NULL THEN 1.0 ELSE 0.0 END AS priority_is_missing FROM {_T})"""


@query(f"SELECT * FROM {_IMPUTED}", "price:4 price_is_missing priority_is_missing")
def impute(spark, sf_dir):
    o, p = _fitted(spark, sf_dir)
    return p.impute(o)


@query(f"SELECT * FROM {_T}", "price:4")
def impute_roundtrip(spark, sf_dir):
    o, p = _fitted(spark, sf_dir)
    return p.unimpute(p.impute(o))


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE 0.0 END AS status_F, CASE WHEN o_orderstatus = 'O' THEN 1.0 ELSE 0.0 END AS status_O, CASE WHEN o_orderstatus = 'P' THEN 1.0 ELSE 0.0 END AS status_P FROM orders", "status_F status_O status_P")
def onehot(spark, sf_dir):
    o = _orders(spark, sf_dir).select("o_orderkey", "status")
    return prep.Preprocessor([], ["status"]).fit(o).encode(o)


_DENSE = "(SELECT c_nationkey, row_number() OVER (ORDER BY CAST(c_nationkey AS VARCHAR)) - 1 AS i, count(*) OVER () AS k FROM (SELECT DISTINCT c_nationkey FROM customer))"


@query(f"SELECT c_custkey, CAST(i AS DOUBLE) / any_value(k) OVER () AS c_nationkey FROM customer JOIN {_DENSE} USING (c_nationkey)", "c_nationkey")
def label_encode(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    return prep.Preprocessor([], ["c_nationkey"]).fit(c).encode(c)


@query("SELECT c_custkey, CAST(c_nationkey AS VARCHAR) AS c_nationkey, c_mktsegment FROM customer")
def encode_roundtrip(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    p = prep.Preprocessor([], ["c_nationkey", "c_mktsegment"]).fit(c)
    return p.decode(p.encode(c)).select("c_custkey", "c_nationkey", "c_mktsegment")


def _scaled(how):
    def run(spark, sf_dir):
        o = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
        return prep.Preprocessor(["o_totalprice"], [], scaling=how, low=-1.0).fit(o).scale(o)

    run.__name__ = f"scale_{how}"
    return run


query("SELECT o_orderkey, (o_totalprice - lo) / (hi - lo) * 2 - 1 AS o_totalprice FROM orders, (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders)", "o_totalprice")(_scaled("minmax"))
query("SELECT o_orderkey, (ln(1 + o_totalprice) - lo) / (hi - lo) * 2 - 1 AS o_totalprice FROM orders, (SELECT min(ln(1 + o_totalprice)) AS lo, max(ln(1 + o_totalprice)) AS hi FROM orders)", "o_totalprice")(_scaled("log1p"))
query("SELECT o_orderkey, (o_totalprice - m) / s AS o_totalprice FROM orders, (SELECT avg(o_totalprice) AS m, stddev_samp(o_totalprice) AS s FROM orders)", "o_totalprice")(_scaled("standard"))


_ENCODED = f"""SELECT o_orderkey, (price - lo) / (hi - lo) AS price, price_is_missing, priority_is_missing,
    {', '.join(f"CASE WHEN status = '{s}' THEN 1.0 ELSE 0.0 END AS status_{s}" for s in 'FOP')}, i / 5.0 AS priority
    FROM {_IMPUTED} JOIN (SELECT DISTINCT priority, dense_rank() OVER (ORDER BY priority) - 1 AS i FROM {_IMPUTED}) USING (priority),
         (SELECT min(price) AS lo, max(price) AS hi FROM {_IMPUTED})"""
_ENCODED_DOUBLES = "price price_is_missing priority_is_missing status_F status_O status_P priority"


@query(_ENCODED, _ENCODED_DOUBLES)
def pipeline_encode(spark, sf_dir):
    o, p = _fitted(spark, sf_dir, encoding_by={"priority": "label"})
    return p.transform(o)


@query(_ENCODED, _ENCODED_DOUBLES)
def pipeline_encode_large(spark, sf_dir):
    """The same with the labels' categories kept in a table, numbered there and met by a join."""
    o, p = _fitted(spark, sf_dir, encoding_by={"priority": "label"}, large=3)
    return p.transform(o)


@query(f"SELECT * FROM {_T}", "price:3")
def pipeline_roundtrip_large(spark, sf_dir):
    """There and back through a parameter table whose categories stay in it."""
    o, p = _fitted(spark, sf_dir, encoding_by={"priority": "label"}, large=3)
    again = prep.Preprocessor(p.continuous, p.categorical, encoding_by=p.encoding_by, large=3).load(p.params_table(spark))
    return again.inverse(again.transform(o), order=["o_orderkey", "price", "priority", "status"])


@query(_ENCODED, _ENCODED_DOUBLES)
def vector_roundtrip(spark, sf_dir):
    """Encoded columns put into a vector and taken out of it again."""
    o, p = _fitted(spark, sf_dir, encoding_by={"priority": "label"})
    vectors = p.vector(p.transform(o)).select("o_orderkey", "features")
    return p.from_vector(vectors)


@query(f"SELECT * FROM {_T}", "price:3")
def pipeline_roundtrip(spark, sf_dir):
    o, p = _fitted(spark, sf_dir, encoding_by={"priority": "label"})
    return p.inverse(p.transform(o), order=["o_orderkey", "price", "priority", "status"])


@query(
    f"""SELECT 'impute' AS stage, 'price' AS col, 'fill' AS key, 0 AS ord, {_MEDIAN} AS num, NULL AS str
    UNION ALL SELECT 'impute', 'status', 'fill', 0, NULL, (SELECT status FROM {_T} GROUP BY status ORDER BY count(*) DESC, status LIMIT 1)
    UNION ALL SELECT 'impute', 'priority', 'fill', 0, NULL, {_MODE}
    UNION ALL SELECT 'onehot', 'status', 'category', row_number() OVER (ORDER BY status) - 1, NULL, status FROM (SELECT DISTINCT status FROM {_T})
    UNION ALL SELECT 'onehot', 'priority', 'category', row_number() OVER (ORDER BY priority) - 1, NULL, priority FROM (SELECT DISTINCT priority FROM {_T} WHERE priority IS NOT NULL)""",
    "num:4",
)
def params_table(spark, sf_dir):
    _, p = _fitted(spark, sf_dir)
    return p.params_table(spark).where("key IN ('fill', 'category')")


@query(f"SELECT count(*) AS checksums FROM (SELECT 1 FROM {_T} LIMIT 1)")
def params_integrity(spark, sf_dir):
    _, p = _fitted(spark, sf_dir)
    t = p.params_table(spark)
    shuffled = params_checksum(t.orderBy(F.desc("key"), F.desc("col")))
    return params_checksum(t).join(shuffled, "checksum").agg(F.count("*").alias("checksums"))


@query(f"SELECT o_orderkey, (price - lo) / (hi - lo) AS f0, {', '.join(f"CASE WHEN status = '{s}' THEN 1.0 ELSE 0.0 END AS f{i + 1}" for i, s in enumerate('FOP'))} FROM (SELECT o_orderkey, coalesce(price, {_MEDIAN}) AS price, status FROM {_T}), (SELECT min(price) AS lo, max(price) AS hi FROM {_T})", "f0 f1 f2 f3")
def feature_vector(spark, sf_dir):
    o = _orders(spark, sf_dir).drop("priority")
    p = prep.Preprocessor(["price"], ["status"]).fit(o)
    v = p.vector(p.transform(o), "features")
    return v.select("o_orderkey", *[F.col("features")[i].alias(f"f{i}") for i in range(4)])


_E = "(SELECT event_id, user_id, CASE WHEN event_id % 3 = 0 THEN NULL ELSE value END AS value FROM events)"


def _events(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", "user_id", F.when(F.col("event_id") % 3 != 0, F.col("value")).alias("value"))


@query(f"SELECT event_id, user_id, last_value(value IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS value FROM {_E}", "value")
def ffill(spark, sf_dir):
    return prep.forward_fill(_events(spark, sf_dir), ["user_id"], "event_id", ["value"])


_B, _A = "PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING", "PARTITION BY user_id ORDER BY event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING"


@query(
    f"""SELECT event_id, user_id, coalesce(value, x0 + (x1 - x0) * (event_id - t0) / (t1 - t0)) AS value FROM (SELECT *,
    last_value(CASE WHEN value IS NOT NULL THEN CAST(event_id AS DOUBLE) END IGNORE NULLS) OVER ({_B}) AS t0, first_value(CASE WHEN value IS NOT NULL THEN CAST(event_id AS DOUBLE) END IGNORE NULLS) OVER ({_A}) AS t1,
    last_value(value IGNORE NULLS) OVER ({_B}) AS x0, first_value(value IGNORE NULLS) OVER ({_A}) AS x1 FROM {_E})""",
    "value:3",
)
def interpolate(spark, sf_dir):
    return prep.interpolate(_events(spark, sf_dir), ["user_id"], "event_id", ["value"])


@query(f"SELECT event_id, user_id, coalesce(value, -999.0) AS value, CASE WHEN value IS NULL THEN 1.0 ELSE 0.0 END AS value_is_missing FROM {_E}", "value value_is_missing")
def sentinel_fill(spark, sf_dir):
    return prep.sentinel_fill(_events(spark, sf_dir), ["value"])


@query("SELECT c_custkey, sha256('s' || c_name) AS c_name FROM customer")
def mask_identifiers(spark, sf_dir):
    return audit.mask_identifiers(table(spark, sf_dir, "customer").select("c_custkey", "c_name"), ["c_name"], "s")


@query("SELECT o_orderkey, CAST(floor(o_totalprice / 10000) * 10000 AS DOUBLE) AS o_totalprice, CAST(date_trunc('month', o_orderdate) AS TIMESTAMP) AS o_orderdate FROM orders", "o_totalprice")
def generalize(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", F.col("o_orderdate").cast("timestamp").alias("o_orderdate"))
    return audit.generalize(o, {"o_totalprice": 10000.0}, {"o_orderdate": "month"}).withColumn("o_orderdate", F.col("o_orderdate").cast("timestamp_ntz"))


_G = 'SELECT least(floor((l_quantity - ql) / ((qh - ql) / 10)), 9) AS bx, least(floor((l_discount - dl) / ((dh - dl) / 10)), 9) AS "by" FROM lineitem, (SELECT min(l_quantity) AS ql, max(l_quantity) AS qh, min(l_discount) AS dl, max(l_discount) AS dh FROM lineitem)'


@query(f'SELECT CAST(bx AS BIGINT) AS bx, CAST("by" AS BIGINT) AS "by", count(*) AS n FROM ({_G}) GROUP BY ALL')
def hist2d(spark, sf_dir):
    return audit.histogram_2d(table(spark, sf_dir, "lineitem"), "l_quantity", "l_discount")


_SPEC_COLS = {"c_custkey": True, "c_name": False, "c_nationkey": True, "c_acctbal": True, "c_mktsegment": False}


@query(
    " UNION ALL ".join(
        f"""SELECT '{c}' AS col, CASE WHEN count(DISTINCT {c}) = count({c}) AND count({c}) > 10 AND {str(c != 'c_acctbal').lower()} THEN 'identifier'
        WHEN {str(not n).lower()} OR count(DISTINCT {c}) <= 10 THEN 'categorical' ELSE 'continuous' END AS role, count(DISTINCT {c}) AS "distinct",
        {f'CAST(min({c}) AS DOUBLE)' if n else 'NULL'} AS min, {f'CAST(max({c}) AS DOUBLE)' if n else 'NULL'} AS max FROM customer"""
        for c, n in _SPEC_COLS.items()
    ),
    "min max",
)
def infer_spec(spark, sf_dir):
    return audit.infer_spec(table(spark, sf_dir, "customer"))
