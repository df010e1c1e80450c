"""Missing values."""

from __future__ import annotations

from pyspark.sql import functions as F

from cleanloom.catalog.registry import query
from cleanloom.plans.recipe import apply_op
from cleanloom.views import view, with_views

COLS = "o_orderkey, o_custkey, priority, price_txt, cust_txt, flag"


def _fill(spark, sf_dir, op, name="orders_messy", **order):
    return apply_op(view(spark, sf_dir, name), {"type": "fill_null", **op}, **order)


def _rounded(df, column):
    return df.withColumn(column, F.round(column, 4))


@query("fill_mean", with_views(["orders_messy"], f"SELECT rid, {COLS}, round(coalesce(price, (SELECT avg(price) FROM orders_messy)), 4) AS price FROM orders_messy"))
def fill_mean(spark, sf_dir):
    return _rounded(_fill(spark, sf_dir, {"column": "price", "strategy": "mean"}), "price")


@query("fill_median", with_views(["orders_messy"], f"SELECT rid, {COLS}, round(coalesce(price, (SELECT quantile_cont(price, 0.5) FROM orders_messy)), 4) AS price FROM orders_messy"))
def fill_median(spark, sf_dir):
    return _rounded(_fill(spark, sf_dir, {"column": "price", "strategy": "median"}), "price")


@query("fill_mode", with_views(["orders_messy"], "SELECT rid, o_orderkey, o_custkey, price, coalesce(priority, (SELECT priority FROM orders_messy "
                               "WHERE priority IS NOT NULL GROUP BY priority ORDER BY count(*) DESC, priority LIMIT 1)) AS priority, price_txt, cust_txt, flag FROM orders_messy"))
def fill_mode(spark, sf_dir):
    return _fill(spark, sf_dir, {"column": "priority", "strategy": "mode"})


@query("fill_forward", with_views(["events_gaps"], "SELECT event_id, user_id, event_type, last_value(value IGNORE NULLS) OVER (ORDER BY event_id) AS value FROM events_gaps"))
def fill_forward(spark, sf_dir):
    return _fill(spark, sf_dir, {"column": "value", "strategy": "forward"}, "events_gaps", order_by="event_id")


@query("fill_forward_by_key", with_views(["events_gaps"], "SELECT event_id, user_id, event_type, last_value(value IGNORE NULLS) OVER "
                                         "(PARTITION BY event_type ORDER BY event_id) AS value FROM events_gaps"))
def fill_forward_by_key(spark, sf_dir):
    return _fill(spark, sf_dir, {"column": "value", "strategy": "forward", "partition_by": "event_type"}, "events_gaps", order_by="event_id")


@query("fill_constant_num", with_views(["orders_messy"], f"SELECT rid, {COLS}, coalesce(price, 12.5) AS price FROM orders_messy"))
def fill_constant_num(spark, sf_dir):
    return _fill(spark, sf_dir, {"column": "price", "strategy": "constant", "value": "12.5"})


@query("fill_constant_text", with_views(["orders_messy"], "SELECT rid, o_orderkey, o_custkey, price, coalesce(priority, 'Unknown') AS priority, "
                                        "price_txt, cust_txt, flag FROM orders_messy"))
def fill_constant_text(spark, sf_dir):
    return _fill(spark, sf_dir, {"column": "priority", "strategy": "constant", "value": "Unknown"})


KNN_SQL = """
, s AS (SELECT avg(c_custkey) AS m1, coalesce(nullif(stddev_samp(c_custkey), 0), 1) AS s1,
               avg(c_nationkey) AS m2, coalesce(nullif(stddev_samp(c_nationkey), 0), 1) AS s2 FROM customer_gaps),
z AS (SELECT c_custkey, acctbal, (c_custkey - m1) / s1 AS z1, (c_nationkey - m2) / s2 AS z2 FROM customer_gaps, s),
p AS (SELECT a.c_custkey, b.acctbal, row_number() OVER (PARTITION BY a.c_custkey
        ORDER BY round(sqrt((power(a.z1 - b.z1, 2) + power(a.z2 - b.z2, 2)) / 2), 9), b.c_custkey) AS rn
      FROM z a JOIN z b ON a.acctbal IS NULL AND b.acctbal IS NOT NULL),
f AS (SELECT c_custkey, avg(acctbal) AS est FROM p WHERE rn <= 5 GROUP BY c_custkey)
SELECT g.c_custkey, g.c_nationkey, round(coalesce(g.acctbal, f.est), 4) AS acctbal FROM customer_gaps g LEFT JOIN f USING (c_custkey)
"""


@query("knn_impute", with_views(["customer_gaps"], KNN_SQL))
def knn_impute(spark, sf_dir):
    out = apply_op(view(spark, sf_dir, "customer_gaps"), {"type": "knn_impute", "column": "acctbal", "k": 5}, order_by="c_custkey")
    return _rounded(out, "acctbal")


@query("knn_fallback", with_views(["customer_gaps"], "SELECT round(coalesce(acctbal, (SELECT quantile_cont(acctbal, 0.5) FROM customer_gaps)), 4) AS acctbal FROM customer_gaps"))
def knn_fallback(spark, sf_dir):
    only = view(spark, sf_dir, "customer_gaps").select("acctbal")
    return _rounded(apply_op(only, {"type": "knn_impute", "column": "acctbal"}), "acctbal")
