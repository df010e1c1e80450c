"""Projections, casts, text hygiene, row removal, duplicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from cleanloom.catalog.registry import null_token, percent, query, strip, to_numeric
from cleanloom.functions import text as X
from cleanloom.operators.base import dtype_of
from cleanloom.operators.rows import duplicate_count
from cleanloom.plans.recipe import apply_op, apply_recipe
from cleanloom.views import table, view, with_views

MESSY = "rid, o_orderkey, o_custkey, price, priority, price_txt, cust_txt, flag"


def _messy(spark, sf_dir):
    return view(spark, sf_dir, "orders_messy")


def _messy_sql(**changed: str) -> str:
    cols = ", ".join(f"{changed[c]} AS {c}" if c in changed else c for c in MESSY.split(", "))
    return with_views(["orders_messy"], f"SELECT {cols} FROM orders_messy")


@query("drop_column", "SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, "
       "l_returnflag, l_linestatus FROM lineitem")
def drop_column(spark, sf_dir):
    return apply_op(table(spark, sf_dir, "lineitem"), {"type": "drop_column", "column": "l_shipdate"})


@query("rename_column", "SELECT c_custkey, c_name, c_nationkey, c_acctbal AS balance, c_mktsegment FROM customer")
def rename_column(spark, sf_dir):
    return apply_op(table(spark, sf_dir, "customer"), {"type": "rename_column", "column": "c_acctbal", "to": " balance "})


INT_CAST = "CASE WHEN regexp_matches(cust_txt, '^[+-]?[0-9]+$') THEN try_cast(cust_txt AS BIGINT) END"


@query("cast_int", _messy_sql(cust_txt=INT_CAST))
def cast_int(spark, sf_dir):
    return apply_op(_messy(spark, sf_dir), {"type": "cast", "column": "cust_txt", "to": "Int64"})


@query("cast_float", _messy_sql(price_txt=to_numeric("price_txt"), cust_txt=f"CAST({INT_CAST} AS DOUBLE)"))
def cast_float(spark, sf_dir):
    ops = [{"type": "cast", "column": "cust_txt", "to": "Float64"},
           {"type": "cast", "column": "price_txt", "to": "Float64", "parse": "numeric"}]
    return apply_recipe(_messy(spark, sf_dir), ops)


@query("cast_string", "SELECT p_partkey, p_name, p_brand, p_type, CAST(p_size AS VARCHAR) AS p_size, p_retailprice FROM part")
def cast_string(spark, sf_dir):
    return apply_op(table(spark, sf_dir, "part"), {"type": "cast", "column": "p_size", "to": "String"})


@query("cast_bool", _messy_sql(flag="CASE WHEN flag = 'true' THEN true WHEN flag = 'false' THEN false END"))
def cast_bool(spark, sf_dir):
    return apply_op(_messy(spark, sf_dir), {"type": "cast", "column": "flag", "to": "Boolean"})


@query("trim_column", _messy_sql(priority=strip("priority")))
def trim_column(spark, sf_dir):
    return apply_op(_messy(spark, sf_dir), {"type": "trim", "column": "priority"}, row_id="rid")


@query("trim_all", f"SELECT doc_id, {strip('text')} AS text, {strip('lang')} AS lang, {strip('source')} AS source, n_chars FROM documents")
def trim_all(spark, sf_dir):
    return apply_op(table(spark, sf_dir, "documents"), {"type": "trim"})


@query("case_lower", _messy_sql(priority="lower(priority)"))
def case_lower(spark, sf_dir):
    return apply_op(_messy(spark, sf_dir), {"type": "normalize_case", "column": "priority"})


@query("case_upper", _messy_sql(flag="upper(flag)"))
def case_upper(spark, sf_dir):
    return apply_op(_messy(spark, sf_dir), {"type": "normalize_case", "column": "flag", "mode": "upper"})


@query("to_numeric", with_views(["orders_messy"], f"SELECT rid, price_txt, {to_numeric('price_txt')} AS price_num, "
                                f"{to_numeric('cust_txt')} AS cust_num, {to_numeric('flag')} AS flag_num FROM orders_messy"))
def to_numeric_view(spark, sf_dir):
    df = _messy(spark, sf_dir)
    nums = [X.to_numeric(F.col(c), dtype_of(df, c)).alias(n) for c, n in (("price_txt", "price_num"), ("cust_txt", "cust_num"), ("flag", "flag_num"))]
    return df.select("rid", "price_txt", *nums)


@query("numeric_ratio", with_views(["orders_messy"], " UNION ALL ".join(
    f"SELECT '{c}' AS name, count({e}) AS parsed, count(CASE WHEN {c}::VARCHAR <> '' THEN 1 END) AS nonblank, "
    f"round(count({e})::DOUBLE / greatest(count(CASE WHEN {c}::VARCHAR <> '' THEN 1 END), 1), 6) AS ratio FROM orders_messy"
    for c, e in (("price", "price"), ("priority", to_numeric("priority")), ("price_txt", to_numeric("price_txt")), ("cust_txt", to_numeric("cust_txt"))))))
def numeric_ratio(spark, sf_dir):
    from cleanloom.operators.profile import numeric_decision

    found = numeric_decision(_messy(spark, sf_dir), ["price", "priority", "price_txt", "cust_txt"])
    return found.select("name", "parsed", "nonblank", F.round("ratio", 6).alias("ratio"))


@query("null_token_count", with_views(["orders_messy"], " UNION ALL ".join(
    f"SELECT '{c}' AS name, count(CASE WHEN {null_token(c)} THEN 1 END) AS tokens FROM orders_messy" for c in ("priority", "price_txt", "cust_txt", "flag"))))
def null_token_count(spark, sf_dir):
    names = ["priority", "price_txt", "cust_txt", "flag"]
    one = _messy(spark, sf_dir).agg(*[F.count(F.when(X.is_null_token(F.col(c)), 1)).alias(c) for c in names])
    return one.unpivot([], names, "name", "tokens")


# --- rows -------------------------------------------------------------------


@query("drop_nulls_column", with_views(["orders_messy"], "SELECT * FROM orders_messy WHERE priority IS NOT NULL"))
def drop_nulls_column(spark, sf_dir):
    return apply_op(_messy(spark, sf_dir), {"type": "drop_nulls", "column": "priority"})


@query("drop_nulls_any", with_views(["orders_messy"], "SELECT * FROM orders_messy WHERE price IS NOT NULL AND priority IS NOT NULL "
                                    "AND price_txt IS NOT NULL AND cust_txt IS NOT NULL AND flag IS NOT NULL"))
def drop_nulls_any(spark, sf_dir):
    return apply_op(_messy(spark, sf_dir), {"type": "drop_nulls"})


def _without(rows: str) -> str:
    return ("SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (ORDER BY o_orderkey) - 1 AS rn FROM orders) "
            f"WHERE rn NOT IN ({rows})")


@query("drop_row", _without("1234"))
def drop_row(spark, sf_dir):
    return apply_op(table(spark, sf_dir, "orders"), {"type": "drop_row", "index": 1234}, order_by="o_orderkey")


@query("drop_rows_batch", _without("0, 7, 7, 500, 1499"))
def drop_rows_batch(spark, sf_dir):
    return apply_op(table(spark, sf_dir, "orders"), {"type": "drop_rows", "indices": [7, 0, 1499, 500, 7]}, order_by="o_orderkey")


@query("dedupe", with_views(["orders_messy"], "SELECT min(rid) AS rid, o_orderkey, o_custkey, price, priority, price_txt, cust_txt, flag "
                            "FROM orders_messy GROUP BY ALL"))
def dedupe(spark, sf_dir):
    return apply_op(_messy(spark, sf_dir), {"type": "drop_duplicates"}, row_id="rid")


@query("duplicate_count", "SELECT count(*) - (SELECT count(*) FROM (SELECT DISTINCT text, lang, source, n_chars FROM documents)) AS duplicates, "
       "count(*) AS rows FROM documents")
def duplicate_rows(spark, sf_dir):
    return duplicate_count(table(spark, sf_dir, "documents").select("text", "lang", "source", "n_chars"))
