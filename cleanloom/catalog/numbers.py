"""Quantiles, outliers, scaling, isolation forest."""

from __future__ import annotations

from pyspark.sql import functions as F

from cleanloom.catalog.registry import half_up, percent, query
from cleanloom.operators import forest
from cleanloom.operators.base import RowOrder
from cleanloom.operators.outliers import iqr_bounds, outlier_report
from cleanloom.operators.scaling import feature_matrix
from cleanloom.plans.quantiles import exact_quantiles
from cleanloom.plans.recipe import apply_op
from cleanloom.views import table, with_views

BOUNDS = ("b AS (SELECT quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3 FROM {t}), "
          "l AS (SELECT q1, q3, q3 - q1 AS iqr, q1 - {m} * (q3 - q1) AS lower, q3 + {m} * (q3 - q1) AS upper FROM b)")


def _bounds(table_name: str, column: str, m: float) -> str:
    return BOUNDS.format(t=table_name, c=column, m=m)


@query("percentiles", " UNION ALL ".join(
    f"SELECT '{c}' AS name, " + ", ".join(f"round(quantile_cont({c}, {p / 100}), 4) AS p{p}" for p in (1, 25, 50, 75, 99)) + " FROM lineitem"
    for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")))
def percentiles(spark, sf_dir):
    columns, probs = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"], (1, 25, 50, 75, 99)
    found = exact_quantiles(table(spark, sf_dir, "lineitem"), {c: F.col(c) for c in columns}, [p / 100 for p in probs])
    rows = [(c, *found[c]) for c in columns]
    raw = spark.createDataFrame(rows, "name string, " + ", ".join(f"p{p} double" for p in probs))
    return raw.select("name", *[F.round(f"p{p}", 4).alias(f"p{p}") for p in probs])


@query("iqr_bounds", f"WITH {_bounds('events', 'value', 1.5)} SELECT " + ", ".join(f"round({c}, 4) AS {c}" for c in ("q1", "q3", "iqr", "lower", "upper")) + " FROM l")
def bounds(spark, sf_dir):
    b = iqr_bounds(table(spark, sf_dir, "events"), "value")
    raw = spark.createDataFrame([tuple(b.values())], ", ".join(f"{n} double" for n in b))
    return raw.select(*[F.round(c, 4).alias(c) for c in raw.columns])


@query("iqr_cap", f"WITH {_bounds('events', 'value', 1.5)} SELECT event_id, ts, user_id, event_type, "
       "round(CASE WHEN value > upper THEN upper WHEN value < lower THEN lower ELSE value END, 4) AS value, props FROM events, l")
def iqr_cap(spark, sf_dir):
    out = apply_op(table(spark, sf_dir, "events"), {"type": "cap_outliers", "column": "value", "multiplier": 1.5})
    return out.withColumn("value", F.round("value", 4))


@query("iqr_cap_int", f"WITH {_bounds('part', 'p_size', 0.1)} SELECT p_partkey, p_name, p_brand, p_type, CAST(CASE WHEN p_size > floor(upper) THEN floor(upper) "
       "WHEN p_size < ceil(lower) THEN ceil(lower) ELSE p_size END AS INTEGER) AS p_size, p_retailprice FROM part, l")
def iqr_cap_int(spark, sf_dir):
    return apply_op(table(spark, sf_dir, "part"), {"type": "cap_outliers", "column": "p_size", "multiplier": 0.1})


@query("iqr_drop", f"WITH {_bounds('events', 'value', 1.5)} SELECT event_id, ts, user_id, event_type, value, props FROM events, l "
       "WHERE value BETWEEN lower AND upper OR value IS NULL")
def iqr_drop(spark, sf_dir):
    return apply_op(table(spark, sf_dir, "events"), {"type": "drop_outliers", "column": "value"})


@query("outlier_report", f"WITH {_bounds('events', 'value', 3.0)} SELECT count(CASE WHEN value < lower OR value > upper THEN 1 END) AS count, "
       f"{percent('count(CASE WHEN value < lower OR value > upper THEN 1 END)', 'count(value)')} AS pct, "
       f"{half_up('any_value(lower)', 4)} AS lower_bound, {half_up('any_value(upper)', 4)} AS upper_bound, 3.0::DOUBLE AS multiplier FROM events, l")
def report(spark, sf_dir):
    return outlier_report(table(spark, sf_dir, "events"), "value", 3.0)


def _scaled(expr: str) -> str:
    return ("WITH s AS (SELECT avg(l_extendedprice) AS m, stddev_samp(l_extendedprice) AS sd, min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem) "
            f"SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, {half_up(expr, 6)} AS l_extendedprice FROM lineitem, s")


def _scale(spark, sf_dir, scaler):
    df = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice")
    return apply_op(df, {"type": "scale", "column": "l_extendedprice", "scaler": scaler})


@query("scale_standard", _scaled("(l_extendedprice - m) / coalesce(nullif(sd, 0), 1)"))
def scale_standard(spark, sf_dir):
    return _scale(spark, sf_dir, "standard")


@query("scale_minmax", _scaled("(l_extendedprice - lo) / coalesce(nullif(hi - lo, 0), 1)"))
def scale_minmax(spark, sf_dir):
    return _scale(spark, sf_dir, "minmax")


@query("feature_matrix", with_views(["orders_messy"], """
, m AS (SELECT quantile_cont(price, 0.5) AS mp, quantile_cont(try_cast(cust_txt AS DOUBLE), 0.5) AS mc FROM orders_messy),
f AS (SELECT rid, coalesce(price, mp) AS p, coalesce(try_cast(cust_txt AS DOUBLE), mc) AS c FROM orders_messy, m),
s AS (SELECT avg(p) AS ap, stddev_samp(p) AS sp, avg(c) AS ac, stddev_samp(c) AS sc FROM f)
SELECT rid, round((p - ap) / sp, 5) AS z_price, round((c - ac) / sc, 5) AS z_cust FROM f, s
"""))
def matrix(spark, sf_dir):
    from cleanloom.views import view

    out = feature_matrix(view(spark, sf_dir, "orders_messy"), ["price", "cust_txt"])
    return out.select("rid", F.round(F.col("features")[0], 5).alias("z_price"), F.round(F.col("features")[1], 5).alias("z_cust"))


EVENT_ORDER = RowOrder.of(order_by="event_id", row_id="event_id")


def forest_sql(source: str, key: str, features: list[str], seed: int = 42, trees: int = 100, sample: int = 256) -> str:
    """Common tables up to ``scored`` (key, score): the whole forest again, level by level, from the same MD5 draws."""
    def drawn(*parts: str) -> str:
        text = ", ':', ".join((f"'{seed}'", *parts))
        return f"(CAST(concat('0x', substr(md5(concat({text})), 1, 13)) AS BIGINT)::DOUBLE / 4503599627370496.0::DOUBLE)"

    values = ", ".join(f"coalesce({f}::DOUBLE, (SELECT coalesce(quantile_cont({f}::DOUBLE, 0.5), 0) FROM {source}))" for f in features)
    path = "(CASE WHEN {n} <= 1 THEN 0.0::DOUBLE ELSE 2 * (ln(({n} - 1)::DOUBLE) + 0.5772156649::DOUBLE) - 2 * ({n} - 1)::DOUBLE / {n}::DOUBLE END)"
    divided = (f"SELECT *, lo + {drawn('tree', 'node', chr(39) + 's' + chr(39))} * (hi - lo) AS split FROM (SELECT *, min(v[f + 1]) OVER w AS lo, max(v[f + 1]) OVER w AS hi, count(*) OVER w AS size "
               f"FROM (SELECT *, CAST(floor({drawn('tree', 'node', chr(39) + 'f' + chr(39))} * {len(features)}) AS INTEGER) AS f FROM g) WINDOW w AS (PARTITION BY tree, node))")
    inner = "depth < ceil(log2(greatest(s, 2))) AND size > 1 AND lo < hi AND lo < split"
    return (f"x AS MATERIALIZED (SELECT {key} AS k, [{values}] AS v FROM {source}), "
            f"o AS MATERIALIZED (SELECT v, row_number() OVER (ORDER BY substr(md5(concat('{seed}', ':', k)), 1, 15), k) - 1 AS place FROM x), "
            f"c AS MATERIALIZED (SELECT count(*) AS n, least({sample}, count(*)) AS s FROM x), "
            f"d AS MATERIALIZED (SELECT tree, slot, CAST(floor({drawn('tree', 'slot')} * n) AS BIGINT) AS place FROM range({trees}) a(tree), range({sample}) b(slot), c WHERE slot < s), "
            f"g AS (SELECT tree, slot, 1 AS node, 0 AS depth, v FROM d JOIN o USING (place) UNION ALL "
            f"SELECT tree, slot, 2 * node + CAST(v[f + 1] >= split AS INTEGER), depth + 1, v FROM ({divided}) h, c WHERE {inner}), "
            f"nodes AS MATERIALIZED (SELECT tree, node, any_value(f) AS f, any_value(split) AS split, any_value({inner}) AS goes_on, "
            f"any_value(depth + {path.format(n='size')}) AS way FROM ({divided}) h, c GROUP BY tree, node), "
            f"r AS (SELECT k, v, tree, 1 AS node FROM x, range({trees}) a(tree) UNION ALL "
            f"SELECT k, v, r.tree, 2 * r.node + CAST(v[f + 1] >= split AS INTEGER) FROM r JOIN nodes ON r.tree = nodes.tree AND r.node = nodes.node WHERE goes_on), "
            f"scored AS MATERIALIZED (SELECT k, pow(2.0::DOUBLE, -(sum(way) / {trees}) / any_value({path.format(n='s')})) AS score "
            f"FROM r JOIN nodes ON r.tree = nodes.tree AND r.node = nodes.node, c WHERE NOT goes_on GROUP BY k)")


EVENT_FOREST = forest_sql("events", "event_id", ["user_id", "value"])


@query("iforest_scores", f"WITH RECURSIVE {EVENT_FOREST} SELECT event_id, user_id, value, round(score, 8) AS score FROM events JOIN scored ON k = event_id")
def iforest_scores(spark, sf_dir):
    df = table(spark, sf_dir, "events").select("event_id", "user_id", "value")
    fitted = forest.fit_forest(df, ["user_id", "value"], EVENT_ORDER)
    return forest.with_scores(df, fitted).withColumn("score", F.round("score", 8))


@query("topk_flag", "WITH k AS (SELECT value AS bar FROM events ORDER BY value DESC OFFSET (SELECT greatest(1, floor(count(*) * 0.05)::BIGINT) - 1 FROM events) LIMIT 1) "
       "SELECT event_id, value, value >= bar AS flag FROM events, k")
def topk_flag(spark, sf_dir):
    return forest.topk_flag(table(spark, sf_dir, "events").select("event_id", "value"), "value", 0.05)


@query("iforest_drop", f"WITH RECURSIVE {EVENT_FOREST}, b AS (SELECT round(score, 12) AS bar FROM scored ORDER BY score DESC "
       "OFFSET (SELECT greatest(1, floor(n * 0.05)::BIGINT) - 1 FROM c) LIMIT 1) SELECT events.* FROM events JOIN scored ON k = event_id, b WHERE round(score, 12) < bar")
def iforest_drop(spark, sf_dir):
    op = {"type": "iforest_outliers", "contamination": 0.05, "features": ["user_id", "value"]}
    return apply_op(table(spark, sf_dir, "events"), op, order_by="event_id")


@query("anomaly_rate", f"WITH RECURSIVE {EVENT_FOREST} SELECT count(*) AS rows, count(CASE WHEN round(score, 12) >= 0.62 THEN 1 END) AS anomalies, "
       "round(count(CASE WHEN round(score, 12) >= 0.62 THEN 1 END)::DOUBLE / count(*), 6) AS rate, NULL::VARCHAR AS reason FROM scored")
def anomaly_rate(spark, sf_dir):
    return forest.anomaly_scan(table(spark, sf_dir, "events"), EVENT_ORDER).withColumn("rate", F.round("rate", 6))
