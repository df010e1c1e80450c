"""Column and table profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from cleanloom.catalog.registry import half_up, number_text, numeric_like, percent, plain, query, strip, to_numeric
from cleanloom.operators import profile as P
from cleanloom.operators.base import RowOrder
from cleanloom.plans.recipe import apply_op
from cleanloom.plans.sketches import approx_quantiles, merge_sketches, rank_error, read_sketches, sketch_columns, unique_error
from cleanloom.views import table, view, with_views

ORDER = RowOrder.of(row_id="rid")
COLUMNS = ["o_orderkey", "o_custkey", "price", "priority", "price_txt", "cust_txt", "flag"]
TEXTS = {"o_orderkey": "CAST(o_orderkey AS VARCHAR)", "o_custkey": "CAST(o_custkey AS VARCHAR)", "price": number_text("price")}
DTYPES = {"o_orderkey": "Int64", "o_custkey": "Int64", "price": "Float64"}

# Long form of the messy table and everything a profile needs, as common table expressions.
LONG = ", v AS (" + " UNION ALL ".join(
    f"SELECT {i} AS position, '{c}' AS name, '{DTYPES.get(c, 'String')}' AS dtype, rid, {TEXTS.get(c, c)} AS v FROM orders_messy"
    for i, c in enumerate(COLUMNS)) + ")"
SAMPLES = (", d AS (SELECT name, v, min(rid) AS f FROM v WHERE v <> '' GROUP BY name, v), "
           "r AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY f) AS n FROM d), "
           "sm AS (SELECT name, list(v ORDER BY n) AS sample FROM r WHERE n <= 3 GROUP BY name)")
COLLISIONS = (f", t AS (SELECT name, {strip('v')} AS t, rid FROM v WHERE v <> ''), "
              "k AS (SELECT name, lower(t) AS low, arg_min(t, rid) AS kept FROM t GROUP BY name, lower(t)), "
              "cc AS (SELECT t.name, count(*) AS case_collisions FROM t JOIN k ON t.name = k.name AND lower(t.t) = k.low WHERE t.t <> k.kept GROUP BY t.name)")
PROFILE = LONG + SAMPLES + COLLISIONS + f""", ms AS (SELECT position, name, dtype, count(*) AS rows,
 count(CASE WHEN v IS NULL THEN 1 END) AS nulls, {percent('count(CASE WHEN v IS NULL THEN 1 END)', 'count(*)')} AS null_pct,
 count(DISTINCT CASE WHEN v <> '' THEN v END) AS uniq,
 CASE WHEN dtype = 'String' THEN {half_up("count(CASE WHEN v <> '' AND " + numeric_like('v') + " THEN 1 END)::DOUBLE / greatest(count(CASE WHEN v <> '' THEN 1 END), 1)", 2)} ELSE 0.0 END AS numeric_like,
 count(CASE WHEN dtype = 'String' AND v <> '' AND {numeric_like('v')} THEN 1 END) AS numbers,
 count(CASE WHEN dtype = 'String' AND v <> '' AND {numeric_like('v')} AND regexp_matches({strip('v')}, '^-?[0-9][0-9,]*$') THEN 1 END) AS wholes,
 CASE WHEN dtype = 'String' THEN count(CASE WHEN v <> '' AND v <> {strip('v')} THEN 1 END) ELSE 0 END AS whitespace FROM v GROUP BY position, name, dtype),
prof AS (SELECT ms.*, coalesce(sample, []) AS sample, CASE WHEN dtype = 'String' THEN coalesce(case_collisions, 0) ELSE 0 END AS case_collisions
 FROM ms LEFT JOIN sm USING (name) LEFT JOIN cc USING (name))"""


def _messy(spark, sf_dir):
    return view(spark, sf_dir, "orders_messy")


def _profile(spark, sf_dir):
    return P.table_profile(_messy(spark, sf_dir), ORDER)


def _of_profile(body: str) -> str:
    return with_views(["orders_messy"], PROFILE + " " + body)


@query("profile_nulls", with_views(["orders_messy"], " UNION ALL ".join(
    f"SELECT '{c}' AS name, count(*) - count({c}) AS nulls, {percent(f'count(*) - count({c})', 'count(*)')} AS null_pct FROM orders_messy" for c in COLUMNS)))
def profile_nulls(spark, sf_dir):
    return P.null_profile(_messy(spark, sf_dir), COLUMNS)


LINE_COLUMNS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
                "l_returnflag", "l_linestatus", "l_shipdate"]


@query("profile_unique", " UNION ALL ".join(f"SELECT '{c}' AS name, count(DISTINCT {c}) AS \"unique\" FROM lineitem" for c in LINE_COLUMNS))
def profile_unique(spark, sf_dir):
    return P.unique_counts(table(spark, sf_dir, "lineitem"), LINE_COLUMNS)


@query("profile_samples", with_views(["orders_messy"], LONG + SAMPLES + " SELECT name, array_to_string(sample, ' | ') AS sample FROM sm"))
def profile_samples(spark, sf_dir):
    return _profile(spark, sf_dir).select("name", F.array_join("sample", " | ").alias("sample"))


@query("profile_numeric_like", _of_profile("SELECT name, numeric_like FROM prof"))
def profile_numeric_like(spark, sf_dir):
    return _profile(spark, sf_dir).select("name", "numeric_like")


@query("profile_whitespace", _of_profile("SELECT name, whitespace FROM prof"))
def profile_whitespace(spark, sf_dir):
    return _profile(spark, sf_dir).select("name", "whitespace")


@query("profile_case_collisions", _of_profile("SELECT name, case_collisions FROM prof"))
def profile_case_collisions(spark, sf_dir):
    return _profile(spark, sf_dir).select("name", "case_collisions")


def _flag(c: str) -> str:
    number = "price" if c == "price" else to_numeric(c)
    typed = "true" if c == "price" else "false"
    ratio = f"count({number})::DOUBLE / greatest(count(CASE WHEN {c}::VARCHAR <> '' THEN 1 END), 1)"
    return (f"SELECT '{c}' AS name, {typed} OR {ratio} >= 0.9 AS numeric, NOT {typed} AND {ratio} >= 0.9 AS coerced FROM orders_messy")


@query("profile_numeric_flag", with_views(["orders_messy"], " UNION ALL ".join(_flag(c) for c in ("price", "priority", "price_txt", "cust_txt", "flag"))))
def profile_numeric_flag(spark, sf_dir):
    found = P.numeric_decision(_messy(spark, sf_dir), ["price", "priority", "price_txt", "cust_txt", "flag"])
    return found.select("name", "numeric", "coerced")


def _stats(c: str, x: str) -> str:
    def q(p: float) -> str:
        return f"quantile_cont({x}, {p})"

    parts = [("min", f"min({x})"), ("q1", q(0.25)), ("median", q(0.5)), ("q3", q(0.75)), ("max", f"max({x})"),
             ("mean", f"avg({x})"), ("std", f"coalesce(stddev_samp({x}), 0)"), ("iqr", f"{q(0.75)} - {q(0.25)}")]
    return (f"SELECT '{c}' AS name, count({x}) AS \"values\", " + ", ".join(f"round({half_up(e, 4)}, 3) AS {n}" for n, e in parts) + " FROM orders_messy")


@query("profile_stats", with_views(["orders_messy"], " UNION ALL ".join(
    _stats(c, x) for c, x in (("price", "price"), ("price_txt", to_numeric("price_txt")), ("cust_txt", to_numeric("cust_txt")), ("o_custkey", "o_custkey")))))
def profile_stats(spark, sf_dir):
    out = P.numeric_summary(_messy(spark, sf_dir), ["price", "price_txt", "cust_txt", "o_custkey"])
    return out.select("name", "values", *[F.round(c, 3).alias(c) for c in out.columns[2:]])


def _histogram(source: str, value: str) -> str:
    return (f"e AS (SELECT min({value}) AS lo, max({value}) AS hi, (max({value}) - min({value})) / 14 AS step FROM {source}), "
            f"h AS (SELECT least(13, greatest(0, floor(({value} - lo) / step)::INTEGER)) AS bin, count(*) AS n FROM {source}, e WHERE {value} IS NOT NULL GROUP BY 1) "
            f"SELECT b.bin::INTEGER AS bin, coalesce(n, 0) AS count, {half_up('lo', 4)} AS min, {half_up('hi', 4)} AS max "
            "FROM range(14) b(bin) LEFT JOIN h ON h.bin = b.bin, e")


@query("histogram", "WITH " + _histogram("events", "value"))
def histogram(spark, sf_dir):
    return P.histogram(table(spark, sf_dir, "events"), "value")


@query("histogram_gaps", with_views(["orders_messy"], ", " + _histogram("orders_messy", "price")))
def histogram_gaps(spark, sf_dir):
    return P.histogram(_messy(spark, sf_dir), "price")


@query("top_values", with_views(["orders_messy"], "SELECT priority AS value, count(*) AS count FROM orders_messy WHERE priority <> '' "
                                "GROUP BY priority ORDER BY count(*) DESC, min(rid) LIMIT 10"))
def top_values(spark, sf_dir):
    return P.top_values(_messy(spark, sf_dir), "priority", ORDER)


@query("profile_tips", _of_profile(
    ", tip AS (SELECT name, [CASE WHEN null_pct > 20 THEN " + plain("null_pct") + " || '% nulls — consider dropping or imputing.' WHEN null_pct > 0 THEN "
    + plain("null_pct") + " || '% nulls — safe to impute.' END, CASE WHEN whitespace > 0 THEN whitespace || ' string values have leading/trailing whitespace.' END, "
    "CASE WHEN case_collisions > 0 THEN case_collisions || ' values differ only by casing.' END, CASE WHEN name = 'cust_txt' THEN (SELECT 'Parsed as numeric (' || "
    f"floor(count({to_numeric('cust_txt')})::DOUBLE / count(CASE WHEN cust_txt <> '' THEN 1 END) * 100 + 0.5)::BIGINT || '% match) — safe to cast to Float64.' FROM orders_messy) END] AS t "
    "FROM prof WHERE name IN ('priority', 'cust_txt')) SELECT name AS \"column\", array_to_string(list_filter(t, lambda x: x IS NOT NULL), ' / ') AS tips FROM tip"))
def profile_tips(spark, sf_dir):
    df = _messy(spark, sf_dir)
    both = P.column_profile(df, "priority", ORDER).unionByName(P.column_profile(df, "cust_txt", ORDER))
    return both.select("column", F.array_join("tips", " / ").alias("tips"))


@query("table_profile", _of_profile("SELECT position, name, dtype, rows, nulls, null_pct, uniq AS \"unique\", array_to_string(sample, ' | ') AS sample, "
                                    "numeric_like, whitespace, case_collisions FROM prof"))
def table_profile(spark, sf_dir):
    return _profile(spark, sf_dir).withColumn("sample", F.array_join("sample", " | ")).drop("numbers", "wholes", "mean_words")


@query("dataset_summary", with_views(["orders_messy"], "SELECT count(*) AS rows, 7 AS cols, 3 AS numeric_cols, 4 AS text_cols, count(*) - (SELECT count(*) FROM "
       "(SELECT DISTINCT o_orderkey, o_custkey, price, priority, price_txt, cust_txt, flag FROM orders_messy)) AS dupes, "
       + percent("7 * count(*) - " + " - ".join(f"count({c})" for c in COLUMNS), "7 * count(*)") + " AS missing_pct FROM orders_messy"))
def dataset_summary(spark, sf_dir):
    return P.dataset_summary(_messy(spark, sf_dir), ORDER)


SKETCHED = ["event_id", "user_id", "event_type", "value", "props"]


MERGED = ("WITH e AS (SELECT event_id, user_id, CASE WHEN event_id % 3 > 0 THEN event_type END AS event_type, CASE WHEN event_id % 4 > 0 THEN value END AS value, props FROM events) "
          + " UNION ALL ".join(f"SELECT '{c}' AS name, count(*) AS rows, count(*) - count({c}) AS nulls, TRUE AS unique_within, TRUE AS cuts_agree FROM e" for c in SKETCHED))


@query("profile_merged", MERGED)
def profile_merged(spark, sf_dir):
    """Distinct counts from sketches of parts: within the stated error of the exact ones, and of each other for another cut.

    The order of merging may move an estimate a little, so equal estimates are not promised.
    """
    df = table(spark, sf_dir, "events").select(
        "event_id", "user_id", F.when(F.col("event_id") % 3 > 0, F.col("event_type")).alias("event_type"), F.when(F.col("event_id") % 4 > 0, F.col("value")).alias("value"), "props")
    exact = df.agg(*[F.countDistinct(c).alias(c) for c in SKETCHED])
    exact = exact.select(F.inline(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).alias("exact")) for c in SKETCHED])))
    merged = read_sketches(merge_sketches(sketch_columns(df, F.col("event_type"))))
    other = read_sketches(merge_sketches(sketch_columns(df, F.col("event_id") % 7))).select("name", F.col("unique").alias("again"))
    near = F.abs(F.col("unique") - F.col("exact")) <= F.lit(unique_error()) * F.col("exact")
    return merged.join(exact, "name").join(other, "name").select("name", "rows", "nulls", near.alias("unique_within"), (F.abs(F.col("unique") - F.col("again")) <= F.lit(unique_error()) * F.col("exact")).alias("cuts_agree"))


@query("quantiles_approx", "SELECT c.name, p::DOUBLE AS p, TRUE AS within FROM (VALUES ('user_id'), ('value')) c(name), (VALUES (0.05), (0.5), (0.99)) q(p) WHERE (SELECT count(*) FROM events) > 0")
def quantiles_approx(spark, sf_dir):
    """Whether the true rank of each sketched quantile is within the stated error of the wanted one."""
    df, probs = table(spark, sf_dir, "events"), [0.05, 0.5, 0.99]
    found = approx_quantiles(df, {c: F.col(c) for c in ("user_id", "value")}, probs)
    rows = []
    for name, values in found.items():
        for p, v in zip(probs, values):
            below, upto = (F.count(F.when(c, 1)) / F.count(name) for c in (F.col(name) < v, F.col(name) <= v))
            rows.append(F.struct(F.lit(name).alias("name"), F.lit(p).alias("p"), ((below - rank_error() <= p) & (upto + rank_error() >= p)).alias("within")))
    return df.agg(F.array(*rows).alias("rows")).select(F.inline("rows"))


@query("fill_median_approx", with_views(["events_gaps"], "SELECT event_id, value, value IS NULL AS filled, TRUE AS near FROM events_gaps"))
def fill_median_approx(spark, sf_dir):
    """Gaps filled with a median from a sketch; ``near`` tells whether its rank is the middle one within the stated error."""
    gaps = view(spark, sf_dir, "events_gaps").select("event_id", "value")
    done = apply_op(gaps, {"type": "fill_null", "column": "value", "strategy": "median", "approx": True}).withColumnRenamed("value", "full")
    both = gaps.join(done, "event_id")
    used = both.where("value is null").agg(F.max("full").alias("used"))
    share = gaps.crossJoin(F.broadcast(used)).agg((F.count(F.when(F.col("value") < F.col("used"), 1)) / F.count("value")).alias("below"),
                                                  (F.count(F.when(F.col("value") <= F.col("used"), 1)) / F.count("value")).alias("upto"), F.max("used").alias("used"))
    ok = (F.col("below") - rank_error() <= 0.5) & (F.col("upto") + rank_error() >= 0.5)
    near = (F.col("value").isNotNull() | (F.col("full") == F.col("used"))) & ok
    return both.join(F.broadcast(share)).select("event_id", "value", F.col("value").isNull().alias("filled"), near.alias("near"))
