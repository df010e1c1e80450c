"""Recipes, command batches, undo history, labels."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from cleanloom.catalog.registry import query, strip
from cleanloom.plans.history import effective_recipe
from cleanloom.plans.recipe import apply_commands, apply_recipe, op_label
from cleanloom.session import scratch_path
from cleanloom.sources import recipe_log
from cleanloom.views import derived, view, with_views

FLAGSHIP = [
    {"type": "drop_duplicates"},
    {"type": "trim", "column": "priority"},
    {"type": "normalize_case", "column": "priority", "mode": "lower"},
    {"type": "fill_null", "column": "price", "strategy": "median"},
    {"type": "drop_nulls", "column": "priority"},
]
FLAGSHIP_SQL = (", d AS (SELECT min(rid) AS rid, o_orderkey, o_custkey, price, priority, price_txt, cust_txt, flag FROM orders_messy GROUP BY ALL) "
                f"SELECT rid, o_orderkey, o_custkey, round(coalesce(price, (SELECT quantile_cont(price, 0.5) FROM d)), 4) AS price, lower({strip('priority')}) AS priority, "
                "price_txt, cust_txt, flag FROM d WHERE priority IS NOT NULL")


@query("recipe_flagship", with_views(["orders_messy"], FLAGSHIP_SQL))
def flagship(spark, sf_dir):
    out = apply_recipe(view(spark, sf_dir, "orders_messy"), FLAGSHIP, row_id="rid")
    return out.withColumn("price", F.round("price", 4))


COMMANDS = [
    {"action_category": "structure", "method": "Dedupe"},
    {"action_category": "text", "method": "strip"},
    {"column": "flag", "action_category": "text", "method": "uppercase"},
    {"column": "cust_txt", "action_category": "types", "method": "cast", "params": {"to": "Int64"}},
    {"column": "price", "action_category": "missing_values", "method": "mean"},
    {"column": "cust_txt", "action_category": "missing_values", "method": "drop_rows"},
    {"column": "priority", "action_category": "missing_values", "method": "custom", "params": {"value": "Unknown"}},
    {"column": "price", "action_category": "outliers", "method": "winsorize", "params": {"m": 0.5}},
    {"column": "price_txt", "action_category": "structure", "method": "drop_column"},
    {"column": "flag", "action_category": "structure", "method": "rename", "params": {"to": "active"}},
]


@query("command_batch", with_views(["orders_messy"], ", d AS (SELECT min(rid) AS rid, o_orderkey, o_custkey, price, priority, price_txt, cust_txt, flag FROM orders_messy GROUP BY ALL), "
       "f AS (SELECT rid, o_orderkey, o_custkey, coalesce(price, (SELECT avg(price) FROM d)) AS price, coalesce(" + strip("priority") + ", 'Unknown') AS priority, "
       "CASE WHEN regexp_matches(cust_txt, '^[+-]?[0-9]+$') THEN try_cast(cust_txt AS BIGINT) END AS cust_txt, upper(flag) AS active FROM d), "
       "k AS (SELECT * FROM f WHERE cust_txt IS NOT NULL), b AS (SELECT quantile_cont(price, 0.25) AS q1, quantile_cont(price, 0.75) AS q3 FROM k) "
       "SELECT rid, o_orderkey, o_custkey, round(greatest(least(price, q3 + 0.5 * (q3 - q1)), q1 - 0.5 * (q3 - q1)), 4) AS price, priority, cust_txt, active FROM k, b"))
def command_batch(spark, sf_dir):
    out = apply_commands(view(spark, sf_dir, "orders_messy"), COMMANDS, row_id="rid")
    return out.withColumn("price", F.round("price", 4))


# Event log made of the orders: one hot dataset holds a third of all events.
LOG = ("SELECT CASE WHEN o_orderkey % 3 = 0 THEN 0 ELSE 1 + o_custkey % 40 END AS dataset_id, o_orderkey AS position, "
       "CASE WHEN (o_orderkey * 7 + o_custkey) % 20 < 11 THEN 'apply' WHEN (o_orderkey * 7 + o_custkey) % 20 < 19 THEN 'undo' ELSE 'reset' END AS event, "
       "CASE WHEN o_orderkey % 2 = 0 THEN concat('[{\"type\":\"trim\",\"column\":\"c', CAST(o_custkey % 9 AS STRING), '\"}]') "
       "ELSE concat('[{\"type\":\"drop_duplicates\"},{\"type\":\"cast\",\"column\":\"c', CAST(o_custkey % 9 AS STRING), '\",\"to\":\"Int64\"}]') END AS ops FROM orders")
# State list: undo depth, then recipe versions newest first (negative: reset). Version 0 is the base.
FOLD = """
, s AS (SELECT dataset_id, list_reduce(list([CASE event WHEN 'apply' THEN 1 WHEN 'reset' THEN 2 ELSE 3 END, position + 1] ORDER BY position),
  lambda a, e: CASE WHEN e[1] = 3 THEN (CASE WHEN a[1] > 0 THEN list_concat([a[1] - 1], a[3:]) ELSE a END)
    ELSE list_concat([least(a[1] + 1, 8), CASE WHEN e[1] = 2 THEN -e[2] ELSE e[2] END], a[2:]) END, [0, 0]) AS st FROM log GROUP BY dataset_id),
v AS (SELECT dataset_id, unnest(st[2:]) AS v, generate_subscripts(st[2:], 1) AS i FROM s),
c AS (SELECT v.dataset_id, v.v - 1 AS position FROM v LEFT JOIN (SELECT dataset_id, min(i) AS stop FROM v WHERE v < 0 GROUP BY 1) r USING (dataset_id)
      WHERE v.v > 0 AND v.i < coalesce(stop, 1000000000))
"""


def _log(spark, sf_dir):
    return derived(spark, sf_dir, LOG, "orders")


@query("effective_recipe", f"WITH log AS ({LOG}) {FOLD} SELECT dataset_id, position, unnest(range(len(o)))::INTEGER AS step, unnest(o) AS op "
       "FROM (SELECT c.dataset_id, c.position, CAST(json_extract(log.ops, '$[*]') AS VARCHAR[]) AS o FROM c JOIN log USING (dataset_id, position))")
def effective(spark, sf_dir):
    return effective_recipe(_log(spark, sf_dir))


# A short session over the messy table: two batches, a wrong one, undo, reset, undo of the reset.
SESSION = [
    ("apply", '[{"type":"trim","column":"priority"}]'),
    ("apply", '[{"type":"fill_null","column":"price","strategy":"constant","value":"0"},{"type":"drop_nulls","column":"cust_txt"}]'),
    ("apply", '[{"type":"drop_column","column":"flag"}]'),
    ("undo", None),
    ("reset", None),
    ("undo", None),
]


@query("recipe_undo", with_views(["orders_messy"], f"SELECT rid, o_orderkey, o_custkey, coalesce(price, 0) AS price, {strip('priority')} AS priority, price_txt, cust_txt, flag "
                                 "FROM orders_messy WHERE cust_txt IS NOT NULL"))
def recipe_undo(spark, sf_dir):
    log = spark.createDataFrame([("s", i, e, o) for i, (e, o) in enumerate(SESSION)], "dataset_id string, position bigint, event string, ops string")
    steps = effective_recipe(log).orderBy("position", "step").collect()
    return apply_recipe(view(spark, sf_dir, "orders_messy"), [json.loads(s.op) for s in steps], row_id="rid")


# Operations logged per order: newest version per dataset, read back from Parquet.
STEPS = ("SELECT CAST(o_custkey % 50 AS STRING) AS dataset_id, o_orderkey % 4 AS version, CAST(o_orderkey AS INT) AS position, "
         "CASE CAST(o_orderkey % 15 AS INT) WHEN 0 THEN '{\"type\":\"drop_duplicates\"}' WHEN 1 THEN '{\"type\":\"drop_nulls\",\"column\":\"a\"}' WHEN 2 THEN '{\"type\":\"drop_column\",\"column\":\"b\"}' "
         "WHEN 3 THEN '{\"type\":\"rename_column\",\"column\":\"b\",\"to\":\"c\"}' WHEN 4 THEN '{\"type\":\"cast\",\"column\":\"b\",\"to\":\"Int64\"}' WHEN 5 THEN '{\"type\":\"trim\"}' "
         "WHEN 6 THEN '{\"type\":\"trim\",\"column\":\"a\"}' WHEN 7 THEN '{\"type\":\"normalize_case\",\"column\":\"a\",\"mode\":\"upper\"}' WHEN 8 THEN '{\"type\":\"knn_impute\",\"column\":\"a\",\"k\":7}' "
         "WHEN 9 THEN '{\"type\":\"cap_outliers\",\"column\":\"a\",\"multiplier\":2.5}' WHEN 10 THEN '{\"type\":\"drop_outliers\",\"column\":\"a\"}' WHEN 11 THEN '{\"type\":\"drop_row\",\"index\":4}' "
         "WHEN 12 THEN '{\"type\":\"iforest_outliers\",\"contamination\":0.1}' WHEN 13 THEN '{\"type\":\"scale\",\"column\":\"a\",\"scaler\":\"minmax\"}' "
         "ELSE '{\"type\":\"fill_null\",\"column\":\"a\",\"strategy\":\"constant\",\"value\":\"x\"}' END AS op_json FROM orders")
LABELS = ("CASE CAST(position % 15 AS INT) WHEN 0 THEN 'Drop duplicate rows' WHEN 1 THEN 'Drop null rows on a' WHEN 2 THEN 'Drop column on b' WHEN 3 THEN 'Rename b → c' WHEN 4 THEN 'Cast b → Int64' "
          "WHEN 5 THEN 'Trim whitespace (all text)' WHEN 6 THEN 'Trim whitespace on a' WHEN 7 THEN 'Normalize case (upper) on a' WHEN 8 THEN 'KNN impute (k=7) on a' "
          "WHEN 9 THEN 'Cap outliers (IQR ×2.5) on a' WHEN 10 THEN 'Drop outlier rows (IQR ×1.5) on a' WHEN 11 THEN 'Delete row #5' "
          "WHEN 12 THEN 'Isolation Forest — drop anomalies (contamination 10.0%)' WHEN 13 THEN 'MinMax scale on a' ELSE 'Fill nulls (constant: \"x\") on a' END")


def _steps(spark, sf_dir):
    return derived(spark, sf_dir, STEPS, "orders")


@query("recipe_log", f"WITH l AS ({STEPS}) SELECT dataset_id, version, position, op_json FROM l JOIN (SELECT dataset_id, max(version) AS version FROM l GROUP BY 1) USING (dataset_id, version)")
def log_roundtrip(spark, sf_dir):
    path = scratch_path(spark, "recipes")
    recipe_log.append(_steps(spark, sf_dir), path)
    return recipe_log.latest(spark.read.schema(recipe_log.SCHEMA).parquet(path))


@query("recipe_labels", f"WITH l AS ({STEPS}) SELECT dataset_id, position, {LABELS} AS label FROM l")
def labels(spark, sf_dir):
    return _steps(spark, sf_dir).select("dataset_id", "position", op_label(F.col("op_json")).alias("label"))
