"""Rules over profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from cleanloom.catalog.profiles import COLUMNS, ORDER, PROFILE
from cleanloom.catalog.registry import half_up, percent, plain, query, strip
from cleanloom.catalog.texts import TASK
from cleanloom.functions import classify as C
from cleanloom.operators import advice as A, profile as P
from cleanloom.operators.base import RowOrder
from cleanloom.operators.rows import duplicate_count
from cleanloom.plans.recipe import apply_recipe
from cleanloom.views import derived, table, view, with_views

DUPES = (", du AS (SELECT count(*) - (SELECT count(*) FROM (SELECT DISTINCT " + ", ".join(COLUMNS) + " FROM orders_messy)) AS dupes, count(*) AS n FROM orders_messy), "
         "dp AS (SELECT dupes, floor(dupes::DOUBLE / n * 1000.0::DOUBLE + 0.5) / 10.0::DOUBLE AS pct FROM du)")
NUMERIC = "regexp_matches(dtype, '^(Int|UInt|Float|Decimal)')"
WHOLE = "(numbers > 0 AND wholes = numbers)"


def _json(kind: str, **fields: str) -> str:
    """SQL text building an operation's JSON; values starting with = are SQL."""
    out = f"'{{\"type\":\"{kind}\"'"
    for k, v in fields.items():
        out += f" || ',\"{k}\":\"' || {v[1:]} || '\"'" if v.startswith("=") else f" || ',\"{k}\":\"{v}\"'"
    return out + " || '}'"


IMPACT = "CASE impact WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END"


def _ranking(parts: list[str], keep: int, prefix: str, extra: str = "") -> str:
    return (", c AS (" + " UNION ALL ".join(parts) + "), n AS (SELECT *, row_number() OVER (PARTITION BY rule ORDER BY k, position) AS nth FROM c), "
            "q AS (SELECT *, row_number() OVER (ORDER BY rule, nth) AS seq FROM n WHERE nth <= lim), "
            f"o AS (SELECT *, row_number() OVER (ORDER BY {IMPACT} DESC, confidence DESC, seq) AS rank FROM q) "
            f"SELECT rank::INTEGER AS rank, '{prefix}' || seq AS id, title, confidence::DOUBLE AS confidence, impact, op{extra} FROM o WHERE rank <= {keep}")


def _rule(rule: int, lim: int, source: str, where: str, title: str, confidence: str, impact: str, op: str, key: str = "0.0", extra: str = "") -> str:
    position = "0" if source == "dp" else "position"
    return (f"SELECT {rule} AS rule, {lim} AS lim, {position} AS position, {key}::DOUBLE AS k, {title} AS title, ({confidence})::DOUBLE AS confidence, "
            f"{impact} AS impact, {op} AS op{extra} FROM {source} WHERE {where}")


BY5 = "CASE WHEN null_pct > 5 THEN 'high' ELSE 'medium' END"
BY10 = "CASE WHEN null_pct > 10 THEN 'high' ELSE 'medium' END"
FILL = f"CASE WHEN null_pct >= 50 THEN 1 WHEN {NUMERIC} THEN 2 WHEN null_pct <= 1.5 THEN 3 WHEN uniq BETWEEN 1 AND 30 THEN 4 ELSE 5 END"


def _by_fill(*values: str) -> str:
    return f"CASE {FILL} " + " ".join(f"WHEN {i + 1} THEN {v}" for i, v in enumerate(values)) + " END"


CAST_TO = f"CASE WHEN {WHOLE} THEN 'Int64' ELSE 'Float64' END"
SUGGESTION_RULES = [
    _rule(0, 1, "dp", "dupes > 0", "'Remove duplicate rows'", "0.97", "CASE WHEN pct > 2 THEN 'high' ELSE 'medium' END", _json("drop_duplicates")),
    _rule(1, 3, "prof", "nulls > 0",
          _by_fill("'Consider dropping \"' || name || '\"'", "'Impute \"' || name || '\" with its median'", "'Drop rows missing \"' || name || '\"'",
                   "'Fill \"' || name || '\" with its mode'", "'Fill nulls in \"' || name || '\" with \"Unknown\"'"),
          _by_fill("0.62", "0.91", "0.84", "0.86", "0.78"), _by_fill("'low'", BY5, "'medium'", BY10, BY10),
          _by_fill(_json("drop_column", column="=name"), _json("fill_null", column="=name", strategy="median"), _json("drop_nulls", column="=name"),
                   _json("fill_null", column="=name", strategy="mode"), _json("fill_null", column="=name", strategy="constant", value="Unknown")),
          key="-null_pct"),
    _rule(2, 2, "prof", "dtype = 'String' AND numeric_like >= 0.9 AND nulls < rows", f"'Cast \"' || name || '\" to ' || {CAST_TO}", "0.93", "'medium'",
          _json("cast", column="=name", to="=" + CAST_TO)),
    _rule(3, 2, "prof", "whitespace >= 3", "'Trim whitespace in \"' || name || '\"'", "0.95", "'medium'", _json("trim", column="=name")),
    _rule(4, 2, "prof", "case_collisions >= 2", "'Normalize case in \"' || name || '\"'", "0.81", "'low'", _json("normalize_case", column="=name", mode="lower")),
]


def _messy(spark, sf_dir):
    return view(spark, sf_dir, "orders_messy")


def _suggestions(df, limit=A.SUGGESTIONS):
    dupes = duplicate_count(df, COLUMNS).first().duplicates
    return A.suggestions(P.table_profile(df, ORDER), dupes, limit)


@query("suggestions", with_views(["orders_messy"], PROFILE + DUPES + _ranking(SUGGESTION_RULES, 7, "sg-")))
def suggestions(spark, sf_dir):
    return _suggestions(_messy(spark, sf_dir)).select("rank", "id", "title", "confidence", "impact", "op")


PFILL = f"CASE WHEN name = 'price' THEN 1 WHEN null_pct >= 60 THEN 2 WHEN {NUMERIC} THEN 3 WHEN {NUMERIC} THEN 4 WHEN uniq BETWEEN 1 AND 50 THEN 5 ELSE 6 END"


def _by_kind(*values: str) -> str:
    return f"CASE {PFILL} " + " ".join(f"WHEN {i + 1} THEN {v}" for i, v in enumerate(values)) + " END"


PCAST = CAST_TO


def _p(method: str, column: str = "name") -> str:
    return f", {method} AS method, {column} AS \"column\""


PROPOSAL_RULES = [
    _rule(0, 1, "dp", "dupes > 0", "'Remove duplicate rows'", "0.97", "CASE WHEN pct > 2 THEN 'high' ELSE 'medium' END", _json("drop_duplicates"),
          extra=_p("'Exact-match deduplication'", "NULL")),
    _rule(1, 3, "prof", "dtype = 'String' AND numeric_like >= 0.9", f"'Cast \"' || name || '\" to ' || {PCAST}", "0.93", "'high'",
          _json("cast", column="=name", to="=" + PCAST), extra=_p("'Type coercion'")),
    _rule(2, 4, "prof", "nulls > 0",
          _by_kind("'Drop rows with a missing target (\"' || name || '\")'", "'Drop sparse column \"' || name || '\"'", "'KNN-impute \"' || name || '\" (k=5)'",
                   "'Median-impute \"' || name || '\"'", "'Mode-impute \"' || name || '\"'", "'Fill \"' || name || '\" with \"Unknown\"'"),
          _by_kind("0.95", "0.70", "0.90", "0.88", "0.85", "0.85"), _by_kind("'high'", "'medium'", BY5, BY5, BY10, BY10),
          _by_kind(_json("drop_nulls", column="=name"), _json("drop_column", column="=name"), "'{\"type\":\"knn_impute\",\"column\":\"' || name || '\",\"k\":5}'",
                   _json("fill_null", column="=name", strategy="median"), _json("fill_null", column="=name", strategy="mode"),
                   _json("fill_null", column="=name", strategy="constant", value="Unknown")), key="-null_pct",
          extra=_p(_by_kind("'Listwise deletion on label'", "'Sparsity threshold'", "'KNN Imputer'", "'Median imputation'", "'Mode imputation'", "'Sentinel category'"))),
    _rule(4, 1, "prof", "name = 'o_orderkey'", "'Standard-scale \"' || name || '\"'", "0.72", "'low'", _json("scale", column="=name", scaler="standard"),
          extra=_p("'StandardScaler (z-score)'")),
    _rule(5, 1, "prof", "case_collisions >= 2", "'Normalize case in \"' || name || '\"'", "0.86", "'medium'", _json("normalize_case", column="=name", mode="lower"),
          extra=_p("'Case folding'")),
    _rule(6, 1, "prof", "whitespace >= 3", "'Trim whitespace in \"' || name || '\"'", "0.94", "'medium'", _json("trim", column="=name"), extra=_p("'String stripping'")),
]
GOAL = {"task": "regression", "target": "price"}


@query("proposals", with_views(["orders_messy"], PROFILE + DUPES + _ranking(PROPOSAL_RULES, 8, "p", ", method, \"column\"")))
def proposals(spark, sf_dir):
    df = _messy(spark, sf_dir)
    dupes = duplicate_count(df, COLUMNS).first().duplicates
    out = A.proposals(P.table_profile(df, ORDER), dupes, ["o_orderkey", "o_custkey", "price"], goal=GOAL)
    return out.select("rank", "id", "title", "confidence", "impact", "op", "method", "column")


CASE_OP = ("CASE CAST((5 * conv_id + turn) % 11 AS INT) WHEN 0 THEN 'drop_column' WHEN 1 THEN 'fill_null' WHEN 2 THEN 'knn_impute' WHEN 3 THEN 'scale' WHEN 4 THEN 'cap_outliers' "
           "WHEN 5 THEN 'drop_outliers' WHEN 6 THEN 'iforest_outliers' WHEN 7 THEN 'drop_duplicates' WHEN 8 THEN 'drop_nulls' WHEN 9 THEN 'cast' ELSE 'trim' END")
ASKED = (f"SELECT conv_id, turn, goal, {CASE_OP} AS op_type, CASE WHEN turn % 2 = 0 THEN 'o_totalprice' ELSE 'o_custkey' END AS op_column, "
         "CAST(conv_id % 7 AS DOUBLE) * 10 AS null_pct FROM {goals}")
GUARD = ("CASE WHEN op_column = target AND op_type = 'drop_column' THEN 'target_drop' WHEN op_column = target AND op_type IN ('fill_null', 'knn_impute') THEN 'target_fill' "
         "WHEN op_column = target AND op_type = 'scale' AND task = 'regression' THEN 'target_scale_regression' WHEN op_column = target AND op_type = 'scale' THEN 'target_scale' "
         "WHEN op_column = target AND op_type IN ('cap_outliers', 'drop_outliers', 'iforest_outliers') THEN 'target_extremes' "
         "WHEN op_type = 'scale' AND task = 'clustering' THEN 'scale_clustering' WHEN op_type = 'scale' AND task IN ('classification', 'regression') THEN 'scale_supervised' "
         "WHEN op_type = 'scale' THEN 'scale_other' WHEN op_type = 'iforest_outliers' AND task = 'classification' THEN 'forest_classification' "
         "WHEN op_type = 'iforest_outliers' AND task = 'timeseries' THEN 'forest_timeseries' WHEN op_type = 'iforest_outliers' THEN 'forest_other' "
         "WHEN op_type = 'drop_duplicates' AND task = 'timeseries' THEN 'dupes_timeseries' WHEN op_type = 'drop_duplicates' THEN 'dupes_other' "
         "WHEN op_type = 'drop_nulls' AND null_pct > 20 THEN 'nulls_many' WHEN op_type = 'drop_nulls' THEN 'nulls_few' "
         "WHEN op_type = 'knn_impute' AND task = 'timeseries' THEN 'knn_timeseries' WHEN op_type = 'knn_impute' THEN 'knn_other' WHEN op_type = 'cap_outliers' THEN 'cap' "
         "WHEN op_type = 'drop_column' AND null_pct >= 50 THEN 'sparse_column' WHEN op_type = 'cast' THEN 'cast' END")
# Expected values, written out: guardrails that carry a note, and those that carry a warning.
NOTED = [
    "cap", "cast", "dupes_other", "forest_classification", "forest_other", "knn_other", "knn_timeseries", "nulls_few", "scale_clustering",
    "scale_supervised", "sparse_column",
]
WARNED = [
    "dupes_timeseries", "forest_classification", "forest_timeseries", "knn_timeseries", "nulls_many", "scale_clustering", "scale_other",
    "scale_supervised", "target_drop", "target_extremes", "target_fill", "target_scale", "target_scale_regression",
]


def _in(codes: list[str]) -> str:
    return "(" + ", ".join(f"'{c}'" for c in codes) + ")"


@query("goal_guardrails", with_views(["goals"], ", a AS (" + ASKED.format(goals="goals") + f"), t AS (SELECT *, {TASK} AS task, "
       "CASE WHEN contains(goal, 'o_totalprice') THEN 'o_totalprice' END AS target FROM a), g AS (SELECT *, " + GUARD + " AS code FROM t) "
       f"SELECT conv_id, turn, task, op_type, op_column, code, coalesce(code IN {_in(NOTED)}, false) AS has_note, coalesce(code IN {_in(WARNED)}, false) AS has_warning FROM g"))
def goal_guardrails(spark, sf_dir):
    asked = spark.sql(ASKED.format(goals="{goals}"), goals=view(spark, sf_dir, "goals"))
    columns = table(spark, sf_dir, "orders").columns
    task, target = C.goal_task(F.col("goal")), C.goal_target(F.col("goal"), columns)
    coded = asked.withColumn("task", task).withColumn("target", target)
    coded = coded.withColumn("code", A.guard_code(F.col("op_type"), F.col("op_column"), F.col("null_pct"), F.col("task"), F.col("target")))
    said = A.guardrails(F.col("code"), F.col("op_column"), F.col("null_pct"), F.col("task"))
    return coded.select("conv_id", "turn", "task", "op_type", "op_column", "code",
                        said["note"].isNotNull().alias("has_note"), said["warning"].isNotNull().alias("has_warning"))


TIDY = f"lower({strip('priority')})"


@query("auto_clean", with_views(["orders_messy"], ", d AS (SELECT min(rid) AS rid, o_orderkey, o_custkey, price, priority, price_txt, cust_txt, flag FROM orders_messy GROUP BY ALL), "
       f"t AS (SELECT rid, o_orderkey, o_custkey, price, {TIDY} AS priority, price_txt, CASE WHEN regexp_matches(cust_txt, '^[+-]?[0-9]+$') THEN cust_txt END AS cust_txt, flag FROM d) "
       "SELECT rid, o_orderkey, o_custkey, round(coalesce(price, (SELECT quantile_cont(price, 0.5) FROM t)), 4) AS price, coalesce(priority, (SELECT priority FROM t WHERE priority IS NOT NULL "
       "GROUP BY priority ORDER BY count(*) DESC, priority LIMIT 1)) AS priority, price_txt, coalesce(cust_txt, 'Unknown') AS cust_txt, flag FROM t"))
def auto_clean(spark, sf_dir):
    df = _messy(spark, sf_dir)
    out = apply_recipe(df, A.auto_clean_ops(_suggestions(df, None)), row_id="rid")
    return out.withColumn("price", F.round("price", 4))


PROSE = "SELECT doc_id, text, lower(text) AS text_lower, lang, source FROM documents"
PROSE_COLUMNS = ["text", "text_lower", "lang", "source"]
PROSE_ORDER = RowOrder.of(row_id="doc_id")
PROSE_SQL = ("WITH p AS (" + PROSE + "), v AS (" + " UNION ALL ".join(f"SELECT {i} AS position, '{c}' AS name, doc_id AS rid, {c} AS v FROM p" for i, c in enumerate(PROSE_COLUMNS)) + ")"
             + ", u AS (SELECT position, name, count(*) AS rows, count(DISTINCT CASE WHEN v <> '' THEN v END) AS uniq, "
             f"avg(CASE WHEN v <> '' THEN len(regexp_split_to_array({strip('v')}, '\\s+')) END) AS words FROM v GROUP BY ALL), w AS (SELECT * FROM u), "
             "f AS (SELECT count(*) AS cols, max(rows) AS rows, count(CASE WHEN words >= 8 AND uniq > greatest(20, 0.4 * rows) THEN 1 END) AS prose, "
             "count(CASE WHEN uniq > 1000 AND uniq > 0.5 * rows THEN 1 END) AS explosive FROM w), "
             "g AS (SELECT 'unstructured_text' AS code, CASE WHEN prose >= 2 THEN 'critical' ELSE 'warn' END AS severity, CASE WHEN prose >= 2 THEN 3 ELSE 2 END AS points, 1 AS r FROM f WHERE prose > 0 "
             "UNION ALL SELECT 'high_cardinality', 'warn', 1, 4 FROM f WHERE explosive > 0)")


def _signals(spark, sf_dir):
    prose = derived(spark, sf_dir, PROSE, "documents")
    return A.complexity_signals(P.table_profile(prose, PROSE_ORDER))


@query("complexity", PROSE_SQL + " SELECT code, severity, points FROM g")
def complexity(spark, sf_dir):
    return _signals(spark, sf_dir).select("code", "severity", "points")


@query("dl_warning", PROSE_SQL + ", m AS (SELECT CASE code WHEN 'unstructured_text' THEN '" + A.TECHNIQUES["unstructured_text"] + "' ELSE '" + A.TECHNIQUES["high_cardinality"]
       + "' END AS t, points, r FROM g) SELECT 'dl-warning' AS id, 'Deep Learning may be required' AS title, string_agg(t, ' · ' ORDER BY r) AS method, true AS requires_explicit_approval "
         "FROM m HAVING sum(points) >= 3")
def dl_warning(spark, sf_dir):
    return A.deep_learning_warning(_signals(spark, sf_dir)).select("id", "title", "method", "requires_explicit_approval")


@query("analyze_all")
def analyze_all(spark, sf_dir):
    out = A.analyze_all(_messy(spark, sf_dir), ORDER, GOAL)
    return out.withColumn("proposals", F.to_json("proposals"))
