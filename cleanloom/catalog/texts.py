"""Text classifiers over tables of goals and messages."""

from __future__ import annotations

from pyspark.sql import functions as F

from cleanloom.catalog.registry import query, strip
from cleanloom.functions import classify as C
from cleanloom.views import table, view, with_views


def _columns(spark, sf_dir) -> list[str]:
    return table(spark, sf_dir, "orders").columns


# Expected values of the SQL side, written out so that a slip in the library shows.
TASKS = [
    ("classification", "classification model", r"\b(classif|churn|fraud|spam|predict .*(class|category|label)|binary|logistic|segment .*customers? into)\b"),
    ("regression", "regression model",
     r"\b(regress|forecast .*(price|value|amount|revenue|sales)|predict .*(price|value|amount|salary|revenue|score|cost)|estimate)\b"),
    ("timeseries", "time-series forecast", r"\b(time[- ]?series|forecast|seasonal|trend over time|arima|prophet)\b"),
    ("clustering", "clustering / segmentation", r"\b(cluster|segment|unsupervised|k-?means|cohort|group .*similar)\b"),
    ("nlp", "NLP / text model", r"\b(nlp|text (analysis|mining|classification)|sentiment|topic model|embedding|llm|language model)\b"),
    ("eda", "analysis / reporting", r"\b(dashboard|report|explor|visuali[sz]|bi\b|analytics|insight)\b"),
]
PHRASE = r"(?:predict|forecast|estimate|target(?: is|:)?|label(?: is|:)?|classify)\s+(?:the\s+)?([\w .\-]{2,40})"
FIRST_INTENTS = [
    ("greeting", r"^(hi|hello|hey)\b"),
    ("auto_clean", r"(auto[- ]?clean|fix everything|clean (it|this|all|everything)|do it all|all at once)"),
    ("priorities", r"(what|which|where).*(fix|issue|problem|wrong|first)|suggest|recommend|prioriti[sz]|what should"),
]
LATER_INTENTS = [
    ("nulls", r"null|missing|empty|blank|impute|imputation|nan"),
    ("duplicates", r"duplicat|dedup|dupe"),
    ("outliers", r"outlier|anomal|winsor|capping|\biqr\b"),
    ("knn", r"\bknn\b"),
    ("types", r"type|cast|convert|number|numeric|string"),
    ("text_hygiene", r"trim|whitespace|space|case|capital|lower|upper"),
    ("export", r"export|download|save|csv out"),
    ("undo_help", r"undo|reset|revert|start over"),
    ("help", r"help|what can you|how do you work|capab"),
]
LOW = f"lower({strip('goal')})"
TASK = "CASE " + " ".join(f"WHEN regexp_matches({LOW}, '{p}') THEN '{t}'" for t, _, p in TASKS) + " ELSE 'unknown' END"
# Longest normalised names first, then table order.
NAMES = "[" + ", ".join(f"{{'c': '{c}', 'n': '{c.replace('_', '')}'}}" for c in
                       ("o_orderpriority", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderkey", "o_custkey")) + "]"


def _norm(x: str) -> str:
    return f"regexp_replace(lower({x}), '[^a-z0-9]', '', 'g')"


SPOKEN = f"CASE WHEN regexp_matches({LOW}, '{PHRASE}') THEN {_norm(f'regexp_extract({LOW}, ' + chr(39) + PHRASE + chr(39) + ', 1)')} END"
TARGET = (f"coalesce(list_filter({NAMES}, lambda x: coalesce(contains({SPOKEN}, x.n) OR contains(x.n, {SPOKEN}), false))[1].c, "
          f"list_filter({NAMES}, lambda x: contains({_norm(LOW)}, x.n))[1].c)")
LABEL = "CASE task " + " ".join(f"WHEN '{t}' THEN '{l}'" for t, l, _ in TASKS) + " END"


@query("goal_task", with_views(["goals"], f"SELECT conv_id, turn, goal, {TASK} AS task FROM goals"))
def goal_task(spark, sf_dir):
    return view(spark, sf_dir, "goals").withColumn("task", C.goal_task(F.col("goal")))


@query("goal_target", with_views(["goals"], f"SELECT conv_id, turn, goal, {TARGET} AS target FROM goals"))
def goal_target(spark, sf_dir):
    return view(spark, sf_dir, "goals").withColumn("target", C.goal_target(F.col("goal"), _columns(spark, sf_dir)))


KEYWORDS = (f"WITH w AS (SELECT conv_id, turn, unnest(regexp_extract_all(lower({strip('text')}), '[a-z]{{4,}}')) AS k, "
            f"generate_subscripts(regexp_extract_all(lower({strip('text')}), '[a-z]{{4,}}'), 1) AS i FROM conversations), "
            "f AS (SELECT conv_id, turn, k, min(i) AS i FROM w GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY i) AS n FROM f) "
            "SELECT c.conv_id, c.turn, coalesce(string_agg(k, ' ' ORDER BY n), '') AS keywords FROM conversations c "
            "LEFT JOIN r ON r.conv_id = c.conv_id AND r.turn = c.turn GROUP BY c.conv_id, c.turn")


@query("goal_keywords", KEYWORDS)
def goal_keywords(spark, sf_dir):
    df = table(spark, sf_dir, "conversations")
    return df.select("conv_id", "turn", F.array_join(C.goal_keywords(F.col("text")), " ").alias("keywords"))


@query("goal_summary", with_views(["goals"], f", g AS (SELECT conv_id, turn, {TASK} AS task, {TARGET} AS target FROM goals) SELECT conv_id, turn, "
       "CASE WHEN task = 'unknown' THEN 'Objective noted' || coalesce(' — target column \"' || target || '\"', '') || '. I''ll keep suggestions general-purpose.' "
       f"ELSE 'Aligning to a ' || {LABEL} || coalesce(' with target \"' || target || '\"', '') || '.' END AS summary FROM g"))
def goal_summary(spark, sf_dir):
    task, target = C.goal_task(F.col("goal")), C.goal_target(F.col("goal"), _columns(spark, sf_dir))
    return view(spark, sf_dir, "goals").select("conv_id", "turn", C.goal_summary(task, target).alias("summary"))


MSG = f"lower({strip('message')})"
TABLE_NAMES = "[" + ", ".join(f"'{c}'" for c in ("oorderkey", "ocustkey", "oorderstatus", "ototalprice", "oorderdate", "oorderpriority")) + "]"
NAMED = f"len(list_filter({TABLE_NAMES}, lambda x: contains({_norm(MSG)}, x))) > 0"


def _route(pairs) -> str:
    return " ".join(f"WHEN regexp_matches({MSG}, '{p}') THEN '{i}'" for i, p in pairs)


@query("chat_intent", with_views(["messages"], f"SELECT conv_id, turn, CASE WHEN regexp_matches(lower(message), '\\b(undo|revert|go back|take (that|it) back)\\b') THEN 'undo' "
       f"WHEN regexp_matches(lower(message), '\\b(reset|start over|clear (the )?recipe|restore original)\\b') THEN 'reset' {_route(FIRST_INTENTS)} "
       f"WHEN {NAMED} AND regexp_matches({MSG}, '(analy|profile|tell me about|column|check|inspect|look at|stats)') THEN 'column_analysis' {_route(LATER_INTENTS)} "
       f"WHEN {NAMED} THEN 'column_mention' ELSE 'fallback' END AS intent, "
       f"CASE WHEN regexp_matches({MSG}, '(hi|hello|hey|help|start)') THEN 'no_data_help' ELSE 'no_data' END AS intent_without_table FROM messages"))
def chat_intent(spark, sf_dir):
    columns = _columns(spark, sf_dir)
    return view(spark, sf_dir, "messages").select(
        "conv_id", "turn", C.message_intent(F.col("message"), columns).alias("intent"),
        C.message_intent(F.col("message"), None).alias("intent_without_table"))
