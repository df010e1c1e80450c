"""Dirty views derived from the given tables; the same text runs in Spark SQL and DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_DIRT = """
  CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE o_totalprice END AS price,
  CASE WHEN o_orderkey % 23 = 0 THEN NULL
       WHEN o_orderkey % 11 = 0 THEN concat('  ', o_orderpriority)
       WHEN o_orderkey % 7 = 0 THEN concat(lower(o_orderpriority), ' ')
       ELSE o_orderpriority END AS priority,
  CASE WHEN o_orderkey % 19 = 0 THEN 'N/A' WHEN o_orderkey % 17 = 0 THEN 'unknown'
       ELSE concat('$', CAST(CAST(floor(o_totalprice / 1000) AS BIGINT) AS STRING), ',',
            lpad(CAST(CAST(floor(o_totalprice) AS BIGINT) % 1000 AS STRING), 3, '0')) END AS price_txt,
  CASE WHEN o_orderkey % 29 = 0 THEN NULL WHEN o_orderkey % 31 = 0 THEN 'x'
       ELSE CAST(o_custkey AS STRING) END AS cust_txt,
  CASE o_orderkey % 6 WHEN 0 THEN 'yes' WHEN 1 THEN 'no' WHEN 2 THEN 'Y'
       WHEN 3 THEN 'n' WHEN 4 THEN 'true' ELSE 'false' END AS flag
"""

# Every tenth order occurs twice; ``rid`` is the row order and not data.
ORDERS_MESSY = f"""
SELECT o_orderkey * 2 AS rid, o_orderkey, o_custkey, {_DIRT} FROM orders
UNION ALL
SELECT o_orderkey * 2 + 1 AS rid, o_orderkey, o_custkey, {_DIRT} FROM orders WHERE o_orderkey % 10 = 0
"""

CUSTOMER_GAPS = """
SELECT c_custkey, c_nationkey, CASE WHEN c_custkey % 9 = 0 THEN NULL ELSE c_acctbal END AS acctbal FROM customer
"""

EVENTS_GAPS = """
SELECT event_id, user_id, event_type, CASE WHEN event_id % 4 <> 0 THEN NULL ELSE value END AS value FROM events
"""

# Every text of the table, and one scripted goal a row beside it.
GOALS = """
SELECT conv_id, turn, text AS goal FROM conversations
UNION ALL
SELECT conv_id, turn, CASE CAST((conv_id + turn) % 9 AS INT)
  WHEN 0 THEN 'Predict customer churn with XGBoost' WHEN 1 THEN 'Forecast monthly revenue per city'
  WHEN 2 THEN 'Cluster customers into segments' WHEN 3 THEN 'I want to build a classification model'
  WHEN 4 THEN 'sentiment analysis of reviews' WHEN 5 THEN 'ARIMA on daily load'
  WHEN 6 THEN 'build a dashboard for BI' WHEN 7 THEN 'predict o_totalprice value'
  ELSE 'just clean it' END AS goal FROM conversations
"""

# Every text of the table, and one scripted question a row beside it.
MESSAGES = """
SELECT conv_id, turn, text AS message FROM conversations
UNION ALL
SELECT conv_id, turn, CASE CAST((conv_id + 3 * turn) % 21 AS INT)
  WHEN 0 THEN 'Hello there' WHEN 1 THEN 'please auto-clean it' WHEN 2 THEN 'what should I fix first?'
  WHEN 3 THEN 'analyze column o_totalprice' WHEN 4 THEN 'how many missing values' WHEN 5 THEN 'any duplicates?'
  WHEN 6 THEN 'show me outliers' WHEN 7 THEN 'how does KNN work' WHEN 8 THEN 'convert this to a number'
  WHEN 9 THEN 'capital letters everywhere' WHEN 10 THEN 'download the file' WHEN 11 THEN 'undo that'
  WHEN 12 THEN 'start over' WHEN 13 THEN 'help me' WHEN 14 THEN 'o_orderdate' WHEN 15 THEN 'showcase of finance'
  WHEN 16 THEN 'revert' ELSE text END AS message FROM conversations
"""

VIEWS = {
    "orders_messy": ORDERS_MESSY,
    "customer_gaps": CUSTOMER_GAPS,
    "events_gaps": EVENTS_GAPS,
    "goals": GOALS,
    "messages": MESSAGES,
}
SOURCES = {"orders_messy": "orders", "customer_gaps": "customer", "events_gaps": "events", "goals": "conversations", "messages": "conversations"}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def derived(spark: SparkSession, folder: str, sql: str, source: str) -> DataFrame:
    """Run SQL text over one given table."""
    text = sql.replace("{", "{{").replace("}", "}}").replace(f"FROM {source}", f"FROM {{{source}}}")
    return spark.sql(text, **{source: table(spark, folder, source)})


def view(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A dirty view over the table it is derived from."""
    return derived(spark, folder, VIEWS[name], SOURCES[name])


def with_views(names: list[str], body: str) -> str:
    """Oracle SQL text: the views as common table expressions before the query."""
    ctes = ", ".join(f"{n} AS ({VIEWS[n]})" for n in names)
    return f"WITH {ctes} {body}"
