"""File sources and sinks, streams, messy rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from cleanloom.catalog.registry import query, strip
from cleanloom.plans.recipe import Recipe
from cleanloom.session import scratch_path
from cleanloom.sources import csv
from cleanloom.streaming.ingest import ingest_csv_stream, replay_stream
from cleanloom.views import table, view, with_views

NULLS = "('', 'NA', 'N/A', 'na', 'null', 'NULL', 'None', 'NaN')"
STREAM_FILES = 4


def _csv_copy(spark, df, files: int | None = None) -> str:
    path = scratch_path(spark, "csv")
    csv.write_csv(df.repartition(files) if files else df, path)
    return path


@query("csv_scan", with_views(["orders_messy"], "SELECT CAST(rid AS VARCHAR) AS rid, CAST(o_orderkey AS VARCHAR) AS o_orderkey, priority, "
                              f"CASE WHEN price_txt NOT IN {NULLS} THEN price_txt END AS price_txt, cust_txt, flag FROM orders_messy"))
def csv_scan(spark, sf_dir):
    df = view(spark, sf_dir, "orders_messy").select("rid", "o_orderkey", "priority", "price_txt", "cust_txt", "flag")
    return csv.scan_text(spark, _csv_copy(spark, df))


# Line breaks, quotes, commas and carriage returns inside the cells of a whole text column.
BROKEN = """concat('"', role, '",', chr(10), replace(text, ' the ', concat(' "the', chr(13), chr(10), '", ')), chr(10), chr(10), turn)"""


@query("csv_multiline", f"SELECT row_number() OVER (ORDER BY conv_id, turn, text) - 1 AS n, conv_id, turn::BIGINT AS turn, {BROKEN} AS text FROM conversations")
def csv_multiline(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.expr(BROKEN).alias("broken"), "text")
    path = scratch_path(spark, "csv")
    csv.write_csv(rows.repartitionByRange(3, "conv_id", "turn", "text").sortWithinPartitions("conv_id", "turn", "text").drop("text").withColumnRenamed("broken", "text"), path)
    return csv.read_csv(spark, path, multi_line=True, row_id="n")


TYPES = {"rid": "Int64", "o_orderkey": "Int64", "o_custkey": "Int64", "price": "Float64", "priority": "String", "price_txt": "String", "cust_txt": "String", "flag": "String"}
DECIDE = ("CASE WHEN count({c}) = 0 THEN 'String' WHEN count(CASE WHEN regexp_matches({c}::VARCHAR, '^[+-]?[0-9]+$') THEN 1 END) = count({c}) THEN 'Int64' "
          "WHEN count(CASE WHEN regexp_matches({c}::VARCHAR, '^[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?$') THEN 1 END) = count({c}) THEN 'Float64' "
          "WHEN count(CASE WHEN {c}::VARCHAR IN ('true', 'false') THEN 1 END) = count({c}) THEN 'Boolean' ELSE 'String' END")


@query("infer_schema", with_views(["orders_messy"], " UNION ALL ".join(f"SELECT '{c}' AS name, {DECIDE.format(c=c)} AS dtype FROM orders_messy" for c in TYPES)))
def infer_schema(spark, sf_dir):
    return csv.infer_types(csv.scan_text(spark, _csv_copy(spark, view(spark, sf_dir, "orders_messy"))))


@query("csv_roundtrip", "SELECT p_partkey, p_name, p_brand, p_type, p_size::BIGINT AS p_size, p_retailprice FROM part")
def csv_roundtrip(spark, sf_dir):
    return csv.read_csv(spark, _csv_copy(spark, table(spark, sf_dir, "part")))


@query("preview", "SELECT o_orderkey, o_custkey, o_orderstatus, round(o_totalprice, 6) AS o_totalprice, strftime(o_orderdate, '%Y-%m-%d') AS o_orderdate, o_orderpriority "
       "FROM orders ORDER BY o_orderkey LIMIT 100")
def preview(spark, sf_dir):
    return csv.preview(table(spark, sf_dir, "orders"), "o_orderkey")


# Four files of parts, three ways to write their header: order, blanks, a byte order mark, no name, missing columns.
HEADERS = [["p_partkey", "p_name", "p_size"], ["\ufeffp_size ", " p_partkey", "p_brand"], ["p_brand", " ", "  p_partkey  "]]
PICKED = [["p_partkey", "p_name", "p_size"], ["p_size", "p_partkey", "p_brand"], ["p_brand", "p_retailprice", "p_partkey"]]


@query("csv_headers", "SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN p_name END AS p_name, CASE WHEN p_partkey % 3 < 2 THEN p_size::BIGINT END AS p_size, "
       "CASE WHEN p_partkey % 3 > 0 THEN p_brand END AS p_brand, CASE WHEN p_partkey % 3 = 2 THEN p_retailprice END AS column_2 FROM part")
def csv_headers(spark, sf_dir):
    part, folder = table(spark, sf_dir, "part"), scratch_path(spark, "csv")
    for i, (header, picked) in enumerate(zip(HEADERS, PICKED)):
        csv.write_csv(part.where(F.col("p_partkey") % 3 == i).select(*picked).toDF(*header).repartition(2), f"{folder}/{i}")
    return csv.read_csv(spark, f"{folder}/*", by_header=True)


INGESTED = {"o_orderkey": "o_orderkey", "o_custkey": "o_custkey", "o_orderstatus": "o_orderstatus", "o_totalprice": "CAST(o_totalprice AS DECIMAL(18, 2))",
            "o_orderdate": "CAST(o_orderdate AS DATE)", "o_orderpriority": "o_orderpriority"}
# A row has a comma or a line feed behind each cell, and each file a header.
HEADER = ",".join(INGESTED)
BYTES = " + ".join(f"coalesce(strlen(CAST({x} AS VARCHAR)), 0)" for x in INGESTED.values())


@query("stream_ingest", f"SELECT count(*) AS rows, {STREAM_FILES} AS chunks, (sum({BYTES} + {len(INGESTED)}) + {STREAM_FILES * (len(HEADER) + 1)})::BIGINT AS bytes, 6 AS cols, "
       f"least(100, count(*))::INTEGER AS preview_rows, '{HEADER}' AS header FROM orders")
def stream_ingest(spark, sf_dir):
    cells = [F.expr(f"CAST({x} AS STRING)").alias(c) for c, x in INGESTED.items()]
    path = _csv_copy(spark, table(spark, sf_dir, "orders").select(*cells), STREAM_FILES)
    return ingest_csv_stream(spark, path).as_frame(spark)


REPLAY = [
    {"type": "fill_null", "column": "value", "strategy": "mean"},
    {"type": "cap_outliers", "column": "user_id", "multiplier": 0.25},
    {"type": "normalize_case", "column": "event_type", "mode": "upper"},
]


@query("stream_replay", with_views(["events_gaps"], ", m AS (SELECT avg(value) AS m, quantile_cont(user_id, 0.25) AS q1, quantile_cont(user_id, 0.75) AS q3 FROM events_gaps) "
       "SELECT event_id, CAST(greatest(least(user_id, floor(q3 + 0.25 * (q3 - q1))), ceil(q1 - 0.25 * (q3 - q1))) AS BIGINT) AS user_id, upper(event_type) AS event_type, "
       "round(coalesce(value, m), 4) AS value FROM events_gaps, m"))
def stream_replay(spark, sf_dir):
    gaps = view(spark, sf_dir, "events_gaps")
    fitted = Recipe(REPLAY).fit(gaps)
    schema = table(spark, sf_dir, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    value = F.when(F.col("event_id") % 4 == 0, F.col("value")).alias("value")
    out = scratch_path(spark, "replayed")
    replay_stream(stream.select("event_id", "user_id", "event_type", value), fitted, out, scratch_path(spark, "state"))
    return spark.read.parquet(out).withColumn("value", F.round("value", 4))
