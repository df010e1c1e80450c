"""Versioned recipe log: (dataset_id, version, position, op_json) as Parquet.

A version without operations is one row with position -1, so that it still counts as the newest.
"""

from __future__ import annotations

import json
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession, functions as F

from cleanloom.operators.base import Op
from cleanloom.plans.lookup import attach

SCHEMA = "dataset_id string, version bigint, position int, op_json string"


def append(log: DataFrame, path: str) -> None:
    log.select("dataset_id", "version", "position", "op_json").write.mode("append").parquet(path)


def save_recipe(spark: SparkSession, path: str, dataset_id: str, version: int, ops: Iterable[Op]) -> None:
    rows = [(dataset_id, version, i, json.dumps(op, sort_keys=True)) for i, op in enumerate(ops)]
    rows = rows or [(dataset_id, version, -1, None)]
    append(spark.createDataFrame(rows, SCHEMA), path)


def load_recipe(spark: SparkSession, path: str, dataset_id: str) -> list[Op]:
    """Latest recipe of one dataset; the filter reaches the files."""
    mine = spark.read.schema(SCHEMA).parquet(path).filter(F.col("dataset_id") == dataset_id)
    newest = mine.agg(F.max("version")).first()[0]
    steps = mine.filter((F.col("version") == F.lit(newest)) & (F.col("position") >= 0)).orderBy("position").select("op_json").collect()
    return [json.loads(s.op_json) for s in steps]


def latest(log: DataFrame) -> DataFrame:
    """Steps of the newest version of every dataset; one dataset may hold most of the log."""
    newest = log.groupBy("dataset_id").agg(F.max("version").alias("newest"), F.count(F.lit(1)).alias("weight"))
    size = newest.agg(F.count(F.lit(1)).alias("n"), F.sum("weight").alias("rows")).first()
    joined = attach(log, newest, ["dataset_id"], "weight", size.rows or 0, size.n, F.lit(True))
    return joined.filter((F.col("version") == F.col("newest")) & (F.col("position") >= 0)).drop("newest")
