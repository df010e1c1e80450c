"""Rules and rounding look at all rows; state survives empty batches and versions."""

import json

import pytest
from pyspark.sql import functions as F

from cleanloom.functions.text import half_up
from cleanloom.operators import advice as A, profile as P
from cleanloom.operators.base import RowOrder
from cleanloom.operators.rows import duplicate_count
from cleanloom.plans.history import effective_recipe
from cleanloom.plans.recipe import apply_recipe
from cleanloom.sources import recipe_log

ORDER = RowOrder.of(row_id="rid")


def test_cast_type_looks_at_every_row(spark):
    """Whole numbers at first, fractions later: the fractions must survive auto-clean."""
    df = spark.createDataFrame([(i, str(i % 10) if i < 100 else f"{i}.5") for i in range(200)], "rid long, x string")
    profile = P.table_profile(df, ORDER)
    assert profile.select("numbers", "wholes").first() == (200, 100)
    ops = A.auto_clean_ops(A.suggestions(profile, duplicate_count(df, ["x"]).first().duplicates, None))
    assert {"type": "cast", "column": "x", "to": "Float64"} in ops
    clean = apply_recipe(df, [o for o in ops if o["type"] == "cast"], row_id="rid")
    assert clean.where(F.col("x").isNull()).count() == 0 and clean.agg(F.max("x")).first()[0] == 199.5
    assert {"type": "cast", "column": "x", "to": "Float64"} in [json.loads(r.op) for r in A.proposals(profile, 0, []).collect()]


def test_auto_clean_covers_a_wide_table(spark):
    names = [f"c{i}" for i in range(12)]
    df = spark.createDataFrame([(i, *[None if (i + k) % 7 == 0 else f" v{i % 5} " for k in range(12)]) for i in range(60)], "rid long, " + ", ".join(f"{n} string" for n in names))
    shown = A.suggestions(P.table_profile(df, ORDER), 0)
    every = A.auto_clean_ops(A.suggestions(P.table_profile(df, ORDER), 0, None))
    assert shown.count() <= 7 and {o["column"] for o in every if o["type"] == "trim"} == set(names) == {o["column"] for o in every if o["type"] == "fill_null"}


@pytest.mark.parametrize(("x", "digits", "want"), [(1e16, 4, 1e16), (-3e15, 4, -3e15), (1e300, 2, 1e300), (-2.5, 0, -2.0), (2.345, 2, 2.35), (1e13, 2, 1e13)])
def test_rounding_of_large_numbers(spark, x, digits, want):
    assert spark.range(1).select(half_up(F.lit(x), digits)).first()[0] == want


def test_empty_batches_use_up_no_undo(spark):
    log = spark.createDataFrame([("d", 0, "apply", '[{"type":"trim"}]'), ("d", 1, "apply", "[]"), ("d", 2, "undo", None), ("e", 0, "apply", '[{"type":"trim"}]'),
                                 ("e", 1, "apply", None)], "dataset_id string, position long, event string, ops string")
    assert [r.dataset_id for r in effective_recipe(log).collect()] == ["e"]
    deep = spark.createDataFrame([("d", i, "apply", '[{"type":"trim"}]') for i in range(4)] + [("d", 4 + i, "undo", None) for i in range(4)],
                                 "dataset_id string, position long, event string, ops string")
    assert effective_recipe(deep, undo_levels=2).count() == 2 and effective_recipe(deep).count() == 0


def test_an_emptied_version_is_the_newest(spark, tmp_path):
    path = str(tmp_path / "log")
    recipe_log.save_recipe(spark, path, "d", 1, [{"type": "trim"}])
    recipe_log.save_recipe(spark, path, "d", 2, [])
    recipe_log.save_recipe(spark, path, "e", 1, [{"type": "trim"}])
    assert recipe_log.load_recipe(spark, path, "d") == []
    assert [r.dataset_id for r in recipe_log.latest(spark.read.schema(recipe_log.SCHEMA).parquet(path)).collect()] == ["e"]


def test_duplicate_count_with_names_of_its_own(spark):
    df = spark.createDataFrame([(1, 2, 3), (1, 2, 3), (2, 2, 3)], ["h1", "h2", "fingerprint rows"])
    assert duplicate_count(df).first()[:2] == (1, 3)
