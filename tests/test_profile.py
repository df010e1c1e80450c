import json
import random

import pytest
from pyspark.sql import functions as F

from cleanloom.operators import advice as A, profile as P
from cleanloom.operators.base import RowOrder
from cleanloom.operators.outliers import outlier_report
from cleanloom.operators.rows import duplicate_count
from conftest import values

ORDER = RowOrder.of(row_id="rid")


def frame(spark, cells, schema="rid int, c string", parts=1, seed=0):
    rows = [(i, c) for i, c in enumerate(cells)]
    random.Random(seed).shuffle(rows)
    return spark.createDataFrame(rows, schema).repartition(parts)


@pytest.mark.parametrize("parts", [1, 3, 17])
def test_case_collisions_follow_the_first_spelling(spark, parts):
    df = frame(spark, ["Paris", "paris", "PARIS ", "Paris", "  ", "", None, "Rome"], parts=parts, seed=parts)
    row = P.table_profile(df, ORDER).first()
    assert (row.case_collisions, row.whitespace, row.nulls, row.unique) == (2, 2, 1, 5)
    assert row.sample == ["Paris", "paris", "PARIS "] and row.null_pct == 12.5


def test_numeric_and_empty_columns(spark):
    df = spark.createDataFrame([(0, 1.5, None), (1, 2.0, None)], "rid int, x double, y string")
    rows = {r.name: r for r in P.table_profile(df, ORDER).collect()}
    assert rows["x"].sample == ["1.5", "2"] and rows["x"].dtype == "Float64" and rows["x"].numeric_like == 0.0
    assert (rows["y"].nulls, rows["y"].unique, rows["y"].sample, rows["y"].null_pct) == (2, 0, [], 100.0)
    assert P.table_profile(df.limit(0), ORDER).count() == 2


def test_sampled_profile_looks_at_the_first_rows(spark):
    df = frame(spark, [str(i) for i in range(50)] + [None], parts=3)
    row = P.table_profile(df, ORDER, sample_rows=10).first()
    assert (row.unique, row.rows, row.nulls, row.numeric_like) == (10, 51, 1, 1.0)


@pytest.mark.parametrize("order", [ORDER, None])
def test_tally_is_shuffled_once(spark, order):
    df = frame(spark, ["a", "b"] * 30, parts=2)
    if order:
        profile = P._bounded_measures(P.bounded_tally(df, ["c"], order), order)
    else:
        profile = P.table_profile(df)
    profile.collect()
    final = profile._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert final.count("ReusedExchange") == 2 and (order is None or final.count("Generate") == 1)


def test_no_long_text_is_shuffled(spark):
    """Keys of long texts are short, and distinct for distinct texts; short texts are their own keys."""
    cells = ["long text " * 50, "long text " * 50 + "x", "b", None, "", "\0abc", "é" * 32, "é" * 33] * 3
    tally = P.bounded_tally(frame(spark, cells, parts=3), ["c"], ORDER)
    rows = tally.collect()
    assert len(rows) == 8 and {r.cnt for r in rows} == {3}
    assert all(len(x) <= 36 for r in rows for x in (r.k, r.t, r.low) if x is not None)
    assert {r.k for r in rows} >= {"b", None, "", "é" * 32} and sum(r.k is not None and r.k.startswith("\0") for r in rows) == 4


def test_fingerprints_and_texts_agree(spark):
    """The two ways of the profile on rows whose order is the order of their texts."""
    rng = random.Random(3)
    cells = sorted(rng.choice(["a", "A", " a", "B ", "b", "12", "1,200", "-3.5", "", "  ", "x y z", "é", "É", "w " * 40, "W " * 40, "  " * 40 + "a", "1" * 70]) for _ in range(200))
    df = spark.createDataFrame([(i, c, float(i % 7) / 4, None) for i, c in enumerate(cells)] + [(200, None, None, None)], "rid long, s string, x double, n string")
    other = df.drop("rid")
    cases = ["case_collisions", "sample"]
    both = [P.table_profile(df, ORDER).drop(*cases).orderBy("position").collect(), P.table_profile(other).drop(*cases).orderBy("position").collect()]
    assert both[0] == both[1]
    assert P.table_profile(df, ORDER).where("name = 's'").first()["sample"] == sorted(set(cells) - {""})[:3]


@pytest.mark.parametrize("keys", [["k"], ["k", "rid"], ["d", "rid"]])
def test_samples_follow_any_order(spark, keys):
    """Text keys, several keys and dates; names like those used inside; repeated late values."""
    rows = [(f"{i:03d}", i, f"v{(i * 7) % 5}" if i > 3 else None, "z") for i in range(40)]
    df = spark.createDataFrame(rows, "k string, rid int, v string, ci string").withColumn("d", F.date_add(F.lit("2020-01-01").cast("date"), F.col("rid"))).repartition(5)
    got = {r.name: r.sample for r in P.table_profile(df, RowOrder.of(order_by=keys, row_id=[c for c in ("k", "rid", "d") if c in keys])).collect()}
    assert got["v"] == ["v3", "v0", "v2"] and got["ci"] == ["z"]


def test_deep_profile_of_a_coerced_column(spark):
    row = P.column_profile(frame(spark, [f"${v}" for v in (1, 2, 3, 4, 100)] * 4 + [None]), "c", ORDER).first()
    assert row.numeric and row.coerced and row.stats.median == 3.0 and row.outliers["count"] == 4
    assert row.histogram[0] == 16 and row.histogram[-1] == 4 and sum(row.histogram) == 20 and len(row.histogram) == 14
    assert row.top_values is None and row.tips[0] == "4.8% nulls — safe to impute." and "100% match" in row.tips[-1]


def test_deep_profile_of_text(spark):
    row = P.column_profile(frame(spark, ["x" * 60, "b", "b", "a", "a", "c"]), "c", ORDER).first()
    assert row.stats is None and [(t.value[0], t["count"]) for t in row.top_values][:3] == [("b", 2), ("a", 2), ("x", 1)]
    assert row.sample[0] == "x" * 42 + "…"


def test_single_value_and_constant_columns(spark):
    one = P.numeric_summary(spark.createDataFrame([(0, 5.0)], "rid int, x double"), ["x"]).first()
    assert one["std"] == 0.0 and one["iqr"] == 0.0
    assert P.histogram(spark.createDataFrame([(5.0,), (5.0,)], "x double"), "x").count() == 0


def test_duplicates_tell_null_positions_apart(spark):
    df = spark.createDataFrame([(None, 1), (1, None), (None, 1), (2, 2)], "a int, b int")
    assert duplicate_count(df).first().asDict() == {"duplicates": 1, "rows": 4}


def test_unique_counts_exact_and_sketched(spark):
    df = spark.range(500).select((F.col("id") % 7).alias("a"), (F.col("id") / 4).alias("b"), F.when(F.col("id") % 5 == 0, "").otherwise(F.col("id").cast("string")).alias("c"))
    assert dict(P.unique_counts(df).collect()) == {"a": 7, "b": 500, "c": 400}
    rough = dict(P.unique_counts(df, approx=True).collect())
    assert rough["a"] == 7 and abs(rough["b"] - 500) < 100


def test_outlier_multiplier_is_clamped(spark):
    df = spark.createDataFrame([(float(i),) for i in range(10)] + [(1000.0,)], "x double")
    assert outlier_report(df, "x", 500).first().multiplier == 20.0
    assert outlier_report(df, "x").first()["count"] == 1


SCHEMA = ("position int, name string, dtype string, rows bigint, nulls bigint, null_pct double, unique bigint, sample array<string>, "
          "numeric_like double, whitespace bigint, case_collisions bigint, numbers bigint, wholes bigint, mean_words double")


def profile(spark, *rows):
    base = {"dtype": "String", "rows": 1000, "nulls": 0, "null_pct": 0.0, "unique": 10, "sample": ["a"], "numeric_like": 0.0, "whitespace": 0, "case_collisions": 0,
            "numbers": 0, "wholes": 0, "mean_words": 1.0}
    full = [{**base, "position": i, **r} for i, r in enumerate(rows)]
    names = [f.split()[0] for f in SCHEMA.split(", ")]
    return spark.createDataFrame([tuple(r[n] for n in names) for r in full], SCHEMA)


def test_suggestion_rules(spark):
    p = profile(
        spark,
        {"name": "a", "nulls": 600, "null_pct": 60.0},
        {"name": "b", "nulls": 10, "null_pct": 1.0},
        {"name": "c", "nulls": 120, "null_pct": 12.0, "unique": 400},
        {"name": "d", "nulls": 1, "null_pct": 0.1, "dtype": "Int64"},
        {"name": "e", "numeric_like": 0.95, "sample": ["1,000", "x", "2"], "numbers": 950, "wholes": 950},
        {"name": "f", "numeric_like": 0.9, "sample": ["1"], "numbers": 900, "wholes": 899},
        {"name": "g", "numeric_like": 1.0, "sample": ["1"], "numbers": 9, "wholes": 9},
    )
    got = A.suggestions(p, 5).orderBy("rank").collect()
    assert [(r.title, r.impact) for r in got] == [
        ('Fill nulls in "c" with "Unknown"', "high"), ("Remove duplicate rows", "medium"), ('Cast "e" to Int64', "medium"),
        ('Cast "f" to Float64', "medium"), ('Drop rows missing "b"', "medium"), ('Consider dropping "a"', "low"),
    ]
    ops = A.auto_clean_ops(A.suggestions(p, 5))
    assert [o["type"] for o in ops] == ["drop_duplicates", "cast", "cast", "fill_null"]
    assert A.suggestions(profile(spark, {"name": "z"}), 0).count() == 0


def test_proposals_follow_the_goal(spark):
    p = profile(spark, {"name": "y", "dtype": "Float64", "nulls": 30, "null_pct": 3.0}, {"name": "x", "dtype": "Int64", "nulls": 60, "null_pct": 6.0},
                {"name": "t", "whitespace": 3, "case_collisions": 2, "sample": ["A", "a"]})
    got = {r.title: r for r in A.proposals(p, 0, ["y", "x"], 40, 0.04, {"task": "classification", "target": "y"}).collect()}
    assert got['Drop rows with a missing target ("y")'].impact == "high"
    assert got['KNN-impute "x" (k=5)'].confidence == 0.9 and json.loads(got['KNN-impute "x" (k=5)'].op) == {"type": "knn_impute", "column": "x", "k": 5}
    forest = got["Isolation Forest — remove 40 anomalous rows"]
    assert json.loads(forest.op) == {"type": "iforest_outliers", "contamination": 0.04, "features": ["y", "x"]}
    assert forest.goal_note and "signal" in forest.goal_warning
    assert 'Standard-scale "x"' in got and 'Trim whitespace in "t"' in got and 'Normalize case in "t"' in got
    plain = A.proposals(p, 0, ["y", "x"]).collect()
    assert all(r.goal_note is None and r.goal_warning is None for r in plain) and not any("scale" in r.title for r in plain)


def test_complexity_signals(spark):
    prose = {"mean_words": 9.0, "unique": 900}
    p = profile(spark, {"name": "email", "unique": 400}, {"name": "hotel", "unique": 400}, {"name": "t1", **prose}, {"name": "t2", **prose})
    got = {r.code: (r.severity, r.points, r.columns) for r in A.complexity_signals(p, 0.15).collect()}
    assert got == {"pii": ("warn", 1, ["email", "hotel"]), "unstructured_text": ("critical", 3, ["t1", "t2"]), "nonlinear_anomalies": ("warn", 2, [])}
    verdict = A.complexity(A.complexity_signals(p, 0.15)).first()
    assert verdict.score == 6 and verdict.complex and verdict.signals == ["unstructured_text", "pii", "nonlinear_anomalies"]
    warning = A.deep_learning_warning(A.complexity_signals(p, 0.15)).first()
    assert warning.method.count(" · ") == 1 and warning.requires_explicit_approval
    assert A.deep_learning_warning(A.complexity_signals(profile(spark, {"name": "q"}), 0.0)).count() == 0
    wide = profile(spark, *[{"name": f"c{i}", "rows": 10, "dtype": "Int64"} for i in range(6)])
    assert [(r.code, r.severity) for r in A.complexity_signals(wide).collect()] == [("high_dimensionality", "critical")]


def test_analyze_all(spark):
    rows = [(i, float(i % 50), float(i % 7), " x" if i % 2 else "X") for i in range(120)]
    df = spark.createDataFrame(rows, "rid int, a double, b double, c string")
    row = A.analyze_all(df, ORDER, {"task": "clustering", "target": None}).first()
    assert (row.rows, row.cols, row.numeric_cols, row.text_cols) == (120, 3, 2, 1) and not row.complex
    assert any("Standard-scale" in p.title for p in row.proposals)


def test_column_profile_reads_the_table_once_a_measure(spark):
    """Quartiles, ends and the tally were found again for outliers, the histogram and each branch of the profile."""
    read = spark.sparkContext.accumulator(0)

    def passed(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    rows = [(i, f"${i % 90},000" if i % 10 else None) for i in range(400)] + [(400, "$9,000,000")]
    df = spark.createDataFrame(rows, "rid long, x string").repartition(3).localCheckpoint().mapInArrow(passed, "rid long, x string")
    got = P.column_profile(df, "x", RowOrder.of(row_id="rid")).first()
    assert (got.nulls, got.unique, got.outliers["count"], sum(got.histogram), got.stats["max"]) == (40, 82, 1, 361, 9e6)
    # Share of numbers, summary, quartiles, outliers, histogram, tally.
    assert read.value == 6 * 401
