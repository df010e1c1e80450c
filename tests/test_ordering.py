import random

import pytest
from pyspark.sql import functions as F

from cleanloom.plans import lookup, ordering
from conftest import values


@pytest.fixture(autouse=True)
def many_blocks(monkeypatch):
    monkeypatch.setattr(ordering, "ROWS_PER_BLOCK", 40)


def shuffled(spark, rows, schema, parts):
    rows = list(rows)
    random.Random(parts).shuffle(rows)
    return spark.createDataFrame(rows, schema).repartition(parts)


@pytest.mark.parametrize("parts", [1, 3, 17])
def test_row_number_is_the_global_one(spark, parts):
    df = shuffled(spark, [(i * 7,) for i in range(500)], "k bigint", parts)
    out = ordering.with_row_number(df, "k", "n").collect()
    assert all(r.n == r.k // 7 for r in out) and len(out) == 500


@pytest.mark.parametrize("parts", [1, 5])
def test_composite_order_with_one_hot_leading_value(spark, parts):
    rows = [("hot", i) for i in range(300)] + [("a", i) for i in range(20)] + [("z", i) for i in range(20)]
    df = shuffled(spark, rows, "src string, k int", parts)
    got = ordering.with_row_number(df, ["src", "k"], "n").collect()
    assert [(r.src, r.k) for r in sorted(got, key=lambda r: r.n)] == sorted(rows)
    blocks = ordering.blocked(df, ["src", "k"]).summary(F.count("*").alias("n")).collect()
    assert max(r.n for r in blocks) < 200


def test_skewed_numeric_keys_are_balanced(spark):
    rows = [(float(i),) for i in range(300)] + [(1e9 + i,) for i in range(100)]
    b = ordering.blocked(shuffled(spark, rows, "k double", 3), "k")
    sizes = [r.n for r in b.summary(F.count("*").alias("n")).collect()]
    assert len(sizes) > 4 and max(sizes) < 120


@pytest.mark.parametrize("parts", [1, 3, 17])
def test_forward_fill_crosses_blocks(spark, parts):
    rng = random.Random(5)
    rows = [(i, rng.choice(["p", "p", "q", None]), rng.random() if rng.random() < 0.05 else None) for i in range(600)]
    df = shuffled(spark, rows, "i int, g string, x double", parts)
    last, per, want, want_g = None, {}, [], []
    for _, g, x in rows:
        last = x if x is not None else last
        per[g] = x if x is not None else per.get(g)
        want.append(last)
        want_g.append(per[g])
    assert values(ordering.forward_filled(df, "x", "i"), "x", "i") == want
    assert values(ordering.forward_filled(df, "x", "i", "g"), "x", "i") == want_g


@pytest.mark.parametrize("kind", ["timestamp", "timestamp_ntz", "date"])
def test_time_keys(spark, kind):
    step = "make_interval(0,0,0,id)" if kind == "date" else "make_interval(0,0,0,0,0,0,id * 0.7)"
    df = spark.range(300).selectExpr("id", f"cast(timestamp_ntz'2024-03-30 22:00:00' + {step} as {kind}) AS t").repartition(5)
    assert len(ordering.blocked(df, "t").summary(F.count("*").alias("n")).collect()) > 4
    assert all(r.n == r.id for r in ordering.with_row_number(df, "t", "n").collect())


def test_rows_at_sorts_only_touched_blocks(spark):
    df = shuffled(spark, [(i,) for i in range(400)], "k int", 3)
    assert sorted(values(ordering.rows_at(df, "k", [0, 123, 399, 123]), "k")) == [0, 123, 399]


def test_no_window_gathers_the_table(spark):
    df = shuffled(spark, [(i, None if i % 3 else i) for i in range(400)], "k int, x int", 3)
    plan = ordering.forward_filled(df, "x", "k")._jdf.queryExecution().executedPlan().toString()
    single = plan[plan.index("SinglePartition"):]
    # The only gathered input is the aggregate with one row per block.
    assert plan.count("SinglePartition") == 1 and single.split("\n")[1].find("HashAggregate") >= 0 or "SortAggregate" in single.split("\n")[1]


@pytest.mark.parametrize("broadcast_rows", [0, 1000])
def test_attach_with_hot_and_null_keys(spark, monkeypatch, broadcast_rows):
    monkeypatch.setattr(lookup, "BROADCAST_ROWS", broadcast_rows)
    monkeypatch.setattr(lookup, "HOT_KEYS", 5)
    keys = [1] * 60 + [None] * 30 + list(range(2, 40))
    fact = spark.createDataFrame([(i, k) for i, k in enumerate(keys)], "i int, k int")
    table = fact.groupBy("k").agg(F.count("*").alias("w")).filter("k is null or k <> 7").withColumn("v", F.coalesce("k", F.lit(-1)) * 10)
    out = lookup.attach(fact, table, ["k"], "w", len(keys), 39, F.col("i") % 2 == 0).collect()
    assert len(out) == len(keys)
    for r in out:
        want = None if r.i % 2 or r.k == 7 else (-1 if r.k is None else r.k) * 10
        assert r.v == want
