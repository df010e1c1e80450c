import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from cleanloom.plans import quantiles as Q


def frame(spark, xs):
    return spark.createDataFrame([(None if x is None else float(x),) for x in xs], "x double").repartition(3)


def test_small_percentiles(spark):
    got = Q.exact_quantiles(frame(spark, [1, 2, 3, 10]), {"x": F.col("x")}, [0.25, 0.5, 0.75])["x"]
    assert got == [1.75, 2.5, 4.75]
    assert Q.exact_quantiles(frame(spark, [None, None]), {"x": F.col("x")}, [0.5])["x"] is None


@pytest.mark.parametrize("kind", ["normal", "hot", "few", "wide"])
def test_narrowing_is_exact(spark, monkeypatch, kind):
    monkeypatch.setattr(Q, "ONE_PASS_ROWS", 10)
    monkeypatch.setattr(Q, "LAST_BRACKET_ROWS", 20)
    monkeypatch.setattr(Q, "SKETCH_ACCURACY", 50)
    rng = np.random.default_rng(3)
    xs = {
        "normal": rng.normal(size=3000),
        "hot": np.where(rng.random(3000) < 0.4, 7.25, rng.normal(size=3000) * 10),
        "few": rng.integers(0, 4, 3000).astype(float),
        "wide": np.exp(rng.normal(size=2001) * 20),
    }[kind]
    probs = [0.0, 0.01, 0.25, 0.5, 0.75, 0.999, 1.0]
    got = Q.exact_quantiles(frame(spark, xs), {"x": F.col("x"), "y": -F.col("x")}, probs)
    assert np.allclose(got["x"], np.quantile(xs, probs), rtol=1e-12, atol=0)
    assert np.allclose(got["y"], np.quantile(-xs, probs), rtol=1e-12, atol=0)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.integers(-5, 5), min_size=12, max_size=60))
def test_order_statistics_of_any_list(spark, xs):
    old = Q.LAST_BRACKET_ROWS
    Q.LAST_BRACKET_ROWS = 3
    try:
        ranks = [0, len(xs) // 2, len(xs) - 1]
        got = Q.order_statistics(frame(spark, xs), {"x": F.col("x")}, {"x": ranks}, {"x": len(xs)})["x"]
    finally:
        Q.LAST_BRACKET_ROWS = old
    assert [got[r] for r in ranks] == [float(sorted(xs)[r]) for r in ranks]


def test_reads_of_the_table_do_not_grow_with_ranks_and_columns(spark, monkeypatch):
    """Every rank once had a pass of its own over all rows; now a sketch and one proving pass serve them all."""
    monkeypatch.setattr(Q, "ONE_PASS_ROWS", 10)
    monkeypatch.setattr(Q, "LAST_BRACKET_ROWS", 2000)
    monkeypatch.setattr(Q, "SKETCH_ACCURACY", 50)
    xs = np.random.default_rng(5).normal(size=3000)
    read = spark.sparkContext.accumulator(0)

    def passed(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    df = frame(spark, xs).localCheckpoint().mapInArrow(passed, "x double")
    probs = [0.1, 0.25, 0.5, 0.75, 0.9]
    got = Q.exact_quantiles(df, {"x": F.col("x"), "y": -F.col("x")}, probs, {"x": 3000, "y": 3000})
    assert np.allclose(got["x"], np.quantile(xs, probs), rtol=1e-12, atol=0)
    assert np.allclose(got["y"], np.quantile(-xs, probs), rtol=1e-12, atol=0)
    assert read.value == 2 * 3000


@pytest.mark.parametrize("split", [1500, 1499, 1, 2999])
def test_two_hot_values_on_both_sides_of_a_quantile(spark, monkeypatch, split):
    monkeypatch.setattr(Q, "ONE_PASS_ROWS", 10)
    monkeypatch.setattr(Q, "LAST_BRACKET_ROWS", 20)
    xs = [1.0] * split + [4.0] * (3000 - split)
    got = Q.exact_quantiles(frame(spark, xs), {"a.b c": F.col("x")}, [0.25, 0.5, 0.75])["a.b c"]
    assert got == list(np.quantile(xs, [0.25, 0.5, 0.75]))
