import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from cleanloom import apply_op
from cleanloom.operators import forest
from cleanloom.operators.base import RowOrder
from conftest import values

ORDER = RowOrder.of(row_id="rid")


def blob(spark, n, parts, outliers=5):
    rng = np.random.default_rng(1)
    rows = [(i, *map(float, rng.normal(size=2))) for i in range(n)]
    rows += [(n + i, 40.0 + i, -40.0 - i) for i in range(outliers)]
    return spark.createDataFrame(rows, "rid bigint, a double, b double").repartition(parts)


def walk(nodes, row, at=0):
    """Recursive twin of the array traversal; gives the value stored at the leaf."""
    feature, split, left, end = nodes[at]
    if math.isinf(split):
        return end
    return walk(nodes, row, int(left) + (0 if row[int(feature)] < split else 1))


def scores(df, **kw):
    fitted = forest.fit_forest(df, ["a", "b"], ORDER, **kw)
    return fitted, values(forest.with_scores(df, fitted), "score", "rid")


def test_scores_do_not_depend_on_partitions(spark):
    runs = [scores(blob(spark, 300, p))[1] for p in (1, 3, 17)]
    assert runs[0] == runs[1] == runs[2]


def test_scores_match_a_recursive_walk(spark):
    df = blob(spark, 120, 3)
    fitted, got = scores(df, trees=20, sample=64)
    rows = [(r.a, r.b) for r in df.orderBy("rid").collect()]
    c = forest.average_path(64)
    want = [2 ** (-np.mean([walk(t, r) for t in fitted["forest"]]) / c) for r in rows]
    assert np.allclose(got, want, atol=1e-9)
    sizes = [len(t) for t in fitted["forest"]]
    assert len(sizes) == 20 and max(sizes) <= 2 * 64


def test_tree_partitions_its_sample():
    rng = np.random.default_rng(0)
    nodes = forest.grow_tree(rng.normal(size=(256, 3)), 42, 7)
    assert nodes[:, 3].max() <= 8 + forest.average_path(256) and np.isinf(nodes[:, 1]).any()
    assert (forest.grow_tree(np.ones((30, 2)), 1, 1)[:, 2] == 0).all()  # nothing to split


def test_planted_outliers_are_dropped_and_replay_is_stable(spark):
    df = blob(spark, 400, 4)
    op = {"type": "iforest_outliers", "contamination": 0.0125}
    kept = [values(apply_op(d, op, row_id="rid"), "rid", "rid") for d in (df, df.repartition(9))]
    assert kept[0] == kept[1] and max(kept[0]) < 400 and len(kept[0]) == 400


def test_draws_reach_the_whole_table(spark):
    df = blob(spark, 600, 5, outliers=0)
    filled = {c: F.col(c) for c in ("a", "b")}
    drawn = forest._draws(df, filled, ["rid"], 600, 42, trees=30, sample=200).collect()
    per_tree = {t: sum(r.tree == t for r in drawn) for t in range(30)}
    assert set(per_tree.values()) == {200} and len({(r.tree, r.slot) for r in drawn}) == 6000
    # Ten draws a row are expected: none is left out, none comes far too often.
    times = Counter((r.x0, r.x1) for r in drawn)
    assert len(times) >= 598 and max(times.values()) < 30 and set(times) <= {(r.a, r.b) for r in df.collect()}


def test_draws_do_not_depend_on_partitions_or_bucket_sizes(spark, monkeypatch):
    runs = [scores(blob(spark, 600, p))[1] for p in (1, 5)]
    monkeypatch.setattr(forest, "COARSE_BITS", 2)
    monkeypatch.setattr(forest, "FINE_BITS", 1)
    runs.append(scores(blob(spark, 600, 3))[1])
    assert runs[0] == runs[1] == runs[2] and np.argsort(runs[0])[-5:].min() >= 600


def test_small_tables_raise_and_nulls_take_the_median(spark):
    with pytest.raises(ValueError, match="20 rows"):
        apply_op(blob(spark, 14, 1), {"type": "iforest_outliers"}, row_id="rid")
    with pytest.raises(ValueError, match="numeric feature"):
        apply_op(spark.createDataFrame([(1, "x")], "rid int, s string"), {"type": "iforest_outliers"}, row_id="rid")
    df = blob(spark, 60, 2).withColumn("a", F.when(F.col("rid") % 2 == 0, F.col("a")))
    assert all(0 < s < 1 for s in scores(df)[1])


def test_threshold_ties_are_all_flagged(spark):
    df = spark.createDataFrame([(3.0,), (3.0,), (2.0,)], "s double")
    assert sorted(values(forest.topk_flag(df, "s", 0.34), "flag")) == [False, True, True]
    assert [forest.clamp_contamination(v) for v in (0, 0.9, None)] == [0.001, 0.4, 0.05]


def test_scan_needs_enough_rows_and_features(spark):
    small = forest.anomaly_scan(blob(spark, 20, 1), ORDER).first()
    assert (small.rows, small.anomalies, small.rate) == (25, None, None)
    big = forest.anomaly_scan(blob(spark, 300, 1), ORDER).first()
    assert big.rows == 305 and big.anomalies >= 3 and abs(big.rate - big.anomalies / 305) < 1e-12
