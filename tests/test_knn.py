import tracemalloc

import numpy as np
import pandas as pd
import pytest

from cleanloom import apply_op
from cleanloom.operators import knn
from cleanloom.plans import lookup
from conftest import values


def brute(rows, k):
    """All-pairs twin: rows are (rid, target, features...); None is missing."""
    x = np.array([[np.nan if v is None else v for v in r[2:]] for r in rows], float)
    y = np.array([np.nan if r[1] is None else r[1] for r in rows], float)
    sd = np.nanstd(x, axis=0, ddof=1)
    z = (x - np.nanmean(x, axis=0)) / np.where(sd > 0, sd, 1)
    out = y.copy()
    known = np.flatnonzero(~np.isnan(y))
    for i in np.flatnonzero(np.isnan(y)):
        diff = z[known] - z[i]
        dims = (~np.isnan(diff)).sum(axis=1)
        d = np.round(np.sqrt(np.nansum(diff**2, axis=1) / np.maximum(dims, 1)), 9)
        near = [known[j] for j in np.argsort(d, kind="stable") if dims[j]][:k]
        if near:
            out[i] = y[near].mean()
    return out


def run(spark, rows, k, parts=3):
    d = len(rows[0]) - 2
    schema = "rid bigint, y double, " + ", ".join(f"x{i} double" for i in range(d))
    df = spark.createDataFrame(rows, schema).repartition(parts)
    out = apply_op(df, {"type": "knn_impute", "column": "y", "k": k}, row_id="rid")
    return np.array([np.nan if v is None else v for v in values(out, "y", "rid")])


@pytest.fixture(params=["one cell", "many cells"])
def cells(request, monkeypatch):
    if request.param == "many cells":
        monkeypatch.setattr(knn, "PACKET_ROWS", 16)
        monkeypatch.setattr(knn, "GAPS_PER_PACKET", 4)
        monkeypatch.setattr(lookup, "BROADCAST_ROWS", 0)
        monkeypatch.setattr(lookup, "HOT_KEYS", 10)


@pytest.mark.parametrize("d,k", [(1, 3), (2, 5), (4, 1), (9, 7)])
def test_equals_brute_force(spark, cells, d, k):
    rng = np.random.default_rng(d)
    rows = []
    for i in range(400):
        xs = [None if rng.random() < 0.1 else float(np.round(rng.normal() * 3 ** (j % 3), 2)) for j in range(d)]
        rows.append((i, None if rng.random() < 0.2 else float(i % 37), *xs))
    want = brute(rows, k)
    got = run(spark, rows, k)
    assert np.allclose(got, want, equal_nan=True, rtol=1e-12)


def test_hot_vector_and_ties_go_to_earlier_rows(spark, cells):
    rows = [(i, None if i % 5 == 0 else float(i), 1.0 if i % 3 else float(i), 2.0) for i in range(300)]
    assert np.allclose(run(spark, rows, 4, 7), brute(rows, 4), equal_nan=True)


def test_flat_leading_features_do_not_crowd_one_cell(spark, monkeypatch):
    monkeypatch.setattr(knn, "PACKET_ROWS", 16)
    rng = np.random.default_rng(4)
    rows = [(i, None if i % 6 == 0 else float(i % 11), 1.0, float(i % 2), 0.0, *map(float, rng.normal(size=4).round(2))) for i in range(600)]
    sizes = []
    of = knn._Cells.of
    monkeypatch.setattr(knn._Cells, "of", staticmethod(lambda *a: sizes.append(of(*a).rows) or of(*a)))
    assert np.allclose(run(spark, rows, 3), brute(rows, 3))
    assert max(sizes[0]) < 200 and len(sizes[0]) > 10


def test_rows_without_shared_features_stay_null(spark):
    rows = [(0, None, None), (1, 5.0, 1.0), (2, 7.0, 2.0), (3, 9.0, 3.0), (4, None, 2.0)]
    assert np.allclose(run(spark, rows, 2), [np.nan, 5, 7, 9, 6], equal_nan=True)


def test_text_target_becomes_numeric(spark):
    df = spark.createDataFrame([(0, "$1,000", 1.0), (1, "n/a", 1.1), (2, "2000", 5.0)], "rid int, y string, x double")
    out = apply_op(df, {"type": "knn_impute", "column": "y", "k": 1}, row_id="rid")
    assert values(out, "y", "rid") == [1000.0, 1000.0, 2000.0]


def test_fallback_and_errors(spark):
    df = spark.createDataFrame([(0, 1.0), (1, None), (2, 3.0)], "rid int, y double")
    assert values(apply_op(df, {"type": "knn_impute", "column": "y"}, row_id="rid"), "y", "rid") == [1.0, 2.0, 3.0]
    none = spark.createDataFrame([(0, None, 1.0)], "rid int, y double, x double")
    with pytest.raises(ValueError, match="no numeric value"):
        apply_op(none, {"type": "knn_impute", "column": "y"}, row_id="rid")
    assert [knn.clamp_k(v) for v in (0, 99, 2.6, None)] == [1, 25, 3, 5]


def test_text_row_keys(spark):
    rows = [(f"r{i:03d}", None if i % 4 == 0 else float(i), float(i % 7)) for i in range(60)]
    df = spark.createDataFrame(rows, "rid string, y double, x double")
    out = apply_op(df, {"type": "knn_impute", "column": "y", "k": 3}, row_id="rid")
    assert np.allclose(values(out, "y", "rid"), brute([(i, *r[1:]) for i, r in enumerate(rows)], 3))


def test_plan_has_no_cross_product(spark):
    df = spark.createDataFrame([(i, None if i % 4 == 0 else float(i), float(i % 7)) for i in range(60)], "rid int, y double, x double")
    plan = apply_op(df, {"type": "knn_impute", "column": "y"}, row_id="rid")._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan and "WindowGroupLimit" in plan


def test_wide_tables_with_gaps(spark, monkeypatch):
    """More features than a mask has bits, and cells from the masks that occur, not from all there could be."""
    monkeypatch.setattr(knn, "PACKET_ROWS", 16)
    rng = np.random.default_rng(3)
    for width in (9, 70):
        x = rng.normal(size=(160, width)).round(2)
        x[rng.random(x.shape) < 0.03] = np.nan
        y = [None if i % 8 == 1 else f"${i},000" for i in range(160)]
        frame = pd.DataFrame(x, columns=[f"x{i}" for i in range(width)]).astype(object).where(~np.isnan(x), None)
        rows = [(i, y[i], *frame.iloc[i]) for i in range(160)]
        df = spark.createDataFrame(rows, "rid long, y string, " + ", ".join(f"x{i} double" for i in range(width))).repartition(3)
        got = {r.rid: r.y for r in apply_op(df, {"type": "knn_impute", "column": "y", "k": 3}, row_id="rid").collect()}
        z = (x - np.nanmean(x, 0)) / np.nanstd(x, 0, ddof=1)
        for i in range(160):
            if y[i] is not None:
                assert got[i] == i * 1000
                continue
            known = []
            for j in range(160):
                both = ~np.isnan(z[i]) & ~np.isnan(z[j])
                if y[j] is not None and both.any():
                    known.append((round(float(np.sqrt(((z[i] - z[j])[both] ** 2).mean())), 9), j))
            assert got[i] == pytest.approx(np.mean([j * 1000 for _, j in sorted(known)[:3]]))


def peak_mb(work):
    tracemalloc.start()
    try:
        out = work()
        return out, tracemalloc.get_traced_memory()[1] / 2**20
    finally:
        tracemalloc.stop()


def test_memory_of_the_search_for_cells_is_bounded():
    """Arrays of 2,000,000 numbers were made, a dozen at a time."""
    rng = np.random.default_rng(2)
    lo = rng.random((400, 2))
    cells = knn._Cells(np.arange(400), np.full(400, 9), np.ones(400, int), lo, lo + 0.4, (np.zeros(2), np.ones(2)))
    gaps = pd.DataFrame({"cell": 7, **{f"f{i}": rng.random(20_000) for i in range(2)}})
    sent, peak = peak_mb(lambda: sum(len(q) for out in knn._ask([gaps], cells, 3) for q in out["q"]))
    assert sent >= 2 * len(gaps) and peak < 60


def test_packet_meets_all_its_gaps_in_bounded_memory():
    """A copy of the packet once went with every message of gaps."""
    rng = np.random.default_rng(3)
    gaps, rows, rid = rng.integers(0, 30, (30_000, 2)).astype(float), rng.integers(0, 30, (2_000, 2)).astype(float), rng.permutation(2_000)
    asks = pd.DataFrame({"q": [gaps[i:i + 1_000].ravel() for i in range(0, len(gaps), 1_000)]})
    packet = pd.DataFrame([{"f0": rows[:, 0], "f1": rows[:, 1], "rid": rid, "y": rid * 2.0}])
    got, peak = peak_mb(lambda: knn._meet(asks, packet, ["f0", "f1"], [(0.0, 1.0), (0.0, 1.0)], 4))
    assert peak < 60 and len(got) == 4 * len(gaps) and (got["y"] == got["rid"] * 2).all()
    for i in range(0, len(gaps), 997):
        dist = np.round(np.sqrt(((rows - gaps[i]) ** 2).sum(axis=1) / 2), 9)
        assert got["rid"][4 * i:4 * i + 4].tolist() == rid[np.lexsort((rid, dist))[:4]].tolist()
    assert not len(knn._meet(asks[:0], packet, ["f0", "f1"], [(0.0, 1.0), (0.0, 1.0)], 4))
