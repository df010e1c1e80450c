"""Columns with dots, quotes and names that helpers use themselves."""

import pytest

from cleanloom import apply_op
from cleanloom.operators.base import RowOrder
from cleanloom.operators.profile import dataset_summary, table_profile
from cleanloom.sources.csv import preview

# Awkward names, and names that helpers use inside; by position: row id, a, q, weight, f0, answer, cell.
SETS = {
    "odd": ["r.id", "a.b", "`q`", "weight", "f0", "answer", "cell"],
    "helpers": ["__rid", "__y", "__score", "__block", "__need", "__salt", "__carry"],
}
NAMES = SETS["odd"]
OPS = [
    {"type": "drop_row", "index": 3},
    {"type": "drop_rows", "indices": [0, 5, 39]},
    {"type": "drop_nulls", "column": "a.b"},
    {"type": "drop_nulls"},
    {"type": "drop_duplicates"},
    {"type": "drop_column", "column": "`q`"},
    {"type": "rename_column", "column": "a.b", "to": "c.d"},
    {"type": "cast", "column": "weight", "to": "String"},
    {"type": "trim", "column": "`q`"},
    {"type": "normalize_case", "column": "`q`", "mode": "upper"},
    *[{"type": "fill_null", "column": "a.b", "strategy": s} for s in ("mean", "median", "mode", "forward")],
    {"type": "knn_impute", "column": "a.b", "k": 3},
    {"type": "knn_impute", "column": "answer", "k": 3},
    {"type": "cap_outliers", "column": "a.b"},
    {"type": "drop_outliers", "column": "f0"},
    {"type": "scale", "column": "a.b"},
    {"type": "iforest_outliers"},
]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, None if i % 7 == 3 else float(i), f" t{i % 5} ", i * 2, float(i % 4), None if i % 9 == 2 else i / 2, i % 3) for i in range(40)]
    return spark.createDataFrame(rows, "`r.id` long, `a.b` double, ```q``` string, weight long, f0 double, answer double, cell int").repartition(3)


@pytest.fixture(scope="module")
def plain(odd):
    return odd.toDF("r", *"abcdef")


@pytest.mark.parametrize("kind", SETS)
@pytest.mark.parametrize("op", OPS, ids=lambda op: f"{op['type']}-{op.get('strategy') or op.get('column')}")
def test_names_do_not_matter(odd, plain, op, kind):
    names, simple = SETS[kind], dict(zip(NAMES, ["r", *"abcdef"]))
    there = {**op, **({"column": names[NAMES.index(op["column"])]} if "column" in op else {})}
    got = apply_op(odd.toDF(*names), there, row_id=names[0])
    want = apply_op(plain, {**op, **({"column": simple[op["column"]]} if "column" in op else {})}, row_id="r")
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)
    back = dict(zip(names, ["r", *"abcdef"]))
    assert [back.get(c, c) for c in got.columns] == want.columns


def test_reports_take_any_name(odd):
    order = RowOrder.of(row_id="r.id")
    assert [r["name"] for r in table_profile(odd, order).collect()]
    assert dataset_summary(odd, order).count() == 1
    assert preview(odd, "r.id").columns == NAMES
