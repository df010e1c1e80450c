import pytest
from pyspark.sql import functions as F

from cleanloom import apply_op
from cleanloom.plans import sketches as S


@pytest.fixture(scope="module")
def mixed(spark):
    rows = [(f"d{i % 4}", None if i % 5 == 0 else i % 700, None if i % 3 == 0 else f"t{i % 90}", float("nan") if i % 11 == 0 else i / 7) for i in range(9_000)]
    return spark.createDataFrame(rows, "`a day` string, rows int, name string, part double").repartition(5)


def test_parts_merge_to_the_whole(mixed):
    parts = S.sketch_columns(mixed, F.col("`a day`"))
    assert parts.count() == 4 * 4 and parts.columns == ["part", "name", "rows", "nulls", "uniques", "ranks"]
    got = {r["name"]: r for r in S.read_sketches(S.merge_sketches(parts)).collect()}
    late = S.read_sketches(S.merge_sketches(parts.where("part <> 'd3'").union(parts.where("part = 'd3'"))))
    whole = {r["name"]: r for r in S.read_sketches(S.merge_sketches(S.sketch_columns(mixed))).collect()}
    for r in late.collect():
        assert (r["rows"], r["nulls"]) == (got[r["name"]]["rows"], got[r["name"]]["nulls"])
        assert abs(r["unique"] - got[r["name"]]["unique"]) <= max(1, S.unique_error() * r["unique"])
    for name, nulls, unique in (("a day", 0, 4), ("rows", 1800, 560), ("name", 3000, 60), ("part", 0, 8183)):
        for r in (got[name], whole[name]):
            assert (r["rows"], r["nulls"]) == (9000, nulls) and abs(r["unique"] - unique) <= max(1, S.unique_error() * unique)
    assert got["name"]["quantiles"] is None
    for p, v in zip((0.25, 0.5, 0.75), got["part"]["quantiles"]):
        assert abs(v / (9000 / 7) - p) < S.rank_error() + 0.01


def test_empty_and_missing(spark, mixed):
    none = mixed.limit(0)
    assert S.sketch_columns(none, F.col("`a day`")).collect() == []
    assert S.approx_quantiles(none, {"v": F.col("part")}, [0.5]) == {"v": None}
    assert S.approx_quantiles(mixed, {}, [0.5]) == {}
    filled = apply_op(mixed.select("rows"), {"type": "fill_null", "column": "rows", "strategy": "median", "approx": True})
    values = {r[0] for r in filled.where("rows is not null").select("rows").distinct().collect()}
    assert filled.where("rows is null").count() == 0 and dict(filled.dtypes)["rows"] == "double" and values <= set(map(float, range(700)))
    empty = mixed.select(F.lit(None).cast("int").alias("v"))
    assert apply_op(empty, {"type": "fill_null", "column": "v", "strategy": "median", "approx": True}).where("v is not null").count() == 0
