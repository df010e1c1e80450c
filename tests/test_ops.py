import pytest
from pyspark.sql import functions as F

from cleanloom import apply_op, apply_recipe
from cleanloom.operators.base import most_frequent
from cleanloom.plans.recipe import Recipe
from conftest import values


def test_rename_and_drop_errors(frame):
    df = frame([(1, 2)], "a int, b int")
    for to in ("b", " ", None):
        with pytest.raises(ValueError):
            apply_op(df, {"type": "rename_column", "column": "a", "to": to})
    with pytest.raises(ValueError, match="does not exist"):
        apply_op(df, {"type": "drop_column", "column": "A"})
    with pytest.raises(ValueError, match="No recipe step"):
        apply_op(df, {"type": "sort"})
    assert apply_op(df, {"type": "rename_column", "column": "a", "to": " c "}).columns == ["c", "b"]


def test_drop_nulls_keeps_nan(frame):
    df = frame([(1.0, "x"), (float("nan"), "y"), (None, "z"), (2.0, None)], "a double, b string")
    assert apply_op(df, {"type": "drop_nulls"}).count() == 2
    assert apply_op(df, {"type": "drop_nulls", "column": "a"}).count() == 3


def test_drop_rows_refer_to_the_view_before(frame):
    df = frame([(i,) for i in range(4)], "i int", 3)
    assert values(apply_op(df, {"type": "drop_rows", "indices": [0, 2]}, order_by="i"), "i", "i") == [1, 3]
    assert values(apply_op(df, {"type": "drop_row", "index": 3}, order_by="i"), "i", "i") == [0, 1, 2]
    with pytest.raises(ValueError, match="no row"):
        apply_op(df, {"type": "drop_row", "index": 4}, order_by="i")
    with pytest.raises(ValueError, match="order_by"):
        apply_op(df, {"type": "drop_row", "index": 1})
    with pytest.raises(ValueError, match="row position"):
        apply_op(df, {"type": "drop_row"}, order_by="i")


def test_dedupe_keeps_first_and_treats_nulls_as_equal(frame):
    df = frame([(3, None, "a"), (1, None, "a"), (2, 5, "a")], "rid int, x int, y string", 2)
    assert values(apply_op(df, {"type": "drop_duplicates"}, row_id="rid"), "rid", "rid") == [1, 2]
    assert apply_op(df.drop("rid"), {"type": "drop_duplicates"}).count() == 2


def test_fill_types(frame):
    df = frame([(1, None), (None, "b"), (4, "b"), (5, "a")], "x bigint, y string")
    mean = apply_op(df, {"type": "fill_null", "column": "x", "strategy": "mean"})
    assert dict(mean.dtypes)["x"] == "double" and sorted(values(mean, "x")) == [1.0, 10 / 3, 4.0, 5.0]
    assert sorted(values(apply_op(df, {"type": "fill_null", "column": "x", "strategy": "median"}), "x")) == [1, 4, 4, 5]
    assert sorted(values(apply_op(df, {"type": "fill_null", "column": "y", "strategy": "mode"}), "y")) == ["a", "b", "b", "b"]
    whole = apply_op(df, {"type": "fill_null", "column": "x", "strategy": "constant", "value": "7"})
    assert dict(whole.dtypes)["x"] == "bigint"
    assert dict(apply_op(df, {"type": "fill_null", "column": "x", "strategy": "constant", "value": "7.5"}).dtypes)["x"] == "double"
    widened = apply_op(df, {"type": "fill_null", "column": "x", "value": "none given"})
    assert dict(widened.dtypes)["x"] == "string" and "none given" in values(widened, "x")
    assert values(apply_op(df, {"type": "fill_null", "column": "y", "strategy": "mean"}), "y").count(None) == 1
    with pytest.raises(ValueError, match="way to fill"):
        apply_op(df, {"type": "fill_null", "column": "x", "strategy": "guess"})


def test_mode_tie_takes_the_smallest(frame):
    df = frame([("b",), ("a",), (None,), (None,), (None,)], "y string")
    assert sorted(values(apply_op(df, {"type": "fill_null", "column": "y", "strategy": "mode"}), "y")) == ["a", "a", "a", "a", "b"]


def test_forward_fill_keeps_leading_nulls(frame):
    df = frame([(0, None), (1, 1), (2, None), (3, 2)], "i int, x int", 3)
    out = apply_op(df, {"type": "fill_null", "column": "x", "strategy": "forward"}, order_by="i")
    assert values(out, "x", "i") == [None, 1, 1, 2]


def test_cap_integer_bounds_stay_inside(frame):
    df = frame([(v,) for v in (0, 2, 3, 4, 5, 6, 7, 30)], "x int")
    out = apply_op(df, {"type": "cap_outliers", "column": "x", "multiplier": 0.2})
    # quartiles 2.75 and 6.25, bounds 2.05 and 6.95
    assert dict(out.dtypes)["x"] == "int" and sorted(values(out, "x")) == [3, 3, 3, 4, 5, 6, 6, 6]


def test_outlier_errors_and_null_rows(frame):
    with pytest.raises(ValueError, match="too few"):
        apply_op(frame([(1,), (2,), (3,)], "x int"), {"type": "cap_outliers", "column": "x"})
    with pytest.raises(ValueError, match="works on numbers"):
        apply_op(frame([("1",)], "x string"), {"type": "drop_outliers", "column": "x"})
    df = frame([(1.0,), (2.0,), (2.5,), (3.0,), (100.0,), (None,)], "x double")
    assert sorted(values(apply_op(df, {"type": "drop_outliers", "column": "x"}), "x"), key=str) == [1.0, 2.0, 2.5, 3.0, None]


def test_scaling(frame):
    same = frame([(5,), (5,), (5,)], "x int")
    for scaler in ("standard", "minmax"):
        assert values(apply_op(same, {"type": "scale", "column": "x", "scaler": scaler}), "x") == [0.0, 0.0, 0.0]
    df = frame([(1.0,), (2.0,), (4.0,), (None,)], "x double")
    assert sorted(values(apply_op(df, {"type": "scale", "column": "x", "scaler": "minmax"}), "x"), key=str) == [0.0, 0.333333, 1.0, None]
    with pytest.raises(ValueError, match="no numbers"):
        apply_op(frame([(None,)], "x double"), {"type": "scale", "column": "x"})


def test_neighbouring_fills_share_one_pass_and_replay(frame, spark):
    df = frame([(1.0, 10, "a"), (None, None, "b"), (3.0, 30, None)], "x double, y int, z string")
    ops = [
        {"type": "fill_null", "column": "x", "strategy": "mean"},
        {"type": "fill_null", "column": "y", "strategy": "median"},
        {"type": "scale", "column": "x", "scaler": "minmax"},
        {"type": "normalize_case", "column": "z", "mode": "upper"},
    ]
    fitted = Recipe.from_json(Recipe(ops).to_json()).fit(df)
    out = fitted.transform(df)
    assert sorted(out.collect()) == sorted(apply_recipe(df, ops).collect(), key=lambda r: r.x)
    new = fitted.transform(frame([(5.0, None, "q")], "x double, y int, z string")).collect()
    assert new[0].x == 2.0 and new[0].y == 20.0 and new[0].z == "Q"
    with pytest.raises(ValueError, match="other rows"):
        Recipe([{"type": "drop_duplicates"}]).fit(df).transform(df)


def test_checkpointed_recipe_gives_the_same(frame):
    df = frame([(float(i), i % 3) for i in range(50)], "x double, y int")
    ops = [{"type": "cap_outliers", "column": "x", "multiplier": 0.1}, {"type": "scale", "column": "x"}]
    assert sorted(apply_recipe(df, ops, checkpoint_every=1).collect()) == sorted(apply_recipe(df, ops).collect())


def test_renamed_order_column_is_followed(frame):
    df = frame([(0, 1), (1, None)], "i int, x int")
    ops = [{"type": "rename_column", "column": "i", "to": "k"}, {"type": "fill_null", "column": "x", "strategy": "forward"}]
    assert values(apply_recipe(df, ops, order_by="i"), "x", "k") == [1, 1]


def test_odd_column_names(frame):
    df = frame([(" a ", 1)], "`my col` string, `x.y` int")
    out = apply_recipe(df, [{"type": "trim"}, {"type": "drop_nulls"}])
    assert out.collect()[0]["my col"] == "a" and out.columns == ["my col", "x.y"]


def test_filter_is_pushed_to_the_scan(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(100).select(F.col("id").alias("a"), F.col("id").alias("b"), F.col("id").alias("c")).write.parquet(path)
    out = apply_recipe(spark.read.parquet(path), [{"type": "drop_nulls", "column": "a"}, {"type": "drop_column", "column": "c"}])
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "IsNotNull(a)" in plan and "c:bigint" not in plan


LONG = [
    {"type": "trim"},
    {"type": "drop_duplicates"},
    {"type": "cast", "column": "x", "to": "Float64"},
    {"type": "fill_null", "column": "x", "strategy": "median"},
    {"type": "fill_null", "column": "z", "strategy": "mode"},
    {"type": "fill_null", "column": "y", "strategy": "mode"},
    {"type": "trim", "column": "z"},
    {"type": "scale", "column": "x", "scaler": "minmax"},
    {"type": "cap_outliers", "column": "y", "multiplier": 0.5},
    {"type": "drop_outliers", "column": "y", "multiplier": 0.3},
    {"type": "drop_nulls", "column": "w"},
    {"type": "fill_null", "column": "x", "strategy": "mean"},
    {"type": "fill_null", "column": "v", "strategy": "mean"},
]


def messy_rows():
    return [(i, None if i % 5 == 0 else f" {i % 7} ", None if i % 6 == 0 else i * i % 31, [None, "b ", "a", "b "][i % 4],
             None if i % 9 == 0 else i, None if i % 4 == 1 else i / 2) for i in [*range(60), *range(20)]]


MESSY = "i int, x string, y int, z string, w int, v double"


@pytest.mark.parametrize("ops", [
    LONG,
    [{"type": "rename_column", "column": "y", "to": "u"}, {"type": "fill_null", "column": "u", "strategy": "mean"},
     {"type": "drop_duplicates"}, {"type": "rename_column", "column": "u", "to": "y"}, {"type": "cap_outliers", "column": "y", "multiplier": 0.2}],
    [{"type": "drop_duplicates"}, {"type": "drop_nulls"}, {"type": "fill_null", "column": "y", "strategy": "mean"}],
    [{"type": "drop_duplicates"}, {"type": "drop_nulls", "column": "w"}, {"type": "scale", "column": "v"}, {"type": "drop_column", "column": "v"},
     {"type": "drop_outliers", "column": "y"}, {"type": "fill_null", "column": "y", "strategy": "mean"}],
    [{"type": "drop_duplicates"}, {"type": "fill_null", "column": "w", "strategy": "forward"}, {"type": "fill_null", "column": "w", "strategy": "mean"},
     {"type": "drop_row", "index": 3}, {"type": "fill_null", "column": "v", "strategy": "median"}, {"type": "scale", "column": "w"}],
    [{"type": "fill_null", "column": "z", "strategy": "constant", "value": "q"}, {"type": "fill_null", "column": "w", "strategy": "forward", "partition_by": "z"},
     {"type": "normalize_case", "column": "z", "mode": "upper"}, {"type": "fill_null", "column": "z", "strategy": "mode"}],
])
def test_planned_recipe_equals_one_step_at_a_time(frame, ops):
    df = frame(messy_rows(), MESSY, 3)
    single = df
    for op in ops:
        single = apply_op(single, op, order_by="i")
    got = apply_recipe(df, ops, order_by="i")
    assert got.columns == single.columns and sorted(map(str, got.collect())) == sorted(map(str, single.collect()))


def test_long_recipe_takes_few_executions(frame, spark):
    df = frame(messy_rows(), MESSY, 3)
    store = spark._jsparkSession.sharedState().statusStore()
    before = store.executionsCount()
    out = apply_recipe(df, LONG, order_by="i")
    # The copy after the duplicates; two rounds of at most aggregate, one pass of quantiles per grid and one tally; the last round of means.
    assert store.executionsCount() - before <= 12
    assert "recipe-statistics" not in out._jdf.queryExecution().toString()


def test_modes_of_several_types_come_from_one_tally(frame, spark):
    df = frame([(1, "b", 2.0, None), (1, "a", None, None), (2, "b", 1.0, None), (3, "a", 0.5, None)], "i int, s string, d double, n string", 2)
    store = spark._jsparkSession.sharedState().statusStore()
    before = store.executionsCount()
    assert most_frequent(df, ["i", "s", "d", "n"]) == {"i": 1, "s": "a", "d": 0.5}
    assert store.executionsCount() - before == 1
