import pytest
from pyspark.sql import functions as F

from cleanloom import apply_commands, command_ops
from cleanloom.plans.recipe import op_label
from conftest import values


def cmd(category, method, column=None, **params):
    return {"action_category": category, "method": method, "column": column, "params": params}


@pytest.mark.parametrize("command,ops", [
    (cmd("missing_values", "KNN", "a", k=2.6), [{"type": "knn_impute", "column": "a", "k": 3}]),
    (cmd("missing_values", "knn", "a", k=99), [{"type": "knn_impute", "column": "a", "k": 25}]),
    (cmd("missing_values", "value", "a", value=0), [{"type": "fill_null", "column": "a", "strategy": "constant", "value": "0"}]),
    (cmd("outliers", "cap", " a ", m="0.01"), [{"type": "cap_outliers", "column": "a", "multiplier": 0.1}]),
    (cmd("outliers", "drop", "a"), [{"type": "drop_outliers", "column": "a", "multiplier": 1.5}]),
    (cmd("manual_edit", "delete_row", indices=[3, 1, 3]), [{"type": "drop_rows", "indices": [1, 3]}]),
    (cmd("manual_edit", "drop_row", index=4), [{"type": "drop_rows", "indices": [4]}]),
    (cmd("types", "cast", "a", to="Int64"), [{"type": "cast", "column": "a", "to": "Int64"}]),
    (cmd("text", "strip"), [{"type": "trim"}]),
    (cmd("text", "upper", "a"), [{"type": "normalize_case", "column": "a", "mode": "upper"}]),
    (cmd("structure", "rename", "a", to=" b "), [{"type": "rename_column", "column": "a", "to": "b"}]),
    (cmd("Structure ", "DEDUPE"), [{"type": "drop_duplicates"}]),
    (cmd("features", "scale", "a", scaler="minmax"), [{"type": "scale", "column": "a", "scaler": "minmax"}]),
    (cmd("outliers", "iforest", contamination=0.9), [{"type": "iforest_outliers", "contamination": 0.4}]),
])
def test_translation(command, ops):
    assert command_ops(command) == ops


@pytest.mark.parametrize("command,message", [
    (cmd("nope", "x"), "No command category"), (cmd("text", "title", "a"), "text has no method"), (cmd("missing_values", "mean"), "name the column"),
    (cmd("missing_values", "custom", "a"), "custom fill"), (cmd("outliers", "cap", "a", multiplier="many"), "no finite number"),
    (cmd("manual_edit", "drop_row"), "counted from 0"), (cmd("manual_edit", "drop_row", index=-1), "counted from 0"), (cmd("manual_edit", "drop_row", index=1.5), "counted from 0"),
    (cmd("types", "cast", "a", to="Int32"), "cast goes to"), (cmd("types", "int64", "a"), "types has no method"), (cmd("structure", "rename", "a"), "new name"),
])
def test_errors(command, message):
    with pytest.raises(ValueError, match=message):
        command_ops(command)


def test_batch_is_all_or_nothing(spark):
    df = spark.createDataFrame([(0, " a"), (1, "b "), (2, None)], "i int, s string")
    out = apply_commands(df, [cmd("text", "trim"), cmd("manual_edit", "drop_row", index=0), cmd("missing_values", "custom", "s", value="?")], order_by="i")
    assert values(out, "s", "i") == ["b", "?"]
    with pytest.raises(ValueError, match="does not exist"):
        apply_commands(df, [cmd("text", "trim"), cmd("text", "lower", "gone")])


def test_labels(spark):
    ops = ['{"type":"drop_rows","indices":[1,3]}', '{"type":"fill_null","column":"a","strategy":"mean"}', '{"type":"iforest_outliers"}', '{"type":"other"}']
    df = spark.createDataFrame([(i, o) for i, o in enumerate(ops)], "i int, op string")
    assert values(df.select("i", op_label(F.col("op")).alias("l")), "l", "i") == [
        "Delete 2 rows", "Fill nulls (mean) on a", "Isolation Forest — drop anomalies (contamination 5.0%)", "other"]
