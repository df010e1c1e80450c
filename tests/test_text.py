import pytest
from pyspark.sql import functions as F, types as T

from cleanloom.functions import text as X
from conftest import values

STRING = T.StringType()


def column(spark, cells, expr):
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cells)], "i int, c string")
    return values(df.withColumn("out", expr(F.col("c"))), "out", "i")


def test_to_numeric_reads_currency_and_percent(spark):
    cells = ["$12,345", "45%", " 7 ", "1e5", "-", "", "€1 000", "-3.5", "3.", None]
    assert column(spark, cells, lambda c: X.to_numeric(c, STRING)) == [12345, 45, 7, None, None, None, 1000, -3.5, None, None]


def test_numeric_like_is_stricter(spark):
    cells = ["45%", "1,200", "$5", ".", " 12 ", "-", "-1.5", ",", "1.2.3"]
    assert column(spark, cells, X.numeric_like) == [False, True, False, False, True, False, True, True, False]


def test_strip_removes_all_white_space(spark):
    cells = ["\t a b\r\n", " x　", "y", "  ", None]
    assert column(spark, cells, X.strip) == ["a b", "x", "y", "", None]


def test_null_tokens(spark):
    assert column(spark, [" N/A ", "None", "-", "x", "NaN", ""], X.is_null_token) == [True, True, True, False, True, True]


def test_half_up_goes_towards_plus_infinity(spark):
    df = spark.createDataFrame([(-2.5,), (2.5,), (1.23456,)], "x double")
    assert values(df.select(X.half_up(F.col("x"), 0).alias("y")), "y") == [-2.0, 3.0, 1.0]


@pytest.mark.parametrize("to,cells,expected", [
    ("Int64", ["12", " 12", "12.0", "-7", "x"], [12, None, None, -7, None]),
    ("Float64", ["1.5", "1e3", "$3", " 2", ".5"], [1.5, 1000.0, None, None, 0.5]),
    ("Boolean", ["true", "false", "yes", "TRUE", "1"], [True, False, None, None, None]),
])
def test_text_casts_are_not_strict(spark, to, cells, expected):
    assert column(spark, cells, lambda c: X.cast_to(c, STRING, to)) == expected


def test_numeric_parse_keeps_currency(spark):
    assert column(spark, ["$12,345", "x"], lambda c: X.cast_to(c, STRING, "Int64", "numeric")) == [12345, None]


def test_float_to_int_truncates_and_overflow_is_null(spark):
    df = spark.createDataFrame([(2.9,), (-2.9,), (1e30,), (float("nan"),)], "x double")
    assert values(df.select(X.cast_to(F.col("x"), T.DoubleType(), "Int64").alias("y")), "y") == [2, -2, None, None]


def test_unknown_cast_target():
    with pytest.raises(ValueError, match="Unsupported dtype"):
        X.cast_to(None, STRING, "Complex")


def test_number_text(spark):
    df = spark.createDataFrame([(5.0,), (0.1,), (17366547.0,), (-0.0,), (1 / 3,), (100.0,)], "x double")
    assert values(df.select(X.number_text(F.col("x"), T.DoubleType()).alias("y")), "y") == ["5", "0.1", "17366547", "0", "0.333333", "100"]
