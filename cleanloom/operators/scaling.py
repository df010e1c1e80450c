"""Scaling of numeric columns and the imputed, z-scored feature matrix."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from cleanloom.functions.text import finite, half_up, to_numeric
from cleanloom.operators.base import Need, Op, Operator, RowOrder, dtype_of, numeric_column, ref, with_values
from cleanloom.plans.quantiles import exact_quantiles

SCALED_DIGITS = 6


def _kinds(op: Op) -> tuple[str, str]:
    return ("min", "max") if op.get("scaler") == "minmax" else ("mean", "std")


def _wanted(df: DataFrame, op: Op) -> list[Need]:
    column = numeric_column(df, op, "Scaling")
    return [Need(column, "count"), *[Need(column, k) for k in _kinds(op)]]


def _fit(df: DataFrame, op: Op, stats: dict, order: RowOrder) -> dict:
    column = op["column"]
    if not stats[Need(column, "count")]:
        raise ValueError(f'{column}: it holds no numbers to scale.')
    first, second = (stats[Need(column, k)] for k in _kinds(op))
    width = second - first if op.get("scaler") == "minmax" else second
    return {"shift": first, "width": width or 1.0}


def scale(df: DataFrame, op: Op, params: dict, order: RowOrder) -> DataFrame:
    column = op["column"]
    scaled = (finite(ref(column)) - F.lit(params["shift"])) / F.lit(params["width"])
    return with_values(df, {column: half_up(scaled, SCALED_DIGITS)})


def numeric_views(df: DataFrame, features: Sequence[str]) -> dict[str, Column]:
    return {f: to_numeric(ref(f), dtype_of(df, f)) for f in features}


def imputed_features(df: DataFrame, features: Sequence[str]) -> dict[str, Column]:
    """Numeric view of every feature with its median in place of missing values (0 if all are missing)."""
    views = numeric_views(df, features)
    medians = exact_quantiles(df, views, (0.5,))
    return {f: F.coalesce(views[f], F.lit(float(medians[f][0] if medians[f] else 0.0))) for f in features}


def feature_matrix(df: DataFrame, features: Sequence[str], name: str = "features") -> DataFrame:
    """Append an array of z-scores; the deviation is taken over the imputed values."""
    filled = imputed_features(df, features)
    aggs = [f(filled[c]).alias(f"{c}_{t}") for c in features for t, f in (("m", F.avg), ("s", F.stddev_samp))]
    row = df.agg(*aggs).first()
    scores = [(filled[c] - F.lit(row[f"{c}_m"])) / F.lit(row[f"{c}_s"] or 1.0) for c in features]
    return df.withColumn(name, F.array(*scores))


OPERATORS = {
    "scale": Operator(scale, needs=_wanted, fit=_fit, column_local=True, row_local=True),
}
