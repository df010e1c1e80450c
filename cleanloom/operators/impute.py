"""Missing values: mean, median, mode, forward fill, constant."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, functions as F

from cleanloom.functions.text import is_integral, is_numeric, is_text
from cleanloom.operators.base import Need, Op, Operator, RowOrder, column_of, dtype_of, ref, with_values
from cleanloom.plans.ordering import forward_filled

STRATEGIES = ("mean", "median", "mode", "forward", "constant")
MEDIAN = (0.5,)


def _strategy(op: Op) -> str:
    strategy = op.get("strategy") or "constant"
    if strategy not in STRATEGIES:
        raise ValueError(f'No way to fill is called {strategy!r}.')
    return strategy


def _wanted(df: DataFrame, op: Op) -> list[Need]:
    column, strategy = column_of(df, op), _strategy(op)
    if strategy == "mode":
        return [Need(column, "mode")]
    if not is_numeric(dtype_of(df, column)):
        return []
    # ``approx`` takes a median of nearly middle rank from one small sketch.
    median = Need(column, "approx" if op.get("approx") else "quantiles", MEDIAN)
    return {"mean": [Need(column, "mean")], "median": [median]}.get(strategy, [])


def _fit(df: DataFrame, op: Op, stats: dict, order: RowOrder) -> dict:
    needs = _wanted(df, op)
    if not needs:
        return {}
    value = stats[needs[0]]
    return {"value": value[0] if isinstance(value, list) else value}


def fill_null(df: DataFrame, op: Op, params: dict, order: RowOrder) -> DataFrame:
    column, strategy = column_of(df, op), _strategy(op)
    dt, c = dtype_of(df, column), ref(column)
    if strategy == "forward":
        return forward_filled(df, column, order.order_by, op.get("partition_by"))
    if strategy == "constant":
        return with_values(df, {column: _constant(c, dt, str(op.get("value") if op.get("value") is not None else ""))})
    value = params.get("value")
    if strategy in ("mean", "median"):
        # The statistic of an integer column is fractional, so the column becomes double.
        # A text column has no mean: it stays as it is.
        return with_values(df, {column: F.coalesce(c.cast("double"), F.lit(value))}) if is_numeric(dt) else df
    return df if value is None else with_values(df, {column: F.coalesce(c, F.lit(value).cast(dt))})


def _constant(c, dt, raw: str):
    """Numeric literal where column and text are numeric, else the column becomes text."""
    try:
        number = float(raw) if raw.strip() else None
    except ValueError:
        number = None
    if is_numeric(dt) and number is not None and math.isfinite(number):
        if is_integral(dt) and not number.is_integer():
            return F.coalesce(c.cast("double"), F.lit(number))
        return F.coalesce(c, F.lit(number).try_cast(dt) if not is_integral(dt) else F.lit(int(number)).cast(dt))
    return F.coalesce(c if is_text(dt) else c.cast("string"), F.lit(raw))


OPERATORS = {
    "fill_null": Operator(fill_null, needs=_wanted, fit=_fit, column_local=True, row_local=True),
}
