"""What every cleaning operator has in common.

An operator is ``fit`` (look at the data once, return plain numbers) followed
by ``transform`` (a lazy projection or filter). Operators that need statistics
of a column declare them, so that neighbouring operators share one pass.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, functions as F, types as T

from cleanloom.functions.text import dtype_name, finite, is_numeric, ref
from cleanloom.plans.quantiles import exact_quantiles
from cleanloom.plans.sketches import approx_quantiles

Op = dict[str, Any]


@dataclass(frozen=True)
class RowOrder:
    """``order_by``: unique columns giving row order; ``row_id``: those of them that are not data."""

    order_by: tuple[str, ...] = ()
    row_id: tuple[str, ...] = ()

    @staticmethod
    def of(order_by=None, row_id=None) -> "RowOrder":
        def names(x) -> tuple[str, ...]:
            return (x,) if isinstance(x, str) else tuple(x or ())

        return RowOrder(names(order_by) or names(row_id), names(row_id))

    def renamed(self, old: str, new: str) -> "RowOrder":
        def swap(x: tuple[str, ...]) -> tuple[str, ...]:
            return tuple(new if c == old else c for c in x)

        return RowOrder(swap(self.order_by), swap(self.row_id))

    def data_columns(self, df: DataFrame) -> list[str]:
        return [c for c in df.columns if c not in self.row_id]


@dataclass(frozen=True)
class Need:
    """A statistic of one column: mean, std, min, max, count, mode or quantiles."""

    column: str
    kind: str
    probs: tuple[float, ...] = ()


@dataclass(frozen=True)
class Operator:
    transform: Callable[[DataFrame, Op, dict, RowOrder], DataFrame]
    needs: Callable[[DataFrame, Op], list[Need]] | None = None
    fit: Callable[[DataFrame, Op, dict, RowOrder], dict] | None = None
    column_local: bool = False  # changes only its own column and keeps all rows
    row_local: bool = False  # needs no other row once fitted; works on streams


def dtype_of(df: DataFrame, column: str) -> T.DataType:
    if column not in df.columns:
        raise ValueError(f'Column "{column}" does not exist.')
    return df.schema[column].dataType


def column_of(df: DataFrame, op: Op) -> str:
    column = op.get("column")
    if not column:
        raise ValueError(f'Name the column that {op["type"]} shall work on.')
    dtype_of(df, column)
    return column


def numeric_column(df: DataFrame, op: Op, what: str) -> str:
    column = column_of(df, op)
    dt = dtype_of(df, column)
    if not is_numeric(dt):
        raise ValueError(f'{what} works on numbers, but {column} is of type {dtype_name(dt)}.')
    return column


def numeric_columns(df: DataFrame, skip: Iterable[str] = ()) -> list[str]:
    skip = set(skip)
    return [f.name for f in df.schema.fields if is_numeric(f.dataType) and f.name not in skip]


def with_values(df: DataFrame, new: dict[str, Any]) -> DataFrame:
    """Replace columns in place, keeping the column order, in one projection."""
    return df.select(*[new[c].alias(c) if c in new else ref(c) for c in df.columns])


def collect_stats(df: DataFrame, needs: Iterable[Need]) -> dict[Need, Any]:
    """All wanted statistics: one aggregation, one quantile pass, one tally for all modes."""
    wanted = list(dict.fromkeys(needs))
    out: dict[Need, Any] = {}
    # Missing features are skipped: infinities and NaN are not numbers here.
    values = {n.column: finite(ref(n.column)) for n in wanted if n.kind not in ("mode",)}
    simple = {"mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max, "count": F.count}
    flat = [n for n in wanted if n.kind in simple]
    quantiles = [n for n in wanted if n.kind == "quantiles"]
    sizes = [Need(n.column, "count") for n in quantiles]
    aggs = list(dict.fromkeys(flat + sizes))
    if aggs:
        row = df.agg(*[simple[n.kind](values[n.column]).alias(f"s{i}") for i, n in enumerate(aggs)]).first()
        out.update({n: row[f"s{i}"] for i, n in enumerate(aggs)})
    by_probs: dict[tuple[float, ...], list[str]] = {}
    for n in quantiles:
        by_probs.setdefault(n.probs, []).append(n.column)
    for probs, columns in by_probs.items():
        size = {c: out[Need(c, "count")] for c in columns}
        found = exact_quantiles(df, {c: values[c] for c in columns}, probs, size)
        out.update({Need(c, "quantiles", probs): found[c] for c in columns})
    near: dict[tuple[float, ...], list[str]] = {}
    for n in wanted:
        if n.kind == "approx":
            near.setdefault(n.probs, []).append(n.column)
    for probs, columns in near.items():
        found = approx_quantiles(df, {c: values[c] for c in columns}, probs)
        out.update({Need(c, "approx", probs): found[c] or [None] * len(probs) for c in columns})
    modes = [n.column for n in wanted if n.kind == "mode"]
    found = most_frequent(df, modes) if modes else {}
    out.update({Need(c, "mode"): found.get(c) for c in modes})
    return out


def most_frequent(df: DataFrame, columns: Iterable[str]) -> dict[str, Any]:
    """Most frequent non-null value of each column, from one tally; the smallest one wins a tie."""
    columns = list(columns)
    types = list(dict.fromkeys(dtype_of(df, c) for c in columns))
    # A value stands in the field of its type, so one tally serves columns of several types and keeps their order.
    cells = [
        F.struct(F.lit(i).alias("at"), *[(ref(c) if dtype_of(df, c) == t else F.lit(None).cast(t)).alias(f"v{j}") for j, t in enumerate(types)])
        for i, c in enumerate(columns)
    ]
    fields = [f"v{j}" for j in range(len(types))]
    tally = df.select(F.inline(F.array(*cells))).where(F.coalesce(*[F.when(F.col(f).isNotNull(), True) for f in fields])).groupBy("at", *fields).count()
    best = tally.groupBy("at").agg(F.min(F.struct(-F.col("count"), *fields)).alias("top")).collect()
    return {columns[r["at"]]: r.top[f"v{types.index(dtype_of(df, columns[r['at']]))}"] for r in best}
