"""Row operators: drop nulls, drop rows by position, duplicates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from cleanloom.operators.base import Op, Operator, RowOrder, column_of, ref
from cleanloom.plans.ordering import as_keys, rows_at


def drop_nulls(df: DataFrame, op: Op, params: dict, order: RowOrder) -> DataFrame:
    columns = [column_of(df, op)] if op.get("column") else df.columns
    # NaN is a value, so df.na.drop() would remove too much.
    return df.filter(reduce(lambda a, b: a & b, [ref(c).isNotNull() for c in columns]))


def drop_rows(df: DataFrame, op: Op, params: dict, order: RowOrder) -> DataFrame:
    """Remove rows by 0-based position in the current order."""
    indices = op["indices"] if "indices" in op else [op.get("index")]
    if not indices or any(not isinstance(i, int) or isinstance(i, bool) for i in indices):
        raise ValueError("The operation names no row position.")
    keys = as_keys(order.order_by)
    gone = rows_at(df, keys, indices)
    # The caller lists the positions, so the right side has no more rows than that list.
    return df.join(F.broadcast(gone), keys, "left_anti").select(*map(ref, df.columns))


def drop_duplicates(df: DataFrame, op: Op, params: dict, order: RowOrder) -> DataFrame:
    """Whole-row duplicates; nulls are equal; the first row by row id stays."""
    data = order.data_columns(df)
    if len(data) == len(df.columns):
        return df.dropDuplicates()
    ids = [c for c in df.columns if c in order.row_id]
    if len(ids) == 1:
        return df.groupBy(*map(ref, data)).agg(F.min(ref(ids[0])).alias(ids[0])).select(*map(ref, df.columns))
    firsts = df.groupBy(*map(ref, data)).agg(F.min(F.struct(*map(ref, order.row_id))).alias("__id"))
    return firsts.select(*[F.col("__id").getField(c).alias(c) if c in ids else ref(c) for c in df.columns])


def fingerprint(columns: list[str]) -> list[Column]:
    """Two independent 64-bit hashes of a whole row; nulls keep their place."""
    parts = [p for c in columns for p in (ref(c).isNull(), ref(c))]
    return [F.xxhash64(F.lit(seed), *parts) for seed in (17, 71)]


def duplicate_count(df: DataFrame, columns: list[str] | None = None, *totals: Column) -> DataFrame:
    """Rows minus distinct rows, as a one-row table; ``totals`` are named sums over all rows.

    Only a 128-bit fingerprint per distinct row is shuffled, not the row.
    """
    keys, count = ["fingerprint 1", "fingerprint 2"], "fingerprint rows"
    while {c.lower() for c in (*keys, count)} & {c.lower() for c in df.columns}:
        keys, count = [k + "_" for k in keys], count + "_"
    hashes = [h.alias(k) for h, k in zip(fingerprint(columns or df.columns), keys)]
    inner = df.select(*hashes, "*").groupBy(*map(ref, keys)).agg(F.count(F.lit(1)).alias(count), *totals)
    extra = inner.columns[3:]
    zero = F.lit(0).cast("bigint")
    return inner.agg(
        F.coalesce(F.sum(ref(count) - 1), zero).alias("duplicates"), F.coalesce(F.sum(ref(count)), zero).alias("rows"),
        *[F.coalesce(F.sum(ref(c)), zero).alias(c) for c in extra])


OPERATORS = {
    "drop_nulls": Operator(drop_nulls, row_local=True),
    "drop_row": Operator(drop_rows),
    "drop_rows": Operator(drop_rows),
    "drop_duplicates": Operator(drop_duplicates),
}
