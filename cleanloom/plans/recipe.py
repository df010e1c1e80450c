"""Recipes: ordered, replayable lists of operations, and the command envelope.

Applying a recipe builds one lazy plan. Operations on different columns share
their statistics passes; fitted numbers become literals.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame, functions as F

from cleanloom.functions.text import ref
from cleanloom.operators import columns, forest, impute, knn, outliers, rows, scaling
from cleanloom.operators.base import Need, Op, Operator, RowOrder, collect_stats
from cleanloom.session import shared_dir, stored

OPERATORS: dict[str, Operator] = {
    **columns.OPERATORS, **rows.OPERATORS, **impute.OPERATORS, **outliers.OPERATORS,
    **scaling.OPERATORS, **knn.OPERATORS, **forest.OPERATORS,
}


def operator(op: Op) -> Operator:
    found = OPERATORS.get(op.get("type"))
    if found is None:
        raise ValueError(f'No recipe step is called {op.get("type")!r}.')
    return found


@dataclass
class Recipe:
    ops: list[Op] = field(default_factory=list)

    @staticmethod
    def from_json(text: str) -> "Recipe":
        return Recipe(json.loads(text))

    def to_json(self) -> str:
        return json.dumps(self.ops, sort_keys=True)

    def fit(self, df: DataFrame, order_by=None, row_id=None) -> "FittedRecipe":
        return fit_recipe(df, self.ops, order_by, row_id)[0]

    def apply(self, df: DataFrame, order_by=None, row_id=None, checkpoint_every: int = 0) -> DataFrame:
        return fit_recipe(df, self.ops, order_by, row_id, checkpoint_every)[1]


@dataclass
class FittedRecipe:
    """Operations with their learned numbers, usable on any frame of the same shape."""

    steps: list[tuple[Op, dict]]

    def transform(self, df: DataFrame) -> DataFrame:
        """Row-local replay, also for streaming frames: nothing is learned from ``df``."""
        for op, params in self.steps:
            spec = operator(op)
            if not spec.row_local or op.get("strategy") == "forward":
                raise ValueError(f'{op["type"]} looks at other rows and cannot be replayed row by row.')
            df = spec.transform(df, op, params, RowOrder())
        return df


def _own_column(op: Op) -> str | None:
    """The one column a step reads and changes, if it keeps all rows: such steps on different columns commute."""
    spec = operator(op)
    local = spec.column_local or op["type"] == "trim"
    return op.get("column") if local and op.get("strategy") != "forward" else None


def _stretch(ops: Sequence[Op], start: int) -> int:
    """End of the stretch of steps that commute across columns; a filter by statistics of one column may close it."""
    end = start
    while end < len(ops) and _own_column(ops[end]):
        end += 1
    if end < len(ops):
        spec = operator(ops[end])
        end += bool(spec.needs and not spec.column_local and ops[end].get("column"))
    return max(end, start + 1)


def _whole_rows(op: Op) -> bool:
    """Steps that look at several rows or at columns they do not name."""
    return not operator(op).row_local or op.get("strategy") == "forward"


def _beyond_columns(op: Op) -> bool:
    """Steps that a copy of some columns cannot follow."""
    return _whole_rows(op) or op["type"] == "rename_column" or not (op.get("column") or op["type"] == "trim")


def _read_later(ops: Sequence[Op], start: int) -> list[str]:
    """Columns to copy for the statistics of the steps from ``start`` on: those they measure or filter by."""
    measured, filtered = [], []
    for op in ops[start:]:
        if _beyond_columns(op):
            break
        if operator(op).needs and (op["type"] != "fill_null" or op.get("strategy") in ("mean", "median", "mode")):
            measured.append(op["column"])
        elif op["type"] == "drop_nulls":
            filtered.append(op["column"])
    return measured + filtered if measured else []


class _Frames:
    """The cleaned frame, and a narrow stored copy of what the next statistics read.

    After a step that moves whole rows the columns of the following statistics are written once, so no pass repeats the
    shuffle. Steps then change both frames alike; the copy ends with the first step that looks beyond its columns.
    """

    def __init__(self, df: DataFrame):
        self.df, self.narrow = df, None

    @property
    def measured(self) -> DataFrame:
        return self.df if self.narrow is None else self.narrow

    def transform(self, op: Op, params: dict, order: RowOrder, later: Sequence[str]) -> None:
        spec, column = operator(op), op.get("column")
        self.df = spec.transform(self.df, op, params, order)
        if _whole_rows(op):
            keep = [c for c in self.df.columns if c in later]
            self.narrow = stored(self.df.select(*map(ref, keep)), "recipe-statistics") if keep else None
        elif self.narrow is not None:
            if _beyond_columns(op):
                self.narrow = None
            elif column is None or column in self.narrow.columns:
                self.narrow = spec.transform(self.narrow, op, params, order)


def fit_recipe(df: DataFrame, ops: Iterable[Op], order_by=None, row_id=None, checkpoint_every: int = 0) -> tuple[FittedRecipe, DataFrame]:
    """Fit and apply in one go. ``checkpoint_every`` cuts the plan after that many rounds of statistics.

    Steps that change one column each wait only for earlier steps on their column. So a stretch of them takes as many
    rounds of statistics as its busiest column has fitted steps, however many columns there are.
    """
    ops, order, at, rounds = list(ops), RowOrder.of(order_by, row_id), 0, 0
    learned: list[dict] = [{} for _ in ops]
    frames = _Frames(df)

    def wants(i: int) -> list[Need]:
        spec = operator(ops[i])
        return spec.needs(frames.df, ops[i]) if spec.needs else []

    def apply(i: int) -> None:
        nonlocal order
        frames.transform(ops[i], learned[i], order, _read_later(ops, i + 1))
        if ops[i]["type"] == "rename_column":
            order = order.renamed(ops[i]["column"], ops[i]["to"].strip())

    while at < len(ops):
        end = _stretch(ops, at)
        queues: dict[str | None, list[int]] = {}
        for i in range(at, end):
            queues.setdefault(ops[i].get("column"), []).append(i)
        # A closing filter is fitted in its column's turn and applied after all others.
        closing = end - 1 if end - at > 1 and not _own_column(ops[end - 1]) else None
        while queues:
            for queue in queues.values():
                while queue and not wants(queue[0]):
                    learned[queue[0]] = _fitted(frames.df, ops[queue[0]], {}, order)
                    apply(queue.pop(0))
            queues = {c: queue for c, queue in queues.items() if queue}
            fronts = [queue.pop(0) for queue in queues.values()]
            if not fronts:
                break
            stats = collect_stats(frames.measured, [n for i in fronts for n in wants(i)])
            for i in fronts:
                learned[i] = _fitted(frames.df, ops[i], stats, order)
                if i != closing:
                    apply(i)
            rounds += 1
            if checkpoint_every and rounds % checkpoint_every == 0:
                shared_dir(df.sparkSession)
                frames.df = frames.df.checkpoint()
        if closing is not None:
            apply(closing)
        at = end
    return FittedRecipe(list(zip(ops, learned))), frames.df


def _fitted(df: DataFrame, op: Op, stats: dict, order: RowOrder) -> dict:
    fit = operator(op).fit
    return fit(df, op, stats, order) if fit else {}


def apply_op(df: DataFrame, op: Op, order_by=None, row_id=None) -> DataFrame:
    return fit_recipe(df, [op], order_by, row_id)[1]


def apply_recipe(df: DataFrame, ops: Iterable[Op], order_by=None, row_id=None, checkpoint_every: int = 0) -> DataFrame:
    return fit_recipe(df, ops, order_by, row_id, checkpoint_every)[1]


# ---------------------------------------------------------------------------
# Command envelope: {"column", "action_category", "method", "params"}
# ---------------------------------------------------------------------------

# Categories, methods and their aliases.
METHODS: dict[str, dict[str, str]] = {
    "missing_values": {
        "drop_rows": "drop_nulls", "mean": "fill", "median": "fill", "mode": "fill", "forward": "fill",
        "custom": "constant", "constant": "constant", "value": "constant", "knn": "knn",
    },
    "outliers": {
        "capping": "cap_outliers", "cap": "cap_outliers", "winsorize": "cap_outliers",
        "drop_rows": "drop_outliers", "drop": "drop_outliers", "iforest": "iforest",
    },
    "manual_edit": {"drop_row": "drop_row", "delete_row": "drop_row", "drop_rows": "drop_row"},
    "types": {"cast": "cast"},
    "text": {
        "trim": "trim", "strip": "trim", "lowercase": "lower", "lower": "lower", "uppercase": "upper", "upper": "upper",
    },
    "structure": {"dedupe": "drop_duplicates", "drop_duplicates": "drop_duplicates", "drop_column": "drop_column", "rename": "rename"},
    "features": {"scale": "scale"},
}
COMMAND_CASTS = ("Int64", "Float64", "String", "Boolean")
COLUMN_FREE = {"drop_row", "trim", "drop_duplicates", "iforest"}


def _number(params: dict, names: Sequence[str], default: float, low: float, high: float) -> float:
    value = next((params[n] for n in names if params.get(n) is not None), None)
    if value is None:
        return default
    try:
        number = float(value)
    except (TypeError, ValueError):
        number = math.nan
    if not math.isfinite(number):
        raise ValueError(f"{names[0]}={value!r} is no finite number.")
    return min(high, max(low, number))


def command_ops(command: dict[str, Any]) -> list[Op]:
    """Translate one command into operations; raises ValueError with an actionable message."""
    category = (command.get("action_category") or "").lower().strip()
    method = (command.get("method") or "").lower().strip()
    column = (command.get("column") or "").strip()
    params = command.get("params") or {}
    if category not in METHODS:
        raise ValueError(f'No command category {category!r}; there are {", ".join(METHODS)}.')
    kind = METHODS[category].get(method)
    if kind is None:
        raise ValueError(f'Category {category} has no method {method!r}, only {", ".join(METHODS[category])}.')
    if kind not in COLUMN_FREE and not column:
        raise ValueError(f'{category}/{method}: name the column it works on.')

    if kind in ("drop_nulls", "drop_column"):
        return [{"type": kind, "column": column}]
    if kind == "fill":
        return [{"type": "fill_null", "column": column, "strategy": method}]
    if kind == "constant":
        value = params.get("value")
        if value is None or str(value) == "":
            raise ValueError('A custom fill has to say which value to write.')
        return [{"type": "fill_null", "column": column, "strategy": "constant", "value": str(value)}]
    if kind == "knn":
        return [{"type": "knn_impute", "column": column, "k": math.floor(_number(params, ["k"], 5, 1, 25) + 0.5)}]
    if kind in ("cap_outliers", "drop_outliers"):
        return [{"type": kind, "column": column, "multiplier": _number(params, ["multiplier", "m"], 1.5, 0.1, 20)}]
    if kind == "iforest":
        op: Op = {"type": "iforest_outliers", "contamination": _number(params, ["contamination"], 0.05, 0.001, 0.4)}
        return [{**op, "features": params["features"]} if params.get("features") else op]
    if kind == "scale":
        return [{"type": "scale", "column": column, "scaler": params.get("scaler", "standard")}]
    if kind == "drop_row":
        return [_row_removal(params)]
    if kind == "cast":
        if params.get("to") not in COMMAND_CASTS:
            raise ValueError(f'A cast goes to one of {", ".join(COMMAND_CASTS)}.')
        return [{"type": "cast", "column": column, "to": params["to"]}]
    if kind == "trim":
        return [{"type": "trim", "column": column}] if column else [{"type": "trim"}]
    if kind in ("lower", "upper"):
        return [{"type": "normalize_case", "column": column, "mode": kind}]
    if kind == "rename":
        target = str(params.get("to") or "").strip()
        if not target:
            raise ValueError("A rename has to say the new name.")
        return [{"type": "rename_column", "column": column, "to": target}]
    return [{"type": "drop_duplicates"}]


def _row_removal(params: dict) -> Op:
    """All positions refer to the table before the command, so one operation removes them together."""
    indices = params["indices"] if isinstance(params.get("indices"), list) else [params["index"]] if "index" in params else []
    try:
        whole = [int(i) for i in indices if float(i) == int(float(i)) and int(float(i)) >= 0]
    except (TypeError, ValueError):
        whole = []
    if not indices or len(whole) != len(indices):
        raise ValueError("Rows to remove are whole positions counted from 0: one index, or a list of indices.")
    return {"type": "drop_rows", "indices": sorted(set(whole))}


def apply_commands(df: DataFrame, commands: Iterable[dict[str, Any]], order_by=None, row_id=None) -> DataFrame:
    return apply_recipe(df, [op for c in commands for op in command_ops(c)], order_by, row_id)


# ---------------------------------------------------------------------------
# Labels of logged operations, as a column expression over their JSON
# ---------------------------------------------------------------------------


# The wording of the label lines.
def op_label(op_json: Column) -> Column:
    """Human-readable line for an operation stored as JSON."""

    def field_(name: str) -> Column:
        return F.get_json_object(op_json, f"$.{name}")

    def text(*parts: str | Column) -> Column:
        return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])

    def or_else(name: str, default: str) -> Column:
        return F.coalesce(field_(name), F.lit(default))

    kind, column = field_("type"), field_("column")
    on = F.coalesce(F.concat(F.lit(" on "), column), F.lit(""))
    strategy = or_else("strategy", "constant")
    value = F.when((field_("strategy") == "constant") & field_("value").isNotNull(), text(': "', field_("value"), '"')).otherwise("")
    share = F.format_number(F.coalesce(field_("contamination").cast("double"), F.lit(0.05)) * 100, 1)
    scaler = F.when(field_("scaler") == "minmax", "MinMax").otherwise("Standard")
    row = F.coalesce(field_("index").cast("bigint"), F.lit(0)) + 1
    labels = {
        "drop_duplicates": F.lit("Drop duplicate rows"),
        "drop_nulls": text("Drop null rows", on),
        "drop_column": text("Drop column", on),
        "rename_column": text("Rename ", column, " → ", field_("to")),
        "cast": text("Cast ", column, " → ", field_("to")),
        "trim": F.when(column.isNotNull(), text("Trim whitespace on ", column)).otherwise("Trim whitespace (all text)"),
        "normalize_case": text("Normalize case (", or_else("mode", "lower"), ")", on),
        "knn_impute": text("KNN impute (k=", or_else("k", "5"), ")", on),
        "cap_outliers": text("Cap outliers (IQR ×", or_else("multiplier", "1.5"), ")", on),
        "drop_outliers": text("Drop outlier rows (IQR ×", or_else("multiplier", "1.5"), ")", on),
        "drop_row": text("Delete row #", row.cast("string")),
        "drop_rows": text("Delete ", F.json_array_length(field_("indices")).cast("string"), " rows"),
        "iforest_outliers": text("Isolation Forest — drop anomalies (contamination ", share, "%)"),
        "scale": text(scaler, " scale", on),
        "fill_null": text("Fill nulls (", strategy, value, ")", on),
    }
    out = None
    for name, label in labels.items():
        out = F.when(kind == name, label) if out is None else out.when(kind == name, label)
    return out.otherwise(kind)
