"""Isolation forest: anomaly scores and removal of anomalous rows.

One hundred trees over at most 256 rows each, drawn from the whole table. Draws
depend only on the seed, the tree, the slot and the row keys, so a replay gives the same forest at
any partitioning. Trees are built in parallel, each from its own few rows; the
finished forest is a small table that every task uses to score its rows.

Median imputation comes first. Splits are drawn between the smallest and the
largest value at hand, so z-scoring a feature does not change the trees and is
left out.
"""

from __future__ import annotations

import hashlib
import math
import sys
from collections import deque
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window, functions as F

from cleanloom.functions.text import is_numeric, spare_name
from cleanloom.operators.base import Op, Operator, RowOrder, dtype_of, ref
from cleanloom.operators.scaling import imputed_features
from cleanloom.plans.ordering import as_keys
from cleanloom.plans.quantiles import LAST_BRACKET_ROWS, order_statistics
from cleanloom.session import stored

# Fixed values of the method.
TREES, SAMPLE, SEED = 100, 256, 42
EULER_GAMMA = 0.5772156649
CONTAMINATION_MIN, CONTAMINATION_MAX, CONTAMINATION_DEFAULT = 0.001, 0.4, 0.05
FEWEST_ROWS = 20
ANOMALY_SCORE = 0.62
SCAN_FEWEST_ROWS, SCAN_FEWEST_FEATURES = 50, 2
# Hash buckets of the draws: few enough coarse ones to collect their counts, many fine ones inside each.
COARSE_BITS, FINE_BITS = 12, 14
HASH_BITS = 60
SCORE_DIGITS = 12
NODE_FIELDS = ["feature", "split", "left", "end"]


def average_path(n: float) -> float:
    """Expected path length of an unsuccessful search among n rows."""
    return 0.0 if n <= 1 else 2 * (math.log(n - 1) + EULER_GAMMA) - 2 * (n - 1) / n


def draw(*parts: int | str) -> float:
    """Number in [0, 1) that depends on the parts alone: the first 52 bits of the MD5 of their text."""
    return int(hashlib.md5(":".join(map(str, parts)).encode()).hexdigest()[:13], 16) / 2.0 ** 52


def default_features(df: DataFrame, order: RowOrder) -> list[str]:
    return [c for c in order.data_columns(df) if is_numeric(dtype_of(df, c))]


def _draws(df: DataFrame, filled: dict[str, Column], keys: list[str], rows: int, seed: int, trees: int, sample: int) -> DataFrame:
    """Rows of every tree, drawn with replacement from the whole table.

    A draw is a position in the order of the keys' MD5 (its first HASH_BITS bits, then the keys). Counts per bucket of hashes turn it into a bucket and a place
    inside, so only the drawn buckets are shuffled and sorted; at most trees x sample draws reach the driver.
    """
    spark = df.sparkSession
    names, ids = [f"x{i}" for i in range(len(filled))], [f"k{i}" for i in range(len(keys))]
    text = F.concat_ws(":", F.lit(str(seed)), *[ref(k).cast("string") for k in keys])
    hashed = df.select(F.conv(F.substring(F.md5(text), 1, HASH_BITS // 4), 16, 10).cast("bigint").alias("h"), *[ref(k).alias(i) for k, i in zip(keys, ids)],
                       *[c.alias(n) for n, c in zip(names, filled.values())])
    hashed = hashed.withColumn("coarse", F.shiftright("h", HASH_BITS - COARSE_BITS).cast("int"))
    hashed = hashed.withColumn("fine", F.shiftright("h", HASH_BITS - COARSE_BITS - FINE_BITS).bitwiseAND(F.lit((1 << FINE_BITS) - 1)).cast("int"))
    counts = hashed.groupBy("coarse", "fine").agg(F.count(F.lit(1)).alias("n"))
    sizes = sorted((r.coarse, r.n) for r in counts.groupBy("coarse").agg(F.sum("n").alias("n")).collect())
    ends = np.cumsum([n for _, n in sizes])
    drawn = np.array([int(draw(seed, tree, slot) * int(ends[-1])) for tree in range(trees) for slot in range(sample)], np.int64)
    which = np.searchsorted(ends, drawn, side="right")
    starts = ends - [n for _, n in sizes]
    places = [(i // sample, i % sample, sizes[w][0], int(p - starts[w])) for i, (w, p) in enumerate(zip(which.tolist(), drawn.tolist()))]
    places = spark.createDataFrame(places, "tree int, slot int, coarse int, place long")
    running = F.sum("n").over(Window.partitionBy("coarse").orderBy("fine"))
    buckets = counts.withColumn("end", running)
    inside = (F.col("place") < F.col("end")) & (F.col("place") >= F.col("end") - F.col("n"))
    found = buckets.join(F.broadcast(places), "coarse").where(inside).select("tree", "slot", "coarse", "fine", (F.col("place") - F.col("end") + F.col("n")).alias("at"))
    found = spark.createDataFrame(found.collect(), "tree int, slot int, coarse int, fine int, at long")
    near = hashed.join(F.broadcast(found.select("coarse", "fine").distinct()), ["coarse", "fine"])
    numbered = near.withColumn("at", F.row_number().over(Window.partitionBy("coarse", "fine").orderBy("h", *ids)).cast("long") - 1)
    return numbered.join(F.broadcast(found), ["coarse", "fine", "at"]).select("tree", "slot", *names)


def grow_tree(rows: np.ndarray, seed: int, tree: int) -> np.ndarray:
    """Nodes of one tree as (feature, split, left, end).

    The right child follows the left one. A leaf points to itself with an
    infinite split; ``end`` is its depth plus the expected rest of the path. The draws of a node depend on its place in
    the tree: the root is 1, the children of node i are 2i and 2i + 1.
    """
    depth_limit = math.ceil(math.log2(max(len(rows), 2)))
    nodes: list[list[float]] = []
    todo = deque([(np.arange(len(rows)), 0, -1, 1)])
    while todo:
        at, depth, parent, place = todo.popleft()
        here = len(nodes)
        nodes.append([0, np.inf, here, depth + average_path(len(at))])
        if parent >= 0 and nodes[parent][2] == parent:
            nodes[parent][2] = here
        if depth >= depth_limit or len(at) <= 1:
            continue
        feature, u = int(draw(seed, tree, place, "f") * rows.shape[1]), draw(seed, tree, place, "s")
        values = rows[at, feature]
        low, high = values.min(), values.max()
        if not low < high:
            continue
        split = low + u * (high - low)
        left, right = at[values < split], at[values >= split]
        if len(left) and len(right):
            nodes[here][:2] = [feature, split]
            todo.append((left, depth + 1, here, 2 * place))
            todo.append((right, depth + 1, here, 2 * place + 1))
    return np.array(nodes, float)


def fit_forest(df: DataFrame, features: Sequence[str], order: RowOrder, rows: int | None = None,
               seed: int = SEED, trees: int = TREES, sample: int = SAMPLE) -> dict:
    """Fitted forest: medians are inside ``filled``; node tables are plain arrays."""
    keys = as_keys(order.order_by)
    rows = df.count() if rows is None else rows
    filled = imputed_features(df, features)
    per_tree = min(sample, rows)
    names = [f"x{i}" for i in range(len(features))]

    def build(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("slot")
        tree = int(group["tree"].iloc[0])
        nodes = grow_tree(group[names].to_numpy(float), seed, tree)
        out = pd.DataFrame(nodes, columns=NODE_FIELDS)
        out.insert(0, "node", range(len(out)))
        out.insert(0, "tree", tree)
        return out

    # Every group holds at most ``sample`` rows, the result at most trees x 2 x sample nodes.
    grown = _draws(df, filled, keys, rows, seed, trees, per_tree).groupBy("tree").applyInPandas(
        build, "tree int, node int, " + ", ".join(f"{c} double" for c in NODE_FIELDS)
    ).toPandas().sort_values(["tree", "node"])
    forest = [g[NODE_FIELDS].to_numpy(float) for _, g in grown.groupby("tree")]
    return {"filled": filled, "forest": forest, "sample": per_tree, "rows": rows}


def path_scores(forest: list[np.ndarray], x: np.ndarray, sample: int) -> np.ndarray:
    """2 ** (-mean path / c(sample)) for a block of rows."""
    # One feature after the other in memory: the cell of a row is feature * rows + row.
    flat, row = np.ascontiguousarray(x.T).ravel(), np.arange(len(x))
    total = np.zeros(len(x))
    for nodes in forest:
        base, split, left = nodes[:, 0].astype(np.int64) * len(x), nodes[:, 1].copy(), nodes[:, 2].astype(np.int64)
        at = np.zeros(len(x), np.int64)
        for _ in range(math.ceil(math.log2(max(sample, 2)))):
            right = flat.take(base.take(at) + row) >= split.take(at)
            at = left.take(at) + right
        total += nodes[:, 3].take(at)
    return np.round(2.0 ** (-(total / len(forest)) / (average_path(sample) or 1.0)), SCORE_DIGITS)


def with_scores(df: DataFrame, fitted: dict, name: str = "score") -> DataFrame:
    shared = df.sparkSession.sparkContext.broadcast(fitted["forest"])
    sample = fitted["sample"]

    @F.pandas_udf("double")
    def score(features: pd.DataFrame) -> pd.Series:
        return pd.Series(path_scores(shared.value, features.to_numpy(float), sample))

    return df.withColumn(name, score(F.struct(*[c.alias(f"x{i}") for i, c in enumerate(fitted["filled"].values())])))


def top_threshold(df: DataFrame, column: str, contamination: float, rows: int | None = None) -> float:
    """The k-th highest score, k = max(1, floor(rows * contamination)); found without a global sort."""
    rows = df.agg(F.count(column)).first()[0] if rows is None else rows
    k = max(1, math.floor(rows * contamination))
    return order_statistics(df, {"s": F.col(column)}, {"s": [rows - k]}, {"s": rows})["s"][rows - k]


def topk_flag(df: DataFrame, column: str, contamination: float, name: str = "flag") -> DataFrame:
    """Flag rows at or above the threshold; ties are all flagged."""
    bar = top_threshold(df, column, contamination)
    return df.withColumn(name, F.col(column) >= F.lit(bar))


def clamp_contamination(value) -> float:
    return min(CONTAMINATION_MAX, max(CONTAMINATION_MIN, float(CONTAMINATION_DEFAULT if value is None else value)))


def iforest_outliers(df: DataFrame, op: Op, params: dict, order: RowOrder) -> DataFrame:
    features = [f for f in op.get("features") or default_features(df, order) if f in df.columns]
    if not features:
        raise ValueError("No numeric feature for the isolation forest: cast a column to a number first.")
    rows = df.count()
    if rows < FEWEST_ROWS:
        raise ValueError(f"An isolation forest needs {FEWEST_ROWS} rows or more, this table has {rows}.")
    name = spare_name(df, "score")
    scored = with_scores(df, fit_forest(df, features, order, rows), name)
    scores = scored.select(name)
    if rows > LAST_BRACKET_ROWS:
        # The threshold takes several passes: they read eight bytes per row instead of scoring again.
        scores = stored(scores, "scores")
    bar = top_threshold(scores, name, clamp_contamination(op.get("contamination")), rows)
    return scored.filter(F.col(name) < F.lit(bar)).select(*map(ref, df.columns))


def anomaly_scan(df: DataFrame, order: RowOrder, features: Sequence[str] | None = None) -> DataFrame:
    """Number and share of clearly anomalous rows; both null, with a reason, where the table is too small to tell."""
    features = list(features or default_features(df, order))
    rows = df.count()
    if len(features) < SCAN_FEWEST_FEATURES or rows < SCAN_FEWEST_ROWS:
        return df.agg(F.count(F.lit(1)).alias("rows")).select(
            "rows", F.lit(None).cast("bigint").alias("anomalies"), F.lit(None).cast("double").alias("rate"),
            F.lit("too few rows or numeric columns").alias("reason"))
    name = spare_name(df, "score")
    scored = with_scores(df, fit_forest(df, features, order, rows), name)
    flagged = F.count(F.when(F.col(name) >= ANOMALY_SCORE, 1))
    return scored.agg(F.count(F.lit(1)).alias("rows"), flagged.alias("anomalies")).withColumn(
        "rate", F.col("anomalies") / F.col("rows")).withColumn("reason", F.lit(None).cast("string"))


# Executors need no installed copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

OPERATORS = {"iforest_outliers": Operator(iforest_outliers)}
