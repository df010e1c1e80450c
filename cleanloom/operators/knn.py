"""Nearest-neighbour imputation, exact at any size.

Semantics: features are all other numeric columns, or those named,
z-scored; the distance of two rows is the root mean square difference over the
features both rows have; a missing value becomes the plain mean of the ``k``
nearest known values; ties go to the earlier row (distances are compared at
nine decimals).

Comparing every gap with every known row would be quadratic. Instead

1. rows with equal features are merged first: equal gaps are answered once,
   and of equal known rows only the first ``k`` can ever be chosen;
2. known rows are put into cells (which features are missing x quantile bins);
   the cells are few and their bounding boxes fit the driver;
3. the boxes alone give each gap an upper limit for its k-th distance, hence
   every cell that can hold a neighbour; gaps of one cell share that search;
4. cells are cut into packets of bounded size, gaps are sent to the packets of
   their cells, and each packet is read once beside all its gaps, a block of
   gaps at a time; only the ``k`` best of each gap go on.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window, functions as F

from cleanloom.functions.text import is_integral, is_numeric, spare_name, to_numeric
from cleanloom.operators.base import Need, Op, Operator, RowOrder, collect_stats, column_of, dtype_of, ref, with_values
from cleanloom.operators.impute import fill_null
from cleanloom.plans.lookup import attach
from cleanloom.plans.ordering import as_keys, with_bucket, with_row_number
from cleanloom.session import stored

# Neighbour count range and default, and the feature limit.
K_MIN, K_MAX, K_DEFAULT = 1, 25, 5
DISTANCE_DIGITS = 9
PACKET_ROWS = 2_048
GAPS_PER_PACKET = 1_024
GAPS_PER_TASK = 65_536
MAX_CELLS = 65_536
BINNED_FEATURES, CELL_ROUNDS = 3, 3
# Numbers in one array of a task, so its memory does not depend on the table.
BLOCK = 262_144


def clamp_k(value) -> int:
    """Round half up, then clamp."""
    return min(K_MAX, max(K_MIN, math.floor(float(K_DEFAULT if value is None else value) + 0.5)))


def feature_columns(df: DataFrame, column: str, order: RowOrder) -> list[str]:
    names = [c for c in order.data_columns(df) if c != column and is_numeric(dtype_of(df, c))]
    return names


def free_name(df: DataFrame, wanted: str) -> str:
    """A name that no column of the table begins with."""
    while any(c.lower().startswith(wanted) for c in df.columns):
        wanted += "x"
    return wanted


def knn_impute(df: DataFrame, op: Op, params: dict, order: RowOrder) -> DataFrame:
    column, k = column_of(df, op), clamp_k(op.get("k"))
    target = to_numeric(ref(column), dtype_of(df, column))
    features = op.get("features") or feature_columns(df, column, order)
    prefix, hit = free_name(df, "f"), free_name(df, "answer")
    views = {f"{prefix}{i}": to_numeric(ref(f), dtype_of(df, f)) for i, f in enumerate(features)}
    aggs = [f(v).alias(f"{n}_{t}") for n, v in views.items() for t, f in (("m", F.avg), ("s", F.stddev_samp), ("d", F.approx_count_distinct))]
    missing = mask_of(list(views.values()))
    seen = df.agg(F.count(F.lit(1)).alias("rows"), F.count(target).alias("known"), F.approx_count_distinct(missing).alias("masks"), *aggs).first()
    if seen.known == 0:
        raise ValueError(f'Column "{column}" has no numeric value to learn neighbours from.')
    if seen.known == seen.rows:
        return df
    if not features or seen.rows < k + 1:
        median = {"type": "fill_null", "column": column, "strategy": "median"}
        if not is_numeric(dtype_of(df, column)):
            return df
        need = Need(column, "quantiles", (0.5,))
        return fill_null(df, median, {"value": collect_stats(df, [need])[need][0]}, order)

    names = list(views)
    keys = as_keys(order.order_by)
    source, rid, own = df, keys[0], spare_name(df, "known")
    if len(keys) > 1 or not is_integral(dtype_of(df, keys[0])):
        rid = spare_name(df, "rid")
        source = with_row_number(df, keys, rid, seen.rows)
    # + 0.0 turns -0.0 into 0.0, so equal features are one group.
    base = source.select(
        ref(rid).cast("bigint").alias("rid"), target.alias("y"), *[(v + F.lit(0.0)).alias(n) for n, v in views.items()]
    )
    scale = [(seen[f"{n}_m"] or 0.0, seen[f"{n}_s"] or 1.0) for n in names]
    answers, gaps = _solve(base, names, scale, k, seen)
    if answers is None:
        return with_values(df, {column: target})
    wide = source.select(*map(ref, source.columns), target.alias(own), *[(v + F.lit(0.0)).alias(n) for n, v in views.items()])
    merged = attach(wide, answers.withColumnRenamed("answer", hit), names, "weight", seen.rows - seen.known, gaps, ref(own).isNull())
    result = F.coalesce(ref(own), ref(hit))
    return merged.select(*[result.alias(c) if c == column else ref(c) for c in df.columns])


def _solve(base: DataFrame, names: list[str], scale: list[tuple[float, float]], k: int, seen):
    """Answer per distinct feature vector of the gaps, and the number of those vectors."""
    celled = _with_cells(base, names, seen)
    known = F.col("y").isNotNull()
    gaps = celled.filter(~known).groupBy("cell", *names).agg(F.count(F.lit(1)).alias("weight"))
    # The rank filter is applied before and after the shuffle, so a hot vector never gathers.
    first_k = Window.partitionBy("cell", *names).orderBy("rid")
    useful = celled.filter(known).withColumn("rank", F.row_number().over(first_k)).filter(F.col("rank") <= k)
    boxes = useful.groupBy("cell").agg(
        F.count(F.lit(1)).alias("rows"),
        *[f(n).alias(f"{t}_{n}") for n in names for t, f in (("lo", F.min), ("hi", F.max))],
    )
    asking = gaps.groupBy("cell").agg(F.count(F.lit(1)).alias("gaps"))
    frame = boxes.join(asking, "cell", "full").fillna(0, ["rows", "gaps"]).toPandas()  # one row a cell: about MAX_CELLS
    n_gaps = int(frame["gaps"].sum())
    cells = _Cells.of(frame, names, scale)
    if not len(cells.ids):
        return None, 0
    spark = base.sparkSession
    plan = spark.sparkContext.broadcast(vars(cells))
    d = len(names)
    vector = [(n, F.coalesce(F.col(n), F.lit(float("nan"))).alias(n)) for n in names]
    # Gaps of a cell travel together (a crowded cell in several parts): they share the search for cells in reach.
    crowd = spark.createDataFrame(
        [(int(c), -(-int(g) // GAPS_PER_TASK)) for c, g in zip(frame["cell"], frame["gaps"]) if g], "cell bigint, parts int")
    part = F.pmod(F.xxhash64(*names), F.col("parts"))
    asking = gaps.join(F.broadcast(crowd), "cell").repartition("cell", part).sortWithinPartitions("cell", *names)
    asks = stored(asking.select("cell", *[c for _, c in vector]).mapInPandas(
        lambda it: _ask(it, _Cells(**plan.value), k), "cell bigint, packet int, q array<double>"
    ), "knn-asks")
    # A cell that many gaps ask, wherever they come from, gets copies enough that no task meets too many of them.
    asked = {r.cell: r.gaps for r in asks.where("packet = 0").groupBy("cell").agg((F.sum(F.size("q")) / d).alias("gaps")).collect()}
    sizes = spark.createDataFrame(
        [(int(c), int(p), max(1, math.ceil(asked.get(int(c), 0) / GAPS_PER_TASK))) for c, p in zip(cells.ids, cells.packets)],
        "cell bigint, packets int, copies int"
    )
    copy = F.pmod(F.xxhash64("q"), F.col("copies")).cast("int").alias("copy")
    asks = asks.join(F.broadcast(sizes), "cell").select("cell", "packet", copy, "q")
    packets = (
        useful.join(F.broadcast(sizes), "cell")
        .withColumn("packet", F.pmod(F.xxhash64("rid"), F.col("packets")).cast("int"))
        .groupBy("cell", "packet", "copies")
        .agg(*[F.collect_list(F.coalesce(c, F.lit(float("nan")))).alias(c_) for c, c_ in [(F.col(n), n) for n in names]],
             F.collect_list("rid").alias("rid"), F.collect_list("y").alias("y"))
        .withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
        .drop("copies")
    )
    place = ["cell", "packet", "copy"]
    found = asks.groupBy(*place).cogroup(packets.groupBy(*place)).applyInPandas(
        lambda left, right: _meet(left, right, names, scale, k), ", ".join([*[f"{n} double" for n in names], "d double", "rid bigint", "y double"])
    )
    best = Window.partitionBy(*names).orderBy("d", "rid")
    nearest = found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    answer = nearest.groupBy(*names).agg(F.avg("y").alias("answer"))
    answer = answer.select(*[F.when(~F.isnan(n), F.col(n)).alias(n) for n in names], "answer")
    cond = F.lit(True)
    left, right = gaps.alias("g"), answer.alias("a")
    for n in names:
        cond = cond & F.col(f"g.{n}").eqNullSafe(F.col(f"a.{n}"))
    return left.join(right, cond).select(*[F.col(f"g.{n}").alias(n) for n in names], "weight", "answer"), n_gaps


def mask_of(features: list[Column]) -> Column:
    """Number for the set of features that a row lacks; one bit each, a hash of the bits beyond 62 features."""
    if len(features) > 62:
        return F.xxhash64(*[f.isNull() for f in features])
    return sum((f.isNull().cast("bigint") * F.lit(1 << i) for i, f in enumerate(features)), F.lit(0).cast("bigint"))


def _with_cells(base: DataFrame, names: list[str], seen) -> DataFrame:
    """Cell number: which features are missing, then quantile bins, finer where rows crowd.

    Any cells give the same answers, so estimates and hash collisions are harmless here.
    """
    wanted = min(MAX_CELLS, max(1, seen.known // PACKET_ROWS)) // max(1, seen.masks)
    out = base.withColumn("cell", mask_of([F.col(n) for n in names]))
    if wanted > 1:
        spark = base.sparkSession
        ranked = sorted(names, key=lambda n: -seen[f"{n}_d"])
        limit = 4 * max(PACKET_ROWS, seen.known // wanted)
        # The masks that occur; as several cells are wanted for each, they are fewer than MAX_CELLS.
        crowded = spark.createDataFrame(out.select("cell").distinct().collect(), "cell bigint")
        for at in range(CELL_ROUNDS):
            binned = ranked[BINNED_FEATURES * at:BINNED_FEATURES * (at + 1)] or ranked[:BINNED_FEATURES]
            out = _split(out, crowded, binned, max(2, int(wanted ** (1 / len(binned)))))
            if at + 1 < CELL_ROUNDS:
                vectors = F.approx_count_distinct(F.xxhash64(*[F.coalesce(n, F.lit(float("nan"))) for n in names]))
                sizes = out.filter(F.col("y").isNotNull()).groupBy("cell").agg(vectors.alias("n"))
                big = sizes.filter(F.col("n") > limit).select("cell").collect()
                if not big:
                    break
                crowded, wanted = spark.createDataFrame(big, "cell bigint"), max(8, wanted // len(big))
    return out.select("cell", "rid", "y", *names)


def _split(celled: DataFrame, crowded: DataFrame, binned: list[str], bins: int) -> DataFrame:
    """Divide the crowded cells by the quantiles that their rows have together."""
    marked = celled.join(F.broadcast(crowded.withColumn("crowd", F.lit(True))), "cell", "left")
    grid = [i / bins for i in range(1, bins)]
    cuts = marked.filter("crowd").agg(*[F.percentile_approx(n, grid, 1000).alias(n) for n in binned]).first()
    labels = []
    for n in binned:
        edges = sorted(set(cuts[n] or []))
        if edges:
            marked = with_bucket(marked, F.col(n), edges, f"b_{n}")
            labels.append(f"b_{n}")
    finer = F.when(F.col("crowd"), F.xxhash64("cell", *labels)).otherwise(F.col("cell"))
    return marked.withColumn("cell", finer).drop("crowd", *labels)


class _Cells:
    """Bounding boxes of the cells in z-space; small, shipped to every task."""

    def __init__(self, ids, rows, packets, lo, hi, scale):
        self.ids, self.rows, self.packets = ids, rows, packets
        self.lo, self.hi, self.scale = lo, hi, scale

    @staticmethod
    def of(boxes: pd.DataFrame, names: list[str], scale: list[tuple[float, float]]) -> "_Cells":
        used = boxes[boxes["rows"] > 0].sort_values("cell").reset_index(drop=True)
        rows = used["rows"].to_numpy(np.int64)
        m, s = np.array([a for a, _ in scale]), np.array([b for _, b in scale])
        lo = (used[[f"lo_{n}" for n in names]].to_numpy(float) - m) / s
        hi = (used[[f"hi_{n}" for n in names]].to_numpy(float) - m) / s
        return _Cells(used["cell"].to_numpy(np.int64), rows, np.maximum(1, -(-rows // PACKET_ROWS)), lo, hi, (m, s))

    def reach(self, low: np.ndarray, high: np.ndarray, k: int, among: np.ndarray) -> np.ndarray:
        """Which of the cells ``among`` may hold one of the k nearest rows of a point in the boxes low..high (boxes x cells)."""
        lo, hi, q0, q1 = self.lo[None, among], self.hi[None, among], low[:, None, :], high[:, None, :]
        shared = ~np.isnan(lo) & ~np.isnan(q0)
        dims = shared.sum(axis=2)
        with np.errstate(invalid="ignore"):
            near = np.where(shared, np.maximum(0.0, np.maximum(lo - q1, q0 - hi)), 0.0)
            far = np.where(shared, np.maximum(hi - q0, q1 - lo), 0.0)
        safe = np.maximum(dims, 1)
        near = np.where(dims > 0, np.sqrt((near**2).sum(axis=2) / safe), np.inf)
        far = np.where(dims > 0, np.sqrt((far**2).sum(axis=2) / safe), np.inf)
        by_far = np.argsort(far, axis=1, kind="stable")
        sorted_far = np.take_along_axis(far, by_far, 1)
        filled = np.cumsum(np.where(np.isinf(sorted_far), 0, self.rows[among][by_far]), axis=1)
        limit = np.take_along_axis(sorted_far, np.argmax(filled >= k, axis=1)[:, None], 1)[:, 0]
        limit = np.where(filled[:, -1] >= k, limit, np.inf)
        # The slack covers the nine-decimal comparison of distances.
        return np.isfinite(near) & (near <= limit[:, None] + 1e-8)


def _ask(batches: Iterator[pd.DataFrame], cells: _Cells, k: int) -> Iterator[pd.DataFrame]:
    """Send each gap to every packet of every cell in reach, many gaps per message.

    The box around neighbouring gaps gives a short list of cells, which is then checked gap by gap.
    """
    m, s = cells.scale
    everywhere = np.arange(len(cells.ids))
    for batch in batches:
        for _, group in batch.groupby("cell", sort=False):
            raw = group.drop(columns="cell").to_numpy(float)
            z = (raw - m) / s
            short = everywhere[cells.reach(z.min(axis=0)[None], z.max(axis=0)[None], k, everywhere)[0]]
            if not len(short):
                continue
            step = max(1, BLOCK // (len(short) * len(m)))
            for at in range(0, len(raw), step):
                hit = cells.reach(z[at:at + step], z[at:at + step], k, short)
                out = []
                for i in np.flatnonzero(hit.any(axis=0)):
                    ci, mine = short[i], raw[at:at + step][hit[:, i]]
                    for lo in range(0, len(mine), GAPS_PER_PACKET):
                        piece = mine[lo:lo + GAPS_PER_PACKET].ravel()
                        out.extend((int(cells.ids[ci]), p, piece) for p in range(int(cells.packets[ci])))
                if out:
                    yield pd.DataFrame(out, columns=["cell", "packet", "q"])


def _meet(asks: pd.DataFrame, packets: pd.DataFrame, names: list[str], scale: list[tuple[float, float]], k: int) -> pd.DataFrame:
    """The k best rows of one packet for each gap that asks it, in blocks of gaps."""
    m, s = np.array([a for a, _ in scale]), np.array([b for _, b in scale])
    d, parts = len(names), []
    if len(asks) and len(packets):
        row = packets.iloc[0]
        raw = np.concatenate([np.asarray(q, float) for q in asks["q"]]).reshape(-1, d)
        known = (np.column_stack([np.asarray(row[n], float) for n in names]) - m) / s
        rid, y = np.asarray(row["rid"], np.int64), np.asarray(row["y"], float)
        step = max(1, BLOCK // len(rid))
        for at in range(0, len(raw), step):
            who, dist, what = _nearest((raw[at:at + step] - m) / s, known, rid, k)
            parts.append((at + who, dist, what))
    who, dist, what = (np.concatenate(x) for x in zip(*parts)) if parts else (np.zeros(0, np.int64),) * 3
    out = pd.DataFrame(raw[who] if parts else np.zeros((0, d)), columns=names)
    out["d"], out["rid"], out["y"] = dist, rid[what] if parts else what, y[what] if parts else dist
    return out


def _nearest(q: np.ndarray, known: np.ndarray, rid: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Gap, distance and place of the k nearest known rows of each gap; ties go to the smaller ``rid``."""
    total, dims = np.zeros((len(q), len(known))), np.zeros((len(q), len(known)))
    for i in range(q.shape[1]):
        diff = q[:, i, None] - known[None, :, i]
        ok = ~np.isnan(diff)
        total += np.where(ok, diff, 0.0) ** 2
        dims += ok
    dist = np.where(dims > 0, np.round(np.sqrt(total / np.maximum(dims, 1)), DISTANCE_DIGITS), np.inf)
    limit = np.partition(dist, k - 1, axis=1)[:, k - 1:k] if len(known) > k else np.inf
    # All rows as near as the k-th, of which the first by distance and rid stay.
    who, what = np.nonzero((dist <= limit) & np.isfinite(dist))
    order = np.lexsort((rid[what], dist[who, what], who))
    who, what = who[order], what[order]
    keep = np.arange(len(who)) - np.searchsorted(who, who) < k
    return who[keep], dist[who[keep], what[keep]], what[keep]


# Executors need no installed copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

OPERATORS = {"knn_impute": Operator(knn_impute)}
