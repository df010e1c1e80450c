"""Exact top-k search by inner product: columnar branch-and-bound."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cleanloom.llm.common import ref

# Dimensions per vertical block, and rows that seed the first limit of each query.
DIMS, SEED_ROWS = 8, 256
# Rows in one candidate block and queries in one query block: 64 dimensions of 8 bytes make 16 and 1 MB.
CANDIDATES, QUERIES = 32_768, 2_048
# Below this magnitude every partial sum of up to 2**21 dimensions is exact in a double.
SAFE = 1 << 16


def search_block(query: np.ndarray, times: np.ndarray, ids: np.ndarray, columns: list[np.ndarray], rest: np.ndarray, seeds: np.ndarray,
                 full: np.ndarray, k: int) -> list[tuple[int, int]]:
    """The k best (id, score) of one candidate block for one query; candidate ``i`` stands for ``times[i]`` equal rows.

    ``columns`` holds the block vertically: one array (dimensions of the block x rows) per dimension block, and
    ``rest[b]`` each row's norm over the dimensions from block ``b`` on. After every block the candidates whose partial
    sum plus the largest possible rest is below the k-th best seed are dropped and the survivors compacted.
    """
    sample = full[seeds] @ query
    fit = sample[times[seeds] > 0]
    limit = np.partition(fit, len(fit) - k)[len(fit) - k] if len(fit) >= k else -np.inf
    alive = None
    total = np.zeros(len(ids))
    at = 0
    for b, block in enumerate(columns):
        part = query[at:at + block.shape[0]]
        at += block.shape[0]
        total += part @ (block if alive is None else block[:, alive])
        mass = np.sqrt(np.dot(query[at:], query[at:])) * (rest[b + 1] if alive is None else rest[b + 1][alive])
        # A double norm may be off in its last digits; the slack keeps the bound safe.
        keep = total + mass * (1 + 1e-9) + 1e-3 >= limit
        if not keep.all():
            alive = np.flatnonzero(keep) if alive is None else alive[keep]
            total = total[keep]
        if len(total) > 4 * k and b + 1 < len(columns):
            # Lower bounds of the survivors may raise the limit further.
            low = total - np.sqrt(np.dot(query[at:], query[at:])) * (rest[b + 1] if alive is None else rest[b + 1][alive]) * (1 + 1e-9) - 1e-3
            low = low[(times if alive is None else times[alive]) > 0]
            if len(low) >= k:
                limit = max(limit, np.partition(low, len(low) - k)[len(low) - k])
    who = ids if alive is None else ids[alive]
    left = times if alive is None else times[alive]
    best = [i for i in np.lexsort((who, -total)) if left[i] > 0][:k] if (left == 0).any() else np.lexsort((who, -total))[:k]
    return [(int(who[i]), int(total[i])) for i in best for _ in range(min(k, int(left[i])))][:k]


def exact_block(query: list[int], times: np.ndarray, ids: np.ndarray, vectors: list[list[int]], k: int) -> list[tuple[int, int]]:
    """Whole-number arithmetic for values too large for doubles; scores outside 64 bits are held at its ends."""
    held = ((max(-2 ** 63, min(2 ** 63 - 1, sum(a * b for a, b in zip(query, v)))), int(i), int(t)) for i, v, t in zip(ids, vectors, times) if t)
    best = sorted(held, key=lambda x: (-x[0], x[1]))[:k]
    return [(i, s) for s, i, t in best for _ in range(min(k, t))][:k]


def top_k(df: DataFrame, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", every: int = 50, scale: int = 256,
          candidates: int = CANDIDATES, queries: int = QUERIES) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k highest integer inner products of each query against all other rows.

    Queries are the rows whose id is divisible by ``every``. Components become ``floor(scale * x)``. Candidates are dealt
    into blocks of a bounded expected size by a hash of the row, queries into blocks likewise, and each pair of blocks is
    one group: every block of queries meets every block of rows once, and a group returns k rows a query. Ties go to the
    smaller id. Equal vectors cost nothing extra: the block number depends on the id too.

    Rows with a null id, a null vector, or null or non-finite components take no part. Shorter vectors count as padded with zeros.
    A component counts as non-finite if it overflows when scaled. Only the query's own row is no candidate: other rows of
    its id are, equal ones too. Equal rows are searched once with their number and count as that many candidates and
    queries. Fewer than k candidates give fewer rows; an empty table gives none.
    """
    vector = ref(vector_col)
    scaled = F.transform(vector, lambda x: x.cast("double") * scale)
    # Doubles from 2**53 on are whole; floor() of Spark would hold them at the ends of a long.
    whole = F.transform(scaled, lambda x: F.when(F.abs(x) >= 2.0 ** 53, x).otherwise(F.floor(x).cast("double")))
    fits = F.forall(scaled, lambda x: F.abs(x) < SAFE)
    good = ref(id_col).isNotNull() & vector.isNotNull() & F.forall(scaled, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    # Rows outside the safe range of doubles take the way of whole numbers.
    rows = df.where(F.coalesce(good, F.lit(False))).select(
        ref(id_col).cast("long").alias("id"), F.when(fits, whole).alias("v"), F.when(~fits, whole).alias("wide"))
    rows = rows.groupBy("id", "v", "wide").agg(F.count(F.lit(1)).alias("times")).withColumn("row", F.xxhash64("id", "v", "wide"))
    n = rows.count()
    n_query = max(1, -(-(n // every + 1) // queries))
    n_block = max(1, -(-n // candidates))
    asked = rows.where(F.col("id") % every == 0).withColumn("q", F.pmod("row", F.lit(n_query)).cast("int"))
    asked = asked.withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(n_block - 1))))
    base = rows.withColumn("c", F.pmod(F.xxhash64("row"), F.lit(n_block)).cast("int"))
    base = base.withColumn("q", F.explode(F.sequence(F.lit(0), F.lit(n_query - 1))))

    def search(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        if len(left) and len(right):
            ids, keys, copies = (right[c].to_numpy(np.int64) for c in ("id", "row", "times"))
            narrow = right["wide"].isna().all() and left["wide"].isna().all()
            if narrow:
                width = max(max(map(len, right["v"])), max(map(len, left["v"])))
                full = np.zeros((len(ids), width))
                for i, v in enumerate(right["v"]):
                    full[i, :len(v)] = v
                columns = [np.ascontiguousarray(full[:, d:d + DIMS].T) for d in range(0, width, DIMS)]
                squares = np.stack([np.einsum("dn,dn->n", b, b) for b in columns] + [np.zeros(len(ids))])
                rest = np.sqrt(np.cumsum(squares[::-1], axis=0)[::-1])
                seeds = np.argsort(-rest[0], kind="stable")[:SEED_ROWS]
                for i, own, asks, v in zip(left["id"], left["row"], left["times"], left["v"]):
                    query = np.zeros(width)
                    query[:len(v)] = v
                    out += [(i, own, asks, a, s) for a, s in search_block(query, copies - (keys == own), ids, columns, rest, seeds, full, k)]
            else:
                whole = [[int(x) for x in (v if v is not None else w)] for v, w in zip(right["v"], right["wide"])]
                for i, own, asks, v, w in zip(left["id"], left["row"], left["times"], left["v"], left["wide"]):
                    query = [int(x) for x in (v if v is not None else w)]
                    out += [(i, own, asks, a, s) for a, s in exact_block(query, copies - (keys == own), ids, whole, k)]
        return pd.DataFrame(out, columns=["query_id", "row", "asks", "vec_id", "score"])

    found = asked.groupBy("q", "c").cogroup(base.groupBy("q", "c")).applyInPandas(search, "query_id long, row long, asks long, vec_id long, score long")
    best = Window.partitionBy("query_id", "row").orderBy(F.desc("score"), "vec_id")
    first = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    every_row = first.withColumn("ask", F.explode(F.sequence(F.lit(1).cast("long"), "asks")))
    return every_row.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
