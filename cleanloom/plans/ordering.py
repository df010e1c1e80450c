"""Row order without a single-partition window.

A table has an explicit order: one or more columns that together are unique.
The order is cut into many ranges ("blocks") holding about equally many rows;
every positional operator works inside blocks and carries one small summary
row per block across block borders.

Blocks of one numeric, date or timestamp key come from split points of a row
sample, so the block of a row is a plain expression. Any other order (several
columns, text) is range-partitioned by Spark itself and kept in the shared
checkpoint folder, whose partitions then are the blocks; one hot leading value
is spread over many of them because the whole key is compared.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from cleanloom.functions.text import is_numeric, ref
from cleanloom.session import shared_dir

ROWS_PER_BLOCK = 1_000_000
MAX_BLOCKS = 20_000
SAMPLE_PER_BLOCK = 50
BLOCK, LOCAL = "__block", "__local"


def as_keys(order_by: str | Sequence[str] | None) -> list[str]:
    keys = [order_by] if isinstance(order_by, str) else list(order_by or [])
    if not keys:
        raise ValueError("This operation depends on row order: pass order_by with a unique key.")
    return keys


def _scalar_position(df: DataFrame, keys: list[str]) -> Column | None:
    """Double that never decreases along the order, for a single sortable number or time."""
    if len(keys) != 1:
        return None
    dt, c = df.schema[keys[0]].dataType, ref(keys[0])
    if isinstance(dt, T.TimestampType):
        return F.unix_micros(c).cast("double")
    if isinstance(dt, T.TimestampNTZType):
        # Whole seconds are enough to place cuts, and need no time zone.
        day = F.unix_date(c.cast("date")).cast("double")
        return day * 86400.0 + F.hour(c) * 3600.0 + F.minute(c) * 60.0 + F.second(c)
    if isinstance(dt, T.DateType):
        return F.unix_date(c).cast("double")
    return c.cast("double") if is_numeric(dt) else None


def renamed(df: DataFrame) -> dict[str, str] | None:
    """Plain names for the columns of a table that uses a helper's kind of name (two underscores in front), else nothing."""
    if not any(c.startswith("__") for c in df.columns):
        return None
    return {c: f"c{i}" for i, c in enumerate(df.columns)}


@dataclass
class Blocked:
    """A table with a block number per row; blocks are ordered and never overlap."""

    df: DataFrame
    keys: list[str]
    rows: int

    def summary(self, *aggs: Column) -> DataFrame:
        """One row per block; at most MAX_BLOCKS rows, hence safe to broadcast."""
        return self.df.groupBy(BLOCK).agg(*aggs)


def block_count(df: DataFrame, rows: int) -> int:
    wanted = -(-rows // ROWS_PER_BLOCK)
    floor = min(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // 1000))
    return max(1, min(MAX_BLOCKS, max(wanted, floor)))


def blocked(df: DataFrame, order_by: str | Sequence[str], rows: int | None = None) -> Blocked:
    keys = as_keys(order_by)
    rows = df.count() if rows is None else rows
    blocks = block_count(df, rows)
    position = _scalar_position(df, keys)
    if position is None:
        shared_dir(df.sparkSession)
        ranged = df.repartitionByRange(blocks, *map(ref, keys)).checkpoint()
        return Blocked(ranged.withColumn(BLOCK, F.spark_partition_id()), keys, rows)
    if blocks == 1:
        return Blocked(df.withColumn(BLOCK, F.lit(0)), keys, rows)
    # The sample only places the cuts: any cuts give the same results.
    share = min(1.0, 1.2 * blocks * SAMPLE_PER_BLOCK / rows)
    sample = df.select(position.alias("p")) if share >= 1.0 else df.select(position.alias("p")).sample(share, seed=11)
    points = sorted(r.p for r in sample.collect() if r.p is not None)
    cuts = sorted({points[len(points) * i // blocks] for i in range(1, blocks)}) if points else []
    if not cuts:
        return Blocked(df.withColumn(BLOCK, F.lit(0)), keys, rows)
    return Blocked(with_bucket(df, position, cuts, BLOCK), keys, rows)


def with_bucket(df: DataFrame, value: Column, cuts: Sequence[float], name: str) -> DataFrame:
    """Add the number of cuts <= value (binary search on the JVM); null goes before the first cut."""
    tmp = f"{name}_v"
    low = F.coalesce(value, F.lit(float("-inf")))
    cutter = Bucketizer(splits=[float("-inf"), *cuts, float("inf")], inputCol=tmp, outputCol=name)
    return cutter.transform(df.withColumn(tmp, low)).drop(tmp).withColumn(name, F.col(name).cast("int"))


def _running(col: Column) -> Column:
    """Total over all earlier blocks; the input has one row per block."""
    earlier = Window.orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(col).over(earlier), F.lit(0))


def with_row_number(df: DataFrame, order_by: str | Sequence[str], name: str = "row_number", rows: int | None = None) -> DataFrame:
    """0-based position of every row."""
    inner = renamed(df)
    if inner:
        got = with_row_number(df.toDF(*inner.values()), [inner[k] for k in as_keys(order_by)], "n", rows)
        return got.toDF(*df.columns, name)
    b = blocked(df, order_by, rows)
    starts = b.summary(F.count(F.lit(1)).alias("n")).select(BLOCK, _running(F.col("n")).alias("__start"))
    local = F.row_number().over(Window.partitionBy(BLOCK).orderBy(*map(ref, b.keys)))
    numbered = b.df.withColumn(LOCAL, local).join(F.broadcast(starts), BLOCK)
    return numbered.withColumn(name, F.col("__start") + F.col(LOCAL) - 1).select(*map(ref, df.columns), ref(name))


def rows_at(df: DataFrame, order_by: str | Sequence[str], indices: Sequence[int]) -> DataFrame:
    """Order keys of the rows at the given 0-based positions.

    Only blocks that hold a wanted position are sorted.
    """
    inner = renamed(df)
    if inner:
        keys = as_keys(order_by)
        return rows_at(df.toDF(*inner.values()), [inner[k] for k in keys], indices).toDF(*keys)
    b = blocked(df, order_by)
    wanted = sorted(set(indices))
    for i in wanted:
        if not 0 <= i < b.rows:
            raise ValueError(f"There is no row {i + 1}: the table ends after {b.rows:,}.")
    sizes = {r[BLOCK]: r.n for r in b.summary(F.count(F.lit(1)).alias("n")).collect()}
    hits, start, at = [], 0, 0
    for block in sorted(sizes):
        end = start + sizes[block]
        while at < len(wanted) and wanted[at] < end:
            hits.append((block, wanted[at] - start + 1))
            at += 1
        start = end
    spark = df.sparkSession
    picks = spark.createDataFrame(hits, f"{BLOCK} int, {LOCAL} int")
    local = F.row_number().over(Window.partitionBy(BLOCK).orderBy(*map(ref, b.keys)))
    touched = b.df.filter(F.col(BLOCK).isin(sorted({h[0] for h in hits}))).select(BLOCK, *map(ref, b.keys))
    return touched.withColumn(LOCAL, local).join(picks, [BLOCK, LOCAL], "left_semi").select(*map(ref, b.keys))


def forward_filled(df: DataFrame, column: str, order_by: str | Sequence[str], partition_by: str | Sequence[str] | None = None) -> DataFrame:
    """Replace nulls by the last earlier non-null value; leading nulls stay."""
    groups = [partition_by] if isinstance(partition_by, str) else list(partition_by or [])
    inner = renamed(df)
    if inner:
        got = forward_filled(df.toDF(*inner.values()), inner[column], [inner[k] for k in as_keys(order_by)], [inner[g] for g in groups])
        return got.toDF(*df.columns)
    b = blocked(df, order_by)
    key = F.struct(*map(ref, b.keys)) if len(b.keys) > 1 else ref(b.keys[0])
    seen = ref(column).isNotNull()
    last = F.max_by(F.when(seen, ref(column)), F.when(seen, key)).alias("__last")
    if groups:
        # A hot group is spread over its blocks; null groups are groups too.
        names = [f"__g{i}" for i in range(len(groups))]
        data = b.df.select("*", *[ref(g).alias(n) for g, n in zip(groups, names)])
        parts = [*names, BLOCK]
        tails = data.groupBy(*parts).agg(last)
        before = Window.partitionBy(*names).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    else:
        data, parts, names = b.df, [BLOCK], []
        tails = b.summary(last)
        before = Window.orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    carry = tails.select(*[F.col(p).alias(f"c{p}") for p in parts], F.last("__last", True).over(before).alias("__carry"))
    inside = Window.partitionBy(*parts).orderBy(*map(ref, b.keys)).rowsBetween(Window.unboundedPreceding, 0)
    local = data.withColumn(LOCAL, F.last(ref(column), ignorenulls=True).over(inside))
    matched = local[BLOCK] == carry[f"c{BLOCK}"]
    for n in names:
        matched = matched & local[n].eqNullSafe(carry[f"c{n}"])
    joined = local.join(carry if groups else F.broadcast(carry), matched, "left")
    filled = F.coalesce(F.col(LOCAL), F.col("__carry"))
    return joined.select(*[filled.alias(c) if c == column else ref(c) for c in df.columns])
