"""Column profiles that merge: stored sketches per part of a table, new data adds a part.

A part may be a file, a day or any other key. Distinct values are kept as HLL sketches, ranks of numbers as KLL sketches;
both are a few kilobytes whatever the rows, and merging parts reads the sketches only, never the rows again.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from cleanloom.functions.text import finite, is_numeric, ref

# Registers of a distinct count (a power of two) and size of a rank sketch.
UNIQUE_BITS, RANK_SIZE = 12, 800


def unique_error(bits: int = UNIQUE_BITS) -> float:
    """Relative error of a distinct count that holds in 997 of 1,000 cases (three standard errors)."""
    return 3 * 1.04 / math.sqrt(1 << bits)


def rank_error(size: int = RANK_SIZE) -> float:
    """Bound on the difference between wanted and true rank, as a share of the rows; three times the usual (99 %) one."""
    return 3 * 2.296 / size ** 0.9021


def sketch_columns(df: DataFrame, part: Column | None = None, columns: Sequence[str] | None = None) -> DataFrame:
    """``part, name, rows, nulls, uniques, ranks``: one row per part and column, from one pass with map-side merging.

    ``ranks`` is null for columns without finite numbers.
    """
    wanted = list(columns or df.columns)
    numeric = {c for c in wanted if is_numeric(df.schema[c].dataType)}
    cells = df.select((F.lit("all") if part is None else part.cast("string")).alias("p"), *[ref(c).alias(f"c{i}") for i, c in enumerate(wanted)])
    aggs = [F.count(F.lit(1)).alias("rows")]
    for i, c in enumerate(wanted):
        aggs += [F.count(f"c{i}").alias(f"n{i}"), F.hll_sketch_agg(F.col(f"c{i}").cast("string"), F.lit(UNIQUE_BITS)).alias(f"u{i}")]
        if c in numeric:
            aggs.append(F.kll_sketch_agg_double(finite(F.col(f"c{i}")), F.lit(RANK_SIZE)).alias(f"r{i}"))
    one = cells.groupBy("p").agg(*aggs)
    rows = [F.struct(F.lit(c).alias("name"), F.col("rows"), (F.col("rows") - F.col(f"n{i}")).alias("nulls"), F.col(f"u{i}").alias("uniques"),
                     (F.col(f"r{i}") if c in numeric else F.lit(None).cast("binary")).alias("ranks")) for i, c in enumerate(wanted)]
    return one.select(F.col("p").alias("part"), F.inline(F.array(*rows)))


def merge_sketches(parts: DataFrame) -> DataFrame:
    """``name, rows, nulls, uniques, ranks`` over all parts; parts of different tables may come by union."""
    return parts.groupBy("name").agg(
        F.sum("rows").alias("rows"), F.sum("nulls").alias("nulls"), F.hll_union_agg("uniques").alias("uniques"), F.kll_merge_agg_double("ranks").alias("ranks"))


def read_sketches(merged: DataFrame, probs: Sequence[float] = (0.25, 0.5, 0.75)) -> DataFrame:
    """``name, rows, nulls, unique, quantiles``: estimates; ``quantiles`` is null where no number was seen."""
    grid = F.array(*[F.lit(float(p)) for p in probs])
    seen = F.col("ranks").isNotNull() & (F.kll_sketch_get_n_double("ranks") > 0)
    return merged.select("name", "rows", "nulls", F.hll_sketch_estimate("uniques").alias("unique"),
                         F.when(seen, F.kll_sketch_get_quantile_double("ranks", grid)).alias("quantiles"))


def approx_quantiles(df: DataFrame, values: Mapping[str, Column], probs: Sequence[float], size: int = RANK_SIZE) -> dict[str, list[float] | None]:
    """Quantiles of all columns from one aggregation; each is a value of the column whose rank is within ``rank_error``."""
    if not values:
        return {}
    grid = F.array(*[F.lit(float(p)) for p in probs])
    sketches = df.agg(*[F.kll_sketch_agg_double(c.cast("double"), F.lit(size)).alias(f"s{i}") for i, c in enumerate(values.values())])
    found = [F.when(F.kll_sketch_get_n_double(f"s{i}") > 0, F.kll_sketch_get_quantile_double(f"s{i}", grid)).alias(f"q{i}") for i in range(len(values))]
    row = sketches.select(*found).first()
    return {n: None if row[i] is None else list(row[i]) for i, n in enumerate(values)}
