"""Column and table profiles.

All text measures of all columns come from one tally: the table is unpivoted
to (column, value) and counted, with the position where a value first occurs.
That is one shuffle with map-side combining, so a hot value costs nothing
extra; every later measure reads the tally, not the table. Each branch reads
all fields of the tally, which lets Spark reuse its exchange.

The table profile shuffles 128-bit fingerprints in place of long texts, which
are measured where they are; only those shown as samples are fetched.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from cleanloom.functions.text import (
    display, dtype_name, exact_text, half_up, is_integral, is_numeric, is_text, numeric_like, percent, strip, to_numeric,
)
from cleanloom.operators.base import RowOrder, dtype_of, ref
from cleanloom.operators.outliers import bounds_from, clamp_multiplier
from cleanloom.operators.rows import duplicate_count
from cleanloom.plans.quantiles import exact_quantiles

# Fixed values of the profile.
BINS, TOP_VALUES, SAMPLES = 14, 10, 3
WHOLE_TEXT = "^-?[0-9][0-9,]*$"
NUMERIC_RATIO = 0.9
SAMPLE_WIDTH = 42
STAT_DIGITS = 4
QUARTERS = (0.25, 0.5, 0.75)


def _position(order: RowOrder) -> Column:
    keys = order.order_by
    if not keys:
        # Without an order the first-seen value is the smallest one.
        return F.lit(0).cast("bigint")
    return ref(keys[0]) if len(keys) == 1 else F.struct(*[ref(k) for k in keys])


def first_rows(df: DataFrame, order: RowOrder, n: int) -> DataFrame:
    """The first n rows in order (a bounded top-n, not a sort of the table)."""
    return df.orderBy(*map(ref, order.order_by)).limit(n)


def value_tally(df: DataFrame, columns: Sequence[str], order: RowOrder, exact: bool = False) -> DataFrame:
    """(ci, v, cnt, first): column number, value text, rows, first position."""
    form = exact_text if exact else display
    cells = [x for i, c in enumerate(columns) for x in (F.lit(i), form(ref(c), dtype_of(df, c)))]
    long = df.select(_position(order).alias("first"), F.stack(F.lit(len(columns)), *cells).alias("ci", "v"))
    # Never null, so no join adds a filter for it to one branch only.
    long = long.withColumn("ci", F.coalesce("ci", F.lit(0)))
    return long.groupBy("ci", "v").agg(F.count(F.lit(1)).alias("cnt"), F.min("first").alias("first"))


def _filled(c: str = "v") -> Column:
    return F.col(c).isNotNull() & (F.col(c) != "")


def _measures(tally: DataFrame) -> DataFrame:
    cnt, v = F.when(F.col("first").isNotNull(), F.col("cnt")), F.col("v")
    return tally.groupBy("ci").agg(
        F.sum(cnt).alias("rows"),
        F.coalesce(F.sum(F.when(v.isNull(), cnt)), F.lit(0)).alias("nulls"),
        F.coalesce(F.sum(F.when(_filled(), cnt)), F.lit(0)).alias("filled"),
        F.count(F.when(_filled(), 1)).alias("unique"),
        F.coalesce(F.sum(F.when(_filled() & (v != strip(v)), cnt)), F.lit(0)).alias("whitespace"),
        F.coalesce(F.sum(F.when(_filled() & numeric_like(v), cnt)), F.lit(0)).alias("numeric_text"),
        F.coalesce(F.sum(F.when(_filled() & numeric_like(v) & strip(v).rlike(WHOLE_TEXT), cnt)), F.lit(0)).alias("whole_text"),
        F.sum(F.when(_filled(), cnt * F.size(F.split(strip(v), r"\s+")))).alias("words"),
    )


def first_values(tally: DataFrame, n: int = SAMPLES) -> DataFrame:
    """The n distinct values of each column that occur first, as an array."""
    # Written on cnt, so the filter stays above the shared tally.
    real = tally.filter(F.when(_filled(), F.col("cnt")).otherwise(0) > 0)
    order = Window.partitionBy("ci").orderBy("first", "v")
    early = real.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n)
    listed = F.transform(F.array_sort(F.collect_list(F.struct("rank", "v"))), lambda x: x["v"])
    return early.groupBy("ci").agg(listed.alias("sample"))


def case_collisions(tally: DataFrame, order: RowOrder) -> DataFrame:
    """Rows whose trimmed text differs from the first-seen spelling of the same lower-case text."""
    t = F.when(F.col("cnt") > 0, strip(F.when(F.col("v") != "", F.col("v"))))
    spelled = tally.groupBy("ci", t.alias("t")).agg(F.sum("cnt").alias("cnt"), F.min("first").alias("first"))
    # A row has one spelling, so first positions are unique where there is an order.
    earliest = F.min_by("cnt", "first" if order.order_by else "t")
    folded = spelled.groupBy("ci", F.lower("t").alias("low")).agg(F.sum("cnt").alias("all"), earliest.alias("kept"))
    clash = F.when(F.col("low").isNotNull(), F.col("all") - F.col("kept"))
    return folded.groupBy("ci").agg(F.coalesce(F.sum(clash), F.lit(0)).alias("case_collisions"))


# State of a value, as bits.
NULL, FILLED, PADDED, NUMBER, WHOLE = 1, 2, 4, 8, 16
# Bytes up to which a text stands for itself in the tally of a table.
SHORT = 64


def _short(c: Column) -> Column:
    return (F.octet_length(c) <= SHORT) & ~c.startswith("\0")


def _key(c: Column) -> Column:
    """A short text itself, a longer one's 128-bit fingerprint behind a zero character."""
    hashed = F.concat(F.lit("\0"), *[x for seed in (17, 71) for x in (F.hex(F.xxhash64(F.lit(seed), c)), F.lit("."))])
    return F.when(_short(c), c).when(c.isNotNull(), hashed)


def _cells(df: DataFrame, columns: Sequence[str], *more: Column) -> DataFrame:
    """(…, ci, v): one row per cell, as displayed; ci is never null, so no join adds a filter for it to one branch only."""
    flat = [x for i, c in enumerate(columns) for x in (F.lit(i), display(ref(c), dtype_of(df, c)))]
    cells = df.select(*more, F.stack(F.lit(len(columns)), *flat).alias("ci", "v"))
    return cells.withColumn("ci", F.coalesce("ci", F.lit(0)))


def _state(v: Column, t: Column) -> Column:
    """Bits of a value; ``t`` is its trimmed text, null outside text columns."""
    number = numeric_like(t)
    of_text = F.when(v != t, PADDED).otherwise(0) + F.when(number, F.when(t.rlike(WHOLE_TEXT), NUMBER + WHOLE).otherwise(NUMBER)).otherwise(0)
    return F.when(v.isNull(), NULL).when(v == "", 0).otherwise(F.lit(FILLED) + F.when(t.isNotNull(), of_text).otherwise(0))


def bounded_tally(df: DataFrame, columns: Sequence[str], order: RowOrder) -> DataFrame:
    """(ci, k, cnt, first, state, words, t, low): one row per column and distinct value.

    ``k``, ``t`` and ``low`` are keys of the value, its trimmed and its folded text. Long texts are measured where they are
    and only their keys are shuffled, so a row of the shuffle is small however long the texts; short ones are measured once
    per distinct value.
    """
    texts = [i for i, c in enumerate(columns) if is_text(dtype_of(df, c))]
    is_textual, v, t = F.col("ci").isin(texts) if texts else F.lit(False), F.col("v"), F.col("t")
    cells = _cells(df, columns, _position(order).alias("first")).withColumn("t", F.when(~_short(v) & is_textual, strip(v)))
    rows = cells.select(
        "ci", "first", _key(v).alias("k"), F.when(~_short(v), _state(v, t)).alias("far_state"), F.size(F.split(t, r"\s+")).alias("far_words"),
        _key(t).alias("far_t"), _key(F.lower(t)).alias("far_low"))
    tally = rows.groupBy("ci", "k", "far_state", "far_words", "far_t", "far_low").agg(F.count(F.lit(1)).alias("cnt"), F.min("first").alias("first"))
    # Always true; it makes every branch read all fields, so that the branches share one exchange.
    tally = tally.where(F.pmod(F.xxhash64("cnt", "first"), F.lit(2)) < 2)
    k = F.col("k")
    near = tally.withColumn("t", F.when(F.col("far_state").isNull() & _filled("k") & is_textual, strip(k)))
    return near.select(
        "ci", "k", "cnt", "first", F.coalesce("far_state", _state(k, t)).alias("state"), F.coalesce("far_words", F.size(F.split(t, r"\s+"))).alias("words"),
        F.coalesce("far_t", _key(t)).alias("t"), F.coalesce("far_low", _key(F.lower(t))).alias("low"))


def _bounded_measures(tally: DataFrame, order: RowOrder) -> DataFrame:
    """One row per column: the sums of the tally, case collisions, and its first values. Filters are written on cnt, so
    they stay above the shared tally."""
    cnt, state = F.col("cnt"), F.col("state")

    def rows_with(bit: int) -> Column:
        return F.coalesce(F.sum(F.when(state.bitwiseAND(bit) > 0, cnt)), F.lit(0))

    sums = tally.groupBy("ci").agg(
        F.sum(cnt).alias("rows"), rows_with(NULL).alias("nulls"), rows_with(FILLED).alias("filled"), F.count(F.when(state.bitwiseAND(FILLED) > 0, cnt)).alias("unique"),
        rows_with(PADDED).alias("whitespace"), rows_with(NUMBER).alias("numeric_text"), rows_with(WHOLE).alias("whole_text"), F.sum(cnt * F.col("words")).alias("words"))
    spelled = tally.where(F.when(F.col("t").isNotNull(), cnt).otherwise(0) > 0).groupBy("ci", "t", "low").agg(F.sum(cnt).alias("cnt"), F.min("first").alias("first"))
    folded = spelled.groupBy("ci", "low").agg((F.sum("cnt") - F.min_by("cnt", "first")).alias("clash"))
    early = Window.partitionBy("ci").orderBy("first", "k")
    filled = tally.where(F.when(state.bitwiseAND(FILLED) > 0, cnt).otherwise(0) > 0)
    firsts = filled.withColumn("n", F.row_number().over(early)).where(F.col("n") <= SAMPLES)
    lead = F.col("first") if len(order.order_by) == 1 else F.col("first").getField(order.order_by[0])
    where = firsts.groupBy("ci").agg(F.array_sort(F.collect_list(F.struct("n", lead.alias("lead"), "k"))).alias("firsts"))
    return sums.join(folded.groupBy("ci").agg(F.sum("clash").alias("case_collisions")), "ci", "left").join(where, "ci", "left")


def _samples(df: DataFrame, columns: Sequence[str], order: RowOrder, found: Sequence) -> dict[int, list[str]]:
    """The texts of the first values of each column, a few per column; only long ones are fetched."""
    out = {r.ci: [x.k for x in r.firsts or ()] for r in found}
    far = [(r.ci, n, x.k, x.lead) for r in found for n, x in enumerate(r.firsts or ()) if x.k.startswith("\0")]
    if not far:
        return out
    lead = order.order_by[0]
    if is_integral(dtype_of(df, lead)) or is_text(dtype_of(df, lead)):
        # Reaches the scan as a range, which is narrow: first values stand at the beginning.
        df = df.where(ref(lead).isin(sorted({x[3] for x in far})))
    wanted = df.sparkSession.createDataFrame([x[:3] for x in far], "ci int, n int, k string")
    cells = _cells(df, columns).where(~_short(F.col("v"))).select("ci", "v", _key(F.col("v")).alias("k"))
    for r in cells.join(F.broadcast(wanted), ["ci", "k"]).groupBy("ci", "n").agg(F.first("v").alias("v")).collect():
        out[r.ci][r.n] = r.v
    return out


def _bounded_parts(df: DataFrame, columns: Sequence[str], order: RowOrder) -> DataFrame:
    """The measures of the whole profile, one row per column, already computed: a job for them and one for the samples."""
    found = _bounded_measures(bounded_tally(df, columns, order), order).collect()
    samples = _samples(df, columns, order, found)
    names = ["ci", "rows", "nulls", "filled", "unique", "whitespace", "numeric_text", "whole_text", "words", "case_collisions"]
    rows = [(*[r[n] for n in names], samples.get(r.ci, [])) for r in found]
    return df.sparkSession.createDataFrame(rows, "ci int, " + ", ".join(f"`{n}` bigint" for n in names[1:]) + ", sample array<string>")


def table_profile(df: DataFrame, order: RowOrder | None = None, sample_rows: int | None = None) -> DataFrame:
    """One row per column: type, nulls, distinct values, samples, text defects.

    ``sample_rows=2000`` reproduces a profile whose text measures look only at
    the first rows; the default looks at all of them. With a row order long
    texts are compared by fingerprints; without one the smallest spelling
    counts as the first, so the texts themselves are compared.
    """
    order = order or RowOrder()
    columns = order.data_columns(df)
    spark = df.sparkSession
    heads = [(i, c, dtype_name(dtype_of(df, c)), is_text(dtype_of(df, c))) for i, c in enumerate(columns)]
    head = spark.createDataFrame(heads, "ci int, name string, dtype string, is_text boolean")
    seen = df if sample_rows is None else first_rows(df, order, sample_rows)
    if order.order_by:
        parts = _bounded_parts(seen, columns, order)
    else:
        tally = value_tally(seen, columns, order)
        parts = _measures(tally).join(first_values(tally), "ci", "left").join(case_collisions(tally, order), "ci", "left")
    if sample_rows is not None:
        full = df.agg(F.count(F.lit(1)).alias("rows"), *[F.count(F.when(ref(c).isNull(), 1)).alias(f"n{i}") for i, c in enumerate(columns)])
        nulls = full.select("rows", F.posexplode(F.array(*[f"n{i}" for i in range(len(columns))])).alias("ci", "nulls"))
        parts = parts.drop("rows", "nulls").join(nulls, "ci")
    text = F.col("is_text")
    zero = F.lit(0).cast("bigint")
    return head.join(parts, "ci", "left").select(
        F.col("ci").alias("position"),
        "name",
        "dtype",
        F.coalesce("rows", zero).alias("rows"),
        F.coalesce("nulls", zero).alias("nulls"),
        F.coalesce(percent(F.col("nulls"), F.col("rows")), F.lit(0.0)).alias("null_pct"),
        F.coalesce("unique", zero).alias("unique"),
        F.coalesce("sample", F.array().cast("array<string>")).alias("sample"),
        F.coalesce(F.when(text, half_up(F.col("numeric_text") / F.greatest(F.col("filled"), F.lit(1)), 2)), F.lit(0.0)).alias("numeric_like"),
        F.coalesce(F.when(text, F.col("whitespace")), zero).alias("whitespace"),
        F.coalesce(F.when(text, F.col("case_collisions")), zero).alias("case_collisions"),
        # Over all rows: texts that are numbers, those that are whole numbers, and words in a filled cell.
        F.coalesce(F.when(text, F.col("numeric_text")), zero).alias("numbers"),
        F.coalesce(F.when(text, F.col("whole_text")), zero).alias("wholes"),
        F.when(text & (F.col("filled") > 0), F.col("words") / F.col("filled")).alias("mean_words"),
    )


def null_profile(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Null count and share per column, in one pass without a shuffle of rows."""
    columns = list(columns or df.columns)
    aggs = [F.count(F.when(ref(c).isNull(), 1)).alias(f"n{i}") for i, c in enumerate(columns)]
    one = df.agg(F.count(F.lit(1)).alias("rows"), *aggs)
    packed = F.array(*[F.struct(F.lit(c).alias("name"), F.col(f"n{i}").alias("nulls")) for i, c in enumerate(columns)])
    return one.select("rows", F.inline(packed)).select("name", "nulls", percent(F.col("nulls"), F.col("rows")).alias("null_pct"))


def number_code(c: Column, dt: T.DataType) -> Column | None:
    """Distinct bigint per distinct value of a type of at most eight bytes, else None."""
    if is_integral(dt):
        return c.cast("bigint")
    if isinstance(dt, T.TimestampType):
        return F.unix_micros(c)
    if isinstance(dt, T.DateType):
        return F.unix_date(c).cast("bigint")
    if isinstance(dt, (T.FloatType, T.DoubleType)):
        return F.when(c.isNotNull(), F.xxhash64(c.cast("double")))
    if isinstance(dt, T.TimestampNTZType):
        return F.when(c.isNotNull(), F.xxhash64(c))
    return None


def unique_counts(df: DataFrame, columns: Sequence[str] | None = None, approx: bool = False) -> DataFrame:
    """Distinct non-blank values per column; ``approx`` uses one sketch per column and no shuffle of values."""
    columns = list(columns or df.columns)
    if approx:
        texts = [F.when(ref(c).cast("string") != "", ref(c)) for c in columns]
        one = df.agg(*[F.approx_count_distinct(t).alias(f"u{i}") for i, t in enumerate(texts)])
        packed = F.array(*[F.struct(F.lit(c).alias("name"), F.col(f"u{i}").alias("unique")) for i, c in enumerate(columns)])
        return one.select(F.inline(packed))
    # Values of at most eight bytes become one number each: integers and times as they are,
    # the rest by xxhash64, which maps eight-byte inputs one to one.
    fixed = [(i, number_code(ref(c), dtype_of(df, c))) for i, c in enumerate(columns)]
    narrow = [(i, code) for i, code in fixed if code is not None]
    text = [(i, exact_text(F.col(f"`{columns[i]}`"), dtype_of(df, columns[i]))) for i, code in fixed if code is None]
    parts = []
    for cells in (narrow, text):
        if cells:
            flat = [x for i, c in cells for x in (F.lit(i), c)]
            values = df.select(F.stack(F.lit(len(cells)), *flat).alias("ci", "v")).filter(F.col("v").isNotNull())
            values = values if cells is narrow else values.filter(F.col("v") != "")
            parts.append(values.distinct().groupBy("ci").agg(F.count(F.lit(1)).alias("unique")))
    names = df.sparkSession.createDataFrame(list(enumerate(columns)), "ci int, name string")
    found = reduce(DataFrame.unionByName, parts)
    return names.join(found, "ci", "left").select("name", F.coalesce("unique", F.lit(0).cast("bigint")).alias("unique"))


def numeric_decision(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Per column: share of cells read as numbers, whether to treat it as numeric, whether that is a coercion."""
    columns = list(columns or df.columns)
    aggs = []
    for i, c in enumerate(columns):
        dt, col = dtype_of(df, c), ref(c)
        nonblank = F.when(col.cast("string") != "", 1)
        aggs += [F.count(to_numeric(col, dt)).alias(f"p{i}"), F.count(nonblank).alias(f"b{i}")]
    one = df.agg(*aggs)
    packed = F.array(*[
        F.struct(F.lit(c).alias("name"), F.lit(is_numeric(dtype_of(df, c))).alias("typed"),
                 F.col(f"p{i}").alias("parsed"), F.col(f"b{i}").alias("nonblank"))
        for i, c in enumerate(columns)
    ])
    ratio = F.when(F.col("nonblank") > 0, F.col("parsed") / F.col("nonblank")).otherwise(0.0)
    rows = one.select(F.inline(packed)).withColumn("ratio", ratio)
    numeric = F.col("typed") | (F.col("ratio") >= NUMERIC_RATIO)
    return rows.select("name", "parsed", "nonblank", "ratio", numeric.alias("numeric"), (numeric & ~F.col("typed")).alias("coerced"))


SUMMARY = ("min", "q1", "median", "q3", "max", "mean", "std", "iqr")


def _summaries(df: DataFrame, columns: Sequence[str]) -> dict[str, dict[str, float]]:
    """Unrounded statistics of the numeric view of each column that has numbers, and how many."""
    views = {f"v{i}": to_numeric(ref(c), dtype_of(df, c)) for i, c in enumerate(columns)}
    aggs = [f(v).alias(f"{n}_{t}") for n, v in views.items()
            for t, f in (("n", F.count), ("lo", F.min), ("hi", F.max), ("m", F.avg), ("s", F.stddev_samp))]
    row = df.agg(*aggs).first()
    sizes = {n: row[f"{n}_n"] for n in views}
    quarters = exact_quantiles(df, views, QUARTERS, sizes)
    out = {}
    for c, n in zip(columns, views):
        if sizes[n]:
            q1, q2, q3 = quarters[n]
            found = (row[f"{n}_lo"], q1, q2, q3, row[f"{n}_hi"], row[f"{n}_m"], row[f"{n}_s"] or 0.0, q3 - q1)
            out[c] = {"values": sizes[n], **dict(zip(SUMMARY, found))}
    return out


def numeric_summary(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """min, quartiles, max, mean, deviation and range of the numeric view, four decimals."""
    return _rounded(df.sparkSession, _summaries(df, columns))


def _rounded(spark: SparkSession, found: dict[str, dict[str, float]]) -> DataFrame:
    raw = spark.createDataFrame(
        [(c, r["values"], *[r[n] for n in SUMMARY]) for c, r in found.items()], "name string, values bigint, " + ", ".join(f"`{n}` double" for n in SUMMARY))
    return raw.select("name", "values", *[half_up(F.col(n), STAT_DIGITS).alias(n) for n in SUMMARY])


def histogram(df: DataFrame, column: str, bins: int = BINS, ends: tuple[float, float] | None = None) -> DataFrame:
    """Equal-width bins of the numeric view, empty ones included; no rows for a constant column.

    ``ends``, the smallest and the largest value, saves the pass that finds them.
    """
    x = to_numeric(ref(column), dtype_of(df, column))
    lo, hi = ends or df.agg(F.min(x), F.max(x)).first()
    spark = df.sparkSession
    if lo is None or not hi > lo:
        return spark.createDataFrame([], "bin int, count bigint, min double, max double")
    step = (hi - lo) / bins
    # Counted by the unbounded bin first: a cell is read as a number once, and at most bins + 1 groups are left.
    raw = df.select(F.floor((x - F.lit(lo)) / F.lit(step)).cast("int").alias("raw")).groupBy("raw").count()
    # least and greatest skip nulls, so missing values leave before.
    at = F.least(F.lit(bins - 1), F.greatest(F.lit(0), F.col("raw")))
    found = raw.where(F.when(F.col("count") > 0, F.col("raw")).isNotNull()).groupBy(at.alias("bin")).agg(F.sum("count").alias("count"))
    every = spark.range(bins).select(F.col("id").cast("int").alias("bin"))
    return every.join(found, "bin", "left").select(
        "bin", F.coalesce("count", F.lit(0).cast("bigint")).alias("count"),
        half_up(F.lit(lo), STAT_DIGITS).alias("min"), half_up(F.lit(hi), STAT_DIGITS).alias("max"))


def top_values(df: DataFrame, column: str, order: RowOrder | None = None, n: int = TOP_VALUES) -> DataFrame:
    """Most frequent non-blank values; the one seen first wins a tie."""
    tally = value_tally(df, [column], order or RowOrder(), exact=True)
    return tally.filter(_filled()).orderBy(F.col("cnt").desc(), "first", "v").limit(n).select(
        F.col("v").alias("value"), F.col("cnt").alias("count"))


def column_profile(df: DataFrame, column: str, order: RowOrder | None = None, multiplier: float | None = None) -> DataFrame:
    """Deep profile of one column as one row: measures, statistics, outliers, histogram, top values, tips."""
    order, m = order or RowOrder(), clamp_multiplier(multiplier)
    dt = dtype_of(df, column)
    spark = df.sparkSession
    decision = numeric_decision(df, [column]).first()
    tally = value_tally(df, [column], order, exact=True)
    parts = _measures(tally).join(first_values(tally), "ci", "left").join(case_collisions(tally, order), "ci", "left")
    sample = F.transform("sample", lambda s: F.when(F.length(s) > SAMPLE_WIDTH, F.concat(F.substring(s, 1, SAMPLE_WIDTH), F.lit("…"))).otherwise(s))
    text = not is_numeric(dt)
    zero = F.lit(0).cast("bigint")
    base = parts.select(
        F.lit(column).alias("column"), F.lit(dtype_name(dt)).alias("dtype"), F.col("rows").alias("total_rows"), "nulls",
        percent(F.col("nulls"), F.col("rows")).alias("null_pct"), "unique", sample.alias("sample"),
        F.lit(decision.numeric).alias("numeric"), F.lit(decision.coerced).alias("coerced"), F.lit(decision.ratio).alias("ratio"),
        (F.col("whitespace") if text else zero).alias("whitespace"),
        (F.col("case_collisions") if text else zero).alias("case_collisions"),
    )
    stats, outliers, bars, tops = F.lit(None), F.lit(None), F.lit(None), F.lit(None)
    if decision.numeric and decision.parsed:
        found = _summaries(df, [column])
        exact, summary = found[column], _rounded(spark, found).first()
        stats = F.struct(*[F.lit(summary[n]).alias(n) for n in SUMMARY])
        o = outlier_row(df, column, m, [exact["q1"], exact["q3"]])
        outliers = F.struct(*[F.lit(o[n]).alias(n) for n in ("count", "pct", "lower_bound", "upper_bound", "multiplier")])
        counts = [r["count"] for r in histogram(df, column, ends=(exact["min"], exact["max"])).orderBy("bin").collect()]
        bars = F.array(*[F.lit(c).cast("bigint") for c in counts]) if counts else F.lit(None)
    else:
        rows = top_values(df, column, order).collect()
        if rows:
            tops = F.array(*[F.struct(F.lit(r.value).alias("value"), F.lit(r["count"]).cast("bigint").alias("count")) for r in rows])
    full = base.select(
        "*",
        stats.cast("struct<min:double,q1:double,median:double,q3:double,max:double,mean:double,std:double,iqr:double>").alias("stats"),
        outliers.cast("struct<count:bigint,pct:double,lower_bound:double,upper_bound:double,multiplier:double>").alias("outliers"),
        bars.cast("array<bigint>").alias("histogram"),
        tops.cast("array<struct<value:string,count:bigint>>").alias("top_values"),
    )
    return full.withColumn("tips", tips()).drop("ratio")


def outlier_row(df: DataFrame, column: str, multiplier: float, quartiles: list[float] | None = None) -> dict:
    """Outlier count and bounds of the numeric view of any column; its quartiles are found unless given."""
    data = df.select(to_numeric(ref(column), dtype_of(df, column)).alias("x"))
    x = F.col("x")
    b = bounds_from(quartiles or exact_quantiles(data, {"x": x}, (0.25, 0.75))["x"], multiplier)
    outside = F.count(F.when((x < b["lower"]) | (x > b["upper"]), 1))
    row = data.agg(
        outside.alias("count"), percent(outside, F.count(x)).alias("pct"),
        half_up(F.lit(b["lower"]), STAT_DIGITS).alias("lower_bound"), half_up(F.lit(b["upper"]), STAT_DIGITS).alias("upper_bound"),
    ).first()
    return {**row.asDict(), "multiplier": multiplier}


def plain(c: Column) -> Column:
    """Number text without a trailing ``.0``."""
    return F.regexp_replace(c.cast("string"), r"\.0$", "")


def tips() -> Column:
    """Advice lines by threshold, over the fields of a deep profile row."""
    # Thresholds and line formats.
    nulls, out = F.col("null_pct"), F.col("outliers")
    say = [
        F.when(nulls > 20, F.concat(plain(nulls), F.lit("% nulls — consider dropping or imputing.")))
        .when(nulls > 0, F.concat(plain(nulls), F.lit("% nulls — safe to impute."))),
        F.when(out["count"] > 0, F.concat(out["count"].cast("string"), F.lit(" outlier rows outside "), plain(out["multiplier"]), F.lit("× IQR."))),
        F.when(F.col("whitespace") > 0, F.concat(F.col("whitespace").cast("string"), F.lit(" string values have leading/trailing whitespace."))),
        F.when(F.col("case_collisions") > 0, F.concat(F.col("case_collisions").cast("string"), F.lit(" values differ only by casing."))),
        F.when(F.col("coerced"), F.concat(F.lit("Parsed as numeric ("), F.floor(F.col("ratio") * 100 + 0.5).cast("string"), F.lit("% match) — safe to cast to Float64."))),
    ]
    return F.array_compact(F.array(*say))


def dataset_summary(df: DataFrame, order: RowOrder | None = None) -> DataFrame:
    """Rows, columns, numeric and text columns, share of missing cells, duplicates: one row, one shuffle."""
    columns = (order or RowOrder()).data_columns(df)
    numeric = sum(is_numeric(dtype_of(df, c)) for c in columns)
    missing = reduce(lambda a, b: a + b, [ref(c).isNull().cast("bigint") for c in columns])
    return duplicate_count(df, columns, F.sum(missing).alias("missing")).select(
        "rows", F.lit(len(columns)).alias("cols"), F.lit(numeric).alias("numeric_cols"), F.lit(len(columns) - numeric).alias("text_cols"),
        F.col("duplicates").alias("dupes"), percent(F.col("missing"), F.col("rows") * len(columns)).alias("missing_pct"))
