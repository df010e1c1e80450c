"""CSV scan with type inference, CSV export, previews."""

from __future__ import annotations

import csv as python_csv
import io
import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from cleanloom.functions.text import FLOAT_TEXT, INGEST_NULLS, INT_TEXT, cast_to, display, is_text, ref
from cleanloom.operators.base import dtype_of
from cleanloom.plans.lookup import BROADCAST_ROWS
from cleanloom.plans.ordering import as_keys

PREVIEW_ROWS = 100
READ_OPTIONS = {"header": "true", "quote": '"', "escape": '"', "mode": "PERMISSIVE"}
# White space around a cell is data and must survive the export.
WRITE_OPTIONS = {
    "header": "true", "quote": '"', "escape": '"', "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false",
}
# Candidate types, narrowest first.
CANDIDATES = ("Int64", "Float64", "Boolean")


def clean_names(names: Sequence[str]) -> list[str]:
    """Trimmed header cells; a blank one becomes ``column_<position>``."""
    out = []
    for i, name in enumerate(names):
        bare = name.strip().lstrip("﻿").strip()
        out.append(f"column_{i + 1}" if bare in ("", f"_c{i}") else bare)
    return out


def scan_text(spark: SparkSession, path: str | Sequence[str], multi_line: bool = False) -> DataFrame:
    """All cells as text, null tokens as null.

    ``multi_line`` allows line breaks inside quotes; the files are still read in splits.
    """
    if multi_line:
        return _cells_of(multi_line_records(spark, path))[0]
    raw = spark.read.options(**READ_OPTIONS).csv(path)
    named = raw.toDF(*clean_names(raw.columns))
    return named.select(*[null_tokens(F.col(f"`{c}`")).alias(c) for c in named.columns])


def multi_line_records(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """``file, record, value``: the records of CSV files whose quoted cells may hold line breaks; record 1 is the header.

    A line begins a record if an even number of quotes stands before it in its file. Quotes are counted per split, one
    row per split is summed up along the file, and inside a split a running sum goes on from there; so no task reads more
    than a split, wherever a record begins. Lines that are records of their own stay where they are; only those of longer
    records are gathered, also across splits. Blank lines between records do not count. A quote that is never closed makes
    the rest of its file one record, as it does for any reader.
    """
    quotes = F.length("value") - F.length(F.replace(F.col("value"), F.lit('"'), F.lit("")))
    lines = spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"),
        F.monotonically_increasing_id().alias("line"), "value", (quotes % 2).alias("odd"))
    earlier = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)

    def carried(parts: DataFrame, name: str) -> DataFrame:
        """Sum over the splits before; one row per split."""
        out = parts.select("file", "split", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias(name))
        return F.broadcast(out) if parts.count() <= BROADCAST_ROWS else out

    opened = carried(lines.groupBy("file", "split").agg(F.sum("odd").alias("n")), "opened")
    inside = Window.partitionBy("file", "split").orderBy("line")
    before = F.coalesce(F.sum("odd").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + F.col("opened")
    marked = lines.join(opened, ["file", "split"]).withColumn("before", before % 2)
    blank = F.col("value").rlike(r"^\s*$")
    marked = marked.where(~((F.col("before") == 0) & blank)).withColumn("begins", (F.col("before") == 0).cast("long"))
    marked = marked.withColumn("begun", F.sum("begins").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    begun = carried(marked.groupBy("file", "split").agg(F.max("begun").alias("n")), "earlier")
    numbered = marked.join(begun, ["file", "split"]).withColumn("record", F.col("begun") + F.col("earlier"))
    whole = (F.col("begins") == 1) & (F.col("odd") == 0)
    pieces = F.transform(F.sort_array(F.collect_list(F.struct("split", "line", "value"))), lambda x: x["value"])
    longer = numbered.where(~whole).groupBy("file", "record").agg(F.array_join(pieces, "\n").alias("value"))
    records = numbered.where(whole).select("file", "record", "value").unionByName(longer)
    return records.withColumn("value", F.regexp_replace("value", r"^\uFEFF|\r$", ""))


def _cells_of(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Text cells of the records, null tokens as null, by the header of the first file; and ``file, record`` beside the cells."""
    heads = records.where("record = 1")
    head = heads.orderBy("file").first()
    names = clean_names(next(python_csv.reader(io.StringIO(head.value, newline="")))) if head else []
    if not names:
        return records.sparkSession.createDataFrame([], T.StructType([])), records.select("file", "record").limit(0)
    schema = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(len(names))])
    options = {k: v for k, v in READ_OPTIONS.items() if k != "header"}
    parsed = F.from_csv("value", schema.simpleString()[7:-1].replace(":", " "), {**options, "multiLine": "true"})
    body = records.where("record > 1").select("file", "record", parsed.alias("cells"))
    cells = body.select("file", "record", *[null_tokens(F.col(f"cells.c{i}")).alias(f"c{i}") for i in range(len(names))])
    return cells.drop("file", "record").toDF(*names), cells


def unique_names(names: Sequence[str]) -> list[str]:
    """A name that stands twice in a header gets a number behind it from its second place on: ``a``, ``a_2``."""
    out: list[str] = []
    for name in names:
        n, free = 1, name
        while free in out or (n > 1 and free in names):
            n += 1
            free = f"{name}_{n}"
        out.append(free)
    return out


def text_by_header(spark: SparkSession, path: str | Sequence[str], row_id: str | None = None) -> DataFrame:
    """All cells as text, each file read by its own header, null tokens as null.

    Headers may differ from file to file in order, in blanks around names, in a byte order mark, and in the columns they
    have; a column absent from a file is null there. Names come in the order of the first file by path, then those that
    only later files have. One pass finds the header of every file; the driver sees distinct headers only. Files with
    nothing but blank lines count as absent.
    """
    lines = spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.struct(F.col("_metadata.file_block_start"), F.monotonically_increasing_id()).alias("at"), "value")
    heads = lines.where(~F.col("value").rlike(r"^\s*$")).groupBy("file").agg(F.min_by("value", "at").alias("head"))
    kinds = heads.groupBy("head").agg(F.min("file").alias("file")).orderBy("file").collect()
    headers = {r["head"]: unique_names(clean_names(next(python_csv.reader([r["head"].lstrip("\ufeff").rstrip("\r")])))) for r in kinds}
    names = list(dict.fromkeys(n for header in headers.values() for n in header))
    if not names:
        return spark.createDataFrame([], T.StructType([]))
    # Place of each name in the cells of a file, counted from 1; 0 where the file lacks it.
    places = [(head, [header.index(n) + 1 if n in header else 0 for n in names]) for head, header in headers.items()]
    of_file = heads.join(spark.createDataFrame(places, "head string, places array<int>"), "head").select("file", "places")
    if heads.count() <= BROADCAST_ROWS:
        of_file = F.broadcast(of_file)
    width = max(map(len, headers.values()))
    cells = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(width)])
    scan = spark.read.options(**READ_OPTIONS).schema(cells).csv(path).select("*", F.col("_metadata.file_path").alias("file"))
    rows = with_file_row_number(scan, "number") if row_id else scan
    found = rows.select("file", *(["number"] if row_id else []), F.array(*cells.names).alias("cells")).join(of_file, "file")
    place = [F.col("places")[i] for i in range(len(names))]
    texts = [null_tokens(F.when(p > 0, F.element_at("cells", F.when(p > 0, p)))).alias(n) for p, n in zip(place, names)]
    return found.select(*([F.col("number").alias(row_id)] if row_id else []), *texts)


def null_tokens(c: Column) -> Column:
    return F.when(~c.isin(INGEST_NULLS), c)


def _fits(c: Column, to: str) -> Column:
    if to == "Boolean":
        return c.isin("true", "false")
    pattern = INT_TEXT if to == "Int64" else FLOAT_TEXT
    return c.rlike(pattern) & cast_to(c, T.StringType(), to).isNotNull()


def infer_types(text: DataFrame, infer_rows: int | None = None) -> DataFrame:
    """(name, dtype): the narrowest type all cells fit, from one pass over all (or the first) rows."""
    columns = text.columns
    seen = text if infer_rows is None else text.limit(infer_rows)
    aggs = []
    for i, c in enumerate(columns):
        col = F.col(f"`{c}`")
        aggs.append(F.count(col).alias(f"n{i}"))
        aggs += [F.count(F.when(_fits(col, to), 1)).alias(f"f{i}_{to}") for to in CANDIDATES]
    one = seen.agg(*aggs)

    def verdict(i: int) -> Column:
        out = F.when(F.col(f"n{i}") == 0, "String")
        for to in CANDIDATES:
            out = out.when(F.col(f"f{i}_{to}") == F.col(f"n{i}"), to)
        return out.otherwise("String")

    return one.select(F.inline(F.array(*[F.struct(F.lit(c).alias("name"), verdict(i).alias("dtype")) for i, c in enumerate(columns)])))


def typed(text: DataFrame, types: dict[str, str]) -> DataFrame:
    """Cast text columns; cells that do not fit become null."""
    return text.select(*[
        (F.col(f"`{c}`") if types[c] == "String" else cast_to(F.col(f"`{c}`"), T.StringType(), types[c])).alias(c) for c in text.columns
    ])


def read_csv(spark: SparkSession, path: str | Sequence[str], multi_line: bool = False, infer_rows: int | None = None,
             row_id: str | None = None, by_header: bool = False) -> DataFrame:
    """Scan, infer and cast; ``row_id`` adds the 0-based row number in file order.

    ``by_header`` reads every file by its own header instead of by that of the first.
    """
    if by_header:
        if multi_line:
            raise ValueError("Files with line breaks inside cells are read by the header of the first one.")
        text = text_by_header(spark, path, row_id)
        data = text.drop(row_id) if row_id else text
        types = {r.name: r.dtype for r in infer_types(data, infer_rows).collect()} if data.columns else {}
        return typed(text, {**types, **({row_id: "String"} if row_id else {})})
    if multi_line:
        text, cells = _cells_of(multi_line_records(spark, path))
    else:
        text = scan_text(spark, path)
    types = {r.name: r.dtype for r in infer_types(text, infer_rows).collect()} if text.columns else {}
    if not row_id or not text.columns:
        return typed(text, types)
    if multi_line:
        # Records are numbered along each file; one row per file puts the files one after another.
        before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
        starts = cells.groupBy("file").agg(F.count(F.lit(1)).alias("n")).select("file", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
        placed = cells.join(starts, "file").select((F.col("start") + F.col("record") - 2).alias("number"), *cells.columns[2:])
        return typed(placed.toDF(row_id, *text.columns), {**types, row_id: "String"})
    numbered = with_file_row_number(spark.read.options(**READ_OPTIONS).csv(path), row_id)
    named = numbered.toDF(row_id, *text.columns)
    body = named.select(row_id, *[null_tokens(F.col(f"`{c}`")).alias(c) for c in text.columns])
    return typed(body, {**types, row_id: "String"})


def with_file_row_number(scan: DataFrame, name: str) -> DataFrame:
    """Row number over the files in path order, without moving a row.

    A scan numbers rows inside each file split; one count per split shifts
    those numbers to their place in the whole.
    """
    split = [F.col("_metadata.file_path").alias("__f"), F.col("_metadata.file_block_start").alias("__b")]
    rows = scan.select(F.monotonically_increasing_id().alias("__m"), *split, *[F.col(f"`{c}`") for c in scan.columns])
    sizes = rows.groupBy("__f", "__b").agg(F.min("__m").alias("__m0"), F.count(F.lit(1)).alias("__n"))
    # One row per file split, far fewer than rows.
    before = Window.orderBy("__f", "__b").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("__f", "__b", "__m0", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__s"))
    if sizes.count() <= BROADCAST_ROWS:
        starts = F.broadcast(starts)
    number = F.col("__s") + F.col("__m") - F.col("__m0")
    return rows.join(starts, ["__f", "__b"]).select(number.alias(name), *[F.col(f"`{c}`") for c in scan.columns])


def write_csv(df: DataFrame, path: str, single_file: bool = False) -> None:
    """Export all rows, by default one file per partition."""
    out = df.coalesce(1) if single_file else df
    out.write.mode("error").options(**WRITE_OPTIONS).csv(path)


def export_name(name: str) -> str:
    """File name of an export: extension dropped, unusual characters replaced."""
    base = re.sub(r"[^A-Za-z0-9_.\-]+", "_", re.sub(r"\.[^.]+$", "", name)) or "dataset"
    return f"cleaned-{base}.csv"


def preview(df: DataFrame, order_by: str | Sequence[str], rows: int = PREVIEW_ROWS) -> DataFrame:
    """First rows in order; fractions at six decimals, times as ISO dates."""
    head = df.orderBy(*map(ref, as_keys(order_by))).limit(rows)

    def cell(c: str) -> Column:
        dt, col = dtype_of(df, c), ref(c)
        if isinstance(dt, (T.FloatType, T.DoubleType, T.DecimalType)):
            return F.round(col.cast("double"), 6)
        if isinstance(dt, (T.DateType, T.TimestampType, T.TimestampNTZType)):
            return F.date_format(col, "yyyy-MM-dd")
        return col if is_text(dt) or not isinstance(dt, (T.ArrayType, T.MapType, T.StructType)) else display(col, dt)

    return head.select(*[cell(c).alias(c) for c in df.columns])
