"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

# Rows that a task turns into Python values at a time.
SLICE_ROWS = 1_024


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def ref(name: str) -> Column:
    """A column by its exact name, dots and backticks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def kind(df: DataFrame, column: str) -> str:
    return df.schema[column].dataType.simpleString()


def free_name(df: DataFrame, wanted: str) -> str:
    """A column name the table does not have yet, in any case of letters."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


def map_rows(df: DataFrame, columns: list[str], schema: str, make: Callable[[], Callable[..., dict[str, list]]], keep: bool = False) -> DataFrame:
    """Map Arrow batches: ``make`` runs once a task and gives a function of one Python list per named column that
    returns one list, or Arrow array, per field of ``schema``.

    Without ``keep`` only the named columns leave the JVM. With it every column stays and the new ones are appended;
    their names must be free. Batches are worked on in slices of SLICE_ROWS, so only a slice is ever held as Python
    lists. If the function has an attribute ``done``, that is called after the task's last row.
    """
    added = StructType.fromDDL(schema)
    fields = to_arrow_schema(added)
    places = [df.columns.index(c) for c in columns] if keep else list(range(len(columns)))
    # Plain names inside: a name with a dot or a clash is nobody's business here.
    picked = df.toDF(*[f"c{i}" for i in range(len(df.columns))]) if keep else df.select([ref(c).alias(f"c{i}") for i, c in enumerate(columns)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = make()
        for whole in batches:
            for at in range(0, whole.num_rows, SLICE_ROWS):
                batch = whole.slice(at, SLICE_ROWS)
                out = step(*[batch.column(i).to_pylist() for i in places])
                new = [out[f.name].cast(f.type) if isinstance(out[f.name], pa.Array) else pa.array(out[f.name], type=f.type) for f in fields]
                if keep:
                    yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=[*batch.schema.names, *fields.names])
                else:
                    yield pa.RecordBatch.from_arrays(new, schema=fields)
        getattr(step, "done", int)()

    if not keep:
        return picked.mapInArrow(run, added)
    return picked.mapInArrow(run, StructType([*picked.schema.fields, *added.fields])).toDF(*df.columns, *added.names)


def in_fold(column: str, modulus: int, rest: int) -> Column:
    """Whether crc32 of the id's text leaves ``rest``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(ref(column).cast("string"), F.lit(""))) % modulus == rest


def spread_sample(df: DataFrame, rows: int, total: int) -> DataFrame:
    """About ``rows`` of ``total`` rows by a hash of the whole row, the same ones in the same order at every partitioning.

    All rows if there are no more than ``rows``. Rows of one id are drawn each for itself, so a hot or null id is neither
    all in nor all out; equal rows share their fate, and never more than twice ``rows`` are drawn, the first ones by hash.
    """
    draw = F.xxhash64(F.lit("sample"), *[ref(c) for c in df.columns])
    share = int(rows / total * 1_000_000) + 1 if total > rows else 1_000_000
    drawn = df.where(F.pmod(draw, F.lit(1_000_000)) < share)
    return drawn.orderBy(draw, *[F.xxhash64(F.lit("order"), ref(c)) for c in df.columns]).limit(2 * rows)
