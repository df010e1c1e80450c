"""Streaming CSV ingest: running counters and a preview, kept in the shared folder beside the checkpoint."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Row, SparkSession, functions as F, types as T

from cleanloom.plans.recipe import FittedRecipe
from cleanloom.session import scratch_path
from cleanloom.sources.csv import PREVIEW_ROWS, READ_OPTIONS, clean_names

COUNTS = "batch bigint, rows bigint, bytes bigint, chunks bigint"


@dataclass
class IngestCounters:
    """Totals over all micro-batches ever written to ``folder``.

    A batch writes the totals up to itself, from those of the batch before: it reads one row, however many batches came
    earlier. Its files are replaced when it is tried again, so a retry or a restart counts nothing twice.
    """

    spark: SparkSession
    header: list[str]
    folder: str

    @property
    def schema(self) -> T.StructType:
        return T.StructType([T.StructField(c, T.StringType()) for c in self.header])

    def _read(self, part: str, schema: str | T.StructType) -> DataFrame:
        return self.spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(f"{self.folder}/{part}")

    def save(self, batch_id: int, batch: DataFrame) -> None:
        """Count one micro-batch with its columns ``cells``, ``file``, ``size``, ``at``, and keep its first rows while the preview is not full."""
        per_file = batch.groupBy("file").agg(F.count(F.lit(1)).alias("n"), F.max("size").alias("z"))
        now = per_file.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.coalesce(F.sum("z"), F.lit(0)).alias("bytes")).first()
        past = self._read(f"counts/{batch_id - 1}", COUNTS).first() if batch_id else Row(rows=0, bytes=0, chunks=0)
        total = [(batch_id, past.rows + now.rows, past.bytes + now.bytes, past.chunks + 1)]
        self.spark.createDataFrame(total, COUNTS).coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/counts/{batch_id}")
        if past.rows < PREVIEW_ROWS:
            first = batch.orderBy("file", "at", F.monotonically_increasing_id()).limit(PREVIEW_ROWS - past.rows)
            numbered = first.select("file", "at", "cells").coalesce(1).select(F.monotonically_increasing_id().alias("n"), "cells")
            numbered.select(F.lit(past.rows).alias("past"), "n", "cells").write.mode("overwrite").parquet(f"{self.folder}/preview/{batch_id}")

    def totals(self) -> Row:
        """Those of the newest batch; zeros before the first."""
        last = F.max_by(F.struct("rows", "bytes", "chunks"), "batch")
        counts = self._read("counts", COUNTS).agg(last.alias("t"))
        return counts.select(*[F.coalesce(f"t.{c}", F.lit(0)).alias(c) for c in ("rows", "bytes", "chunks")]).first()

    @property
    def rows(self) -> int:
        return self.totals().rows

    @property
    def bytes(self) -> int:
        return self.totals().bytes

    @property
    def chunks(self) -> int:
        return self.totals().chunks

    @property
    def preview(self) -> list[tuple]:
        """First rows that arrived, at most PREVIEW_ROWS: batches in turn, each by file and place in it."""
        kept = self._read("preview", self.preview_schema)
        return [tuple(r.cells) for r in kept.orderBy("past", "n").limit(PREVIEW_ROWS).collect()]

    @property
    def preview_schema(self) -> T.StructType:
        return T.StructType([T.StructField("past", T.LongType()), T.StructField("n", T.LongType()), T.StructField("cells", self.schema)])

    def as_frame(self, spark: SparkSession) -> DataFrame:
        t = self.totals()
        row = (t.rows, t.chunks, t.bytes, len(self.header), len(self.preview), ",".join(self.header))
        return spark.createDataFrame([row], "rows bigint, chunks int, bytes bigint, cols int, preview_rows int, header string")


def ingest_csv_stream(spark: SparkSession, folder: str, files_per_batch: int = 1, checkpoint: str | None = None) -> IngestCounters:
    """Count everything that arrives in a folder of CSV files, then stop.

    A later call with the same ``checkpoint`` counts only what is new, and its totals cover both calls.
    """
    names = spark.read.options(**READ_OPTIONS).csv(folder).columns
    checkpoint = (checkpoint or scratch_path(spark, "ingest")).rstrip("/")
    counters = IngestCounters(spark, clean_names(names), f"{checkpoint}-counters")
    # Nothing may have arrived yet: an empty table makes the folders readable.
    for part, schema in (("counts", COUNTS), ("preview", counters.preview_schema)):
        spark.createDataFrame([], schema).write.mode("overwrite").parquet(f"{counters.folder}/{part}/none")
    stream = (
        spark.readStream.options(**READ_OPTIONS).option("maxFilesPerTrigger", files_per_batch).schema(counters.schema).csv(folder)
        .select(F.struct("*").alias("cells"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("size"),
                F.col("_metadata.file_block_start").alias("at"))
    )
    query = (
        stream.writeStream.foreachBatch(lambda batch, batch_id: counters.save(batch_id, batch)).trigger(availableNow=True)
        .option("checkpointLocation", checkpoint).start()
    )
    query.awaitTermination()
    return counters


def replay_stream(stream: DataFrame, fitted: FittedRecipe, out: str, checkpoint: str) -> None:
    """Clean a stream with already learned numbers and append the result as Parquet."""
    cleaned = fitted.transform(stream)
    query = cleaned.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
