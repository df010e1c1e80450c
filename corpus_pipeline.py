"""A corpus pipeline: toxicity, near copies, benchmark leaks, personal data, tokens. Each stage reads what the one before kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cleanloom.llm import bpe, decontaminate, jaccard, pii, toxicity
from cleanloom.llm.common import free_name, read, ref
from cleanloom.session import stored

VOCABULARY = "byte_bpe_50k.tiktoken"
# Near copies share 80 of 100 shingles of five words.
WORDS, PERCENT = 5, 80


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below one half. Every labelled document of ``docs`` may train."""
    model = toxicity.fit(docs, docs, read(spark, sf_dir, "labels"), "doc_id", "text", "toxic")
    scored, name = toxicity.with_score(docs, model)
    return scored.where(ref(name) < 0.5).select([ref(c) for c in docs.columns])


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each linked group: the smallest id, of several texts under it the smallest hash, of repeated rows any one.

    A null id comes after all others and is told from other null ids by its text. Rows without words are linked with
    nothing and all stay.
    """
    number, row = free_name(docs, "number"), free_name(docs, "row_hash")
    late = F.lit(1 << 62) + F.shiftrightunsigned(F.xxhash64("text"), 2)
    worded = F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    keyed = docs.withColumn(number, F.coalesce(F.col("doc_id").cast("long"), late)).withColumn(row, F.xxhash64("text")).where(worded)
    found = jaccard.join_components(keyed, id_col=number, words=WORDS, percent=PERCENT)
    # Also a hot row that is repeated many times is folded before it moves.
    once = keyed.dropDuplicates([number, row])
    first = found.where("label is not null").groupBy("label").agg(F.min(F.struct("doc_id", "row")).alias("kept")).select("kept.*").distinct()
    stays = (once[number] == first["doc_id"]) & (once[row] == first["row"])
    return once.join(first, stays, "left_semi").select([ref(c) for c in docs.columns]).union(docs.where(~worded))


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item within its error budget."""
    marked, name = decontaminate.with_matches(docs, read(spark, sf_dir, "benchmark"))
    return marked.where(F.size(ref(name)) == 0).select([ref(c) for c in docs.columns])


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data in their texts replaced by marks."""
    masked = pii.mask_personal_data(docs)
    if "n_chars" not in docs.columns:
        return masked
    return masked.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select([ref(c) for c in docs.columns])


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the documents that are left, in place of their texts."""
    return bpe.encode(docs, public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN, digests=True)


STAGES = [("toxicity", drop_toxic), ("jaccard", drop_near_copies), ("decontaminate", drop_leaks), ("pii", mask_personal_data), ("bpe", tokenize)]

# Trained scores, edit distances and a random field are beyond SQL; the stages are tested against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = stored(docs, f"stage-{name}")
    return docs
