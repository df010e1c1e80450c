"""Ranked lexical search: a sharded index of compressed blocks, searched by Block-Max MaxScore; shard heaps are merged."""

from __future__ import annotations

import math
from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cleanloom.llm.common import ref
from cleanloom.session import stored

# Documents and postings that a shard holds at most (one document may go beyond the second), postings of a block.
SHARD_DOCS, SHARD_POSTINGS, BLOCK = 8_192, 2_000_000, 64
# Documents scored at a time; after each window the lists are parted anew.
WINDOW = 1_024
# Distinct terms that a task filters by; items are taken in blocks of at most so many terms.
TERMS_AT_ONCE = 500_000
# Postings of one shard that a task keeps decompressed.
OPENED = 4_000_000

# Bytes that stand in no term become blanks, A-Z become a-z; all bytes of non-ASCII letters stay.
_TABLE = bytes(c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))


def terms(text: bytes | None) -> list[bytes]:
    """Terms of a whole text in UTF-8: maximal runs of ASCII letters, digits and anything beyond ASCII."""
    return text.translate(_TABLE).split() if text else []


def narrow(values: np.ndarray) -> np.ndarray:
    """The same numbers in the narrowest unsigned type."""
    top = int(values.max()) if len(values) else 0
    return values.astype(np.uint8 if top < 1 << 8 else np.uint16 if top < 1 << 16 else np.uint32)


def peaks(tf: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Pairs (tf, length) that no other pair of the block beats with as many occurrences in as short a document.

    The largest score of a block is that of one of them, whatever the corpus' average length turns out to be.
    """
    order = np.lexsort((length, -tf.astype(np.int64)))
    shortest = np.minimum.accumulate(length[order])
    best = order[np.concatenate([[True], shortest[1:] < shortest[:-1]])]
    return np.stack([tf[best], length[best]], 1)


def packed(at: np.ndarray, tf: np.ndarray, lengths: np.ndarray) -> tuple[bytes, bytes, bytes]:
    """Heads, peaks and body of a list: ``at`` are ascending places of documents in the shard.

    A head is first place, last place, postings, width of gaps, width of counts, offset of the body, peaks.
    """
    heads, tops, body, offset = [], [], [], 0
    for a in range(0, len(at), BLOCK):
        place, count = at[a:a + BLOCK], tf[a:a + BLOCK]
        gaps, counts = narrow(np.diff(place)), narrow(count)
        best = peaks(count, lengths[place])
        heads.append((place[0], place[-1], len(place), gaps.itemsize, counts.itemsize, offset, len(best)))
        tops.append(best)
        raw = gaps.tobytes() + counts.tobytes()
        offset += len(raw)
        body.append(raw)
    return np.array(heads, "<u4").tobytes(), np.concatenate(tops).astype("<u4").tobytes(), b"".join(body)


def index(docs: DataFrame, wanted: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``shard, term, df, words, heads, peaks, body`` of all documents: one row per shard and term, and one with a null term per shard.

    Each task cuts its documents into shards of bounded size. The row without term holds the ids and lengths of the
    shard's documents that hold a term at all, by ascending id, and the sum of their lengths in ``words``. ``wanted`` (term),
    at most TERMS_AT_ONCE of them, leaves out the lists of all other terms; lengths count every term. Null ids come last in
    their shard.
    """
    spark = docs.sparkSession
    few = None if wanted is None else spark.sparkContext.broadcast(frozenset(bytes(r[0]) for r in wanted.distinct().toLocalIterator()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep, part, made = None if few is None else few.value, TaskContext.get().partitionId(), 0
        ids: list[int | None] = []
        lengths: list[int] = []
        # Per term its documents, by arrival, and how often each holds it.
        lists: dict[bytes, array] = {}
        postings = 0

        def shard() -> Iterator[pa.RecordBatch]:
            order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0))
            place = np.empty(len(ids), np.int64)
            place[order] = np.arange(len(ids))
            size = np.array(lengths, np.int64)[order]
            name = (part << 33) + made
            own = [ids[i] for i in order]
            nulls = np.array([i is None for i in own], np.uint8)
            rows = [(None, len(own), int(size.sum()), nulls.tobytes(), size.astype("<i8").tobytes(), np.array([i or 0 for i in own], "<i8").tobytes())]
            for t, flat in lists.items():
                pair = np.frombuffer(flat, np.uint32).reshape(-1, 2)
                at = place[pair[:, 0]]
                by = np.argsort(at)
                rows.append((t, len(pair), None, *packed(at[by], pair[by, 1], size)))
                if len(rows) >= 10_000:
                    yield table(name, rows)
                    rows = []
            yield table(name, rows)

        def table(name: int, rows: list[tuple]) -> pa.RecordBatch:
            columns = [pa.array([name] * len(rows), pa.int64()), pa.array([r[0] for r in rows], pa.binary()),
                       *[pa.array([r[k] for r in rows], pa.int64()) for k in (1, 2)], *[pa.array([r[k] for r in rows], pa.binary()) for k in (3, 4, 5)]]
            return pa.RecordBatch.from_arrays(columns, names=["shard", "term", "df", "words", "heads", "peaks", "body"])

        for batch in batches:
            for i in range(batch.num_rows):
                found = terms(batch.column(1)[i].as_py())
                if not found:
                    continue
                counts = Counter(found)
                held = counts.keys() if keep is None else counts.keys() & keep
                for t in held:
                    own = lists.get(t)
                    if own is None:
                        own = lists[t] = array("I")
                    own.append(len(ids))
                    own.append(counts[t])
                ids.append(batch.column(0)[i].as_py())
                lengths.append(len(found))
                postings += len(held)
                if len(ids) >= SHARD_DOCS or postings >= SHARD_POSTINGS:
                    yield from shard()
                    made, postings = made + 1, 0
                    ids, lengths, lists = [], [], {}
        if ids:
            yield from shard()

    source = docs.select(ref(id_col).cast("long").alias("id"), ref(text_col).cast("binary").alias("text"))
    return source.mapInArrow(run, "shard long, term binary, df long, words long, heads binary, peaks binary, body binary")


class Shard:
    """One shard of the index, opened for search."""

    def __init__(self, rows: pd.DataFrame, weights: dict[bytes, int], documents: int, words: int):
        self.lists, self.opened, self.held = {}, {}, 0
        self.documents, self.words, self.weights = documents, words, weights
        for term, heads, tops, body in zip(rows["term"], rows["heads"], rows["peaks"], rows["body"]):
            if term is None:
                self.length = np.frombuffer(tops, "<i8")
                self.ids, self.none = np.frombuffer(body, "<i8"), np.frombuffer(heads, np.uint8).astype(bool)
                self.norm = self.norms(self.length)
            else:
                self.lists[bytes(term)] = (np.frombuffer(heads, "<u4").reshape(-1, 7).astype(np.int64), np.frombuffer(tops, "<u4").reshape(-1, 2).astype(np.int64), bytes(body))
        self.bounds = {t: self.block_bounds(*entry[:2]) for t, entry in self.lists.items()}

    def norms(self, length: np.ndarray) -> np.ndarray:
        return 12 * (100 - 25 + (25 * length.astype(np.int64) * self.documents) // self.words)

    def block_bounds(self, heads: np.ndarray, tops: np.ndarray) -> np.ndarray:
        """Largest impact of each block, exact: that of one of its peaks."""
        impact = (1_000_000_000 * tops[:, 0]) // (1_000 * tops[:, 0] + self.norms(tops[:, 1]))
        return np.maximum.reduceat(impact, np.concatenate([[0], np.cumsum(heads[:-1, 6])]))

    def block(self, term: bytes, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and impacts of one block, decompressed."""
        got = self.opened.get((term, k))
        if got is None:
            heads, _, body = self.lists[term]
            first, _, n, gap, width, offset, _ = heads[k].tolist()
            place = np.empty(n, np.int64)
            place[0] = first
            np.cumsum(np.frombuffer(body, f"<u{gap}", n - 1, offset), out=place[1:])
            place[1:] += first
            tf = np.frombuffer(body, f"<u{width}", n, offset + (n - 1) * gap).astype(np.int64)
            got = place, (1_000_000_000 * tf) // (1_000 * tf + self.norm[place])
            if self.held > OPENED:
                self.opened.clear()
                self.held = 0
            self.opened[term, k] = got
            self.held += n
        return got

    def add(self, score: np.ndarray, term: bytes, factor: int, start: int, blocks: np.ndarray) -> None:
        """Add the impacts of some blocks of a list to the scores of the window that begins at place ``start``."""
        for k in blocks.tolist():
            place, impact = self.block(term, k)
            a, b = np.searchsorted(place, (start, start + len(score)))
            score[place[a:b] - start] += factor * impact[a:b]

    def top(self, query: list[tuple[bytes, int]], limit: int) -> list[tuple[int, int]]:
        """(score, place) of the ``limit`` best documents, best first, equal scores by place.

        Lists stand by ascending global bound. As long as the bounds of the first lists together do not beat the heap's
        least score, these are not essential: a document that is in none of the others cannot enter the heap. Documents go
        by ascending place, so an equal score comes too late.
        """
        found = []
        for term, times in query:
            factor = times * self.weights.get(term, 0)
            if term in self.lists and factor:
                found.append((factor * int(self.bounds[term].max()), term, factor))
        found.sort()
        reach = np.cumsum([b for b, _, _ in found]).tolist()
        heads = {t: self.lists[t][0] for _, t, _ in found}
        heap: list[tuple[int, int]] = []
        least, first = 0, 0
        for start in range(0, len(self.length), WINDOW):
            if len(heap) == limit:
                least = -heap[-1][0]
                while first < len(found) and reach[first] <= least:
                    first += 1
            if first == len(found):
                break
            stop = min(start + WINDOW, len(self.length))
            score = np.zeros(stop - start, np.int64)
            for _, term, factor in found[first:]:
                a, b = self.span(heads[term], start, stop)
                self.add(score, term, factor, start, np.arange(a, b))
            at = np.flatnonzero(score)
            if first:
                # What the other lists can add at most: all their bounds, or the bounds of the blocks that a candidate lies in.
                at = at[score[at] + reach[first - 1] > least]
                where, most = np.full((first, len(at)), -1), np.zeros((first, len(at)), np.int64)
                for j, (_, term, factor) in enumerate(found[:first] if len(at) else []):
                    k = np.searchsorted(heads[term][:, 1], at + start)
                    inside = k < len(heads[term])
                    inside[inside] = heads[term][k[inside], 0] <= at[inside] + start
                    where[j, inside], most[j, inside] = k[inside], factor * self.bounds[term][k[inside]]
                most = most.cumsum(0)
                for j in range(first - 1, -1, -1):
                    keep = score[at] + most[j] > least
                    at, where, most = at[keep], where[:, keep], most[:, keep]
                    if not len(at):
                        break
                    _, term, factor = found[j]
                    blocks = np.unique(where[j])
                    exact = np.zeros(len(score), np.int64)
                    self.add(exact, term, factor, start, blocks[blocks >= 0])
                    score[at] += exact[at]
            at = at[score[at] > least]
            if len(at):
                heap += [(-int(s), int(p) + start) for s, p in zip(score[at], at)]
                heap = sorted(heap)[:limit]
        return [(-s, p) for s, p in heap]

    @staticmethod
    def span(heads: np.ndarray, start: int, stop: int) -> tuple[int, int]:
        """Blocks that touch the places from start to stop - 1."""
        return int(np.searchsorted(heads[:, 1], start)), int(np.searchsorted(heads[:, 0], stop))


def search(lists: DataFrame, queries: DataFrame, limit: int = 20) -> DataFrame:
    """``query, rank, doc_id, score``: the ``limit`` best documents of a stored ``index`` for each row of ``queries`` (query, terms).

    N, L and every df are summed over all shards. Each shard is searched by itself with a heap per query; only the heaps are
    shuffled and merged. The queries and their terms' weights go to every task: ``rank_documents`` bounds them.
    """
    spark = lists.sparkSession
    documents, words = lists.where("term is null").agg(F.sum("df"), F.sum("words")).first()
    asked = [(r["query"], sorted(Counter(map(bytes, r["terms"])).items())) for r in queries.toLocalIterator()]
    used = queries.select(F.explode("terms").alias("term")).distinct()
    lists = lists.join(F.broadcast(used), "term", "left_semi").unionByName(lists.where("term is null"))
    counts = lists.where("term is not null").groupBy("term").agg(F.sum("df").alias("df"))
    weights = {bytes(r["term"]): math.floor(1000 * math.log((2 * documents + 2) / (2 * r["df"] + 1))) for r in counts.toLocalIterator()}
    shared = spark.sparkContext.broadcast((asked, weights))

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        asked, weights = shared.value
        shard = Shard(rows, weights, documents, words)
        out = [(query, None if shard.none[p] else int(shard.ids[p]), s) for query, found in asked for s, p in shard.top(found, limit)]
        return pd.DataFrame({name: pd.array([o[k] for o in out], "Int64") for k, name in enumerate(("query", "doc_id", "score"))})

    heaps = lists.groupBy("shard").applyInPandas(run, "query long, doc_id long, score long")
    best = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return heaps.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= limit).select("query", "rank", "doc_id", "score")


def rank_documents(docs: DataFrame, items: DataFrame, limit: int = 20, id_col: str = "doc_id", item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """``item, rank, id, score``: the ``limit`` best documents with a score above 0 for each item, best first, ties by smaller id.

    Terms are runs of ASCII letters, digits and characters beyond ASCII, A-Z lowered. Weights, lengths and scores are whole numbers as
    stated at ``search`` and in ``Shard``, so every partitioning gives the same rows. Items beyond TERMS_AT_ONCE terms are searched
    in blocks over an index of all terms; fewer need only the lists of their own terms.

    Null and empty texts hold no term: such documents do not count, such items find nothing. Every row of ``docs`` is a
    document of its own; null ids come after all others. Equal rows of ``items`` are one item, different texts of one item id
    are searched and ranked each by itself. Empty tables give no rows; other columns are ignored.
    """
    asked = items.select(ref(item_col).alias("item"), ref(text_col).alias("text")).distinct()
    asked = asked.select("item", F.col("text").cast("binary").alias("text"), F.monotonically_increasing_id().alias("query"))

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = pa.array([terms(t) for t in b.column(1).to_pylist()], pa.list_(pa.binary()))
            yield pa.RecordBatch.from_arrays([b.column(0), found], names=["query", "terms"])

    named = stored(asked, "search-items")
    queries = stored(named.select("query", "text").mapInArrow(split, "query long, terms array<binary>").where(F.size("terms") > 0), "search-queries")
    asked_terms = queries.agg(F.sum(F.size("terms"))).first()[0] or 0
    blocks = max(1, -(-asked_terms // TERMS_AT_ONCE))
    wanted = queries.select(F.explode("terms").alias("term")) if blocks == 1 else None
    lists = stored(index(docs, wanted, id_col, text_col), "search-index")
    found = None
    for k in range(blocks):
        part = search(lists, queries.where(F.pmod(F.xxhash64("query"), F.lit(blocks)) == k), limit)
        found = part if found is None else found.unionByName(part)
    return found.join(F.broadcast(named.select("query", "item")) if blocks == 1 else named.select("query", "item"), "query").select(
        F.col("item").alias(item_col), F.col("rank"), F.col("doc_id").alias(id_col), F.col("score"))
