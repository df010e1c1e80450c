"""N-gram Jaccard join as a metric-space join: regions around pivots, triangle-inequality windows, exact recursion."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cleanloom.llm.common import SLICE_ROWS, map_rows, ref
from cleanloom.session import stored

# Words in a shingle, and the least similarity of linked documents in hundredths.
WORDS, PERCENT = 3, 90
# Sizes of one ring differ by this factor at most.
RING = 1.25

_A, _B, _C, _D = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93))


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _D
    x = (x ^ (x >> np.uint64(29))) * _A
    return x ^ (x >> np.uint64(32))


def shingles(text: str | bytes | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles. Bytes split and lower-case in ASCII only, as the rules ask."""
    raw = text if isinstance(text, bytes) else (text or "").encode("utf-8", "surrogatepass")
    found = raw.lower().split()
    if not found:
        return np.zeros(0, np.uint64)
    hashed = np.empty(len(found), object)
    hashed[:] = found
    h = pd.util.hash_array(hashed, categorize=False).astype(np.uint64, copy=False)
    size = min(words, len(h))
    total = np.full(len(h) - size + 1, size, np.uint64)
    for k in range(size):
        total = mixed(total * _B + h[k:len(h) - size + 1 + k])
    return np.unique(total)


@lru_cache(maxsize=None)
def ring_start(i: int) -> int:
    """Least set size of ring i; ring 0 starts at 1."""
    return 1 if i == 0 else max(ring_start(i - 1) + 1, math.ceil(RING ** i))


def ring_of(n: int) -> int:
    i = 0
    while ring_start(i + 1) <= n:
        i += 1
    return i


@lru_cache(maxsize=None)
def parts_of(ring: int, percent: int) -> tuple[int, int]:
    """(parts, empty parts allowed) of a ring, for pairs whose smaller set lies in it.

    Linked sets x, y differ in at most (|x| + |y|) * (1 - t) / (1 + t) shingles. With one part more than that, one part is
    equal in both. A few parts more let documents leave out as many empty ones, which say nothing.
    """
    low, high = ring_start(ring), ring_start(ring + 1) - 1
    differ = (high + high * 100 // percent) * (100 - percent) // (100 + percent)
    expected = (differ + 1) * math.exp(-low / (differ + 1))
    spare = math.ceil(expected + 3 * math.sqrt(expected)) if expected >= 0.05 else 0
    return differ + 1 + spare, spare


def region_keys(s: np.ndarray, percent: int) -> np.ndarray:
    """Keys of the regions that a set belongs to: its own size ring, and the ring below if sets there may still link
    (the boundary window). Equal keys mean an equal part of the universe within a ring.

    A set with more empty parts than a ring allows gives keys for those too, so two such sets meet as well.
    """
    n, home, out = len(s), ring_of(len(s)), []
    rings = [home]
    while rings[-1] > 0 and ring_start(rings[-1]) - 1 >= -(-n * percent // 100):
        rings.append(rings[-1] - 1)
    for ring in rings:
        parts, spare = parts_of(ring, percent)
        if parts < 2:
            # Nothing may differ: such sets are equal and already one class.
            continue
        part = (s >> np.uint64(17)) % np.uint64(parts)
        order = np.argsort(part, kind="stable")
        part = part[order]
        first = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
        totals = np.add.reduceat(mixed(s[order] + _C), first)
        seen = part[first]
        if parts - len(seen) > spare:
            empty = np.setdiff1d(np.arange(parts, dtype=np.uint64), seen)
            seen, totals = np.concatenate([seen, empty]), np.concatenate([totals, np.zeros(len(empty), np.uint64)])
        out.append(mixed(totals ^ mixed(seen * _B + np.uint64(ring + 1))))
    return np.concatenate(out).view(np.int64) if out else np.zeros(0, np.int64)


def digest(s: np.ndarray) -> int:
    return int(mixed(mixed(s).sum(keepdims=True, dtype=np.uint64) + np.uint64(len(s))).view(np.int64)[0])


def rows_of(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``doc_id, row, text``; ``row``, the hash of the text, tells rows of one id apart."""
    return df.select(ref(id_col).cast("long").alias("doc_id"), F.xxhash64(ref(text_col)).alias("row"), ref(text_col).alias("text"))


def sketches(source: DataFrame, words: int) -> DataFrame:
    """``doc_id, row, n, set``: size and digest of each document's set."""
    def make():
        def step(ids, rows, texts):
            sets = [shingles(t, words) for t in texts]
            return {"doc_id": ids, "row": rows, "n": [len(s) for s in sets], "set": [digest(s) for s in sets]}

        return step

    return map_rows(source, ["doc_id", "row", "text"], "doc_id long, row long, n long, set long", make)


# Sets whose keys a task remembers to have given; beyond, it forgets and gives them again, which changes no result.
GIVEN = 200_000


def keyed(source: DataFrame, words: int, percent: int) -> DataFrame:
    """``set, key`` for the region keys of every set. A task gives the keys of equal sets once, so a large group of copies
    sends no more rows than there are tasks."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        given: set[int] = set()
        for whole in batches:
            for at in range(0, whole.num_rows, SLICE_ROWS):
                names, keys = [], []
                for text in whole.column(0).slice(at, SLICE_ROWS).to_pylist():
                    s = shingles(text, words)
                    name = digest(s)
                    if len(s) and name not in given:
                        given.add(name)
                        keys.append(region_keys(s, percent))
                        names.append(name)
                if len(given) > GIVEN:
                    given.clear()
                if keys:
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.array(names, np.int64), list(map(len, keys)))), pa.array(np.concatenate(keys))], names=["set", "key"])

    return source.select("text").mapInArrow(run, "set long, key long")


def histogram(s: np.ndarray) -> bytes:
    """Counts of a set's members in 2**k slices of the universe, about half as many slices as members.

    One minus sum(min) / sum(max) of two histograms is a metric too, and never above the Jaccard distance of the sets.
    Adding up the halves of a histogram gives that of half as many slices.
    """
    size = 1 << max(3, (len(s) // 2).bit_length())
    return np.bincount((s & np.uint64(size - 1)).astype(np.int64), minlength=size).astype("<u2").tobytes()


def with_histograms(rows: DataFrame, words: int) -> DataFrame:
    """``set, text, histogram`` of ``set, text``; the whole text goes on compressed, as it meets one partner after another."""
    def make():
        pack = zstandard.ZstdCompressor(level=3).compress
        return lambda sets, texts: {"set": sets, "text": [pack(t.encode("utf-8", "surrogatepass")) for t in texts], "histogram": [histogram(shingles(t, words)) for t in texts]}

    return map_rows(rows, ["set", "text"], "set long, text binary, histogram binary", make)


def close_pairs(points: np.ndarray, label: np.ndarray, limit: float) -> list[tuple[int, int]]:
    """Pairs of rows of different labels whose histograms are within ``limit``: a recursive Voronoi join.

    A few rows become pivots; each row goes to its nearest pivot's region and, since the distance is a metric, to
    every region whose pivot is at most twice the limit farther. Regions that do not shrink are compared row by row.
    """
    def distances(at: np.ndarray, one: int) -> np.ndarray:
        low = np.minimum(points[at], points[one]).sum(1, dtype=np.int64)
        high = np.maximum(points[at], points[one]).sum(1, dtype=np.int64)
        return 1 - low / np.maximum(high, 1)

    found: set[tuple[int, int]] = set()
    todo = [np.arange(len(points))]
    while todo:
        at = todo.pop()
        if len(at) > 32:
            pivots = at[np.linspace(0, len(at) - 1, 8).astype(int)]
            d = np.stack([distances(at, p) for p in pivots], 1)
            inside = d <= d.min(1, keepdims=True) + 2 * limit + 1e-9
            if inside.sum(0).max() <= 0.7 * len(at):
                todo += [at[inside[:, k]] for k in range(len(pivots))]
                continue
        for i in range(len(at) - 1):
            rest = at[i + 1:][label[at[i + 1:]] != label[at[i]]]
            if len(rest):
                for j in rest[distances(rest, at[i]) <= limit + 1e-9].tolist():
                    found.add((min(int(at[i]), j), max(int(at[i]), j)))
    return sorted(found)


# Members that one task compares at once; larger regions are cut into chunks that meet pairwise. Shingles a task keeps.
LEAF, KEPT = 512, 4_000_000


def leaf_links(regions: DataFrame, texts: DataFrame, words: int, percent: int, leaf: int = LEAF) -> DataFrame:
    """Distinct ``a, b``: links between sets of one region (pivot, set, label) that have different labels, enough of them to
    join all labels that links inside the region join.

    A region over ``leaf`` members is dealt into chunks; every two chunks meet in one cell, so no cell holds more than
    about twice ``leaf`` members. Cells go to tasks by hash. Pairs that their histograms do not rule out are compared whole; labels
    once joined are not compared again, so a cell gives fewer links than it has members.
    """
    sizes = regions.groupBy("pivot").agg(F.ceil(F.count("set") / leaf).cast("int").alias("chunks"))
    cells = regions.join(sizes, "pivot").withColumn("chunk", F.pmod(F.xxhash64("set"), F.col("chunks")).cast("int"))
    cells = cells.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    cells = cells.select(F.xxhash64("pivot", F.least("chunk", "other"), F.greatest("chunk", "other")).alias("cell"), "set", "label",
                         "chunk", (F.col("chunk") == F.col("other")).alias("inner"))
    groups = max(1, regions.count() // 1_000)
    cells = cells.join(texts.select("set", "histogram", "text"), "set").withColumn("task", F.pmod("cell", F.lit(groups)))

    def run(f: pd.DataFrame) -> pd.DataFrame:
        opened = zstandard.ZstdDecompressor().decompress
        out: set[tuple[int, int]] = set()
        above: dict[int, int] = {}
        apart: set[tuple[int, int]] = set()
        known: dict[int, np.ndarray] = {}
        held = 0

        def root(x: int) -> int:
            while above.get(x, x) != x:
                above[x] = x = above.get(above[x], above[x])
            return x

        def members(name: int, text: bytes) -> np.ndarray:
            nonlocal held
            if name not in known:
                if held > KEPT:
                    known.clear()
                    held = 0
                known[name] = shingles(opened(text), words)
                held += len(known[name])
            return known[name]

        for rows in f.groupby("cell").indices.values():
            own = f.iloc[rows]
            vectors = [np.frombuffer(h, "<u2").astype(np.uint32) for h in own["histogram"]]
            size = min(map(len, vectors))
            points = np.stack([v.reshape(-1, size).sum(0, dtype=np.uint32) for v in vectors])
            sets, blobs, chunks, inner = own["set"].tolist(), own["text"].tolist(), own["chunk"].tolist(), bool(own["inner"].iloc[0])
            labels = own["label"].tolist()
            for i, j in close_pairs(points, np.array([root(x) for x in labels]), (100 - percent) / 100):
                # A pair inside a chunk is the task of the cell where the chunk meets itself.
                one, two = root(labels[i]), root(labels[j])
                pair = (min(sets[i], sets[j]), max(sets[i], sets[j]))
                if one == two or not inner and chunks[i] == chunks[j] or pair in apart:
                    continue
                x, y = members(sets[i], blobs[i]), members(sets[j], blobs[j])
                same = len(np.intersect1d(x, y, assume_unique=True))
                if 100 * same >= percent * (len(x) + len(y) - same):
                    above[one] = two
                    out.add(pair)
                elif len(apart) < KEPT:
                    apart.add(pair)
        return pd.DataFrame(sorted(out), columns=["a", "b"], dtype=np.int64)

    return cells.groupBy("task").applyInPandas(run, "a long, b long").distinct()


def verified(pairs: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """``a, b, distance, linked`` for pairs of sets: their exact overlap from the whole texts.

    Each side's text comes by a join on its set, so a hot pivot is a skewed join that Spark may split.
    ``distance`` is in hundredths.
    """
    both = pairs.join(texts.select(F.col("set").alias("a"), F.col("text").alias("ta")), "a")
    both = both.join(texts.select(F.col("set").alias("b"), F.col("text").alias("tb")), "b")

    def make():
        opened = zstandard.ZstdDecompressor().decompress
        known, pivot = None, np.zeros(0, np.uint64)

        def step(left, right, ta, tb):
            nonlocal known, pivot
            distance, linked = [], []
            for b, one, two in zip(right, ta, tb):
                if b != known:
                    known, pivot = b, shingles(opened(two), words)
                s = shingles(opened(one), words)
                same = len(np.intersect1d(s, pivot, assume_unique=True))
                union = len(s) + len(pivot) - same
                distance.append(100 - 100 * same / union)
                linked.append(100 * same >= percent * union)
            return {"a": left, "b": right, "distance": distance, "linked": linked}

        return step

    return map_rows(both, ["a", "b", "ta", "tb"], "a long, b long, distance double, linked boolean", make)


def components(edges: DataFrame) -> DataFrame:
    """``node, label`` with the smallest node of each component, by large and small stars; nothing is collected.

    A hub's star is one pre-aggregated minimum, so its size does not matter.
    """
    now = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    now, before = stored(now, "stars"), None
    while True:
        # Large star: every greater neighbour of a node points to the least node around it.
        both = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # Small star: a node and its smaller neighbours point to the least of them.
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = stored(small.union(low.select("u", F.col("m").alias("v"))).distinct(), "stars")
        now, seen = after, after.agg(F.count("u"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if seen == before:
            break
        before = seen
    roots = now.select(F.col("v").alias("node")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("label")).union(roots.select("node", F.col("node").alias("label")))


def join_components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """``doc_id, row, n_shingles, component_id, label`` of every row; ``row`` is the hash of the text, ``label`` the component's own
    name, which tells components apart whose smallest ids are equal because an id occurs with several texts.

    Documents link when ``100 * intersection >= percent * union`` of their sets of word shingles (with fewer words the whole
    sequence is one); the component is the smallest id reachable. Exact, up to equal 64-bit hashes.

    Jaccard distance is a metric, but unrelated texts all lie at distance 1 of each other, so balls around arbitrary pivots
    could not tell them apart. Pivots are therefore found by keys: sets of a size ring (with a window for sets that reach into
    the ring below) that hold an equal part of the universe share a key, linked sets always do, and the smallest set of a key
    is the pivot of its others. Every set is measured against its pivots, and each pivot's ball becomes one component. What
    may still link by the triangle inequality goes on in its pivots' regions; inside, a Voronoi recursion around more pivots in a
    metric of histograms that is never above the Jaccard distance leaves few pairs, and these are compared whole.

    Equal sets are one class from the start. Empty and null texts have no shingles and link with nothing, nor do rows with
    a null id, whose component is null. Repeated rows are equal sets. An empty table gives no rows; other columns are ignored.
    """
    source = rows_of(df, id_col, text_col)
    base = stored(sketches(source, words), "sketches")
    known = base.where(F.col("doc_id").isNotNull() & (F.col("n") > 0))
    # One exchange by key finds the crowded keys, those of two sets or more, and keeps their rows.
    around = Window.partitionBy("key")
    spread = keyed(source.where(F.col("doc_id").isNotNull()), words, percent)
    spread = spread.withColumn("low", F.min("set").over(around)).withColumn("high", F.max("set").over(around))
    regions = stored(spread.where("low < high").select("key", "set").distinct(), "regions")
    active = regions.select("set").distinct()
    # One row stands for each set; its text is fetched once.
    rows = known.select("set", "doc_id", "row").join(active, "set").groupBy("set").agg(F.min(F.struct("doc_id", "row")).alias("r"))
    rows = rows.select("set", F.col("r.doc_id").alias("doc_id"), F.col("r.row").alias("row"))
    once = source.where(F.col("doc_id").isNotNull()).dropDuplicates(["doc_id", "row"])
    texts = stored(with_histograms(once.join(rows, ["doc_id", "row"]).select("set", "text"), words), "texts")
    # First round: every member of a region against its pivot.
    members = regions.join(regions.groupBy("key").agg(F.min("set").alias("pivot")), "key").where("set <> pivot")
    measured = stored(verified(members.select(F.col("set").alias("a"), F.col("pivot").alias("b")).distinct(), texts, words, percent), "measured")
    labels = stored(components(measured.where("linked").select("a", "b")), "labels")
    # Next: all that met one pivot are its region; those that still hold several components go on. Inside the pivot's ball
    # only the rim within reach of the nearest outsider does.
    left = measured.select(F.col("a").alias("set"), F.col("b").alias("pivot"), "distance", "linked")
    left = left.join(labels.select(F.col("node").alias("set"), "label"), "set", "left").withColumn("label", F.coalesce("label", "set"))
    reach = left.where("not linked").groupBy("pivot").agg(F.min("distance").alias("nearest"))
    left = left.join(reach, "pivot").where(~F.col("linked") | (F.col("distance") + (100 - percent) + 1e-9 >= F.col("nearest")))
    several = left.groupBy("pivot").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low < high").select("pivot")
    rest = stored(left.join(several, "pivot").select("pivot", "set", "label"), "regions")
    more = stored(leaf_links(rest, texts, words, percent), "measured")
    # The components found so far are the nodes of the second, small graph.
    named = labels.select(F.col("node"), F.col("label"))
    for side in ("a", "b"):
        more = more.join(named.select(F.col("node").alias(side), F.col("label").alias(f"{side}_label")), side, "left")
    second = components(more.select(F.coalesce("a_label", "a").alias("a"), F.coalesce("b_label", "b").alias("b")))
    classes = known.groupBy("set").agg(F.min("doc_id").alias("least"))
    classes = classes.join(labels.select(F.col("node").alias("set"), "label"), "set", "left").withColumn("first", F.coalesce("label", "set")).drop("label")
    classes = classes.join(second.select(F.col("node").alias("first"), "label"), "first", "left").withColumn("label", F.coalesce("label", "first"))
    named = classes.join(classes.groupBy("label").agg(F.min("least").alias("component")), "label").select("set", "component", "label")
    linkable = known.select("doc_id", "row", "n", "set").join(named, "set").select("doc_id", "row", "n", "component", "label")
    alone = base.where(F.col("doc_id").isNull() | (F.col("n") == 0)).select("doc_id", "row", "n", F.col("doc_id").alias("component"), F.lit(None).cast("long"))
    return linkable.union(alone).select("doc_id", "row", F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), "label")
