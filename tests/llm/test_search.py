"""Ranked search against plain scoring of every document."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from cleanloom.llm import search


def words(text):
    return [t.translate({c: c + 32 for c in range(65, 91)}) for t in re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text or "")]


def brute(docs, items, limit=20):
    held = [(i, Counter(words(t))) for i, t in docs if words(t)]
    n, total = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item, text in set(items):
        scored = []
        for i, c in held:
            size = sum(c.values())
            m = 100 - 25 + (25 * size * n) // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 12 * m)) for t in words(text) if t in c)
            if score > 0:
                scored.append((-score, i is None, i or 0, i))
        out += [(item, r + 1, s[3], -s[0]) for r, s in enumerate(sorted(scored)[:limit])]
    return sorted(out, key=str)


def made(seed, n):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(40)] + ["Été", "日本語", "A1", "x y"]
    weights = [1 / (k + 1) for k in range(len(vocabulary))]
    docs = [(i, " ".join(rng.choices(vocabulary, weights, k=rng.choice([1, 5, 30, 90])))) for i in range(n)]
    docs += [(n, None), (n + 1, ""), (n + 2, "- !! ("), (None, "w39 w38 w37"), (None, "w39 w38 w37"), (3, "w39 w38 w37 w36"), (n + 3, "w1 " * 9_000)]
    docs += [(n + 9 + k, "tie tie") for k in range(45)]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.choice([1, 4, 12])))) for i in range(25)]
    items += [(90, "tie w39"), (91, None), (92, "nowhere"), (93, "W0;w0 TIE"), (93, "W0;w0 TIE"), (94, "x y A1a")]
    return docs, items


@pytest.mark.parametrize("shard,window,block,at_once", [(8192, 1024, 64, 500_000), (70, 16, 4, 500_000), (70, 16, 4, 40)])
def test_equals_brute_force(spark, monkeypatch, shard, window, block, at_once):
    for name, value in (("SHARD_DOCS", shard), ("WINDOW", window), ("BLOCK", block), ("TERMS_AT_ONCE", at_once)):
        monkeypatch.setattr(search, name, value)
    docs, items = made(shard, 300)
    left = spark.createDataFrame([(i, t, "q", 1) for i, t in docs], "doc_id long, text string, query string, score int").repartition(3)
    right = spark.createDataFrame([(i, t, 5) for i, t in items], "item_id long, text string, rank int")
    # Values of the module reach the tasks through the functions that carry them.
    got = search.rank_documents(left, right)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, got.collect()), key=str) == brute(docs, items)


def test_shard_rejects_before_opening():
    """Lists of frequent terms are opened only at the blocks of documents that can still enter the heap."""
    rng = random.Random(5)
    docs = [["the"] * rng.randint(1, 3) + ["pad"] * 30 + (["rare"] * 3 if k in (5, 4_000, 8_000) else []) for k in range(8_192)]
    size = np.array([len(d) for d in docs])
    rows = [(None, np.zeros(len(docs), np.uint8).tobytes(), size.astype("<i8").tobytes(), np.arange(len(docs)).astype("<i8").tobytes())]
    for t in ("the", "rare"):
        at = np.array([k for k, d in enumerate(docs) if t in d])
        rows.append((t.encode(), *search.packed(at, np.array([docs[k].count(t) for k in at]), size)))
    pd = pytest.importorskip("pandas")
    shard = search.Shard(pd.DataFrame(rows, columns=["term", "heads", "peaks", "body"]), {b"the": 3, b"rare": 9_000}, len(docs), int(size.sum()))
    best = shard.top([(b"rare", 1), (b"the", 1)], 3)
    assert {p for _, p in best} == {5, 4_000, 8_000}
    assert len([1 for t, _ in shard.opened if t == b"the"]) < 24


def test_empty_tables(spark):
    docs, items = made(1, 20)
    left, right = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert search.rank_documents(left.limit(0), right).collect() == []
    assert search.rank_documents(left, right.limit(0)).collect() == []
    assert search.rank_documents(left.where("text is null"), right).collect() == []
