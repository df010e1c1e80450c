"""Compression classifier: held-out accuracy, plain sizes, degenerate tables."""

import random

import pytest
import zstandard

from cleanloom.llm import quality


def made(n, seed=2):
    rng = random.Random(seed)
    good = ["river", "stone", "garden", "window", "morning", "under", "letter", "quiet", "the", "and", "of"]
    bad = ["click", "BUY", "now!!", "free%%%", "win$$$", "###", "offer", "cheap"]
    rows = []
    for i in range(n):
        y = int(rng.random() < 0.7)
        rows.append((i, " ".join(rng.choice(good if y or rng.random() < 0.2 else bad) for _ in range(rng.choice([20, 60, 400]))), y))
    return rows


def test_held_out_accuracy(spark):
    rows = made(400)
    docs = spark.createDataFrame([(i, t, "s", 1.0) for i, t, _ in rows] + [(None, rows[0][1], "s", 1.0), (900, None, "s", 1.0), (901, "", "s", 1.0), (902, "stone " * 60_000, "s", 1.0)],
                                 "doc_id long, text string, quality string, score double").repartition(3)
    labels = spark.createDataFrame([(i, y) for i, _, y in rows if i % 5] + [(1, 0), (None, 1), (901, None)], "doc_id long, quality int")
    got = quality.score_quality(docs, docs.where("doc_id % 5 <> 0"), labels)
    assert got.columns == ["doc_id", "score", "predicted"]
    found = {r["doc_id"]: r for r in got.collect()}
    assert len(found) == 404 and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in found.values())
    held = [(found[i]["predicted"], y) for i, _, y in rows if i % 5 == 0]
    assert sum(a == b for a, b in held) >= 0.95 * len(held)
    assert found[900]["score"] == found[901]["score"] and found[902]["predicted"] == 1 and found[None]["score"] == found[0]["score"]
    again = {r["doc_id"]: r["score"] for r in quality.score_quality(docs.repartition(7), docs.where("doc_id % 5 <> 0"), labels).collect()}
    assert again == {i: r["score"] for i, r in found.items()}


def test_difference_is_that_of_the_sizes():
    rows = made(300, 4)
    samples = [[p for _, t, y in rows if y == k for p in quality.pieces(t)] for k in (0, 1)]
    judge = quality.Judge(quality.dictionary(samples[1]), quality.dictionary(samples[0]))
    text = "é" + "river stone free%%% " * 150
    raw, sizes = text.encode(), []
    for data in (judge.good, judge.bad):
        tool = zstandard.ZstdCompressor(level=quality.LEVEL, dict_data=zstandard.ZstdCompressionDict(data), write_content_size=False, write_checksum=False, write_dict_id=False)
        sizes.append(sum(len(tool.compress(raw[at:at + quality.WINDOW_BYTES])) for at in range(0, len(raw), quality.WINDOW_BYTES)))
    assert judge.measure(text)[:2] == pytest.approx(((sizes[1] - sizes[0]) / sum(sizes), sum(sizes) / 2 / len(raw)), rel=1e-2)
    assert b"".join(quality.pieces("abc")) == b"abc" and quality.pieces(None) == quality.pieces("") == []
    assert [len(p) for p in quality.pieces("x" * 50_000)] == [quality.PIECE_BYTES] * quality.PIECES_EACH


def test_without_both_classes(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None), (2, "c")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert [r["score"] for r in quality.score_quality(docs, docs, none).collect()] == [0.5] * 3
    ones = spark.createDataFrame([(1, 1), (2, 1), (7, 0)], "doc_id long, quality int")
    assert len({r["score"] for r in quality.score_quality(docs, docs, ones).collect()}) == 1
    assert quality.score_quality(docs.limit(0), docs.limit(0), ones).collect() == []
