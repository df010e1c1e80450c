"""Merkle manifest against a plain recursive tree."""

import hashlib
import random
import zlib

import pytest

from cleanloom.llm import merkle

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row, add=0):
    out = []
    for c in FIELDS:
        v = row[c]
        if c == "n_chars" and v is not None:
            v += add
        out.append("-" if v is None else f"{len(str(v).encode())}:{v}")
    return h(*out)


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([h(*out[-1][i:i + 2]) for i in range(0, len(out[-1]), 2)])
    return out


def way(tree, i):
    """(sibling or None, whether it comes before) per level."""
    out = []
    for nodes in tree[:-1]:
        j = i ^ 1
        out.append((nodes[j] if j < len(nodes) else None, j < i))
        i //= 2
    return out


def brute(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r["lang"], []).append(r)
    names = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for g in names:
        groups[g].sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r)))
        trees[g] = levels([leaf(r) for r in groups[g]])
    top = levels([trees[g][-1][0] for g in names])
    out = []
    for k, g in enumerate(names):
        for i, r in enumerate(groups[g]):
            steps = way(trees[g], i) + way(top, k)
            hit = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 7 == 0
            acc = leaf(r, 1) if hit else leaf(r)
            for s, before in steps:
                acc = h(acc) if s is None else h(s, acc) if before else h(acc, s)
            root = top[-1][0]
            out.append((r["doc_id"], leaf(r), trees[g][-1][0], root, h(*[s for s, _ in steps if s]), acc, acc == root))
    return sorted(out, key=str)


def table(sizes, seed=1):
    rng = random.Random(seed)
    rows, i = [], 0
    for lang, n in sizes.items():
        for _ in range(n):
            i += rng.randint(1, 3)
            rows.append({"doc_id": i, "source": rng.choice(["a", None, ""]), "lang": lang, "n_chars": rng.choice([None, 5, -3, 2**63 - 1]),
                         "text": rng.choice([None, "", "é" * 3, "x:1-", "long " * 40_000 if n < 3 else "b"]), "tree": "t", "lo": 1, "Digest": 2.5})
    rng.shuffle(rows)
    return rows


SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, tree string, lo int, Digest double"
COLUMNS = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def collected(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=str)


@pytest.mark.parametrize("band,sizes", [(6, {"en": 150, None: 3, "": 2, "fr": 1, "été": 64, "en-": 65}), (2, {"en": 70, "de": 17, "fr": 16, "x": 1})])
def test_equals_brute_force(spark, monkeypatch, band, sizes):
    monkeypatch.setattr(merkle, "BAND", band)
    rows = table(sizes)
    if None in sizes:
        rows += [dict(rows[0]), dict(rows[0]), {**rows[1], "doc_id": None}, {**rows[1], "doc_id": None, "text": "other"}]
    got = merkle.dataset_manifest(spark.createDataFrame(rows, SCHEMA).repartition(3))
    assert got.columns == list(COLUMNS)
    assert collected(got) == brute(rows)


def test_small_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert merkle.dataset_manifest(empty).collect() == []
    one = [{"doc_id": 4, "source": None, "lang": None, "n_chars": None, "text": None, "tree": None, "lo": None, "Digest": None}]
    (row,) = merkle.dataset_manifest(spark.createDataFrame(one, SCHEMA)).collect()
    assert row["leaf"] == row["subroot"] == row["root"] == row["folded_root"] and row["proof_sha256"] == h("") and row["verified"]
    with pytest.raises(ValueError):
        merkle.dataset_manifest(empty, tamper_col="text")


def test_nodes_cover_their_leaves(spark, monkeypatch):
    monkeypatch.setattr(merkle, "BAND", 2)
    names = [h(str(i)) for i in range(21)]
    df = spark.createDataFrame([("t", i, d) for i, d in enumerate(names)] + [("one", 0, names[0]), *[("four", i, names[i]) for i in range(16)]], "tree string, k int, digest string")
    found = merkle.manifest(df, ["k"], ["k"])
    for tree, n in (("t", 21), ("one", 1), ("four", 16)):
        want = [(level, i << level, min(n, (i + 1) << level), d) for level, nodes in enumerate(levels(names[:n])) for i, d in enumerate(nodes)]
        assert sorted(tuple(r)[1:] for r in found.nodes.where(f"tree = '{tree}'").collect()) == sorted(want)
    assert {(r["k"], r["rank"]) for r in found.leaves.where("tree = 't'").collect()} == {(i, i) for i in range(21)}
