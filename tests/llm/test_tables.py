"""URL filter, vector search, registered queries and the pipeline."""

import fnmatch
import random

import duckdb
import pytest

import corpus_pipeline
from cleanloom.llm import queries, topk, url_filter
from tools.check_oracle import tidy

FOLDER = "/root/testdata/sf0.001"


def test_automaton_equals_plain_globs():
    rng = random.Random(3)
    patterns = ["".join(rng.choice("ab*?") for _ in range(rng.randint(0, 9))) for _ in range(60)] + ["*" + "ab" * 60 + "*", "^a*", "^.b/a*"]
    texts = ["".join(rng.choice("ab./") for _ in range(rng.randint(0, 12))) for _ in range(300)] + ["b" + "ab" * 60]
    hit = url_filter.Automaton.build(patterns).match([t.encode() for t in texts])
    for k, p in enumerate(patterns):
        for i, t in enumerate(texts):
            want = any("/" not in t[:j] and fnmatch.fnmatchcase(t[j:], p[1:]) for j in range(len(t) + 1)) if p[:1] == "^" else fnmatch.fnmatchcase(t, p)
            assert hit[i, k] == want, (p, t)


def test_url_edges(spark):
    urls = [None, "", "x", "HTTP://WWW.Example.NET/en/a?b", "http://example.net", "http://net/x", "a://b.org/fr/", "http://Éa.com/free-bets", "x://" + "a" * 5000 + ".net/"]
    df = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)] + [(None, "x://y.net/", "h")], "page_id long, url string, host string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.filter_urls(df).collect()}
    assert got[0] == got[1] == got[2] == ("", "", None, "allow")
    assert got[3] == ("www.example.net", "/en/a", "example.net/en/", "allow") and got[4] == ("example.net", "", None, "allow")
    assert got[5][2:] == ("net/", "block") and got[6][2:] == ("org/fr/", "allow") and got[7][2:] == (None, "block") and got[7][0] == "Éa.com"
    assert got[8][2] == "net/" and got[None][2] == "net/"
    assert url_filter.filter_urls(df.limit(0)).collect() == []


def brute_top(rows, k=5, every=50):
    import math
    good = [(i, [math.floor(256 * x) for x in v]) for i, v in rows
            if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for own, (q, a) in enumerate(good):
        if q % every == 0:
            scored = sorted((-max(-2**63, min(2**63 - 1, sum(x * y for x, y in zip(a, b)))), i) for j, (i, b) in enumerate(good) if j != own)[:k]
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored)]
    return sorted(out)


@pytest.mark.parametrize("scale", [0.2, 3.0, 1e6, 1e17])
def test_search_equals_brute_force(spark, scale):
    rng = random.Random(9)
    rows = [(i, [rng.gauss(0, scale) for _ in range(19)]) for i in range(230)]
    rows += [(400, rows[0][1]), (401, rows[0][1]), (3, rows[3][1]), (402, None), (403, [None] * 19), (404, [float("nan")] * 19), (None, rows[1][1]), (450, [1.0])]
    # Repeated rows of a query (more than k, and two), of a candidate, and two vectors under one query's id.
    rows += [(500, rows[7][1])] * 7 + [(100, rows[100][1])] + [(601, [9 * x for x in rows[100][1]])] * 3 + [(150, rows[9][1])]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, id int")
    for blocks in ({}, {"candidates": 40, "queries": 2}):
        got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in topk.top_k(df, **blocks).collect())
        assert got == brute_top(rows)
    assert topk.top_k(df.limit(0)).collect() == []


def test_search_sql_on_repeated_rows(spark):
    rng = random.Random(4)
    rows = [(i % 60, [rng.gauss(0, 1) for _ in range(6)]) for i in range(130)]
    rows += rows[:4] * 6
    got = sorted(tuple(r) for r in topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect())
    con = duckdb.connect()
    con.execute("CREATE TABLE embeddings (vec_id BIGINT, embedding DOUBLE[])")
    con.executemany("INSERT INTO embeddings VALUES (?, ?)", rows)
    assert got == sorted(con.execute(queries.TOPK_SQL).fetchall())


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, name):
    got = queries.QUERIES[name](spark, FOLDER).toPandas()
    assert len(got)
    sql = queries.ORACLES.get(name)
    if sql:
        con = duckdb.connect()
        for table in ("pages", "embeddings", "documents", "benchmark"):
            con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
        assert tidy(got).equals(tidy(con.execute(sql).df()))


def test_stages_take_effect(spark, tmp_path):
    """Toxic, copied and leaked documents go, clean ones stay, and every stage keeps the columns."""
    words = ["the", "house", "is", "green", "and", "stands", "on", "hill", "near", "water", "with", "trees", "by", "sea"]
    rng = random.Random(12)
    clean = [" ".join(rng.choice(words) for _ in range(60)) for _ in range(120)]
    item = "Seven quiet painters carried their ladders across the frozen square before noon"
    texts = [t + (" stupid moron" if i % 6 == 0 else "") for i, t in enumerate(clean)]
    texts += [clean[1] + " end", clean[2] + f" {item} and {item} yes", clean[3].upper(), None, "", "mail me@home.org or call"]
    # One changed word of fifty is a near copy (41 of 51 shingles of five words), two are not (36 of 56).
    fifty = [f"{chr(97 + i // 8)}{chr(97 + i % 8)}x" for i in range(50)]
    texts += [" ".join("other" if i in changed else w for i, w in enumerate(fifty)) for changed in ((), (25,), (10, 40))]
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i % 6 == 0)) for i in range(100)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        if k < 4:
            assert out.columns == docs.columns and out.dtypes == docs.dtypes
            docs = corpus_pipeline.stored(out, "t")
            kept.append({r[0] for r in docs.select("doc_id").collect()})
    everything = set(range(len(texts)))
    assert everything - kept[0] == {i for i in range(120) if i % 6 == 0}
    assert kept[0] - kept[1] == {120, 122, 127} and kept[1] - kept[2] == {121} and kept[3] == kept[2]
    assert docs.where("doc_id = 125").first()["text"] == "mail [EMAIL] or call"
    final = out.collect()
    assert {r["doc_id"] for r in final} == kept[3] and corpus_pipeline.run(spark, str(tmp_path)).count() == len(final)


def test_near_copies_equal_brute_force(spark):
    """Five words at 0.8: one row of each linked group stays, with repeated rows, null ids and an id with several texts."""
    rng = random.Random(8)
    words = [f"{a}{b}" for a in "abcdefgh" for b in "klmnop"]
    rows = []
    for i in range(40):
        base = [rng.choice(words) for _ in range(rng.choice([1, 3, 12, 60, 200]))]
        rows.append((rng.choice([i, i, None]), " ".join(base)))
        for _ in range(rng.choice([0, 0, 1, 4])):
            near = list(base)
            for _ in range(rng.choice([0, 1, 2, 5])):
                near[rng.randrange(len(near))] = rng.choice(words)
            rows.append((rng.choice([None, i, 100 + len(rows)]), rng.choice([" ", "\n", "  "]).join(near)))
    rows += [rows[0]] * 30 + [(7, None), (7, None), (None, " \t"), (8, "")]
    shingled = [frozenset(tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))) if (w := (t or "").split()) else None for _, t in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if shingled[i] and shingled[j] and 100 * len(shingled[i] & shingled[j]) >= 80 * len(shingled[i] | shingled[j]):
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    groups = {}
    for k, g in enumerate(group):
        if shingled[k]:
            groups.setdefault(g, []).append(rows[k])
    docs = spark.createDataFrame([(i, t, "x", k, 5) for k, (i, t) in enumerate(rows)], "doc_id long, text string, label string, row int, key int").repartition(4)
    got = [(r["doc_id"], r["text"]) for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect()]
    assert sorted([g for g in got if not (g[1] or "").split()], key=str) == sorted([(7, None), (7, None), (None, " \t"), (8, "")], key=str)
    kept = [g for g in got if (g[1] or "").split()]
    assert len(kept) == len(groups)
    for members in groups.values():
        mine = [k for k in kept if k in members]
        ids = [i for i, _ in members if i is not None]
        assert len(mine) == 1 and mine[0][0] == (min(ids) if ids else None)
