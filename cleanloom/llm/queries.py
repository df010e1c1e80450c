"""Registered queries of the training-data operators, with SQL twins where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cleanloom.llm import bpe, decontaminate, html_text, jaccard, language, masked_lm, merkle, pii, quality, search, topk, toxicity, url_filter
from cleanloom.llm.common import in_fold, read

VOCABULARY = "byte_bpe_50k.tiktoken"


def op1_pii(spark: SparkSession, folder: str) -> DataFrame:
    return pii.find_personal_data(read(spark, folder, "documents"))


def op2_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    return url_filter.filter_urls(read(spark, folder, "pages"))


def op3_topk(spark: SparkSession, folder: str) -> DataFrame:
    return topk.top_k(read(spark, folder, "embeddings"))


def op4_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    documents = read(spark, folder, "documents").select("doc_id", "text")
    held = in_fold("doc_id", 5, 0)
    scored = toxicity.score_toxicity(documents, documents.where(~held), read(spark, folder, "labels"))
    return scored.select("doc_id", held.alias("held_out"), "score", "predicted")


def op5_masked_lm(spark: SparkSession, folder: str) -> DataFrame:
    return masked_lm.score_documents(read(spark, folder, "documents"))


def op6_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.find_leaks(read(spark, folder, "documents"), read(spark, folder, "benchmark"))


def op7_language(spark: SparkSession, folder: str) -> DataFrame:
    documents = read(spark, folder, "documents")
    held = in_fold("doc_id", 4, 2)
    found = language.identify(documents, documents.where(~held))
    return found.select("doc_id", held.alias("held_out"), "lang_pred", "score")


def op8_bpe(spark: SparkSession, folder: str) -> DataFrame:
    return bpe.encode(read(spark, folder, "documents"), public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN, digests=True)


def op9_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard.join_components(read(spark, folder, "documents")).select("doc_id", "n_shingles", "component_id")


def op10_html_text(spark: SparkSession, folder: str) -> DataFrame:
    return html_text.extract_text(read(spark, folder, "pages"))


def op11_quality(spark: SparkSession, folder: str) -> DataFrame:
    documents = read(spark, folder, "documents").select("doc_id", "text")
    held = in_fold("doc_id", 5, 0)
    scored = quality.score_quality(documents, documents.where(~held), read(spark, folder, "labels"))
    return scored.select("doc_id", held.alias("held_out"), "score", "predicted")


def op12_merkle(spark: SparkSession, folder: str) -> DataFrame:
    return merkle.dataset_manifest(read(spark, folder, "documents"))


def op13_search(spark: SparkSession, folder: str) -> DataFrame:
    return search.rank_documents(read(spark, folder, "documents"), read(spark, folder, "benchmark"))


def pipeline(spark: SparkSession, folder: str) -> DataFrame:
    import corpus_pipeline
    return corpus_pipeline.run(spark, folder)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_pii, op2_url_filter, op3_topk, op4_toxicity, op5_masked_lm, op6_decontaminate, op7_language, op8_bpe,
                            op9_jaccard_join, op10_html_text, op11_quality, op12_merkle, op13_search, pipeline)}

URL_SQL = r"""
WITH u AS (SELECT page_id, regexp_extract(coalesce(url, ''), '(?s)^.*?://(.*)$', 1) AS rest FROM pages),
h AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
r AS (SELECT *, CASE WHEN suffix(concat('.', host), '.example.net') AND prefix(path, '/en/') THEN 'example.net/en/'
                     WHEN suffix(concat('.', host), '.example.com') AND prefix(path, '/de/') THEN 'example.com/de/'
                     WHEN suffix(concat('.', host), '.org') AND prefix(path, '/fr/') THEN 'org/fr/'
                     WHEN suffix(concat('.', host), '.net') AND prefix(path, '/') THEN 'net/' END AS rule,
             CAST(contains(concat('.', host, path), 'free-bets') AS BIGINT) + CAST(contains(concat('.', host, path), 'casino') AS BIGINT)
             + CAST(contains(concat('.', host, path), '/ads/') AS BIGINT) + CAST(contains(concat('.', host, path), '.onion/') AS BIGINT) AS globs_hit FROM h)
SELECT page_id, host, path, rule, CASE rule WHEN 'net/' THEN 'block' WHEN 'example.net/en/' THEN 'allow' WHEN 'example.com/de/' THEN 'block'
       WHEN 'org/fr/' THEN 'allow' ELSE CASE WHEN globs_hit > 0 THEN 'block' ELSE 'allow' END END AS verdict, globs_hit FROM r
"""

TOPK_SQL = """
WITH v AS (SELECT vec_id, row_number() OVER () AS own, list_transform(embedding, lambda x: floor(x::DOUBLE * 256)) AS e FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.own, q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
      FROM v q JOIN v c ON q.own <> c.own WHERE q.vec_id % 50 = 0),
k AS (SELECT *, CAST(row_number() OVER (PARTITION BY own ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM k WHERE rank <= 5
"""

JACCARD_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
g AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
             ELSE list_distinct(list_transform(range(1, len(ws) - 1), lambda i: concat(ws[i], ' ', ws[i + 1], ' ', ws[i + 2]))) END AS s FROM w),
n AS (SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles FROM g),
e AS (SELECT doc_id, unnest(s) AS sh FROM g),
f AS (SELECT sh, count(*) AS df FROM e GROUP BY sh),
o AS (SELECT doc_id, e.sh, row_number() OVER (PARTITION BY doc_id ORDER BY df, e.sh) AS pos FROM e JOIN f USING (sh)),
p AS (SELECT o.doc_id, sh FROM o JOIN n USING (doc_id) WHERE pos <= n_shingles - ceil(n_shingles * 0.9 - 1e-9) + 1),
c AS (SELECT DISTINCT a.doc_id AS x, b.doc_id AS y FROM p a JOIN p b ON a.sh = b.sh AND a.doc_id < b.doc_id),
l AS (SELECT x, y FROM c JOIN g a ON a.doc_id = x JOIN g b ON b.doc_id = y
      WHERE 100 * len(list_intersect(a.s, b.s)) >= 90 * (len(a.s) + len(b.s) - len(list_intersect(a.s, b.s)))),
z AS (SELECT x AS u, y AS v FROM l UNION ALL SELECT y, x FROM l),
t(doc_id, r) AS (SELECT doc_id, doc_id FROM n UNION SELECT z.v, t.r FROM t JOIN z ON z.u = t.doc_id)
SELECT n.doc_id, n_shingles, CAST(min(t.r) AS BIGINT) AS component_id FROM n JOIN t USING (doc_id) GROUP BY ALL
"""

MERKLE_SQL = r"""
WITH RECURSIVE e AS (SELECT *, CAST(doc_id AS VARCHAR) AS i, CAST(n_chars AS VARCHAR) AS c, CAST(CAST(n_chars AS HUGEINT) + 1 AS VARCHAR) AS c1 FROM documents),
f AS (SELECT doc_id, i, coalesce(concat(strlen(lang), ':', lang), '-') AS tree, lang,
             concat(coalesce(concat(strlen(i), ':', i), '-'), coalesce(concat(strlen(source), ':', source), '-'), coalesce(concat(strlen(lang), ':', lang), '-')) AS head,
             coalesce(concat(strlen(c), ':', c), '-') AS mid, coalesce(concat(strlen(c1), ':', c1), '-') AS mid1, coalesce(concat(strlen(text), ':', text), '-') AS tail FROM e),
-- CRC-32 of the id's decimal digits, bit by bit.
z AS (SELECT *, xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(i, ''), lambda s: ascii(s)::BIGINT)),
                    lambda a, b: list_reduce(list_concat([xor(a, b)], [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295) % 7 = 0 AS hit FROM f),
l AS (SELECT doc_id, tree, lang, sha256(concat(head, mid, tail)) AS leaf, CASE WHEN hit THEN sha256(concat(head, mid1, tail)) END AS bad,
             row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST) - 1 AS r FROM z),
t AS (SELECT tree, 0 AS level, list(leaf ORDER BY r) AS ns FROM l GROUP BY tree
      UNION ALL
      SELECT tree, level + 1, list_transform(range(0, (len(ns) + 1) // 2), lambda k: sha256(concat(ns[2 * k + 1], coalesce(ns[2 * k + 2], '')))) FROM t WHERE len(ns) > 1),
s AS (SELECT tree, ns[1] AS subroot FROM t WHERE len(ns) = 1),
n AS (SELECT DISTINCT tree, lang FROM l),
o AS (SELECT tree, subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS r FROM s JOIN n USING (tree)),
u AS (SELECT 0 AS level, list(subroot ORDER BY r) AS ns FROM o
      UNION ALL
      SELECT level + 1, list_transform(range(0, (len(ns) + 1) // 2), lambda k: sha256(concat(ns[2 * k + 1], coalesce(ns[2 * k + 2], '')))) FROM u WHERE len(ns) > 1),
w AS (SELECT ns[1] AS root FROM u WHERE len(ns) = 1),
p AS (SELECT doc_id, tree, leaf, r, 0 AS level, coalesce(bad, leaf) AS acc, '' AS sibs FROM l
      UNION ALL
      SELECT doc_id, p.tree, leaf, r // 2, p.level + 1, sha256(CASE WHEN r % 2 = 1 THEN concat(ns[r], acc) ELSE concat(acc, coalesce(ns[r + 2], '')) END),
             concat(sibs, CASE WHEN r % 2 = 1 THEN ns[r] ELSE coalesce(ns[r + 2], '') END)
      FROM p JOIN t ON p.tree = t.tree AND p.level = t.level WHERE len(ns) > 1),
p1 AS (SELECT p.* FROM p JOIN t ON p.tree = t.tree AND p.level = t.level WHERE len(ns) = 1),
q AS (SELECT doc_id, p1.tree, leaf, o.r, 0 AS level, acc, sibs FROM p1 JOIN o ON o.tree = p1.tree
      UNION ALL
      SELECT doc_id, tree, leaf, r // 2, q.level + 1, sha256(CASE WHEN r % 2 = 1 THEN concat(ns[r], acc) ELSE concat(acc, coalesce(ns[r + 2], '')) END),
             concat(sibs, CASE WHEN r % 2 = 1 THEN ns[r] ELSE coalesce(ns[r + 2], '') END)
      FROM q JOIN u ON q.level = u.level WHERE len(ns) > 1)
SELECT doc_id, leaf, subroot, root, sha256(sibs) AS proof_sha256, acc AS folded_root, acc = root AS verified
FROM q JOIN u ON q.level = u.level AND len(u.ns) = 1 JOIN s ON s.tree = q.tree CROSS JOIN w
"""

SEARCH_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts
           FROM documents),
n AS (SELECT doc_id, CAST(len(ts) AS BIGINT) AS n, ts FROM d WHERE len(ts) > 0),
c AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS words FROM n),
p AS (SELECT doc_id, n, t, count(*) AS tf FROM (SELECT doc_id, n, unnest(ts) AS t FROM n) GROUP BY ALL),
w AS (SELECT t, CAST(floor(1000 * ln((2 * any_value(docs) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE)) AS BIGINT) AS w FROM p CROSS JOIN c GROUP BY t),
i AS (SELECT item_id, t, count(*) AS times FROM (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM benchmark) GROUP BY ALL),
s AS (SELECT item_id, doc_id, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + (25 * n * docs) // words)))) AS BIGINT) AS score
      FROM i JOIN p USING (t) JOIN w USING (t) CROSS JOIN c GROUP BY ALL),
r AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM s WHERE score > 0)
SELECT * FROM r WHERE rank <= 20
"""

ORACLES = {"op2_url_filter": URL_SQL, "op3_topk": TOPK_SQL, "op9_jaccard_join": JACCARD_SQL, "op12_merkle": MERKLE_SQL,
           "op13_search": SEARCH_SQL}
