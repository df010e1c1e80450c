"""Operators on texts: edge rows, brute force and round trips."""

import hashlib
import math
import random
import re

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from cleanloom.llm import bpe, decontaminate, html_text, jaccard, language, masked_lm, pii, toxicity
from cleanloom.llm.common import spread_sample

@pytest.fixture
def docs(spark):
    """Rows of (doc_id, text) with odd column names beside them that operators might use themselves."""
    def make(rows):
        schema = "doc_id long, text string, set long, `key` string, matches int, `a.b` string, masked string, toxicity int"
        return spark.createDataFrame([(*r, 1, "k", 2, "x", None, 3) for r in rows], schema)

    return make


EDGES = [(1, None), (2, ""), (2, ""), (None, "word"), (3, "a" * 200_000), (4, "the same words here again and more"), (5, "the same words here again and more")]

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


def by_id(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: (r[0] is None, r))


# --- personal data ---------------------------------------------------------------------------------------------------

def plain_spans(text):
    """The contract's patterns as written."""
    out = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append((m.start(), 0, m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m.group().split(".")):
            out.append((m.start(), 1, m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m.group())
        if 12 <= len(digits) <= 19 and sum(sum(divmod(2 * int(c), 10)) if i % 2 else int(c) for i, c in enumerate(reversed(digits))) % 10 == 0:
            out.append((m.start(), 2, m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= len(re.findall("[0-9]", m.group())) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


def test_base_spans_equal_plain_patterns():
    rng = random.Random(5)
    bits = ["a", "b@c.d", "@", ".", "x.y@z", "1.2.3.4", "256.1.1.1", "4111 1111 1111 1111", "+1 (262) 555-3752", "+", " ", "-", "9", "0", "00012.1.1.1", "é", "12", "\n", "(", ")"]
    for _ in range(4000):
        text = "".join(rng.choice(bits) for _ in range(rng.randint(0, 14)))
        assert pii.base_spans(text) == plain_spans(text), text


def test_short_forms_follow_a_full_number(docs):
    full = [(i, f"call me at +1 (26{i % 10}) 55{i % 10}-375{i % 10} now or a{i}@mail.example.com and 10.0.{i}.7 then") for i in range(200)]
    text = "write to +12625553752 today and later 2625553752 again while the version 4.0 stays"
    got = {r["doc_id"]: r for r in pii.find_personal_data(docs([*full, (900, text)])).collect()}
    assert got[900]["n_phone"] == 1 and got[900]["spans"].split(",")[0] == "phone:9:21"
    assert f"phone:{text.index('2625553752', 25)}:{text.index(' again')}" in got[900]["spans"].split(",")
    assert "4.0" not in [text[int(a):int(b)] for a, b in (s.split(":")[1:] for s in got[900]["spans"].split(","))]


def test_personal_data_edges(docs):
    rows = by_id(pii.find_personal_data(docs(EDGES)))
    assert len(rows) == len(EDGES) and all(r[5] == hashlib.sha256(b"").hexdigest() for r in rows)
    assert pii.find_personal_data(docs([])).collect() == []
    masked = pii.mask_personal_data(docs([(1, "mail x@y.org now"), (2, None)]))
    assert masked.columns == docs([]).columns
    assert [r["text"] for r in masked.orderBy("doc_id").collect()] == ["mail [EMAIL] now", None]


# --- toxicity ----------------------------------------------------------------------------------------------------------

@pytest.fixture(scope="module")
def toxic(spark):
    rng = random.Random(1)
    words = ["the", "house", "is", "green", "and", "stands", "on", "a", "hill", "near", "water", "with", "trees", "stupid", "moron"]
    rows = [(i, " ".join(rng.choice(words[:13]) for _ in range(30)) + (" stupid" if i % 8 == 0 else " moron" if i % 8 == 1 else "")) for i in range(400)]
    documents = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 8 < 2)) for i in range(400)] + [(None, 1), (7, None), (3, 0)], "doc_id long, toxic int")
    return documents, labels


def test_disguised_words_are_restored_and_scored(toxic, docs):
    documents, labels = toxic
    model = toxicity.fit(documents, documents, labels, "doc_id", "text", "toxic")
    for written in ("5tup1d", "s t u p i d", "st*up*id", "stuuupid", "m.o.r.o.n", "m0r0n", "STUPID!!!"):
        assert model.score(f"the house is {written} and green") > 0.5, written
        assert model.channel.restored_text(f"house {written}").split()[1] in ("stupid", "moron")
    assert model.score("the house is green### and stands*** on a hill") < 0.5
    got = toxicity.score_toxicity(docs(EDGES), documents, labels).collect()
    assert len(got) == len(EDGES) and all(0 <= r["score"] <= 1 and r["predicted"] == 0 for r in got)
    assert toxicity.score_toxicity(docs([]), documents.limit(0), labels.limit(0)).collect() == []


def test_decoder_equals_brute_force(toxic):
    """Viterbi against all paths of the lattice."""
    channel = toxicity.Channel.of(toxicity.letter_counts(toxic[0], "text"))

    def every(token, state, last):
        if not token:
            yield channel.log[state][0], ""
            return
        c, rest = token[0], token[1:]
        own = toxicity.STATE.get(c)
        for to, price, letter in [(own, 0.0, c)] if own else [(toxicity.STATE[x], toxicity.SIGN, x) for x in toxicity.LEET.get(c, "")]:
            for score, tail in every(rest, to, c):
                yield score + price + channel.log[state][to], letter + tail
        if own and c == last and state == own:
            yield from ((s + toxicity.AGAIN, t) for s, t in every(rest, state, c))
        if not own:
            yield from ((s + (toxicity.BETWEEN if c in toxicity.LEET else toxicity.FILLER), t) for s, t in every(rest, state, c))

    for token in ("5tu", "m0*n", "aaab", "1l!", "h0ou$e", "$$", "x"):
        best = max(every(token, 0, ""))
        assert channel.decode(token) == best[1]


# --- masked LM ---------------------------------------------------------------------------------------------------------

def test_likely_texts_score_higher(spark, docs):
    train = spark.createDataFrame([(i, "one two three four five six " * 5) for i in range(50)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in masked_lm.score_documents(docs([(1, "one two three four five"), (2, "two two five one six"), (3, None), (4, "")]), train).collect()}
    assert got[1]["mean_log_prob"] > got[2]["mean_log_prob"] + 1
    assert (got[3]["n_tokens"], got[3]["log_prob"], got[3]["mean_log_prob"]) == (0, 0.0, None) == (got[4]["n_tokens"], got[4]["log_prob"], got[4]["mean_log_prob"])
    assert len(masked_lm.score_documents(docs(EDGES)).collect()) == len(EDGES) and masked_lm.score_documents(docs([])).collect() == []


def test_context_counts_equal_plain_counts(docs):
    import numpy as np
    df = docs([(1, "a b a"), (2, "a b c9 a")])
    words = masked_lm.common_words(df, "text", 2)
    counts = masked_lm.context_counts(df, "text", words)
    want = np.zeros_like(counts)
    for text in ("a b a", "a b c9 a"):
        c = masked_lm.Classer(words)(text)
        for left, mid, right in zip(c, c[1:], c[2:]):
            want[left, right, mid] += 1
    assert words == ["a", "b"] and (counts == want).all()
    assert np.allclose(np.exp(masked_lm.Network.fit(counts).table()).reshape(-1, masked_lm.CLASSES).sum(1), 1, atol=1e-3)


def test_runs_of_texts_are_split_once_and_keep_their_borders(monkeypatch):
    import numpy as np
    split, calls = masked_lm.tokens, []
    monkeypatch.setattr(masked_lm, "tokens", lambda text: calls.append(text) or split(text))
    monkeypatch.setattr(masked_lm, "SLICE", 7)
    texts, words = ["a b a c9", None, "", "x", "b " * 20 + "yy", "a"], ["a", "b"]
    of = np.append(masked_lm.Classer(words).of, 0)
    runs = list(masked_lm.joined(texts, masked_lm.Slots(words), len(of) - 1))
    assert calls == texts and len(runs) == 3 and [t for held, _ in runs for t in held] == [split(t) for t in texts]
    got = [masked_lm.cells_of(of[flat])[of[flat][1:-1] > 0] for _, flat in runs]
    want = [masked_lm.cells_of(masked_lm.Classer(words)(t)) for t in texts]
    assert np.concatenate(got).tolist() == np.concatenate(want).tolist()


def test_every_word_reaches_the_score(spark, docs):
    rng = random.Random(4)
    seen = ["".join(rng.choice("aeioust") for _ in range(rng.randint(4, 9))) for _ in range(900)]
    texts = [" ".join(rng.choice(seen) for _ in range(60)) for _ in range(80)]
    train = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    common = set(masked_lm.common_words(train, "text"))
    # The same shapes in other letters, and in the same letters dealt anew; common words stay.
    other = [" ".join(w if w in common else "".join(rng.choice("qxzwk") for _ in w) for w in t.split()) for t in texts]
    dealt = [" ".join(w if w in common else "".join(rng.choice("aeioust") for _ in w) for w in t.split()) for t in texts]
    both = docs([*enumerate(texts), *((100 + i, t) for i, t in enumerate(other)), *((200 + i, t) for i, t in enumerate(dealt)), (7, texts[7]), (None, texts[7])])
    got = [(r["doc_id"], r["log_prob"]) for r in masked_lm.score_documents(both, train).collect()]
    by = dict(got)
    assert len(got) == 242 and all(by[i] > by[200 + i] > by[100 + i] for i in range(80) if texts[i] != dealt[i])
    assert [pytest.approx(by[7])] * 3 == [p for i, p in got if i in (7, None)]
    # What tasks hold and what they join makes no difference.
    few = dict((r["doc_id"], r["log_prob"]) for r in masked_lm.score_documents(both, train, held=0).collect())
    assert few == {i: pytest.approx(p) for i, p in by.items()}


def test_words_of_a_class_sum_to_one(spark, docs):
    import numpy as np
    words = [f"w{i:04d}" for i in range(400)]
    df = docs([(i, f"{w} " * (1 + i % 3)) for i, w in enumerate(words)])
    table = masked_lm.word_table(masked_lm.word_counts(df, "text"), masked_lm.common_words(df, "text")).collect()
    assert len(table) == 400 and sum(r["n"] for r in table) == sum(1 + i % 3 for i in range(400))
    left = [r["n"] for r in table if r["class"] > masked_lm.WORDS]
    assert len(left) == 400 - masked_lm.WORDS and len({r["class"] for r in table}) == masked_lm.WORDS + 1
    assert np.isclose(sum(n - masked_lm.DISCOUNT for n in left) + masked_lm.DISCOUNT * len(left), sum(left))


# --- decontamination ---------------------------------------------------------------------------------------------------

def least_distance(item, text):
    before = [0] * (len(text) + 1)
    for i, a in enumerate(item, 1):
        now = [i]
        for j, b in enumerate(text, 1):
            now.append(min(before[j - 1] + (a != b), before[j] + 1, now[j - 1] + 1))
        before = now
    return min(before)


def test_matches_equal_edit_distance():
    rng = random.Random(3)
    near = 0
    for _ in range(500):
        letters = rng.choice(["abcde ", "ab ", "abcdefghijklmnop "])
        item = decontaminate.canonical("".join(rng.choice(letters) for _ in range(rng.randint(12, 120))))
        if len(item) < 8:
            continue
        edited = list(item)
        for _ in range(rng.randint(0, int(len(item) * 0.14) + 1)):
            k = rng.randrange(len(edited))
            edited[k:k + rng.choice([0, 1])] = rng.choice(["", "x", "ab"])
        text = decontaminate.canonical("".join(rng.choice(letters) for _ in range(30)) + "".join(edited) + "".join(rng.choice(letters) for _ in range(30)))
        want, budget = least_distance(item, text), int(len(item) * 0.1)
        found = decontaminate.Matcher([(1, item)], 0.1, 8).find(text)
        near += 0 < want <= budget
        assert bool(found) == (want <= budget) and (not found or found[0][1] == want)
    assert near > 40


def test_leaks_in_blocks_and_edges(spark, docs):
    items = ["Quick brown foxes jump over lazy dogs near the old river bank", "tiny", None, "   "]
    benchmark = spark.createDataFrame([(i, t) for i, t in enumerate(items)], "item_id long, text string")
    rows = [(10, "Intro. quick brown  foxes jumped over lazy dogs near the old\nriver bank. End"), (11, "Tiny"), (12, "tiny words"), *EDGES]
    for block in (10, 10**6):
        got = {r["doc_id"]: (r["contaminated"], r["item_ids"], r["distance"]) for r in decontaminate.find_leaks(docs(rows), benchmark, block_chars=block).collect()}
        assert got[10] == (True, "0", 2) and got[11] == (True, "1", 0) and got[12][0] is False and got[1] == (False, "", None)
    assert decontaminate.find_leaks(docs([]), benchmark.limit(0)).collect() == []


def test_short_items_inside_texts(spark, docs):
    items = ["Who wrote Hamlet?", "is it so", "法国的首都是哪里", "two words"]
    benchmark = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    rows = [(1, "The quiz began: who  wrote\nhamlet? Nobody knew."), (2, "The quiz began: who wrot hamlet? Nobody knew."), (3, "Who sold Hamlet?"),
            (4, "well is it so, they said"), (5, "this it so"), (6, "is it some"), (7, "请问法国的首都是哪里呢"), (8, "just two words"), (9, "Two  words")]
    got = {r["doc_id"]: (r["item_ids"], r["distance"]) for r in decontaminate.find_leaks(docs(rows), benchmark).collect()}
    assert got == {1: ("0", 0), 2: ("0", 1), 3: ("", None), 4: ("1", 0), 5: ("", None), 6: ("", None), 7: ("2", 0), 8: ("", None), 9: ("3", 0)}


def test_short_matches_equal_edit_distance_between_words():
    def whole_distance(a, b):
        before = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            now = [i]
            for j, y in enumerate(b, 1):
                now.append(min(before[j - 1] + (x != y), before[j] + 1, now[j - 1] + 1))
            before = now
        return before[-1]

    rng = random.Random(6)
    hits = misses = 0
    for _ in range(250):
        item = decontaminate.canonical(" ".join("".join(rng.choice("abc") for _ in range(rng.randint(1, 6))) for _ in range(rng.randint(3, 6))))[:31].strip()
        if decontaminate.words(item) < 3:
            continue
        edited = list(item)
        for _ in range(rng.randint(0, len(item) // 10 + 1)):
            k = rng.randrange(len(edited))
            edited[k:k + rng.choice([0, 1])] = rng.choice(["", "a", "c "])
        text = decontaminate.canonical(rng.choice(["ab ", "ab", "c, "]) + "".join(edited) + rng.choice([" ba", "b", "? a"]))
        cuts, budget = [i for i in range(len(text) + 1) if decontaminate.is_boundary(text, i)], len(item) // 10
        want = min(whole_distance(item, text[i:j]) for i in cuts for j in cuts if i < j and abs(j - i - len(item)) <= budget + 1)\
            if any(i < j and abs(j - i - len(item)) <= budget + 1 for i in cuts for j in cuts) else 99
        found = decontaminate.Matcher([(1, item)], 0.1, 32).find(text)
        assert bool(found) == (want <= budget) and (not found or found[0][1] == want), (item, text)
        hits += bool(found)
        misses += not found and least_distance(item, text) <= budget
    assert hits > 40 and misses > 10


# --- language ------------------------------------------------------------------------------------------------------------

def test_language_learns_and_edges(spark, docs):
    rng = random.Random(2)
    kinds = {"xx": ["ba", "lo", "ki", "ne"], "yy": ["zu", "gra", "pft", "schn"]}
    rows = [(i, " ".join("".join(rng.choice(kinds[k]) for _ in range(3)) for _ in range(20)), k if i % 9 else None)
            for i, k in enumerate(rng.choice(list(kinds)) for _ in range(300))]
    train = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    fresh = [(1000, "baloki nekiba loloba"), (1001, "zugra pftschnzu"), (1002, None), (1003, "12 !? 3"), (None, "kineba lo")]
    got = {r[0]: (r[1], r[2]) for r in language.identify(docs(fresh), train).collect()}
    assert got[1000][0] == "xx" and got[1001][0] == "yy" and got[1002] == ("und", 0.0) == got[1003] and got[None][0] == "xx"
    assert all(0 <= s <= 1 for _, s in got.values())
    assert {r[1] for r in language.identify(docs(EDGES), train.limit(0)).collect()} == {"und"}


def plain_buckets(text):
    """Bucket of every n-gram by whole numbers."""
    codes, out = [ord(c) for c in text.lower()], []
    for n in (1, 2, 3):
        for i in range(len(codes) - n + 1):
            h = 0
            for k, m in enumerate((0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35)[:n]):
                h ^= codes[i + k] * m % 2**32
            out.append((h ^ h >> 15) * (0x2C1B3C6D + 2 * n) % 2**32 >> 32 - language.BITS)
    return out


def test_buckets_equal_plain_hashes(monkeypatch):
    rng = random.Random(4)
    for slice_size in (1 << 20, 5):
        monkeypatch.setattr(language, "SLICE", slice_size)
        for size in (0, 1, 2, 3, 11, 40):
            text = "".join(rng.choice("abÉ ß日\U0001f600") for _ in range(size))
            assert sorted(b for part in language.buckets(text) for b in part.tolist()) == sorted(plain_buckets(text))


def plain_ftrl(rows, labels, classes, epochs, train, alpha=1.0, beta=1.0, l1=2e-3, l2=1e-3):
    """Weights by key and class, one number at a time."""
    z, n = {}, {}

    def weight(key, c):
        v = z.get((key, c), 0.0)
        return 0.0 if abs(v) <= l1 else -(v - math.copysign(l1, v)) / ((beta + math.sqrt(n.get((key, c), 0.0))) / alpha + l2)

    for epoch in range(epochs):
        for i in np.random.default_rng(epoch).permutation(train):
            scores = [sum(x * weight(key, c) for key, x in rows[i].items()) for c in range(classes)]
            top = [math.exp(s - max(scores)) for s in scores]
            for key, x in rows[i].items():
                for c in range(classes):
                    g = x * (top[c] / sum(top) - (c == labels[i]))
                    w, old = weight(key, c), n.get((key, c), 0.0)
                    n[key, c] = old + g * g
                    z[key, c] = z.get((key, c), 0.0) + g - (math.sqrt(old + g * g) - math.sqrt(old)) / alpha * w
    return weight


def test_language_model_equals_plain_training(spark, docs):
    rng = random.Random(5)
    rows = [(i, "".join(rng.choice(abc) for _ in range(rng.randint(0, 14))), lang)
            for i, (abc, lang) in enumerate(rng.choice([("abc ", "l1"), ("bcd é", "l2"), ("xyz", "l3")]) for _ in range(30))]
    df = spark.createDataFrame([*rows, (99, None, "l1"), (98, "abc", None)], "doc_id long, text string, lang string")
    model = language.fit(df, "doc_id", "text", "lang", epochs=2)
    labelled = df.where("lang is not null")
    sample = [(plain_buckets(r.text or ""), r.lang) for r in spread_sample(labelled, 100, 31).collect()]
    assert len(sample) == 31 and model.names == ["l1", "l2", "l3"]
    idf = {b: math.log(32 / (1 + sum(b in found for found, _ in sample))) + 0.1 for found, _ in sample for b in found}
    features = [{**{b: float(np.float32(found.count(b) / len(found))) * idf[b] * language.GAIN for b in set(found)}, "all": 1.0} for found, _ in sample]
    order = np.random.default_rng(7).permutation(31)
    weight = plain_ftrl(features, [model.names.index(lang) for _, lang in sample], 3, 2, np.setdiff1d(order, order[::5]))
    for b in idf:
        assert np.allclose(model.table[b], [weight(b, c) * idf[b] * language.GAIN for c in range(3)], rtol=1e-4, atol=1e-5)
    assert np.allclose(model.offset, [weight("all", c) for c in range(3)], atol=1e-7)
    fresh = [(1, "abcab"), (2, "dé dd"), (3, "zzxy"), (4, "Qa")]
    got = {r.doc_id: r for r in language.identify(docs(fresh), df.where("doc_id <> -1")).collect()}
    full = language.fit(df, "doc_id", "text", "lang")
    for i, text in fresh:
        found = plain_buckets(text)
        score = [(sum(float(full.table[b][c]) for b in found) / len(found) + full.offset[c]) / full.temperature for c in range(3)]
        top = [math.exp(s - max(score)) for s in score]
        assert got[i].lang_pred == full.names[top.index(max(top))] and abs(got[i].score - max(top) / sum(top)) < 1e-5


def test_sample_and_model_do_not_depend_on_partitions(spark):
    rows = [(None if i % 3 else i, f"t{i % 200}", "ab"[i % 2]) for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    drawn = [[tuple(r) for r in spread_sample(df.repartition(n), 100, 600).collect()] for n in (1, 7)]
    assert drawn[0] == drawn[1] and 50 < len(drawn[0]) <= 200 and {None} < {r[0] for r in drawn[0]}
    hot = spark.createDataFrame([(None, "same", "a")] * 500 + rows[:100], df.schema)
    for seed in (1, 7):
        assert len(spread_sample(hot.repartition(seed), 600, 600).collect()) == 600 and len(spread_sample(hot.repartition(seed), 20, 600).collect()) <= 40
    models = [language.fit(df.repartition(n), "doc_id", "text", "lang", train_rows=100) for n in (1, 7)]
    assert (models[0].table == models[1].table).all() and models[0].temperature == models[1].temperature


# --- BPE -----------------------------------------------------------------------------------------------------------------

def test_ids_equal_tiktoken_and_round_trip(docs):
    tool = bpe.codec(PATH, public_tokenizers.PATTERN)
    other = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=tool.ranks, special_tokens={})
    rng = random.Random(1)
    letters = " a b\n\t \x1c\x85éñ1²½!?'stab  \r\n漢字ß\U0001f600"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 40))) for _ in range(1500)]
    texts += ["a" * 5000, "ab" * 3000, " " * 500 + "x", "".join(rng.choice("abcd") for _ in range(20_000)), "<|endoftext|>"]
    for text, ids in zip(texts, tool.encode(texts)):
        assert list(memoryview(ids).cast("I")) == other.encode_ordinary(text), text[:80]
        assert tool.decode(ids) == text.encode()
    df = docs(EDGES)
    coded = bpe.encode(df, PATH, public_tokenizers.PATTERN)
    back = by_id(bpe.decode(coded, PATH, public_tokenizers.PATTERN))
    assert [bytes(r[1]).decode() for r in back] == [(t or "") for _, t in sorted(EDGES, key=lambda r: (r[0] is None, r[0] or 0))]
    digest = {r["doc_id"]: r for r in bpe.encode(df, PATH, public_tokenizers.PATTERN, digests=True).collect()}
    assert digest[1]["n_tokens"] == 0 and digest[1]["ids_sha256"] == hashlib.sha256(b"").hexdigest() and digest[3]["n_tokens"] > 0


def test_forgetting_changes_no_ids(monkeypatch):
    tool = bpe.Codec.load(PATH, public_tokenizers.PATTERN)
    rng = random.Random(8)
    texts = [" ".join("".join(rng.choice("abcdeé1 ") for _ in range(rng.randint(1, 9))) for _ in range(60)) for _ in range(30)]
    want = tool.encode(texts)
    for name, n in (("REMEMBERED", 20), ("LASTING", 5), ("RESTING", 2)):
        monkeypatch.setattr(bpe, name, n)
    other = bpe.Codec.load(PATH, public_tokenizers.PATTERN)
    assert [other.encode([t])[0] for t in texts] == want
    other.rest()
    assert len(other.known) <= 2 and len(other.words) <= 2 and other.encode(texts) == want


def test_rank_queue_gives_lowest_first():
    rng = random.Random(4)
    queue, want = bpe.RankQueue(300_000), []
    for _ in range(3000):
        if want and rng.random() < 0.4:
            rank, places = queue.pop()
            assert rank == min(want)
            want = [w for w in want if w != rank]
        else:
            rank = rng.randrange(300_000 if rng.random() < 0.5 else 70)
            queue.put(rank, [1])
            want.append(rank)


# --- Jaccard join ----------------------------------------------------------------------------------------------------------

def brute_components(rows):
    sets = {}
    for i, text in rows:
        w = (text or "").encode().lower().split()
        sets[i] = {tuple(w[k:k + 3]) for k in range(len(w) - 2)} if len(w) > 2 else {tuple(w)} if w else set()
    root = {i: i for i in sets}
    while True:
        before = dict(root)
        for a in sets:
            for b in sets:
                if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 90 * len(sets[a] | sets[b]):
                    root[a] = min(root[a], root[b])
        if root == before:
            return {i: (len(s), root[i]) for i, s in sets.items()}


def test_join_equals_brute_force(docs):
    rng = random.Random(8)
    words = [f"w{i}" for i in range(60)]
    rows, at = [], 0
    for family in range(14):
        size = rng.choice([1, 2, 3, 5, 12, 40, 90, 200])
        seed = [rng.choice(words) for _ in range(size)]
        for _ in range(rng.randint(1, 14)):
            copy = list(seed)
            for _ in range(rng.randint(0, max(1, size // 30))):
                k = rng.randrange(len(copy))
                copy[k:k + 1] = rng.choice([[], [rng.choice(words)], [copy[k], rng.choice(words)]])
            if rng.random() < 0.3:
                seed = copy or seed
            rows.append((at, rng.choice([" ", "\n", " \t"]).join(copy).upper() if at % 5 == 0 else " ".join(copy)))
            at += 1
    rows += [(at, None), (at + 1, ""), (at + 2, "  "), (at + 3, "caf\u00e9\u00a0x y"), (at + 4, "solo")]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.join_components(docs(rows)).collect()}
    assert got == brute_components(rows)
    assert len({v[1] for v in got.values()}) < len(rows) - 20


def test_join_edges(docs):
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.join_components(docs(EDGES)).collect()), key=str)
    assert got == sorted([(1, 0, 1), (2, 0, 2), (2, 0, 2), (None, 1, None), (3, 1, 3), (4, 5, 4), (5, 5, 4)], key=str)
    assert jaccard.join_components(docs([])).collect() == []


def test_regions_lose_no_pair_and_histograms_bound():
    """Every pair within the limit shares a region key, and histograms are never farther apart than the sets."""
    import numpy as np
    rng = np.random.default_rng(6)
    for _ in range(400):
        n = int(rng.integers(1, 400))
        s = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        drop, add = rng.integers(0, n // 10 + 2), rng.integers(0, n // 10 + 2)
        t = np.unique(np.concatenate([rng.permutation(s)[drop:], rng.integers(0, 2**63, add).astype(np.uint64)]))
        same, union = len(np.intersect1d(s, t)), len(np.union1d(s, t))
        if len(t) and 100 * same >= 90 * union and same < union:
            assert set(jaccard.region_keys(s, 90)) & set(jaccard.region_keys(t, 90))
        a, b = (np.frombuffer(jaccard.histogram(x), "<u2").astype(int) for x in (s, t))
        size = min(len(a), len(b))
        a, b = a.reshape(-1, size).sum(0), b.reshape(-1, size).sum(0)
        assert np.minimum(a, b).sum() * union >= same * np.maximum(a, b).sum()


def test_leaf_join_equals_all_pairs(spark):
    import numpy as np
    rng = np.random.default_rng(2)
    base = rng.poisson(3, (20, 64))
    points = np.concatenate([np.maximum(0, base[i % 20] + (rng.random(64) < 0.05)) for i in range(200)]).reshape(200, 64).astype(np.uint32)
    label = rng.integers(0, 50, 200)
    want = [(i, j) for i in range(200) for j in range(i + 1, 200) if label[i] != label[j]
            and 1 - np.minimum(points[i], points[j]).sum() / np.maximum(points[i], points[j]).sum() <= 0.1 + 1e-9]
    assert jaccard.close_pairs(points, label, 0.1) == want and want


# --- HTML ----------------------------------------------------------------------------------------------------------------

PAGES = [
    (None, None), ("", ""), ("<p>a<p>b", "a\n\nb"), ("x<br>y &amp; z", "x\ny & z"), ("<div hidden>no</div>yes", "yes"),
    ("<ul><li>a<li>b<ol><li>c</ol></ul>", "- a\n- b\n  1. c"), ("<pre> a\n  b</pre>", " a\n  b"), ("a < b", "a < b"),
    ("<table><tr><th>Name<th>N<tr><td>long one<td>2</table>", "Name      N\nlong one  2"), ("<script>if (a<b) x()</script>t", "t"),
    ("<title>t</title><h1>H</h1>text", "H\n\ntext"), ("<p style='display: none'>no</p>yes<!-- no -->", "yes"), ("</p></b>x<b", "x"),
    ("<td>loose", "loose"), ("a\n  b\tc", "a b c"), ("<details>more<summary>s</summary></details>", "s"),
]


@pytest.mark.parametrize(("source", "text"), PAGES)
def test_layout(source, text):
    assert html_text.to_text(source) == text


def test_cells_stay_in_their_columns():
    long = " ".join(["word"] * 40)
    lines = html_text.to_text(f"<table><tr><td>{'a' * 60}<td>1<tr><td>b<td>2<tr><td>{long}<td>3</table>").split("\n")
    assert len({line.rindex(n) for n in "123" for line in lines if line.endswith(n)}) == 1
    assert "".join(lines).count("word") == 40
    assert html_text.to_text("<table><tr><td rowspan=2>ab<td>c<tr><td>d<tr><td>e<td>f</table>") == "ab  c\n    d\ne   f"
    assert html_text.to_text("<table><tr><td>x<td rowspan=0>up<td>c<tr><td>y<td>d<tbody><tr><td>z<td>e</table>") == "x  up  c\ny      d\nz  e"
    assert html_text.to_text("a<xmp><b>x &amp; y</b>\n  z</xmp>b") == "a\n\n<b>x &amp; y</b>\n  z\n\nb"


def test_broken_and_deep_pages(spark):
    for source in ("<div>" * 50_000 + "deep", "<b>" * 5000 + "</i>" * 5000 + "x", "<table><tr><td>" * 200 + "n", "<p>" * 3000 + "x", "<a href='" * 2000):
        assert len(html_text.to_text(source)) < 10
    df = spark.createDataFrame([(1, None, "h"), (1, None, "h"), (None, "<p>x", "h"), (2, "", "h")], "page_id long, html string, text string")
    got = sorted((tuple(r) for r in html_text.extract_text(df).collect()), key=str)
    assert got == sorted([(1, None, 0, 0), (1, None, 0, 0), (None, "x", 1, 1), (2, "", 0, 0)], key=str)
