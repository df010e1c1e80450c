"""LM scoring: masked pseudo-likelihood of a bidirectional window network."""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cleanloom.llm.common import map_rows, ref
from cleanloom.session import stored

# Classes of tokens: the commonest WORDS words, and shapes of all others. Class 0 is the border of a document.
WORDS, SHAPES = 223, 32
CLASSES = 1 + WORDS + SHAPES
# Hidden units and training steps; one step sees every context of the corpus.
HIDDEN, STEPS, RATE = 24, 120, 0.05
# Tokens worked on at a time in numpy, words a task counts before it passes its counts on, and contexts in one product of the network.
SLICE, COUNTED, CONTEXTS = 200_000, 200_000, 4_096
# Uncommon words a task remembers, and the longest of them.
REMEMBERED, LONGEST = 400_000, 48
# Words whose counts every task holds (all others are joined; no result depends on it), and the count taken from each word for unseen ones.
HELD, DISCOUNT = 50_000, 0.5


DIGIT = re.compile("[0-9]")


def tokens(text: str | None) -> list[str]:
    """Lower-cased pieces between white space."""
    return (text or "").lower().split()


def shape(token: str) -> int:
    """One of SHAPES classes of an uncommon token: length in eight steps, ending in three kinds, digits apart."""
    size = min(7, (len(token) - 1) // 2)
    if DIGIT.search(token):
        return 24 + size
    last = token[-1]
    return size * 3 + (0 if last.isalpha() else 1 if last in ".!?" else 2)


def word_counts(df: DataFrame, text_col: str) -> DataFrame:
    """``word, n`` of every distinct token of every whole text.

    Tasks pre-aggregate their tokens in tables of bounded size before the shuffle.
    """
    def run(batches):
        tally: Counter[str] = Counter()

        def out():
            return pa.RecordBatch.from_arrays([pa.array(list(tally), pa.string()), pa.array(list(tally.values()), pa.int64())], names=["word", "n"])

        for batch in batches:
            for text in batch.column(0).to_pylist():
                tally.update(tokens(text))
                if len(tally) > COUNTED:
                    yield out()
                    tally.clear()
        yield out()

    return df.select(ref(text_col).alias("text")).mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def common_words(df: DataFrame, text_col: str, words: int = WORDS) -> list[str]:
    """The commonest tokens by counts over every whole text, ties in order of the text."""
    return [r[0] for r in commonest(word_counts(df, text_col), words)]


def commonest(counts: DataFrame, words: int) -> list:
    return counts.orderBy(F.desc("n"), "word").limit(words).collect()


def word_table(counts: DataFrame, words: list[str]) -> DataFrame:
    """``word, n, class`` of every counted token."""
    def make():
        known = {w: i + 1 for i, w in enumerate(words)}
        return lambda found, n: {"word": found, "n": n, "class": [known.get(w) or 1 + WORDS + shape(w) for w in found]}

    return map_rows(counts, ["word", "n"], "word string, n long, class int", make)


class Spelling:
    """Log-probability of an unseen token letter by letter, from the letters of each distinct token and its end."""

    def __init__(self, letters: dict[str, int]):
        total, kinds = sum(letters.values()), len(letters)
        # Letters never met share the mass of as many sightings as there are kinds of letters.
        self.log = {c: float(np.log(n / (total + kinds))) for c, n in letters.items()}
        self.other = float(np.log(max(1, kinds) / max(1, total + kinds) / 1_114_113))

    @classmethod
    def of(cls, counts: DataFrame) -> "Spelling":
        def run(batches):
            tally: dict[str, int] = {}
            for batch in batches:
                for w in batch.column(0).to_pylist():
                    for c in w:
                        tally[c] = tally.get(c, 0) + 1
                    tally[""] = tally.get("", 0) + 1
            yield pa.RecordBatch.from_arrays([pa.array(list(tally), pa.string()), pa.array(list(tally.values()), pa.int64())], names=["letter", "n"])

        return cls({r[0]: r[1] for r in counts.select("word").mapInArrow(run, "letter string, n long").groupBy("letter").agg(F.sum("n")).collect()})

    def __call__(self, token: str) -> float:
        return sum(self.log.get(c, self.other) for c in token) + self.log.get("", self.other)


class Slots:
    """Numbers of tokens: common ones have their place in a list, all others one number a shape behind it; remembers
    uncommon tokens up to a bound."""

    def __init__(self, common: list[str]):
        self.common = {w: i for i, w in enumerate(common)}
        self.first = len(common)
        self.kept = dict(self.common)

    def __call__(self, found: list[str]) -> list[int]:
        slots = list(map(self.kept.get, found))
        if None in slots:
            if len(self.kept) - self.first > REMEMBERED:
                self.kept = dict(self.common)
            for i, slot in enumerate(slots):
                if slot is None:
                    slots[i] = self.first + shape(found[i])
                    if len(found[i]) <= LONGEST:
                        self.kept[found[i]] = slots[i]
        return slots


class Classer:
    """Maps the tokens of a text to classes, with the border on both sides."""

    def __init__(self, words: list[str]):
        self.slots = Slots(words)
        # A full list of words makes shapes follow them; a shorter one leaves a gap.
        self.of = np.concatenate([1 + np.arange(len(words)), 1 + WORDS + np.arange(SHAPES)])

    def __call__(self, text: str | None) -> np.ndarray:
        return np.concatenate([[0], self.of[np.array(self.slots(tokens(text)), np.int64)], [0]])


def joined(texts, slots: Slots, border: int):
    """Runs of texts with about SLICE tokens: ``(token lists, flat slots)``; a border stands before, between and behind the texts."""
    held, flat = [], [border]
    for text in texts:
        found = tokens(text)
        held.append(found)
        flat += slots(found)
        flat.append(border)
        if len(flat) > SLICE:
            yield held, np.array(flat, np.int32)
            held, flat = [], [border]
    if held:
        yield held, np.array(flat, np.int32)


def cells_of(classes: np.ndarray) -> np.ndarray:
    """The cell of left, right and middle class around each place but the ends."""
    return (classes[:-2] * CLASSES + classes[2:]) * CLASSES + classes[1:-1]


def context_counts(df: DataFrame, text_col: str, words: list[str]) -> np.ndarray:
    """How often each class stands between each pair of classes, over every whole text: left x right x middle.

    Each task emits its non-empty cells once; their sums are shuffled by cell, at most CLASSES ** 3 of them.
    """
    def run(batches):
        slots, total = Slots(words), np.zeros(CLASSES ** 3, np.int64)
        of = np.append(Classer(words).of, 0).astype(np.int32)
        for batch in batches:
            for _, flat in joined(batch.column(0).to_pylist(), slots, len(of) - 1):
                c = of[flat]
                np.add.at(total, cells_of(c)[c[1:-1] > 0], 1)
        cells = np.flatnonzero(total)
        for at in range(0, len(cells), 200_000):
            part = cells[at:at + 200_000]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(total[part], pa.int64())], names=["cell", "n"])

    got = df.select(ref(text_col).alias("text")).mapInArrow(run, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(CLASSES ** 3)
    for batch in got.to_batches():
        out[batch.column(0).to_numpy()] = batch.column(1).to_numpy()
    return out.reshape(CLASSES, CLASSES, CLASSES)


@dataclass
class Network:
    """One hidden layer over the embeddings of both neighbours, then a softmax over the classes."""

    left: np.ndarray
    right: np.ndarray
    bias: np.ndarray
    out: np.ndarray
    offset: np.ndarray

    @classmethod
    def fit(cls, counts: np.ndarray, hidden: int = HIDDEN, steps: int = STEPS, rate: float = RATE) -> "Network":
        """Adam on the exact pseudo-likelihood of the corpus: the gradient runs over all observed contexts, weighted by
        their counts, which equals a pass over all tokens. The result does not depend on the partitioning."""
        rng = np.random.default_rng(11)
        size = CLASSES
        p = [rng.normal(0, 0.3, (size, hidden)), rng.normal(0, 0.3, (size, hidden)), np.zeros(hidden), rng.normal(0, 0.1, (hidden, size)),
             np.log((counts.sum((0, 1)) + 0.5) / (counts.sum() + 0.5 * size))]
        m, v = [np.zeros_like(x) for x in p], [np.zeros_like(x) for x in p]
        a, b = np.nonzero(counts.sum(2))
        total = max(1.0, counts.sum())
        for step in range(1, steps + 1 if len(a) else 1):
            g = [np.zeros_like(x) for x in p]
            weights, offset = p[3].astype(np.float32), p[4].astype(np.float32)
            for at in range(0, len(a), CONTEXTS):
                i, j = a[at:at + CONTEXTS], b[at:at + CONTEXTS]
                target = counts[i, j].astype(np.float32)
                h = np.tanh(p[0][i] + p[1][j] + p[2]).astype(np.float32)
                q = softmax(h @ weights + offset)
                dz = (q * target.sum(1, keepdims=True) - target) / total
                dh = (dz @ weights.T) * (1 - h * h)
                for have, more in zip(g, (summed(i, dh, size), summed(j, dh, size), dh.sum(0), h.T @ dz, dz.sum(0))):
                    have += more
            for i in range(5):
                m[i] = 0.9 * m[i] + 0.1 * g[i]
                v[i] = 0.99 * v[i] + 0.01 * g[i] ** 2
                p[i] = p[i] - rate * (m[i] / (1 - 0.9 ** step)) / (np.sqrt(v[i] / (1 - 0.99 ** step)) + 1e-9)
        return cls(*p)

    def table(self) -> np.ndarray:
        """Log-probability of each class between each pair of classes."""
        out = np.empty((CLASSES, CLASSES, CLASSES), np.float32)
        weights, offset = self.out.astype(np.float32), self.offset.astype(np.float32)
        for k in range(CLASSES):
            z = np.tanh(self.left[k] + self.right + self.bias).astype(np.float32) @ weights + offset
            z -= z.max(1, keepdims=True)
            out[k] = z - np.log(np.exp(z).sum(1, keepdims=True))
        return out.reshape(-1)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def summed(index: np.ndarray, values: np.ndarray, size: int) -> np.ndarray:
    return np.stack([np.bincount(index, values[:, k], size) for k in range(values.shape[1])], 1)


def score_documents(df: DataFrame, train: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", held: int = HELD) -> DataFrame:
    """``id, n_tokens, log_prob, mean_log_prob`` of every whole text: the sum over its tokens of the log-probability of
    each, masked, given the tokens on both sides.

    Tokens are lower-cased pieces between white space. The log-probability of one is that of its class between the classes
    of its neighbours, plus that of the word itself within its class. Common words are classes of their own, all others
    share a class by shape. The first part comes from a network trained in numpy on counts of every context of ``train``
    (the same table by default). The second comes from the counts of every word of ``train``, a table without bound on the
    driver or in a task: (n - DISCOUNT) / tokens of the class, and what is taken off goes to unseen words by their letters.
    Tasks hold the counts of the ``held`` commonest words and join the others.

    A null or empty text has no tokens, log-probability 0 and a null mean. Ids are kept as they are, null and repeated
    ones too; other columns are ignored; long texts are scored whole. Untrained (empty ``train``), all classes are alike.
    """
    spark, source = df.sparkSession, df if train is None else train
    counts = stored(word_counts(source, text_col), "words")
    top = commonest(counts, max(WORDS, held))
    words = [r[0] for r in top[:WORDS]]
    table = word_table(counts, words)
    sizes = {r[0]: (r[1], r[2]) for r in table.groupBy("class").agg(F.sum("n"), F.count("*")).collect()}
    # Of one class: its tokens, and the log-probability that a token of it is an unseen word.
    tokens_of = np.array([sizes.get(c, (0, 0))[0] for c in range(CLASSES)], np.float64)
    unseen = [float(np.log(DISCOUNT * sizes[c][1] / sizes[c][0])) if c in sizes else 0.0 for c in range(CLASSES)]
    net = Network.fit(context_counts(source, text_col, words))
    # Without texts of another table every word has been counted.
    spelling = None if train is None else Spelling.of(counts)
    shared = spark.sparkContext.broadcast((words, net, [tuple(r) for r in top[WORDS:held]], tokens_of, unseen, spelling))

    def make():
        words, net, more, tokens_of, unseen, spelling = shared.value
        table, slots = net.table(), Slots([*words, *[w for w, _ in more]])
        # Class and log-probability within it by slot: common words, words held here, shapes, the border.
        far = 1 + WORDS + np.arange(SHAPES)
        held_in = np.array([1 + WORDS + shape(w) for w, _ in more], np.int64)
        of = np.concatenate([1 + np.arange(len(words)), held_in, far, [0]]).astype(np.int32)
        log = np.zeros(len(of))
        log[len(words):slots.first] = np.log((np.array([n for _, n in more], np.float64) - DISCOUNT) / tokens_of[held_in])

        def step(texts: list) -> dict[str, list | pa.Array]:
            n, totals, ends, rest, times = [], [], [0], [], []
            for held, flat in joined(texts, slots, len(of) - 1):
                c = of[flat]
                # A text's part ends with the border behind it, which counts nothing, so no part is empty.
                starts = np.cumsum([0] + [len(found) + 1 for found in held[:-1]])
                price = np.where(c[1:-1] > 0, table[cells_of(c)], 0.0)
                totals.append(np.add.reduceat(np.append(price, 0.0) + log[flat[1:]], starts))
                uncommon = (flat[1:] >= slots.first) & (c[1:] > 0)
                for at, found in zip(starts.tolist(), held):
                    n.append(len(found))
                    tally = Counter([found[i] for i in np.flatnonzero(uncommon[at:at + len(found)]).tolist()])
                    rest += tally
                    times += tally.values()
                    ends.append(len(rest))
            new = [spelling(w) + unseen[1 + WORDS + shape(w)] for w in rest] if spelling else np.zeros(len(rest))
            parts = pa.StructArray.from_arrays([pa.array(rest, pa.string()), pa.array(times, pa.int32()), pa.array(new, pa.float64())], names=["word", "times", "new"])
            return {"n": n, "total": np.concatenate([np.zeros(0), *totals]), "rest": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), parts)}
        return step

    # Stored, so that the numbers of the rows stay the same.
    rows = df.select(ref(id_col).alias("id"), ref(text_col).alias("text")).withColumn("row", F.monotonically_increasing_id())
    kept = map_rows(rows, ["text"], "n long, total double, rest array<struct<word: string, times: int, new: double>>", make, keep=True)
    kept = stored(kept.drop("text"), "scored")
    per_class = F.array(*[F.lit(float(n)) for n in tokens_of])
    price = table.select("word", F.log((F.col("n") - DISCOUNT) / per_class[F.col("class")]).alias("price"))
    rest = kept.select("row", F.explode("rest").alias("r")).select("row", "r.*")
    sums = rest.join(price, "word", "left").groupBy("row").agg(F.sum(F.col("times") * F.coalesce("price", "new")).alias("more"))
    total = F.col("total") + F.coalesce("more", F.lit(0.0))
    return kept.drop("rest").join(sums, "row", "left").select(
        F.col("id").alias(id_col), F.col("n").alias("n_tokens"), total.alias("log_prob"), F.when(F.col("n") > 0, total / F.col("n")).alias("mean_log_prob"))
