"""Toxicity: noisy-channel deobfuscation under a character model, then a score of the restored text."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cleanloom.llm.common import free_name, map_rows, quoted, ref
from cleanloom.session import stored

# Letters of the character model: a-z and the small letters of Latin-1; state 0 is the border of a word.
LETTERS = "abcdefghijklmnopqrstuvwxyz" + "".join(chr(c) for c in range(0xDF, 0x100) if c != 0xF7)
STATE = {c: i + 1 for i, c in enumerate(LETTERS)}
# Letters that a character may stand for, besides itself.
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "bg", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i",
        "|": "il", "+": "t", "(": "c", "<": "c", "€": "e", "£": "l", "¡": "i", "µ": "u"}
# Log-probabilities of the channel: a written sign for a letter, such a sign put between letters for nothing, any other
# sign put between letters, a letter written again.
SIGN, BETWEEN, FILLER, AGAIN = -1.0, -9.0, -0.7, -2.0
# Labelled documents that fit the classifier, words it keeps, least documents a word must occur in.
TRAIN_ROWS, FEATURES, LEAST = 20_000, 4_096, 3
# A worker forgets restored tokens beyond this many; a task passes its counts of terms on beyond COUNTED.
REMEMBERED, COUNTED = 100_000, 50_000
_EDGE = ".,;:!?\"'()[]{}<>«»¡¿…-–—"
_WORD = re.compile(r"[^\W\d_]+")
_SPACED = re.compile(r"(?<!\S)\S(?:\s\S){2,}(?!\S)")
_TRIPLE = re.compile(r"(.)\1\1")
# Signs written three times or more at an end of a token are ornament.
_ORNAMENT = re.compile(r"^([^\w\s])\1{2,}|([^\w\s])\2{2,}$")


def letter_counts(df: DataFrame, text_col: str) -> np.ndarray:
    """Counts of neighbouring letters (state x state) over every whole text; one small vector a task."""
    size = len(LETTERS) + 1
    table = np.zeros(0x10000, np.int64)
    for c, s in STATE.items():
        table[ord(c)] = s

    def run(batches):
        total = np.zeros(size * size, np.int64)
        for batch in batches:
            for text in batch.column(0).to_pylist():
                if text:
                    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
                    for at in range(0, len(codes), 1 << 20):
                        s = table[np.minimum(codes[max(0, at - 1):at + (1 << 20)], 0xFFFF)]
                        total += np.bincount(s[:-1] * size + s[1:], minlength=size * size)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], names=["pair", "n"])

    got = df.select(ref(text_col).alias("text")).mapInArrow(run, "pair int, n long").groupBy("pair").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(size * size)
    out[got["pair"].to_numpy(np.int64)] = got["n"].to_numpy()
    return out.reshape(size, size)


@dataclass
class Channel:
    """Character bigram model and the decoder of noisy tokens."""

    log: list[list[float]]
    memory: dict[str, tuple[str, ...]] = field(default_factory=dict)

    @classmethod
    def of(cls, counts: np.ndarray) -> "Channel":
        smooth = counts + 0.1 + 0.01 * counts.sum(0, keepdims=True) / max(1.0, counts.sum())
        return cls(np.log(smooth / smooth.sum(1, keepdims=True)).tolist())

    def decode(self, token: str) -> str:
        """Best word for a noisy token: Viterbi over its lattice. A state is the last letter put out.

        Each character may stand for itself, for a letter it looks like, or for nothing: signs between letters and
        letters written again are dropped at a price.
        """
        log = self.log
        # state -> (score, chain of letters); a chain is (letter, chain before).
        states: dict[int, tuple[float, tuple | None]] = {0: (0.0, None)}
        last = ""
        for c in token:
            now: dict[int, tuple[float, tuple | None]] = {}
            own = STATE.get(c)
            options = [(own, 0.0, c)] if own else [(STATE[x], SIGN, x) for x in LEET.get(c, "")]
            drop = None if own and c != last else AGAIN if own else BETWEEN if c in LEET else FILLER
            for state, (score, chain) in states.items():
                for to, price, letter in options:
                    new = score + price + log[state][to]
                    if to not in now or new > now[to][0]:
                        now[to] = (new, (letter, chain))
                if drop is not None and (not own or state == own):
                    new = score + drop
                    if state not in now or new > now[state][0]:
                        now[state] = (new, chain)
            if now:
                states = now
            last = c
        chain = max(((score + log[state][0], chain) for state, (score, chain) in states.items()), key=lambda x: x[0])[1]
        out = []
        while chain:
            out.append(chain[0])
            chain = chain[1]
        return "".join(reversed(out))

    def words(self, token: str) -> tuple[str, ...]:
        """Words of one token between white space, as written and as restored."""
        found = self.memory.get(token)
        if found is not None:
            return found
        core = _ORNAMENT.sub("", token.strip(_EDGE)).strip(_EDGE)
        if core.isalpha() and not _TRIPLE.search(core):
            found = (core,)
        else:
            plain = _WORD.findall(core)
            restored = self.decode(core) if plain or any(c in LEET for c in core) and not core.isdigit() else ""
            found = tuple(dict.fromkeys([*plain, restored] if restored else plain))
        if len(self.memory) > REMEMBERED:
            self.memory.clear()
        if len(token) <= 64:
            self.memory[token] = found
        return found

    def restore(self, text: str) -> tuple[set[str], list[str]]:
        """Distinct words of a whole text, and the restored letters of runs like ``s p a c e d``."""
        text = text.lower()
        known, out, memory = self.words, set(), self.memory
        for token in set(text.split()):
            words = memory.get(token)
            out.update(known(token) if words is None else words)
        return out, [self.decode("".join(m.group().split())) for m in _SPACED.finditer(text)]

    def restored_text(self, text: str) -> str:
        """The text with noisy tokens replaced by their restored words; for reading and tests."""
        text = _SPACED.sub(lambda m: self.decode("".join(m.group().split())), text.lower())
        return " ".join(" ".join(self.words(t)[-1:]) for t in text.split())


def terms(words: set[str]) -> set[str]:
    """Features of a document: its words and the first four and five letters of longer ones."""
    return words | {f"^{w[:5]}" for w in words if len(w) > 5} | {f"^{w[:4]}" for w in words if len(w) > 4}


@dataclass
class Scorer:
    """Weights of telling terms; spaced runs are searched for telling words inside."""

    channel: Channel
    weights: dict[str, float]
    offset: float

    def inside(self, run: str) -> list[str]:
        return [run[a:b] for a in range(len(run)) for b in range(a + 4, min(len(run), a + 16) + 1) if self.weights.get(run[a:b], 0.0) > 0]

    def score(self, text: str | None) -> float:
        words, runs = self.channel.restore(text or "")
        for run in runs:
            words.update(self.inside(run))
        get = self.weights.get
        z = self.offset
        for w in words:
            z += get(w, 0.0)
        if self.prefixes:
            found = {w[:5] for w in words if len(w) > 5} & self.prefixes | {w[:4] for w in words if len(w) > 4} & self.prefixes
            z += sum(self.weights["^" + p] for p in found)
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, z))))

    def __post_init__(self) -> None:
        self.prefixes = {t[1:] for t in self.weights if t[0] == "^"}


def logistic(rows: np.ndarray, cols: np.ndarray, y: np.ndarray, width: int, l2: float = 0.05, steps: int = 400) -> tuple[np.ndarray, float]:
    """Weights and offset of a logistic regression over sparse 0/1 rows: full-batch steps, per-weight rates."""
    w, b, n = np.zeros(width), math.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5)), len(y)
    gw, gb = np.full(width, 1e-6), 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(rows, w[cols], n) + b, -500, 500)))
        g = np.bincount(cols, (p - y)[rows], width) + l2 * w
        gw += g * g
        w -= 0.5 * g / np.sqrt(gw)
        d = float((p - y).sum())
        gb += d * d
        b -= 0.5 * d / math.sqrt(gb)
    return w, b


def telling(labelled: DataFrame, channel, positives: int, negatives: int) -> list[str]:
    """Terms whose share among the toxic documents differs surely from that among the others (likelihood ratio)."""
    def run(batches):
        tally: dict[str, list[int]] = {}
        tool = channel.value

        def out():
            return pa.RecordBatch.from_arrays([pa.array(list(tally), pa.string()), pa.array([v[1] for v in tally.values()], pa.int64()),
                                               pa.array([v[0] for v in tally.values()], pa.int64())], names=["term", "p", "n"])

        for batch in batches:
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for t in terms(tool.restore(text or "")[0]):
                    tally.setdefault(t, [0, 0])[toxic] += 1
                if len(tally) > COUNTED:
                    yield out()
                    tally.clear()
        yield out()

    counts = labelled.select("text", "toxic").mapInArrow(run, "term string, p long, n long").groupBy("term").agg(F.sum("p").alias("p"), F.sum("n").alias("n"))
    counts = counts.where((F.col("p") + F.col("n") >= LEAST) & (F.col("p") > 0))
    share = (F.col("p") + F.col("n")) / (positives + negatives)

    def part(seen, of):
        return F.when(seen > 0, seen * F.log(seen / (share * of))).otherwise(0.0)

    ratio = 2 * (part(F.col("p"), positives) + part(F.col("n"), negatives))
    kept = counts.withColumn("gain", ratio).where((F.col("gain") > 8) & (F.col("p") / positives > 2 * F.col("n") / max(1, negatives)))
    return [r[0] for r in kept.orderBy(F.desc("gain"), "term").limit(FEATURES).select("term").collect()]


def fit(df: DataFrame, train: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, train_rows: int = TRAIN_ROWS) -> Scorer:
    """Character model over all texts of ``df``; classifier on at most ``train_rows`` labelled rows of ``train``, chosen by hash of the id.

    Repeated labels of an id count once, the higher one; null ids and labels do not count. Only the chosen ids, the kept
    terms and the sparse rows of the chosen documents reach the driver.
    """
    spark = df.sparkSession
    channel = Channel.of(letter_counts(df, text_col))
    shared = spark.sparkContext.broadcast(channel)
    chosen = labels.select(ref(id_col).alias("id"), ref(label_col).cast("int").alias("toxic")).dropna()
    chosen = chosen.groupBy("id").agg(F.max("toxic").alias("toxic")).where(F.col("toxic").isin(0, 1))
    chosen = chosen.join(train.select(ref(id_col).alias("id")).distinct(), "id", "left_semi").orderBy(F.xxhash64(F.lit("toxic"), "id"), "id").limit(train_rows)
    rows = train.select(ref(id_col).alias("id"), ref(text_col).alias("text")).join(F.broadcast(chosen), "id")
    rows = stored(rows, "toxicity-sample")
    tally = {r[0]: r[1] for r in rows.groupBy("toxic").count().collect()}
    positives, negatives = tally.get(1, 0), tally.get(0, 0)
    if not positives:
        return Scorer(channel, {}, -50.0)
    names = telling(rows, shared, positives, negatives)
    place = {t: i for i, t in enumerate(names)}

    def make():
        tool = shared.value
        return lambda texts: {"at": [[place[t] for t in terms(tool.restore(x or "")[0]) if t in place] for x in texts]}

    got = map_rows(rows, ["text"], "at array<int>", make, keep=True).select("toxic", "at").toPandas()
    sizes = np.fromiter(map(len, got["at"]), np.int64, len(got))
    cols = np.concatenate([np.asarray(a, np.int64) for a in got["at"]] or [np.zeros(0, np.int64)])
    weights, offset = logistic(np.repeat(np.arange(len(got)), sizes), cols, got["toxic"].to_numpy(float), len(names))
    return Scorer(channel, {t: float(w) for t, w in zip(names, weights) if abs(w) > 1e-6}, offset)


def with_score(df: DataFrame, model: Scorer, text_col: str = "text") -> tuple[DataFrame, str]:
    """The table with one more column, the score, and that column's name."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    name = free_name(df, "toxicity")

    def make():
        tool = shared.value
        return lambda texts: {name: [tool.score(t) for t in texts]}

    return map_rows(df, [text_col], f"{quoted(name)} double", make, keep=True), name


def score_toxicity(df: DataFrame, train: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
                   train_rows: int = TRAIN_ROWS) -> DataFrame:
    """``id, score, predicted`` of every whole text.

    Tokens with signs, digits, repeated letters or spaced letters are decoded to the likeliest word under a character
    model of all texts; a logistic regression over the restored words gives the score. A null or empty text gets the
    score of a document without words, 0 if nothing toxic was labelled. Ids are kept as they are, null and repeated ones too;
    other columns are ignored; long texts are read whole.
    """
    model = fit(df, train, labels, id_col, text_col, label_col, train_rows)
    out, name = with_score(df.select(ref(id_col).alias("id"), ref(text_col).alias("text")), model)
    return out.select(F.col("id").alias(id_col), ref(name).alias("score"), F.when(ref(name) >= 0.5, 1).otherwise(0).alias("predicted"))
