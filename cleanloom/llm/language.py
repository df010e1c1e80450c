"""Language ID: sparse multinomial logistic regression on TF-IDF character n-grams."""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cleanloom.llm.common import kind, map_rows, quoted, ref, spread_sample

# n-grams of 1 to 3 characters fall into 2**BITS buckets; about TRAIN_ROWS labelled documents fit the weights.
BITS, ORDERS = 15, (1, 2, 3)
TRAIN_ROWS = 4_000
# Characters hashed at a time.
SLICE = 1 << 20
UNKNOWN = "und"
_LETTER = re.compile(r"[^\W\d_]")
_MIX = (np.uint32(0x9E3779B1), np.uint32(0x85EBCA6B), np.uint32(0xC2B2AE35))


def buckets(text: str) -> list[np.ndarray]:
    """Bucket of every n-gram of the whole lower-cased text, in slices of bounded size."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint32, copy=False)
    out = []
    for at in range(0, len(codes), SLICE):
        c = codes[at:at + SLICE + max(ORDERS) - 1]
        size = min(SLICE, len(codes) - at)
        mixed = [c * m for m in _MIX]
        for n in ORDERS:
            h = mixed[0][:size].copy()
            for k in range(1, n):
                tail = mixed[k][k:k + size]
                h = h[:len(tail)] ^ tail
            h ^= h >> np.uint32(15)
            h *= np.uint32(0x2C1B3C6D + 2 * n)
            out.append((h >> np.uint32(32 - BITS)).astype(np.int32))
    return out


def counts(df: DataFrame, text_col: str) -> tuple[int, np.ndarray]:
    """Number of documents, and in how many each bucket occurs, over every row.

    A task keeps one vector of bucket counts and emits it once; the sums are bounded by the number of buckets.
    """
    def run(batches):
        import pyarrow as pa
        seen, total = np.zeros(1 << BITS, np.int64), 0
        for batch in batches:
            for text in batch.column(0).to_pylist():
                mark = np.zeros(1 << BITS, bool)
                for h in buckets(text or ""):
                    mark[h] = True
                seen += mark
                total += 1
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1), pa.int32()), pa.array(np.append(seen[at], total), pa.int64())], names=["bucket", "n"])

    got = df.select(ref(text_col).alias("text")).mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    found = np.zeros(1 << BITS)
    real = got[got["bucket"] >= 0]
    found[real["bucket"].to_numpy()] = real["n"].to_numpy()
    return int(got.loc[got["bucket"] < 0, "n"].sum()), found


class Ftrl:
    """Follow-the-regularised-leader with elastic net, for a softmax over sparse rows."""

    def __init__(self, width: int, classes: int, alpha: float = 1.0, beta: float = 1.0, l1: float = 2e-3, l2: float = 1e-3):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z = np.zeros((width, classes))
        self.n = np.zeros((width, classes))

    def weights(self, at=slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        return np.where(np.abs(z) <= self.l1, 0.0, -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def learn(self, at: np.ndarray, x: np.ndarray, label: int) -> None:
        w = self.weights(at)
        p = softmax((x @ w)[None, :])[0]
        p[label] -= 1
        g = x[:, None] * p[None, :]
        n = self.n[at]
        more = n + g * g
        self.z[at] += g - (np.sqrt(more) - np.sqrt(n)) / self.alpha * w
        self.n[at] = more


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


@dataclass
class Model:
    """Languages, bucket weights with the idf factored in, offsets, and the softmax temperature."""

    names: list[str]
    table: np.ndarray
    offset: np.ndarray
    temperature: float

    def predict(self, text: str | None) -> tuple[str, float]:
        if text is None or not self.names or not _LETTER.search(text):
            return UNKNOWN, 0.0
        total, n = np.zeros(len(self.names)), 0
        for h in buckets(text):
            total += self.table[h].sum(axis=0, dtype=np.float64)
            n += len(h)
        p = softmax(((total / n + self.offset) / self.temperature)[None, :])[0]
        best = int(p.argmax())
        return self.names[best], float(p[best])


# Scales the mean over n-grams to values about 1.
GAIN = 30.0


def fit(df: DataFrame, id_col: str, text_col: str, lang_col: str, train_rows: int = TRAIN_ROWS, epochs: int = 5) -> Model:
    """Fit on rows with a language: document frequencies over all of them, weights on about ``train_rows`` by hash of the row.

    A fifth of the sample is held back to calibrate the temperature. The driver gets bucket counts, the sorted names
    of the languages and the sparse rows of the sample.
    """
    labelled = df.where(ref(lang_col).isNotNull()).select(ref(id_col).alias("id"), ref(text_col).alias("text"), ref(lang_col).cast("string").alias("lang"))
    total, seen = counts(labelled, "text")
    names = sorted(r[0] for r in labelled.select("lang").distinct().collect())
    if not total or not names:
        return Model([], np.zeros((1 << BITS, 0), np.float32), np.zeros(0), 1.0)
    idf = np.log((1 + total) / (1 + seen)) + 0.1

    def make():
        def step(texts: list) -> dict[str, list]:
            at, x = [], []
            for text in texts:
                found = np.concatenate(buckets(text or "") or [np.zeros(0, np.int32)])
                which, n = np.unique(found, return_counts=True)
                at.append(which.tolist())
                x.append((n / max(1, len(found))).tolist())
            return {"at": at, "x": x}
        return step

    sample = spread_sample(labelled, train_rows, total)
    got = map_rows(sample, ["text"], "at array<int>, x array<float>", make, keep=True).select("lang", "at", "x").toPandas()
    label = {name: i for i, name in enumerate(names)}
    order = np.random.default_rng(7).permutation(len(got))
    held = order[::5] if len(order) >= 10 else order
    train = np.setdiff1d(order, held) if len(order) >= 10 else order
    tool = Ftrl((1 << BITS) + 1, len(names))
    rows = []
    for at, x, lang in zip(got["at"], got["x"], got["lang"]):
        at = np.asarray(at, np.int64)
        rows.append((np.append(at, 1 << BITS), np.append(np.asarray(x, float) * idf[at] * GAIN, 1.0), label[lang]))
    for epoch in range(epochs):
        for i in np.random.default_rng(epoch).permutation(train):
            tool.learn(*rows[i])
    w = tool.weights()
    scores = np.array([x @ w[at] for at, x, _ in (rows[i] for i in held)]).reshape(-1, len(names))
    truth = np.array([rows[i][2] for i in held], np.int64)
    grid = np.exp(np.linspace(np.log(0.05), np.log(20), 60))
    loss = [-np.log(softmax(scores / t)[np.arange(len(truth)), truth] + 1e-12).mean() if len(truth) else 0.0 for t in grid]
    return Model(names, (w[:-1] * (idf * GAIN)[:, None]).astype(np.float32), w[-1], float(grid[int(np.argmin(loss))]))


def identify(df: DataFrame, train: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
             train_rows: int = TRAIN_ROWS) -> DataFrame:
    """``id, lang_pred, score`` of every whole text; the model is fitted on ``train``.

    Features are the relative frequencies of all character n-grams of the lower-cased text times idf. A null text, or one
    without a letter, is ``und`` with score 0; so is everything if ``train`` has no language. Ids are kept as they are,
    null and repeated ones too; other columns are ignored; equal scores go to the first name in order.
    """
    shared = df.sparkSession.sparkContext.broadcast(fit(train, id_col, text_col, lang_col, train_rows))

    def make():
        model = shared.value

        def step(ids: list, texts: list) -> dict[str, list]:
            found = [model.predict(t) for t in texts]
            return {id_col: ids, "lang_pred": [f[0] for f in found], "score": [f[1] for f in found]}
        return step

    return map_rows(df, [id_col, text_col], f"{quoted(id_col)} {kind(df, id_col)}, lang_pred string, score double", make)
