"""Quality: how much better a zstandard dictionary of good text compresses a document than one of bad text."""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cleanloom.llm.common import free_name, map_rows, quoted, ref
from cleanloom.session import stored

# Labelled documents that fit the classifier; pieces of text a class' dictionary is built from, their bytes, and how many a
# document may give; bytes of a dictionary.
TRAIN_ROWS, PIECES, PIECE_BYTES, PIECES_EACH, DICT_BYTES = 20_000, 3_000, 2_048, 4, 65_536
# Text is compressed in windows of so many bytes, so that a long text does not become its own dictionary.
WINDOW_BYTES, LEVEL = 1_024, 3
# Thirds of the labelled documents: the last one only calibrates.
FOLDS = 3


def pieces(text: str | None) -> list[bytes]:
    """A few pieces at even distances over the whole text."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    n = min(PIECES_EACH, -(-len(raw) // PIECE_BYTES))
    last = max(0, len(raw) - PIECE_BYTES)
    return [raw[at:at + PIECE_BYTES] for at in np.linspace(0, last, n).astype(int).tolist()]


def dictionary(samples: list[bytes]) -> bytes:
    """A trained dictionary; of too few samples, their own bytes."""
    try:
        return zstandard.train_dictionary(DICT_BYTES, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-DICT_BYTES:]


def compressor(data: bytes) -> zstandard.ZstdCompressor:
    options = {"level": LEVEL, "write_content_size": False, "write_checksum": False, "write_dict_id": False}
    if len(data) < 8:
        return zstandard.ZstdCompressor(**options)
    known = zstandard.ZstdCompressionDict(data)
    known.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(dict_data=known, **options)


def expanded(x: np.ndarray) -> np.ndarray:
    """Difference, share and log length, with the square of the difference and its products with the other two."""
    return np.column_stack([x, x[:, 0] ** 2, x[:, 0] * x[:, 1], x[:, 0] * x[:, 2]])


def calibrated(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 30) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Means, scales and weights (the last one the offset) of a logistic regression by damped Newton steps."""
    mean, scale = x.mean(0), x.std(0)
    scale[scale == 0] = 1.0
    z = np.column_stack([(x - mean) / scale, np.ones(len(x))])
    keep = np.append(np.full(x.shape[1], ridge), 1e-3)
    w = np.zeros(z.shape[1])
    w[-1] = math.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))

    def loss(w: np.ndarray) -> float:
        s = z @ w
        return float(np.logaddexp(0, s).sum() - (y * s).sum() + (keep * w * w).sum() / 2)

    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -500, 500)))
        move = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(keep + 1e-9), z.T @ (p - y) + keep * w)
        size = 1.0
        while size > 1e-6 and loss(w - size * move) > loss(w):
            size /= 2
        w = w - size * move
    return mean, scale, w


@dataclass
class Judge:
    """Two dictionaries and the calibration; without both classes only the share of good documents."""

    good: bytes
    bad: bytes
    mean: np.ndarray | None = None
    scale: np.ndarray | None = None
    weights: np.ndarray | None = None
    prior: float = 0.5

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "tools"}

    @cached_property
    def tools(self) -> tuple[zstandard.ZstdCompressor, zstandard.ZstdCompressor]:
        return compressor(self.good), compressor(self.bad)

    def measure(self, text: str | None) -> tuple[float, float, float]:
        """(size with the bad dictionary - size with the good one) / both, mean size per byte, log of the length; of a whole text."""
        raw = (text or "").encode("utf-8", "surrogatepass")
        good, bad = self.tools
        a = b = 0
        for at in range(0, max(1, len(raw)), WINDOW_BYTES):
            window = raw[at:at + WINDOW_BYTES]
            a += len(good.compress(window))
            b += len(bad.compress(window))
        return (b - a) / (b + a), (a + b) / 2 / max(1, len(raw)), math.log1p(len(raw))

    def scores(self, texts: list[str | None]) -> list[float]:
        if self.weights is None or not texts:
            return [self.prior] * len(texts)
        x = (expanded(np.array([self.measure(t) for t in texts])) - self.mean) / self.scale
        return (1 / (1 + np.exp(-np.clip(x @ self.weights[:-1] + self.weights[-1], -500, 500)))).tolist()


def fit(train: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", train_rows: int = TRAIN_ROWS) -> Judge:
    """Dictionaries and calibration from at most ``train_rows`` labelled rows of ``train``, chosen by hash of the id.

    Two thirds of the chosen ids give the pieces of text that the dictionaries are built from, the others calibrate, so
    the calibration sees texts as new as those to be scored. Repeated labels of an id count once, the higher one; null ids
    and labels do not count. Only PIECES pieces a class and three numbers per calibrating row reach the driver.
    """
    spark = train.sparkSession
    chosen = labels.select(ref(id_col).alias("id"), ref(label_col).cast("int").alias("good")).dropna()
    chosen = chosen.groupBy("id").agg(F.max("good").alias("good")).where(F.col("good").isin(0, 1))
    chosen = chosen.join(train.select(ref(id_col).alias("id")).distinct(), "id", "left_semi")
    order = F.xxhash64(F.lit("quality"), "id")
    chosen = chosen.orderBy(order, "id").limit(train_rows)
    # One text stands for an id that occurs in several rows.
    rows = train.select(ref(id_col).alias("id"), ref(text_col).alias("text")).join(F.broadcast(chosen), "id")
    rows = stored(rows.groupBy("id").agg(F.max("good").alias("good"), F.min("text").alias("text")), "quality-sample")
    fold = F.pmod(F.xxhash64(F.lit("fold"), "id"), F.lit(FOLDS))
    cut = map_rows(rows.where(fold < FOLDS - 1), ["text"], "pieces array<binary>", lambda: lambda texts: {"pieces": [pieces(t) for t in texts]}, keep=True)
    cut = stored(cut.select("id", "good", F.posexplode("pieces").alias("at", "piece")), "quality-pieces")
    samples = [[bytes(r[0]) for r in cut.where(F.col("good") == k).orderBy(F.xxhash64(F.lit("piece"), "id", "at"), "id", "at").limit(PIECES).select("piece").collect()]
               for k in (0, 1)]
    judge = Judge(dictionary(samples[1]), dictionary(samples[0]))
    shared = spark.sparkContext.broadcast(judge)

    def make():
        tool = shared.value

        def step(texts):
            got = [tool.measure(t) for t in texts]
            return {name: [g[k] for g in got] for k, name in enumerate(("difference", "share", "length"))}

        return step

    measured = map_rows(rows.where(fold == FOLDS - 1), ["text"], "difference double, share double, length double", make, keep=True)
    got = measured.select("difference", "share", "length", "good").toPandas()
    y = got["good"].to_numpy(float)
    judge.prior = float((y.sum() + 0.5) / (len(y) + 1))
    if all(samples) and 0 < y.sum() < len(y):
        judge.mean, judge.scale, judge.weights = calibrated(expanded(got[["difference", "share", "length"]].to_numpy(float)), y)
    return judge


def with_score(df: DataFrame, judge: Judge, text_col: str = "text") -> tuple[DataFrame, str]:
    """The table with one more column, the score, and that column's name."""
    shared = df.sparkSession.sparkContext.broadcast(judge)
    name = free_name(df, "quality")
    return map_rows(df, [text_col], f"{quoted(name)} double", lambda: lambda texts: {name: shared.value.scores(texts)}, keep=True), name


def score_quality(df: DataFrame, train: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
                  threshold: float = 0.3, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """``id, score, predicted`` of every whole text; the score is the chance that it is good.

    A null or empty text is compressed like any other: both sizes are equal, and the calibration tells its score. Without
    labelled rows of both classes every score is the share of good ones, one half if there are none. Ids are kept as they are,
    null and repeated ones too; other columns are ignored; an empty table gives no rows.
    """
    judge = fit(train, labels, id_col, text_col, label_col, train_rows)
    out, name = with_score(df.select(ref(id_col).alias("id"), ref(text_col).alias("text")), judge, "text")
    return out.select(F.col("id").alias(id_col), ref(name).alias("score"), F.when(ref(name) >= threshold, 1).otherwise(0).alias("predicted"))
