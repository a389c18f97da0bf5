"""Quality scores from random Fourier features of document statistics.

Statistics of the whole text (lengths, shares of kinds of characters, variety and
repetition of words and lines) are standardised and mapped to random Fourier features,
whose inner products approximate a Gaussian kernel. Ridge scores come from the normal
equations, which every partition sums on its own and a few tasks add up, so fitting takes
any number of labelled rows and the driver sees a few matrices of a fixed size. Isotonic
calibration, over BINS bins of the raw score, turns scores into chances of label 1.

Learnt are labels of training rows alone; labels, language, source and id are no inputs.

Defined cases: a null text is empty, and an empty text has statistics like any other;
several labels of a document are averaged; null labels are ignored; without labelled
training rows every score is 0.5, with one kind of label only it is that label; rows of
equal id are scored each; an empty table gives an empty result.
"""

from __future__ import annotations

from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C

FEATURES = 256
#: Width of the kernel in standard deviations of all statistics together.
WIDTH = 4.0
RIDGE = 1e-4
BINS = 1024
SEED = 20240501
#: Weight of the raw score in the calibrated one; it only orders what calibration ties.
TIES = 1e-3
SUMS = 8

_CLASSES = np.zeros((8, 256), np.float64)
for _k, _set in enumerate((range(65, 91), range(97, 123), range(48, 58), range(128, 256), b"#*$%&<>@^~", b"|", b"!", b".,;:?")):
    _CLASSES[_k, list(_set)] = 1


def statistics(text: bytes) -> list[float]:
    """The inputs of the model."""
    kinds = _CLASSES @ np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    words, lines = text.split(), [x for x in text.split(b"\n") if x.strip()]
    n, n_lines = len(words), len(lines)
    some, chars = max(1, n), max(1, len(text))
    upper, lower, digit, other, symbol, bar, bang, stop = kinds.tolist()
    letters = max(1.0, upper + lower)
    pairs = max(1, n - 1)
    counts = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    return [
        np.log1p(n),
        np.log1p(n_lines),
        min(40.0, len(text) / some),
        upper / letters,
        digit / chars,
        other / chars,
        min(3.0, symbol / some),
        min(3.0, bar / some),
        min(3.0, bang / some),
        min(3.0, stop / some),
        np.log1p(len(counts)) / np.log1p(some),
        len(counts) / some,
        sum(map(eq, words, words[1:])) / pairs,
        len(set(zip(words, words[1:]))) / pairs,
        max(counts.values(), default=0) / some,
        len(set(lines)) / max(1, n_lines),
        np.log1p(n / max(1, n_lines)),
    ]


def _features(batches):
    for b in batches:
        xs = [statistics(t.as_py() or b"") for t in b.column(1)]
        flat = pa.array(np.array(xs, np.float64).reshape(-1))
        width = len(statistics(b""))
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(xs) + 1) * width, pa.int32()), flat)
        yield pa.RecordBatch.from_arrays([b.column(0), lists], ["row", "x"])


def features(docs: DataFrame, text: str = "text") -> DataFrame:
    """Struct `row` (docs without the text) and the statistics x."""
    C.bounded_memory(docs.sparkSession)
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns if c != text]).alias("row"), F.encode(docs[text], "UTF-8").alias("body"))
    return rows.mapInArrow(_features, rows.select("row", F.lit(None).cast("array<double>").alias("x")).schema)


class Model:
    """Standardisation, random features, ridge weights and calibration."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray):
        rng = np.random.default_rng(SEED)
        self.mean, self.scale = mean, scale
        self.w = rng.standard_normal((len(mean), FEATURES)) / WIDTH
        self.b = rng.uniform(0, 2 * np.pi, FEATURES)
        self.beta = np.zeros(FEATURES + 1)
        self.at, self.to = np.array([0.0]), np.array([0.5])

    def map(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -6, 6) @ self.w + self.b
        return np.hstack([np.cos(z) * np.sqrt(2 / FEATURES), np.ones((len(x), 1))])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.map(x) @ self.beta

    def score(self, x: np.ndarray) -> np.ndarray:
        raw = self.raw(x)
        order = 1 / (1 + np.exp(-np.clip(4 * (raw - 0.5), -30, 30)))
        return np.clip((1 - TIES) * np.interp(raw, self.at, self.to) + TIES * order, 0, 1)


def isotonic(at: np.ndarray, y: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators of bins at (ascending): places and values to interpolate."""
    blocks: list[list[float]] = []
    for a, v, k in zip(at, y, n):
        blocks.append([a * k, v, k])
        while len(blocks) > 1 and blocks[-2][1] / blocks[-2][2] >= blocks[-1][1] / blocks[-1][2]:
            last = blocks.pop()
            blocks[-1] = [p + q for p, q in zip(blocks[-1], last)]
    return np.array([b[0] / b[2] for b in blocks]), np.array([b[1] / b[2] for b in blocks])


def _matrix(column) -> np.ndarray:
    return column.values.to_numpy()[column.offsets.to_numpy()[0] :].reshape(len(column), -1)


def _sums(model: Model):
    def run(batches):
        a, v = np.zeros((FEATURES + 1, FEATURES + 1)), np.zeros(FEATURES + 1)
        for b in batches:
            if b.num_rows:
                z = model.map(_matrix(b.column(0)))
                a += z.T @ z
                v += z.T @ b.column(1).to_numpy()
        yield pa.RecordBatch.from_arrays([pa.array([a.tobytes()]), pa.array([v.tobytes()])], ["a", "v"])

    return run


def _added(batches):
    parts = [(np.frombuffer(a.as_py()), np.frombuffer(v.as_py())) for b in batches for a, v in zip(b.column(0), b.column(1))]
    if parts:
        a, v = (sum(p[k] for p in parts) for k in (0, 1))
        yield pa.RecordBatch.from_arrays([pa.array([a.tobytes()]), pa.array([v.tobytes()])], ["a", "v"])


def _raw(model: Model):
    def run(batches):
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array(model.raw(_matrix(b.column(0)))), b.column(1)], ["raw", "y"])

    return run


def fit(train: DataFrame) -> Model:
    """A model of labelled rows (x, y); train is read three times, so it should be settled."""
    width = len(statistics(b""))
    cells = [F.col("x")[i] for i in range(width)]
    row = train.agg(F.count("y"), F.min("y"), F.max("y"), *[F.avg(c) for c in cells], *[F.stddev_pop(c) for c in cells]).first()
    n, low, high = row[:3]
    if not n or low == high:
        model = Model(np.zeros(width), np.ones(width))
        model.to = np.array([float(low) if n else 0.5])
        return model
    mean, scale = np.array(row[3 : 3 + width]), np.array(row[3 + width :])
    model = Model(mean, np.where(scale > 1e-9, scale, 1.0))
    parts = train.select("x", "y").mapInArrow(_sums(model), "a binary, v binary").repartition(SUMS).mapInArrow(_added, "a binary, v binary").collect()
    a = sum(np.frombuffer(p.a) for p in parts).reshape(FEATURES + 1, FEATURES + 1)
    model.beta = np.linalg.solve(a + RIDGE * n * np.eye(FEATURES + 1), sum(np.frombuffer(p.v) for p in parts))
    scored = train.select("x", "y").mapInArrow(_raw(model), "raw double, y double")
    bin_ = F.floor((F.greatest(F.lit(-0.5), F.least(F.lit(1.5), F.col("raw"))) + 0.5) / 2 * BINS)
    bins = scored.groupBy(bin_.alias("bin")).agg(F.avg("raw").alias("at"), F.sum("y").alias("y"), F.count("*").alias("n")).orderBy("bin").collect()
    model.at, model.to = isotonic(*(np.array([float(b[c]) for b in bins]) for c in ("at", "y", "n")))
    return model


def _scores(model: Model):
    def run(batches):
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(model.score(_matrix(b.column(1))))], ["row", "score"])

    return run


def score(docs: DataFrame, labels: DataFrame, held_out: Column, text: str = "text", key: str = "doc_id", label: str = "quality") -> DataFrame:
    """Struct `row` (docs without the text) and score, learnt from the labels of rows for whose
    `key` the condition held_out (on the column `key`) doesn't hold."""
    x = C.settle(features(docs, text), "quality-features")
    y = labels.select(labels[key].alias("key"), labels[label].cast("double").alias("y"))
    y = y.where(F.col("key").isNotNull() & F.col("y").isNotNull() & ~held_out).groupBy("key").agg(F.avg("y").alias("y"))
    train = C.settle(x.join(y, F.col("row").getField(key) == F.col("key")).select("x", "y"), "quality-train")
    schema = x.select("row", F.lit(0.0).alias("score")).schema
    return x.mapInArrow(_scores(fit(train)), schema)
