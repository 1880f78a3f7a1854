"""Quality classifier: random Fourier features, ridge regression, isotonic calibration.

A text becomes a fixed vector of document statistics. Random cosines of the
standardised vector approximate a Gaussian kernel, so a linear fit on them is a
kernel fit. Each partition of the training rows sums its share of the normal
equations; the sums meet on the driver, which solves them once (their size is the
square of the number of features, whatever the number of rows). A further part of
the training rows, kept out of the fit, gives the isotonic step that turns
scores into probabilities.

Training takes at most about `SAMPLE` labelled rows, chosen by hash. Whole texts
count, in training and in scoring.

Defined results: null texts are empty; empty texts are scored like any other; a
table without labels of both kinds gives every row the share of label 1 there is,
or 0.5; a doc_id with several labels takes the largest; rows with a null doc_id
have no label and count as not held out; repeated rows are rows; ties of scores
share a level; very long texts are described whole; an empty table gives an empty
result; other columns, whatever their names, are not read.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.llm.common import cut, opened, ship
from assayer.llm.langid import held_out
from assayer.llm.quality_rules import STOP_WORDS

#: Labelled rows that the classifier is fitted and calibrated on, at most about.
SAMPLE = 20_000
#: Partitions that the sample's statistics are summed in; each sends its sums, half a megabyte, to the driver.
PARTS = 16
FEATURES = 256
RIDGE = 1.0
SEED = 11
#: Of a hundred training rows, those kept for calibration.
CALIBRATE = 30
THRESHOLD = 0.3

_STOP = frozenset(STOP_WORDS)
_UPPER, _DIGIT = np.zeros(256, bool), np.zeros(256, bool)
_UPPER[65:91], _DIGIT[48:58] = True, True
_SYMBOL, _MARK, _BLANK = np.zeros(256, bool), np.zeros(256, bool), np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>~^=+{}[]\\@")], _MARK[list(b".,;:!?\"'()-/_")], _BLANK[list(b" \t\n\x0b\x0c\r")] = True, True, True


def statistics(text: str | None) -> list[float]:
    """The document statistics of a whole text."""
    text = text or ""
    raw = np.bincount(np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8), minlength=256)
    words = text.split()
    n, chars = len(words), max(1, int(raw.sum()))
    per = max(1, n)
    low = text.lower().split()
    lines = [s for s in text.split("\n") if s and not s.isspace()]
    share = raw / chars
    seen = share[share > 0]
    counts = Counter(low)
    return [
        np.log1p(n),
        sum(map(len, words)) / per,
        raw[_SYMBOL].sum() / per,
        raw[_MARK].sum() / per,
        raw[33] / per,
        raw[_UPPER].sum() / chars,
        raw[_DIGIT].sum() / chars,
        raw[_BLANK].sum() / chars,
        raw[128:].sum() / chars,
        sum(map(_STOP.__contains__, low)) / per,
        len(counts) / per,
        max(counts.values(), default=0) / per,
        len(set(zip(low, low[1:]))) / per,
        1 - len(set(lines)) / max(1, len(lines)),
        np.log1p(n / max(1, len(lines))),
        float(-(seen * np.log(seen)).sum()),
    ]


class Model:
    """Everything a score needs; plain arrays, of fixed size."""

    def __init__(self, mean, spread, weights, xs, ys):
        rng = np.random.default_rng(SEED)
        self.mean, self.spread, self.weights, self.xs, self.ys = mean, spread, weights, xs, ys
        d = len(mean)
        self.w, self.b = rng.normal(size=(d, FEATURES)) / np.sqrt(d), rng.uniform(0, 2 * np.pi, FEATURES)

    def features(self, stats: np.ndarray) -> np.ndarray:
        z = np.clip((stats - self.mean) / self.spread, -6, 6)
        return np.hstack([np.sqrt(2 / FEATURES) * np.cos(z @ self.w + self.b), np.ones((len(z), 1))])

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return self.features(stats) @ self.weights

    def score(self, stats: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.full(len(stats), self.ys)
        return np.clip(np.interp(self.raw(stats), self.xs, self.ys), 0.0, 1.0)


def solve(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """x of a x = b for a positive definite a, by elimination in place of a threaded LAPACK, which can hang beside the JVM."""
    a, b = a.copy(), b.astype(float).copy()
    for k in range(len(b)):
        f = a[k + 1 :, k] / a[k, k]
        a[k + 1 :, k:] -= f[:, None] * a[k, k:]
        b[k + 1 :] -= f * b[k]
    for k in range(len(b) - 1, -1, -1):
        b[k] = (b[k] - (a[k, k + 1 :] * b[k + 1 :]).sum()) / a[k, k]
    return b


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool-adjacent-violators fit of y on x: the pools' mean x, ascending, and their level.

    A pool's level is (ones + 1/2) / (rows + 1), so that no finite sample claims certainty.
    """
    order = np.lexsort((y, x))
    pools: list[list[float]] = []  # rows, sum of y, sum of x
    for a, b in zip(x[order].tolist(), y[order].tolist()):
        pools.append([1, b, a])
        while len(pools) > 1 and pools[-2][1] * pools[-1][0] >= pools[-1][1] * pools[-2][0]:
            n, s, t = pools.pop()
            pools[-1] = [pools[-1][0] + n, pools[-1][1] + s, pools[-1][2] + t]
    level = np.maximum.accumulate([(s + 0.5) / (n + 1) for n, s, _ in pools])
    return np.array([t / n for n, _, t in pools]), level


def _partition_sums(model: Model):
    """Per partition, the sums of the normal equations over rows (stats, label)."""

    def run(batches):
        size = FEATURES + 1
        left, right, n = np.zeros((size, size)), np.zeros(size), 0
        for b in batches:
            if b.num_rows:
                stats = np.array(b.column(0).to_pylist(), dtype=np.float64)
                f, y = model.features(stats), b.column(1).to_numpy(zero_copy_only=False).astype(np.float64)
                left, right, n = left + f.T @ f, right + f.T @ y, n + len(y)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([left.tobytes()], pa.binary()), pa.array([right.tobytes()], pa.binary())], names=["left", "right"])

    return run


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """A model from labelled rows that aren't held out (crc32 of doc_id not divisible by 5)."""
    own = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    own = own.where("doc_id is not null and quality is not null").where(~held_out(F.col("doc_id"), 5, 0))
    own = own.groupBy("doc_id").agg(F.max("quality").alias("quality"))
    n = own.count()
    h = F.pmod(F.xxhash64("doc_id", F.lit(SEED)), F.lit(1 << 30))
    own = own.where(h < int(min(1.0, SAMPLE / max(n, 1)) * (1 << 30)))  # about SAMPLE rows of two numbers: small enough to broadcast
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(own), "doc_id")

    def describe(batches):
        for b in batches:
            stats = [[float(v) for v in statistics(t.as_py())] for t in b.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(stats, pa.list_(pa.float64())), b.column(1), b.column(2)], names=["stats", "y", "calibrate"])

    split = F.pmod(F.xxhash64("doc_id", F.lit(SEED + 1)), F.lit(100)) < CALIBRATE
    rows = texts.select("text", F.col("quality").cast("double").alias("y"), split.alias("calibrate"))
    # few partitions: each gives its sums, whatever the number of files the texts came from
    rows = cut(rows.mapInArrow(describe, "stats array<double>, y double, calibrate boolean").repartition(PARTS))
    d = len(statistics(""))
    fit = rows.where("not calibrate")
    sums = fit.agg(F.count("*").alias("n"), F.sum("y").alias("ones"), *[f(F.col("stats")[i]).alias(f"{k}{i}") for i in range(d) for k, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    if not sums["n"] or sums["ones"] in (0.0, float(sums["n"])):
        share = rows.agg(F.avg("y")).first()[0]
        return Model(np.zeros(d), np.ones(d), None, None, 0.5 if share is None else float(share))
    mean, spread = (np.array([sums[f"{k}{i}"] for i in range(d)]) for k in "ms")
    model = Model(mean, np.where(spread > 1e-9, spread, 1.0), None, None, None)
    size = FEATURES + 1
    left, right = RIDGE * np.eye(size), np.zeros(size)
    left[-1, -1] = 1e-6
    for r in fit.select("stats", "y").mapInArrow(_partition_sums(model), "left binary, right binary").collect():  # at most PARTS rows
        left += np.frombuffer(r["left"]).reshape(size, size)
        right += np.frombuffer(r["right"])
    model.weights = solve(left, right)
    kept = rows.where("calibrate").select("stats", "y").toArrow()  # a share of the bounded sample
    kept = kept if kept.num_rows else fit.select("stats", "y").toArrow()
    model.xs, model.ys = isotonic(model.raw(np.array(kept.column(0).to_pylist())), kept.column(1).to_numpy())
    return model


def score_quality(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of `docs` (doc_id, text); labels: (doc_id, quality)."""
    shared = ship(docs.sparkSession, train(docs, labels))

    def run(batches):
        model = opened(shared)
        for b in batches:
            stats = np.array([statistics(t.as_py()) for t in b.column(1)], dtype=np.float64).reshape(b.num_rows, -1)
            score = model.score(stats) if b.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(score, pa.float64()), pa.array((score >= threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), held_out(F.col("doc_id"), 5, 0).alias("held_out"))
    return src.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
