"""Quality: random Fourier features over document statistics, ridge regression by summed normal equations, isotonic
calibration."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import discard, settle, small
from textloom.llm.line_rules import SYMBOLS, repeated_words

FEATURES, GAMMA, RIDGE, SEED = 256, 0.05, 1.0, 11
BINS, LOW, HIGH = 2000, -0.5, 1.5
#: Label rows with this remainder of a hash calibrate; the others fit the ridge.
CALIBRATE_MOD = 4
_TO_SYMBOLS = {ord(c): None for c in SYMBOLS}


def statistics(text: str) -> list[float]:
    """Numbers that describe a text; all zero without words."""
    words = text.split()
    n = len(words)
    if not n:
        return [0.0] * 18
    chars = sum(map(len, words))
    counts = Counter(words)
    lines = [x for x in text.split("\n") if x.strip()] or [text]
    letters = sum(map(str.isalpha, text))
    upper = sum(map(str.isupper, text))
    marks = chars - letters
    ends = sum(w[-1] in ".!?" for w in words)
    return [
        math.log1p(n), chars / n, upper / max(1, letters), marks / chars, (len(text) - len(text.translate(_TO_SYMBOLS))) / chars,
        text.count("!") / n, text.count("|") / n, sum(map(str.isdigit, text)) / chars, len(counts) / n, counts.most_common(1)[0][1] / n,
        sum(map(str.__eq__, words, words[1:])) / n, repeated_words(text.encode("utf-8", "surrogatepass").split()) / n,
        1 - len(set(lines)) / len(lines), math.log1p(n / len(lines)), sum(x.rstrip()[-1] in ".!?" for x in lines) / len(lines),
        ends / n, sum(len(w) <= 3 for w in words) / n, max(map(len, words)) / 40,
    ]


def document_statistics(docs: DataFrame) -> DataFrame:
    """doc_id and statistics of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                rows = [statistics(t or "") for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(rows, pa.list_(pa.float64()))], ["doc_id", "stats"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, stats array<double>")


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _summed(df: DataFrame, of, size: int) -> np.ndarray:
    """Sums a vector over all rows: each partition sums its rows, a second step sums the partitions' vectors in eight
    tasks, and eight vectors come to the driver."""

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            if batch.num_rows:
                total += of(_matrix(batch.column(0)), batch.column(1).to_numpy(zero_copy_only=False).astype(float))
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["v"])

    def second(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            for v in batch.column(0).to_pylist():
                total += np.frombuffer(v)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["v"])

    parts = df.select("stats", "y").mapInArrow(first, "v binary").repartition(8).mapInArrow(second, "v binary").collect()
    return np.sum([np.frombuffer(r["v"]) for r in parts], axis=0) if parts else np.zeros(size)


def isotonic(weights: np.ndarray, sums: np.ndarray) -> np.ndarray:
    """Pools adjacent violators: the non-decreasing means of bins with these weights and sums of labels."""
    blocks: list[list[float]] = []
    for w, s in zip(weights, sums, strict=True):
        blocks.append([w, s, 1])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][0] >= blocks[-1][1] * blocks[-2][0]:
            w2, s2, k2 = blocks.pop()
            blocks[-1] = [blocks[-1][0] + w2, blocks[-1][1] + s2, blocks[-1][2] + k2]
    return np.concatenate([np.full(int(k), s / w) for w, s, k in blocks]) if blocks else np.empty(0)


class QualityModel:
    """Fixed random features, the ridge's coefficients and the calibration's steps."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray) -> None:
        draw = np.random.default_rng(SEED)
        self.mean, self.scale = mean, scale
        self.turn = draw.normal(0, math.sqrt(2 * GAMMA), (len(mean), FEATURES))
        self.shift = draw.uniform(0, 2 * math.pi, FEATURES)
        self.beta = np.zeros(1 + len(mean) + FEATURES)
        self.knots, self.values = np.array([0.0, 1.0]), np.array([0.0, 1.0])

    def expand(self, stats: np.ndarray) -> np.ndarray:
        x = np.clip((stats - self.mean) / self.scale, -5, 5)
        return np.hstack([np.ones((len(x), 1)), x, math.sqrt(2 / FEATURES) * np.cos(x @ self.turn + self.shift)])

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return self.expand(stats) @ self.beta

    def score(self, stats: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.raw(stats), self.knots, self.values), 0, 1)


def train_quality(stats: DataFrame, labels: DataFrame, where: Column, label: str = "quality", limit: int | None = None) -> QualityModel:
    """Fits on all label rows that fulfil ``where`` (null labels and ids are left out, of a repeated id one label
    counts). Three quarters of them, by a hash of doc_id, give the normal equations; the rest calibrate. Only sums
    come to the driver: means, one matrix of fixed size, counts of BINS bins. Without rows every score is a half."""
    known = settle(labels.where(where & F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(label).cast("double").alias("y")), "labels")
    rows = settle(stats.join(small(known, limit), "doc_id"), "training")
    held = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(CALIBRATE_MOD)) == 0
    fit, rest = rows.where(~held), rows.where(held)
    d = len(statistics(""))
    first = _summed(fit, lambda x, y: np.concatenate([[len(x)], x.sum(0), (x * x).sum(0)]), 1 + 2 * d)
    n = max(first[0], 1)
    mean = first[1 : 1 + d] / n
    model = QualityModel(mean, np.sqrt(np.maximum(first[1 + d :] / n - mean**2, 1e-12)))
    k = len(model.beta)

    def equations(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        z = model.expand(x)
        return np.concatenate([(z.T @ z).ravel(), z.T @ y])

    total = _summed(fit, equations, k * k + k)
    penalty = np.eye(k) * RIDGE
    penalty[0, 0] = 1e-9
    model.beta = np.linalg.solve(total[: k * k].reshape(k, k) + penalty, total[k * k :])

    def bins(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        at = np.clip(((model.raw(x) - LOW) / (HIGH - LOW) * BINS).astype(int), 0, BINS - 1)
        return np.concatenate([np.bincount(at, minlength=BINS), np.bincount(at, y, minlength=BINS)])

    counted = _summed(rest, bins, 2 * BINS)
    weights, sums = counted[:BINS], counted[BINS:]
    full = np.flatnonzero(weights)
    if len(full):
        model.knots = LOW + (full + 0.5) * (HIGH - LOW) / BINS
        model.values = isotonic(weights[full], sums[full])
    elif not first[0]:
        model.values = np.array([0.5, 0.5])
    discard(known, rows)
    return model


def score_quality(stats: DataFrame, model: QualityModel) -> DataFrame:
    """doc_id and score of every row of statistics."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(_matrix(batch.column(1))))], ["doc_id", "score"])

    return stats.select("doc_id", "stats").mapInArrow(run, "doc_id long, score double")
