"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.llm.words import gram_hashes

BITS = 20
#: The documented bound of the training sample: so many labelled rows come to the driver at most, as hashed features.
TRAIN_ROWS = 8_000
EPOCHS = 8
ALPHA, BETA, L1, L2 = 1.0, 1.0, 30.0, 0.0
#: Documents of the rarer label 1 count so often at most.
MAX_WEIGHT = 10.0
STRIP = bytes(b for b in range(33, 127) if not chr(b).isalnum())


class _Normal(dict):
    """Hashes of words in lower case without marks around them; 0 for marks alone."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        bare = word.strip(STRIP)
        h = self[word] = (xxhash.xxh3_64_intdigest(bare) >> 1) if bare else 0
        return h


_normal = _Normal()


def features(text: str) -> np.ndarray:
    """Slots of the text's words, pairs and pairs with one word skipped, each slot as often as it occurs."""
    words = text.lower().encode("utf-8", "surrogatepass").split()
    if len(_normal) > 400_000:
        _normal.clear()
    h = np.fromiter(map(_normal.__getitem__, words), np.uint64, len(words))
    h = h[h != 0]
    skip = gram_hashes(np.stack([h[:-2], h[2:] ^ np.uint64(0x5851F42D4C957F2D)], 1).ravel(), 2)[::2] if len(h) > 2 else h[:0]
    return (np.concatenate([gram_hashes(h, 1), gram_hashes(h, 2), skip]) >> np.uint64(64 - BITS)).astype(np.int32)


def ftrl(rows: list[np.ndarray], labels: np.ndarray, epochs: int = EPOCHS, seed: int = 3) -> tuple[np.ndarray, np.ndarray, float]:
    """Trains on sets of slots; returns the slots with weights other than zero, the weights and the bias.

    Per slot: z sums gradients corrected by the change of the rate, n squared gradients; the weight is zero while
    abs(z) <= L1, else -(z - sign(z) L1) / ((BETA + sqrt(n)) / ALPHA + L2). The bias has no L1.
    Label 1 is weighted up to the number of label 0, MAX_WEIGHT times at most, so that half is a fair threshold.
    """
    z, n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)
    bias = 1 << BITS
    floor = np.full((1 << BITS) + 1, L1)
    floor[bias] = 0

    def weights(at: np.ndarray) -> np.ndarray:
        zi = z[at]
        return np.where(np.abs(zi) <= floor[at], 0.0, -(zi - np.sign(zi) * floor[at]) / ((BETA + np.sqrt(n[at])) / ALPHA + L2))

    sets = [np.append(r, bias) for r in rows]
    heavier = min(max(np.sum(labels == 0) / max(np.sum(labels == 1), 1), 1.0), MAX_WEIGHT)
    order = np.random.default_rng(seed)
    for _ in range(epochs):
        for k in order.permutation(len(sets)):
            at = sets[k]
            w = weights(at)
            p = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35)))
            g = (p - labels[k]) * (heavier if labels[k] else 1.0)
            z[at] += g - (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA * w
            n[at] += g * g
    every = weights(np.arange((1 << BITS) + 1))
    slots = np.flatnonzero(every[:-1]).astype(np.int32)
    return slots, every[slots].astype(np.float32), float(every[bias])


def train_toxicity(docs: DataFrame, labels: DataFrame, where: Column, label: str = "toxic", rows: int = TRAIN_ROWS) -> tuple[np.ndarray, np.ndarray, float]:
    """Fits on at most ``rows`` labelled documents, those with the least hash of doc_id among the label rows that
    fulfil ``where``. Texts become slots on the executors; the sample's slots come to the driver, about 8 KB a
    document. Null labels, ids and texts are left out; of a repeated id one label row counts. Without rows, or with
    one class only, the scores are the share of label 1 (a half without rows)."""
    known = labels.where(where & F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(label).alias("y"))
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    some = docs.where("text IS NOT NULL").select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("doc_id", "y", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slots = [np.unique(features(t)).tobytes() for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1).cast(pa.int32()), pa.array(slots, pa.binary())], ["doc_id", "y", "slots"])

    got = some.mapInArrow(run, "doc_id long, y int, slots binary").toPandas().sort_values("doc_id", kind="stable")
    y = got["y"].to_numpy(float)
    if len(set(y)) < 2:
        share = min(max(float(y.mean()), 0.01), 0.99) if len(y) else 0.5
        return np.empty(0, np.int32), np.empty(0, np.float32), float(np.log(share / (1 - share)))
    return ftrl([np.frombuffer(s, np.int32) for s in got["slots"]], y)


def score_toxicity(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, float]) -> DataFrame:
    """doc_id and score (0 to 1) of every row; the whole text counts. The model, a few thousand weights at most of the
    1 << BITS, travels with the task; no shuffle. Null or empty text: the bias's score. Null id: scored, id null.
    Repeated rows: each. Empty table: empty result. Other columns are not read."""
    slots, values, bias = model

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dense = np.zeros(1 << BITS, np.float32)
        dense[slots] = values
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                sums = []
                for text in part.column(1).to_pylist():
                    f = features(text or "")
                    f = f[dense[f] != 0]
                    sums.append(bias + float(dense[np.unique(f)].sum(dtype=np.float64)))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(1 / (1 + np.exp(-np.clip(sums, -35, 35))))], ["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")
