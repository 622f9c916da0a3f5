"""Quality classifier: hashed word n-gram logistic regression, trained by follow-the-regularised-leader updates.

Features are hashed counts of words, word pairs and their shapes (letters folded to case classes, other characters kept),
and of how often words repeat inside the text; values are log counts scaled to unit length, so scores are sparse dot
products. Only the text is an input; labels, lang, source and ids never are.

Training reads at most ``TRAIN_ROWS`` labelled rows, those with the smallest hash of their id among the training fold, and
goes through them in that order with per-coordinate FTRL. Scoring covers every whole text.

Defined cases: null and empty texts have only the bias feature and get its score; rows are scored one by one; labels with a
null id or quality are not learnt from, and repeated labels each count; with no labels the score is 0.5 everywhere; only the
named columns are read; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_batches, written

BITS, TRAIN_ROWS, ROUNDS = 18, 20_000, 2
ALPHA, BETA, L1, L2 = 0.3, 1.0, 0.3, 1.0
THRESHOLD = 0.3
_SHAPES = [(re.compile(r"[^\W\d_]*[a-zà-ÿ][^\W\d_]*"), "x"), (re.compile(r"[A-ZÀ-Þ]+"), "X"), (re.compile(r"[0-9]+"), "9")]


class Ids(dict):
    """Feature numbers of a word and of its shape; forgotten when many, so that memory stays bounded."""

    def __missing__(self, word: str) -> tuple[int, int]:
        if len(self) > 200_000:
            self.clear()
        shape = word
        for pattern, to in _SHAPES:
            shape = pattern.sub(to, shape)
        value = self[word] = (zlib.crc32(word.encode()), zlib.crc32(b"\0" + shape.encode()))
        return value


def features(text: str | None, ids: Ids, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Indices and values of one text."""
    size = np.uint32((1 << bits) - 1)
    words = (text or "").split()
    bias = np.zeros(1, np.uint32)
    if not words:
        return bias, np.ones(1, np.float32)
    pairs = np.array([ids[w] for w in words], np.uint32)
    word, shape = pairs[:, 0], pairs[:, 1]
    parts = [word, shape]
    if len(words) > 1:
        parts += [word[:-1] * np.uint32(0x9E3779B1) ^ word[1:], shape[:-1] * np.uint32(0x85EBCA77) ^ shape[1:]]
    h = np.concatenate(parts)
    h ^= h >> np.uint32(15)
    index, count = np.unique(h * np.uint32(0x2C1B3C6D) >> np.uint32(32 - bits), return_counts=True)
    value = np.log1p(count).astype(np.float32)
    # how repetitive: the share of words that occur k times, hashed by the share's log class
    times = Counter(Counter(words).values())
    top = max(times)
    share = sum(k * n for k, n in times.items() if k > 2) / len(words)
    extra = np.array([zlib.crc32(f"top{int(4 * top / math.sqrt(len(words)))}".encode()), zlib.crc32(f"share{int(8 * share)}:{int(math.log2(len(words)))}".encode())], np.uint32) & size
    value /= math.sqrt(float((value * value).sum()))
    return np.concatenate([bias, extra, index]), np.concatenate([np.ones(3, np.float32), value])


#: Updates that a small training set is brought to by further passes, and the most passes.
UPDATES, MOST_ROUNDS = 40_000, 40


def train(rows: list[tuple[int, np.ndarray, np.ndarray]], bits: int = BITS, rounds: int = ROUNDS) -> np.ndarray:
    """FTRL-proximal over the rows (label, indices, values) in order; few rows are passed more often, to as many updates."""
    z, n = np.zeros(1 << bits), np.zeros(1 << bits)

    def weights(i: np.ndarray) -> np.ndarray:
        zi = z[i]
        return np.where(np.abs(zi) <= L1, 0.0, -(zi - np.sign(zi) * L1) / ((BETA + np.sqrt(n[i])) / ALPHA + L2))

    for _ in range(max(rounds, min(MOST_ROUNDS, UPDATES // max(len(rows), 1)))):
        for label, i, x in rows:
            w = weights(i)
            p = 1 / (1 + math.exp(-max(-35.0, min(35.0, float(w @ x)))))
            g = (p - label) * x
            sigma = (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / ALPHA
            # an index may occur twice in one row, where a feature collides with another: both updates count
            np.add.at(z, i, g - sigma * w)
            np.add.at(n, i, g * g)
    return weights(np.arange(1 << bits)).astype(np.float32)


def _featurize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    ids = Ids()
    for batch in batches:
        made = [features(t, ids) for t in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([i.tobytes() for i, _ in made], pa.binary()), pa.array([x.tobytes() for _, x in made], pa.binary())], names=["order", "label", "i", "x"])


def _fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = [(order, label, i, x) for b in batches for order, label, i, x in zip(*(c.to_pylist() for c in b.columns))]
    rows.sort()
    w = train([(label, np.frombuffer(i, np.uint32), np.frombuffer(x, np.float32)) for _, label, i, x in rows])
    yield pa.RecordBatch.from_arrays([pa.array([w.tobytes()], pa.binary())], names=["w"])


def fold(key: str):
    """The id's fold: crc32 of its text modulo 5; fold 0 is held out."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % 5


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality") -> np.ndarray:
    """Weights learnt from the training fold. Bounded: ``TRAIN_ROWS`` rows, in one task of at most that many rows."""
    arrow_batches(docs.sparkSession)
    rows = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull() & (fold(key) != 0))
    rows = rows.select(F.col(key).alias("id"), F.xxhash64(key).alias("order"), F.col(label).cast("int").alias("label")).orderBy("order", "id", "label").limit(TRAIN_ROWS)
    rows = written(rows, "train-ids")  # bounded, so broadcast
    texts = docs.select(F.col(key).alias("id"), F.col(text).alias("text")).join(F.broadcast(rows), "id").select("order", "label", "text")
    made = written(texts.mapInArrow(_featurize, "order long, label int, i binary, x binary"), "train-rows")
    got = made.repartition(1).mapInArrow(_fit, "w binary").first()
    return np.frombuffer(got["w"], np.float32) if got else np.zeros(1 << BITS, np.float32)


def score(docs: DataFrame, weights: np.ndarray, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: key, score in 0 to 1."""
    arrow_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(weights)  # 4 bytes times 2 ** BITS
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, w = Ids(), shared.value
        for batch in batches:
            out = []
            for t in batch.column(1).to_pylist():
                i, x = features(t, ids)
                out.append(1 / (1 + math.exp(-max(-35.0, min(35.0, float(w[i] @ x))))))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.float64())], names=[key, "score"])

    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, score double")


def classify(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: key, held_out, score, predicted (1 from ``THRESHOLD``)."""
    scored = score(docs, fit(docs, labels, key, text), key, text)
    return scored.select(key, (fold(key) == 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
