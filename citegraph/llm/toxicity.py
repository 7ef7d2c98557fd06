"""Toxicity: linear classifier over character n-grams scaled by naive Bayes log-count ratios.

Presence of hashed 3- to 5-grams (lower-cased) is counted for both classes over a bounded
labelled sample. Each n-gram's value is the log ratio of its smoothed class frequencies; the
most telling ones (chi-square) are kept, and an L2-regularised logistic regression is fitted to
them. All documents are scored with two broadcast vectors.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citegraph.llm.common import byte_table, per_batch
from citegraph.llm.labelled import labelled_sample
from citegraph.llm.ngrams import buckets, utf8
from citegraph.llm.quality import predict  # noqa: F401  the same scoring pass

NS, BITS = (3, 4, 5), 18
#: Labelled documents a class, n-grams kept.
PER_CLASS, KEPT = 4096, 2048
LOWER = byte_table(lambda b: True)


def presence(col: pa.Array, kept: np.ndarray, width: int) -> np.ndarray:
    """bool matrix (texts, width): which of the kept n-grams a text holds. ``kept`` maps a
    bucket to its column, or to ``width`` for none."""
    data, offsets = utf8(col, LOWER)
    out = np.zeros((len(col), width + 1), bool)
    for row, bucket in buckets(data, offsets, NS, BITS):
        out[row, kept[bucket]] = True
    return out[:, :width]


class ToxicityModel:
    """kept: bucket -> column; weight: of each column (log ratio times coefficient)."""

    def __init__(self, kept: np.ndarray, weight: np.ndarray, bias: float):
        self.kept, self.weight, self.bias = kept, weight, bias

    def score(self, col: pa.Array) -> np.ndarray:
        z = presence(col, self.kept, len(self.weight)) @ self.weight + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def class_counts(sample: DataFrame) -> DataFrame:
    """(y, bucket, n): documents of each class that hold an n-gram; bucket -1 counts the documents."""

    def partial(batches):
        n = np.zeros((2, (1 << BITS) + 1), np.int64)
        seen = np.zeros(1 << BITS, bool)
        for batch in batches:
            y = batch.column("y").to_numpy(zero_copy_only=False)
            for k in range(batch.num_rows):
                data, offsets = utf8(batch.column("text").slice(k, 1), LOWER)
                seen[:] = False
                for _, bucket in buckets(data, offsets, NS, BITS):
                    seen[bucket] = True
                n[y[k], :-1] += seen
                n[y[k], -1] += 1
        y, at = np.nonzero(n)
        bucket = np.where(at == 1 << BITS, -1, at)
        yield pa.RecordBatch.from_pydict({"y": pa.array(y.astype(np.int32)), "bucket": pa.array(bucket.astype(np.int32)),
                                          "n": pa.array(n[y, at])})

    return (sample.select("text", "y").mapInArrow(partial, "y int, bucket int, n long")
            .groupBy("y", "bucket").agg(F.sum("n").alias("n")))


def logistic(x: np.ndarray, y: np.ndarray, l2: float = 1e-3, rounds: int = 300, rate: float = 0.05) -> tuple[np.ndarray, float]:
    """Coefficients and bias; both classes weigh the same."""
    x = np.concatenate([x, np.ones((len(x), 1), np.float32)], 1)
    w = np.zeros(x.shape[1], np.float32)
    m, v = np.zeros_like(w), np.zeros_like(w)
    share = np.where(y == 1, 0.5 / max(y.sum(), 1), 0.5 / max((1 - y).sum(), 1)).astype(np.float32)
    keep = np.append(np.full(x.shape[1] - 1, l2, np.float32), 0).astype(np.float32)
    for t in range(1, rounds + 1):  # Adam
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        g = x.T @ ((p - y) * share).astype(np.float32) + keep * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w[:-1], float(w[-1])


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", per_class: int = PER_CLASS, folds: int = 5,
        n_kept: int = KEPT) -> ToxicityModel:
    """Labels are read only from documents whose crc32(id) modulo ``folds`` is not 0, at most ``per_class`` of
    each class. Without both classes every score is 0.5."""
    spark = docs.sparkSession
    sample = labelled_sample(docs, labels, label, per_class, folds)
    got = class_counts(sample).toPandas()
    docs_of = got[got["bucket"] < 0].set_index("y")["n"]
    none = ToxicityModel(np.zeros(1 << BITS, np.int32), np.zeros(0), 0.0)
    if len(docs_of) < 2:
        return none
    n = np.zeros((2, 1 << BITS))
    inside = got[got["bucket"] >= 0]
    n[inside["y"], inside["bucket"]] = inside["n"]
    share = (n + 1) / (n + 1).sum(1, keepdims=True)
    ratio = np.log(share[1] / share[0])
    freq = n / np.array([[docs_of[0]], [docs_of[1]]])
    telling = (freq[1] - freq[0]) ** 2 / np.maximum(freq.sum(0), 1e-12)
    columns = np.sort(np.argsort(-telling, kind="stable")[:n_kept])
    kept = np.full(1 << BITS, len(columns), np.int32)
    kept[columns] = np.arange(len(columns))
    bc = spark.sparkContext.broadcast(kept)

    def packed(batch: pa.RecordBatch) -> pa.RecordBatch:
        bits = np.packbits(presence(batch.column("text"), bc.value, len(columns)), axis=1)
        return pa.RecordBatch.from_pydict({"id": batch.column("id"), "y": batch.column("y"),
                                           "x": pa.array([r.tobytes() for r in bits], pa.binary())})

    rows = sample.mapInArrow(per_batch(packed, 128), "id long, y int, x binary").toPandas().sort_values(["id", "x"])
    x = np.unpackbits(np.frombuffer(b"".join(rows["x"]), np.uint8).reshape(len(rows), -1), axis=1)[:, :len(columns)]
    scale = ratio[columns].astype(np.float32)
    w, bias = logistic(x.astype(np.float32) * scale, rows["y"].to_numpy(np.float32))
    return ToxicityModel(kept, (w * scale).astype(np.float64), bias)
