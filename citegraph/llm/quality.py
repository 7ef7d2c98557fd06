"""Quality classifier: nearest-neighbour voting in a latent semantic space.

Texts become TF-IDF vectors of hashed byte 1- to 3-grams (weights from all documents), with the
share of words that repeat the word before them as one more dimension. A truncated SVD of a
bounded labelled sample gives the latent space; the sample's vectors in it are broadcast. Every document is compared with all of them in blocks (exact
cosines), and its nearest neighbours vote with their similarity as weight.
"""

from __future__ import annotations

from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from citegraph.llm.common import per_batch
from citegraph.llm.labelled import labelled_sample
from citegraph.llm.ngrams import counts, inverse_frequencies, tf_idf

NS, BITS = (1, 2, 3), 11
#: Labelled documents a class, latent dimensions, voters.
PER_CLASS, DIMS, VOTERS = 1500, 48, 15
#: Length of the repetition part beside the n-gram part's 1, for a text of nothing but repeated words.
REPEATS = 1.5
WIDTH = (1 << BITS) + 1


def features(col: pa.Array) -> np.ndarray:
    return counts(col, NS, BITS)


def vectors(col: pa.Array, idf: np.ndarray) -> np.ndarray:
    """The unit TF-IDF vector, and in the last column the share of words that repeat the one before."""
    words = [t.split() if t else [] for t in col.to_pylist()]
    share = np.array([[sum(map(eq, w, w[1:])) / max(1, len(w))] for w in words], np.float32).reshape(-1, 1)
    return np.concatenate([tf_idf(features(col), idf), REPEATS * share], 1)


class QualityModel:
    """Weights, latent basis, and the labelled vectors with their labels."""

    def __init__(self, idf: np.ndarray, basis: np.ndarray, vectors: np.ndarray, y: np.ndarray):
        self.idf, self.basis, self.vectors, self.y = idf, basis, vectors, y

    def latent(self, col: pa.Array) -> np.ndarray:
        z = vectors(col, self.idf) @ self.basis
        return z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-9)

    def score(self, col: pa.Array) -> np.ndarray:
        if not len(self.y):
            return np.full(len(col), 0.5)
        sim = self.latent(col) @ self.vectors.T
        k = min(VOTERS, len(self.y))
        near = np.argpartition(-sim, k - 1, axis=1)[:, :k]
        weight = np.maximum(np.take_along_axis(sim, near, 1), 0).astype(float) ** 4
        total = weight.sum(1)
        vote = (weight * self.y[near]).sum(1) / np.maximum(total, 1e-12)
        return np.where(total > 1e-9, np.clip(vote, 0, 1), self.y.mean())


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", per_class: int = PER_CLASS, folds: int = 5,
        dims: int = DIMS) -> QualityModel:
    """Labels are read only from documents whose crc32(id) modulo ``folds`` is not 0, at most ``per_class``
    of each class; n-gram weights come from all documents."""
    spark = docs.sparkSession
    idf = inverse_frequencies(docs, "text", features, 1 << BITS)
    bc = spark.sparkContext.broadcast(idf)

    def sampled(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = vectors(batch.column("text"), bc.value)
        x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
        return pa.RecordBatch.from_pydict({"id": batch.column("id"), "y": batch.column("y"),
                                           "x": pa.array([r.tobytes() for r in x], pa.binary())})

    got = (labelled_sample(docs, labels, label, per_class, folds)
           .mapInArrow(per_batch(sampled, 128), "id long, y int, x binary").toPandas())
    got = got.sort_values(["id", "x"])
    x = np.frombuffer(b"".join(got["x"]), np.float32).reshape(len(got), WIDTH)
    y = got["y"].to_numpy(dtype=float)
    if not len(y):
        return QualityModel(idf, np.zeros((WIDTH, 1), np.float32), np.zeros((0, 1), np.float32), y)
    _, v = np.linalg.eigh(x.T @ x)  # right singular vectors, the strongest last
    basis = np.ascontiguousarray(v[:, ::-1][:, :dims]).astype(np.float32)
    z = x @ basis
    z /= np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-9)
    return QualityModel(idf, basis, z, y)


def predict(docs: DataFrame, model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) of every row. A null text counts as empty; a text like no labelled one, empty ones
    included, gets the sample's mean label; without labels all get 0.5."""
    bc = docs.sparkSession.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(bc.value.score(batch.column(1)), pa.float64())], names=[id_col, "score"])

    return docs.select(id_col, text_col).mapInArrow(per_batch(run, 128), docs.select(id_col).schema.add("score", "double"))
