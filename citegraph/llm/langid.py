"""Language identification by nearest centroid.

Texts become unit TF-IDF vectors of hashed character 1- to 3-grams. The labelled
documents of each language are clustered into a few centroids (spherical k-means, one Spark
group a language over a bounded sample); a text takes the language of the centroid with the
largest cosine. It is rejected when that cosine is below what nearly all of the centroid's own
members reach, cut to the text's length (short texts have few n-grams and small cosines), or when there is no letter.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citegraph.llm.common import byte_table, per_batch, released, smallest
from citegraph.llm.labelled import one_text
from citegraph.llm.ngrams import counts, inverse_frequencies, tf_idf

NS, BITS = (1, 2, 3), 12
#: Labelled documents a language, centroids a language.
PER_LANG, CENTROIDS = 512, 3
#: A text is rejected under ``SLACK`` times the cosine that all but this share of the centroid's members reach.
OUTSIDE, SLACK = 0.02, 0.9
#: A cluster has at least this share of its language's texts; a radius of one length is taken over so many members.
LEAST_SHARE, LEAST_MEMBERS = 0.1, 20
#: Lengths that have a radius of their own: 2**0 to 2**(SIZES - 1) characters.
SIZES = 16
LETTERS = byte_table(lambda b: 0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A)


def features(col: pa.Array) -> np.ndarray:
    return counts(col, NS, BITS, LETTERS)


def radius(sim: np.ndarray) -> float:
    """The cosine that all but ``OUTSIDE`` of the members reach."""
    return float(np.quantile(sim, OUTSIDE, method="lower"))


def cluster(x: np.ndarray, k: int, rounds: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """Unit centroids of spherical k-means, and the radius of each one's members. The first start is the text
    nearest to the mean, and the next ones are far from the others but not among the ``LEAST_SHARE`` farthest; smaller clusters
    go to the remaining ones. The result depends only on the order of rows."""
    start = [int((x @ x.mean(0)).argmax())]
    best = x @ x[start[0]]
    for _ in range(min(k, len(x)) - 1):
        start.append(int(np.argsort(best, kind="stable")[int(LEAST_SHARE * len(x))]))
        best = np.maximum(best, x @ x[start[-1]])
    c = x[start]
    for _ in range(rounds):
        near = (x @ c.T).argmax(1)
        sums = np.stack([x[near == j].sum(0) for j in range(len(c))])
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        c = np.where(norm > 0, sums / np.maximum(norm, 1e-12), c)
    size = np.bincount((x @ c.T).argmax(1), minlength=len(c))
    c = c[size >= max(1, LEAST_SHARE * len(x))]
    sim = x @ c.T
    near = sim.argmax(1)
    used = [j for j in range(len(c)) if (near == j).any()]
    return c[used], np.array([radius(sim[near == j, j]) for j in used])


def vectors(texts: list[str], idf: np.ndarray) -> np.ndarray:
    return np.concatenate([tf_idf(features(pa.array(texts[s:s + 128], pa.string())), idf) for s in range(0, len(texts), 128)])


def learn(texts: list[str], idf: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Centroids of a language's texts, and their limits (centroids, SIZES): a text of 2**b characters or more is held
    against the members' first 2**b characters (all of the language's where a cluster has few), or the longest start
    that enough texts have."""
    x = vectors(texts, idf)
    c, least = cluster(x, k)
    near = (x @ c.T).argmax(1)
    length = np.array([len(t) for t in texts])
    limits = np.zeros((len(c), SIZES))
    for b in range(SIZES):
        long = np.flatnonzero(length >= 1 << b)
        sim = (vectors([texts[i][:1 << b] for i in long], idf) * c[near[long]]).sum(1) if len(long) else np.zeros(0)
        for j in range(len(c)):
            own = sim[near[long] == j]
            if len(own) < LEAST_MEMBERS:
                own = sim  # all of the language's
            limits[j, b] = radius(own) if len(own) >= LEAST_MEMBERS or not b else limits[j, b - 1]
    return c, SLACK * np.minimum(limits, least[:, None])


class LanguageModel:
    """Centroids, their languages and limits (centroids, SIZES), and the n-gram weights."""

    def __init__(self, idf: np.ndarray, langs: list[str], centroids: np.ndarray, limits: np.ndarray):
        self.idf, self.langs, self.centroids, self.limits = idf, langs, centroids, limits


def fit(docs: DataFrame, lang_col: str = "lang", id_col: str = "doc_id", text_col: str = "text",
        per_lang: int = PER_LANG, centroids: int = CENTROIDS) -> LanguageModel:
    """Learn from the rows of ``docs`` with a language, an id and a letter. N-gram weights come from all of
    them, centroids from the ``per_lang`` ids of each language with the smallest hash, one row of each."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    rows = rows.where(F.col("lang").isNotNull() & F.col("id").isNotNull() & F.col("text").rlike("\\p{L}"))
    idf = inverse_frequencies(rows, "text", features, 1 << BITS)
    chosen = smallest(rows.select("id", "lang").distinct(), "lang", per_lang, "id")
    sample = one_text(rows.join(F.broadcast(chosen), ["id", "lang"]), "id", "lang")
    bc = docs.sparkSession.sparkContext.broadcast(idf)

    def group(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["id", "text"])
        c, limits = learn(pdf["text"].to_list(), bc.value, centroids)
        return pd.DataFrame({"lang": pdf["lang"].iloc[0], "number": np.arange(len(c)),
                             "centroid": list(c.astype(np.float32)), "limits": list(limits)})

    got = (sample.groupBy("lang").applyInPandas(group, "lang string, number int, centroid array<float>, limits array<double>")
           .toPandas().sort_values(["lang", "number"]))
    c = np.array(got["centroid"].to_list(), np.float32).reshape(len(got), 1 << BITS)
    return LanguageModel(idf, got["lang"].to_list(), c, np.array(got["limits"].to_list(), float).reshape(len(got), SIZES))


def predict(docs: DataFrame, model: LanguageModel, text_col: str = "text",
            out_cols: tuple[str, str, str] = ("lang_pred", "score", "rejected")) -> DataFrame:
    """``docs`` with the language (``und`` for a null text, one without a letter, or a model
    without languages), the cosine of the nearest centroid (0 to 1; 0 for ``und``), and whether the text is
    rejected. Ties go to the language first in the alphabet. A column of ``docs`` named like an output is
    replaced by it."""
    spark = docs.sparkSession
    bc = spark.sparkContext.broadcast(model)
    flag = "has_letter"
    while flag in docs.columns:
        flag += "_"
    rows = docs.drop(*out_cols).withColumn(flag, F.coalesce(F.col(text_col).rlike("\\p{L}"), F.lit(False)))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        m = bc.value
        ok = batch.column(flag).to_numpy(zero_copy_only=False).astype(bool) & bool(m.langs)
        lang, score = ["und"] * batch.num_rows, np.zeros(batch.num_rows)
        gone = ~ok
        if ok.any():
            x = tf_idf(features(batch.column(text_col)), m.idf)
            sim = x @ m.centroids.T
            best = sim.argmax(1)
            top = np.clip(sim[np.arange(len(best)), best].astype(float), 0, 1)
            length = pc.fill_null(pc.utf8_length(batch.column(text_col)), 0).to_numpy(zero_copy_only=False)
            size = np.minimum(np.log2(np.maximum(length, 1)).astype(int), SIZES - 1)
            gone |= top < m.limits[best, size]
            score = np.where(ok, top, 0.0)
            lang = [m.langs[b] if k else "und" for b, k in zip(best.tolist(), ok.tolist())]
        k = batch.schema.get_field_index(flag)
        batch = batch.remove_column(k)
        cols = [*batch.columns, pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(gone)]
        return pa.RecordBatch.from_arrays(cols, names=[*batch.schema.names, *out_cols])

    schema = docs.drop(*out_cols).schema
    schema = schema.add(out_cols[0], "string").add(out_cols[1], "double").add(out_cols[2], "boolean")
    def whole(batches):
        yield from per_batch(run, 128)(batches)
        released()

    return rows.mapInArrow(whole, schema)
