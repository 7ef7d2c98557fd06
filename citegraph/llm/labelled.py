"""A bounded sample of labelled documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citegraph.llm.common import crc_mod, smallest


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int, folds: int,
                    id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text, y): up to ``per_class`` documents of each class whose fold is not 0.

    A document with several label rows takes the rounded mean; null ids and labels are left out.
    The rows with the smallest hash of the id are taken, so the choice does not depend on
    partitioning. At most 2 * per_class ids are broadcast. An id of several rows gives one of them (:func:`one_text`), so the
    sample is bounded in rows too.
    """
    one = (labels.where(crc_mod(id_col, folds) != 0).groupBy(F.col(id_col).alias("id"))
           .agg(F.round(F.avg(F.col(label))).cast("int").alias("y")).where("y in (0, 1)"))
    chosen = smallest(one, "y", per_class, "id")
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return one_text(rows.join(F.broadcast(chosen), "id"), "id", "y").select("id", "text", "y")


def one_text(rows: DataFrame, *keys: str) -> DataFrame:
    """One row for each value of ``keys``: the text with the smallest hash. A task keeps one of its own rows first, so the
    copies of a hot id are not shuffled."""
    least = F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("least")
    return rows.groupBy(*keys).agg(least).select(*keys, F.col("least.text").alias("text"))
