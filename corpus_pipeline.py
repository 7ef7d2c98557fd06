"""Corpus pipeline: language ID, line dedup, near-dedup, decontamination, tokenising.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and returns a frame that is written as
Parquet and reread as the next one's docs. All but the last return the columns of ``documents``.
``ORACLE_SQL`` is None: nearest centroids and SentencePiece cannot be said in SQL; tests compare the stages with
brute force.

Any column may be null. Documents without text or without a letter go in the first stage; an empty table
stays empty through all stages. Rows that repeat an id stay together. Extra columns of documents stay as they are, whatever
their names: columns of the stages' own take other names where theirs are taken (the last stage's ``ids``, ``n_tokens`` and
``round_trip`` get an underscore).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citegraph.llm import decontaminate, langid, line_dedup, near_dedup
from citegraph.llm.common import Stored, crc_mod, free_names, table
from citegraph.llm.queries import TOKENIZER
from citegraph.llm.sentencepiece import Model, encode


def _recounted(docs: DataFrame) -> DataFrame:
    """``n_chars`` of the text as it is now."""
    return docs.withColumn("n_chars", F.length("text").cast("long"))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language like the labelled ones; a missing ``lang`` is filled in."""
    model = langid.fit(docs.where(crc_mod("doc_id", 4) != 2))
    names = tuple(free_names(docs.columns, "lang_pred", "lang_score", "lang_rejected"))
    found = langid.predict(docs, model, out_cols=names)
    return found.where(~F.col(names[2])).withColumn("lang", F.coalesce("lang", names[0])).select(docs.columns)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that repeat an earlier one; a document that loses all of its text goes."""
    before, = free_names(docs.columns, "before")
    left = line_dedup.drop_lines(docs.withColumn(before, F.col("text")), line_dedup.duplicate_lines(docs))
    bare = lambda c: F.trim(F.regexp_replace(F.coalesce(F.col(c), F.lit("")), "[\\x09-\\x0D]", " ")) == ""
    return _recounted(left.where(~bare("text") | bare(before)).select(docs.columns))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five-word shingles, similarity 0.8)."""
    return near_dedup.keep_one(docs, near_dedup.near_groups(docs, shingle_words=5, percent=80))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without benchmark passages; a document that is half benchmark or more goes."""
    return _recounted(decontaminate.remove_contamination(docs, table(spark, sf_dir, "benchmark")))


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their token ids, and whether decoding these gives the text back."""
    model = Model.read(TOKENIZER, unigram=True)
    ids, number, back, decoded = free_names(docs.columns, "ids", "n_tokens", "round_trip", "decoded")
    out = encode(docs, model, out_col=ids, decoded_col=decoded)
    return out.select(*docs.columns, ids, F.size(ids).cast("long").alias(number),
                      F.col(decoded).eqNullSafe(F.col("text")).alias(back))


STAGES = [("language_id", language_id), ("line_dedup", line_dedup_stage), ("near_dedup", near_dedup_stage),
          ("decontamination", decontamination), ("sentencepiece", tokenise)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    store = Stored(spark)
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        docs = store.put(stage(spark, docs, sf_dir), name)
        if before:
            store.drop(before)
        before = name
    return docs
