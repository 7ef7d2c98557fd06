"""Recommendation operators: J8, U3, U4, M8, G17."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citegraph.session import cut_lineage


def expand_neighbours(knn: DataFrame, citations: DataFrame, *, query_col: str = "query_id",
                      neighbour_col: str = "neighbour_id") -> DataFrame:
    """J8 + U4: per query, the neighbours and every reference of each neighbour, distinct.

    Keyed by the neighbour's own id (the reference looked up positions and the
    query's references, SURVEY Q1). Returns (query_id, rec_id).

    The neighbours are stored, since the search would run again for each of their uses. The found rows are counted from the
    references' counts and dealt over tasks of about TASK_ROWS, which drop the repeats: no task's memory grows with the input.
    """
    nb = cut_lineage(knn.select(F.col(query_col).alias("query_id"), F.col(neighbour_col).alias("rec_id")))
    asks, refs = spread(nb.withColumnRenamed("rec_id", "source"), citations.select("source", "target"))
    found = asks.join(refs, ["source", "salt", "part"]).select("query_id", F.col("target").alias("rec_id"))
    cited = citations.groupBy(F.col("source").alias("rec_id")).agg(F.count("*").alias("n"))
    rows = nb.join(cited, "rec_id", "left").agg(F.sum(F.coalesce("n", F.lit(0)) + 1)).first()[0] or 0
    tasks = max(nb.sparkSession.sparkContext.defaultParallelism, math.ceil(rows / TASK_ROWS))
    return nb.unionByName(found).repartition(tasks, "query_id", "rec_id").distinct()


#: Found rows, before repeats are dropped, of one task.
TASK_ROWS = 1 << 20

#: Rows of one join key on either side; a key with more is dealt over several.
KEY_ROWS = 4096


def spread(asks: DataFrame, refs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both sides of the join of (query_id, source) with (source, target), with the further keys ``salt`` and ``part``.

    A neighbour of many queries has its askers dealt by salt, and a copy of its references for each; a paper of many
    references has these dealt into parts, and a copy of each asker for each. So no key has more than about KEY_ROWS rows on
    either side. Who is that large is counted first (a map-side combined aggregate; few rows pass).
    """
    heavy = lambda df, name: (df.groupBy("source").agg(F.count("*").alias("n")).where(F.col("n") > KEY_ROWS)
                              .select("source", F.ceil(F.col("n") / KEY_ROWS).cast("int").alias(name)))
    salts, parts = heavy(asks, "salts"), heavy(refs, "parts")
    sized = lambda df: df.join(salts, "source", "left").join(parts, "source", "left").fillna(1, ["salts", "parts"])
    every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    of = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    left = sized(asks).withColumn("salt", of("query_id", "salts")).withColumn("part", every("parts"))
    right = sized(refs).withColumn("part", of("target", "parts")).withColumn("salt", every("salts"))
    return left.drop("salts", "parts"), right.drop("salts", "parts")


def matched_references(recs: DataFrame, truth: DataFrame) -> DataFrame:
    """Recommended ids that are true references of the query (set intersection)."""
    t = truth.select(F.col("source").alias("query_id"), F.col("target").alias("rec_id"))
    return recs.select("query_id", "rec_id").intersect(t)


def titles_of(recs: DataFrame, papers: DataFrame, id_col: str = "target") -> DataFrame:
    """Recommended ids → titles (inner join)."""
    return recs.join(papers.select(F.col("paper_id").alias(id_col), F.col("title").alias("target_title")),
                     id_col)


def recommend_citations(decisions: DataFrame, truth: DataFrame, papers: DataFrame,
                        paper_id: int | None = None) -> DataFrame:
    """Predicted-positive true citations with titles, for one paper (P11) or all.

    P11 + J5 + J9; the per-paper counts are :func:`metrics.truth_hits` (A9).
    """
    from citegraph.operators.metrics import edges_of, hits_in_truth

    t = edges_of(truth, paper_id) if paper_id is not None else truth
    hits = hits_in_truth(decisions.where(F.col("pred") == 1), t)
    return titles_of(hits.select("source", "target"), papers)


def recommend_by_text(query_ids: DataFrame, papers: DataFrame, citations: DataFrame, model,
                      k: int = 10, *, sep: str = " ", exclude_self: bool = True, exact: bool = False) -> DataFrame:
    """M8: the whole text route for listed papers.

    P7 lookup → J1 text → F4 tokens → M3 inferred paragraph vector → T2 search through the index (T1 with ``exact``)
    among every paper's vector (M4) → J8/U4 neighbours and their references → A11 precision / recall / F1 per query
    paper. ``model`` is a word model (M1). Neighbours are keyed by paper id (SURVEY Q1) and the query itself is
    excluded from its neighbours by default (Q2).
    """
    from citegraph.functions.text import tokenize
    from citegraph.operators.corpus import paper_text
    from citegraph.operators.metrics import recommendation_quality
    from citegraph.operators.paragraphs import infer_paragraphs
    from citegraph.operators.vector_index import ann_knn
    from citegraph.operators.vectors import knn
    from citegraph.session import RunTables

    all_text = paper_text(papers.select("paper_id"), papers, sep)
    corpus = RunTables(papers.sparkSession).put(infer_paragraphs(model, all_text.select("paper_id", tokenize("text").alias("tokens"))))
    # a listed paper's vector is that of its text, which the corpus has
    q_vec = corpus.join(query_ids.select(F.col("paper_id").alias("id")).distinct(), "id", "left_semi")
    nn = (knn if exact else ann_knn)(q_vec, corpus, k, exclude_self=exclude_self)
    return recommendation_quality(expand_neighbours(nn, citations), citations)
