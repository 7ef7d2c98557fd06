"""Corpus ETL over the bibliography: P4-P8, J1-J3, U1, U2, A1-A7.

``papers(paper_id, title, abstract)`` and ``citations(source, target)`` are the
two inputs; ``bib`` is papers with a ``refs ARRAY<BIGINT>`` column.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citegraph.functions.hashing import hash64
from citegraph.functions.text import (
    TAG_ABSTRACT, TAG_INDEX, TAG_REFERENCE, TAG_TITLE, join_text, record_lines, tag_value,
    tag_values, to_id, tokenize,
)


# ---------------------------------------------------------------- S3 parsing core
def parse_records(records: DataFrame, value_col: str = "value",
                  order_cols: list[str] | None = None) -> DataFrame:
    """Tagged records → papers(paper_id, title, abstract, refs) plus ``_ok``.

    One record per row. Lines: ``#index<id>``, ``#*<title>``, ``#!<abstract>``,
    ``#%<ref id>`` (repeatable); other lines are ignored. A record without a
    usable ``#index`` has ``_ok = false`` (rejected, SURVEY Q5/Q6). An absent
    title is NULL (no carry-over from the previous record), an absent or empty
    abstract NULL, absent references an empty array. ``n_bad_refs`` counts the
    references that are no integers; they are left out of ``refs``.
    """
    lines = record_lines(F.col(value_col))
    parsed = records.select(
        *(order_cols or []),
        to_id(tag_value(lines, TAG_INDEX)).alias("paper_id"),
        tag_value(lines, TAG_TITLE).alias("title"),
        F.nullif(tag_value(lines, TAG_ABSTRACT), F.lit("")).alias("abstract"),
        F.filter(F.transform(tag_values(lines, TAG_REFERENCE), lambda x: to_id(x)),
                 lambda x: x.isNotNull()).alias("refs"),
        F.size(F.filter(tag_values(lines, TAG_REFERENCE), lambda x: to_id(x).isNull())).alias("n_bad_refs"),
    )
    return parsed.withColumn("_ok", F.col("paper_id").isNotNull())


def last_record_wins(parsed: DataFrame, order_col: str = "_order") -> DataFrame:
    """Q7: for a repeated id keep the whole last record (largest ``order_col``).

    ``max_by`` is a hash aggregate with a map-side partial step, so an id
    repeated in a third of all records is still combined before the shuffle.
    """
    keep = [c for c in parsed.columns if c not in ("paper_id", order_col, "_ok")]
    best = F.max_by(F.struct(*keep), F.col(order_col))
    return (parsed.where("_ok").groupBy("paper_id").agg(best.alias("_r"))
            .select("paper_id", *[F.col(f"_r.{c}").alias(c) for c in keep]))


def format_records(bib: DataFrame) -> DataFrame:
    """Inverse of :func:`parse_records`: one tagged text record per paper.

    Newlines inside title or abstract become spaces (a tag holds one line).
    """
    flat = lambda c: F.regexp_replace(F.col(c), r"\r?\n", " ")
    return bib.select(F.concat_ws(
        "\n",
        F.concat(F.lit(TAG_INDEX), F.col("paper_id").cast("string")),
        F.when(F.col("title").isNotNull(), F.concat(F.lit(TAG_TITLE), flat("title"))),
        F.when(F.coalesce(F.col("abstract"), F.lit("")) != "", F.concat(F.lit(TAG_ABSTRACT), flat("abstract"))),
        F.array_join(F.transform("refs", lambda r: F.concat(F.lit(TAG_REFERENCE), r.cast("string"))), "\n"),
    ).alias("value"))


# ---------------------------------------------------------------- P5-P8
def nonempty_abstracts(papers: DataFrame) -> DataFrame:
    """P5: an empty abstract is absent (NULL)."""
    return papers.withColumn("abstract", F.nullif(F.col("abstract"), F.lit("")))


def papers_with_refs(bib: DataFrame) -> DataFrame:
    """Citing papers whose reference list is non-empty."""
    return bib.where(F.size("refs") > 0)


def with_ref_counts(papers: DataFrame, citations: DataFrame) -> DataFrame:
    """P6 / A6 from the edge list: papers with ``n_refs``, their number of references, counted map-side first; no list of a
    hub's references is gathered."""
    n = citations.groupBy(F.col("source").alias("paper_id")).agg(F.count(F.lit(1)).alias("n_refs"))
    return papers.join(n, "paper_id", "left").withColumn("n_refs", F.coalesce("n_refs", F.lit(0)).cast("bigint"))


def lookup_papers(papers: DataFrame, ids: DataFrame, id_col: str = "paper_id") -> DataFrame:
    """Rows whose id is in ``ids`` (a semi join; the id table is never collected)."""
    return papers.join(ids.select(F.col(id_col).alias("paper_id")).distinct(), "paper_id", "left_semi")


def nonempty_text(hits: DataFrame, text_col: str = "text") -> DataFrame:
    """Drop result rows whose text is empty (applied after the top-n cut)."""
    return hits.where(F.coalesce(F.col(text_col), F.lit("")) != "")


# ---------------------------------------------------------------- J1-J3
def paper_text(active: DataFrame, papers: DataFrame, sep: str = " ") -> DataFrame:
    """(paper_id, text = title + sep + abstract), missing parts as ''."""
    return (active.select("paper_id").join(papers.select("paper_id", "title", "abstract"),
                                           "paper_id", "left")
            .select("paper_id", join_text("title", "abstract", sep).alias("text")))


def restrict_corpus(papers: DataFrame, active: DataFrame) -> DataFrame:
    """Keep only the active ids' rows."""
    return papers.join(active.select("paper_id"), "paper_id", "left_semi")


def reference_text(citations: DataFrame, papers: DataFrame, sep: str = " ", digest: bool = False) -> DataFrame:
    """Text of each cited id, per citation edge: (source, target, has_title, text).

    With ``digest`` the last column is ``text_md5``, taken before the join, so no text is copied per edge.
    """
    text = join_text("title", "abstract", sep)
    last = "text_md5" if digest else "text"
    p = papers.select(F.col("paper_id").alias("target"), F.col("title").isNotNull().alias("has_title"),
                      (F.md5(text) if digest else text).alias(last))
    absent = F.md5(F.lit(sep)) if digest else F.lit(sep)
    return (citations.select("source", "target").join(p, "target", "left")
            .select("source", "target", F.coalesce("has_title", F.lit(False)).alias("has_title"),
                    F.coalesce(last, absent).alias(last)))


# ---------------------------------------------------------------- U1, U2
def citations_of(bib: DataFrame) -> DataFrame:
    """DM4 exploded: (source, target) per reference, duplicates kept."""
    return bib.select(F.col("paper_id").alias("source"), F.explode("refs").alias("target"))


def active_papers(bib: DataFrame) -> DataFrame:
    """Cited ids ∪ citing ids with at least one reference, distinct."""
    cited = bib.select(F.explode("refs").alias("paper_id"))
    citing = papers_with_refs(bib).select("paper_id")
    return cited.union(citing).distinct()


def active_of(citations: DataFrame) -> DataFrame:
    """U1 from the edge list itself: citing and cited ids, distinct."""
    return (citations.select(F.col("source").alias("paper_id"))
            .union(citations.select(F.col("target").alias("paper_id"))).distinct())


def edge_endpoints(edges: DataFrame) -> DataFrame:
    """Unique node ids over both ends of an edge list."""
    return (edges.select(F.col("source").alias("id"))
            .union(edges.select(F.col("target").alias("id"))).distinct())


# ---------------------------------------------------------------- A1-A7
def adjacency(edges: DataFrame, chunk: int = 1024) -> DataFrame:
    """A1: sorted target lists per source → (source, part, n_targets, targets).

    A source with more than ``chunk`` targets is split into ``ceil(deg/chunk)``
    parts by a hash of the target, so no list (and no task) grows with the
    largest hub. Degrees come from a map-side-combined count first.
    """
    deg = edges.groupBy("source").agg(F.count(F.lit(1)).alias("_deg"))
    parts = F.greatest(F.lit(1), F.ceil(F.col("_deg") / F.lit(chunk)))
    keyed = (edges.join(deg, "source")
             .withColumn("part", F.pmod(hash64("target"), parts.cast("bigint"))))
    return (keyed.groupBy("source", "part")
            .agg(F.count(F.lit(1)).alias("n_targets"),
                 F.array_sort(F.collect_list("target")).alias("targets")))


def degree_filter(edges: DataFrame, min_degree: int = 81) -> DataFrame:
    """A2: papers with more than ``min_degree`` references, and their counts."""
    return (edges.groupBy("source").agg(F.count(F.lit(1)).alias("n_refs"))
            .where(F.col("n_refs") > min_degree))


def distinct_ids(df: DataFrame, col: str = "paper_id") -> DataFrame:
    """A3."""
    return df.select(col).distinct()


def distinct_refs(citations: DataFrame, papers: DataFrame, sep: str = " ") -> DataFrame:
    """A4: distinct cited ids with their text; ``has_title`` marks those with a title."""
    cited = citations.select(F.col("target").alias("paper_id")).distinct()
    return (cited.join(papers.select("paper_id", "title", "abstract"), "paper_id", "left")
            .select("paper_id", F.col("title").isNotNull().alias("has_title"),
                    join_text("title", "abstract", sep).alias("text")))


def duplicate_texts(texts: DataFrame, text_col: str = "text") -> DataFrame:
    """A5: texts occurring more than once → (text_md5, n_chars, n). Digest and length are the key: no text is shuffled."""
    return (texts.select(F.md5(F.col(text_col)).alias("text_md5"), F.length(F.col(text_col)).cast("bigint").alias("n_chars"))
            .groupBy("text_md5", "n_chars").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1))


def corpus_counts(papers: DataFrame, citations: DataFrame) -> DataFrame:
    """Sizes of the corpus maps and lists (plus the active set), from papers and their citations."""
    base = with_ref_counts(papers.select("paper_id", "title", "abstract"), citations).agg(
        F.count(F.lit(1)).alias("n_papers"),
        F.count("title").alias("n_titles"),
        F.count(F.nullif(F.col("abstract"), F.lit(""))).alias("n_abstracts"),
        F.count_if(F.col("n_refs") > 0).alias("n_citing"),
        F.sum("n_refs").cast("bigint").alias("n_citations"),
    )
    n_active = active_of(lookup_papers(citations.withColumnRenamed("source", "paper_id"), papers)
                         .withColumnRenamed("paper_id", "source")).agg(F.count(F.lit(1)).alias("n_active"))
    return base.join(n_active)  # one row each


def vocabulary(tokens: DataFrame, tokens_col: str = "tokens", min_count: int = 1) -> DataFrame:
    """Token counts kept when >= min_count (hash aggregate, map-side combined)."""
    return (tokens.select(F.explode(tokens_col).alias("token"))
            .groupBy("token").agg(F.count(F.lit(1)).alias("n"))
            .where(F.col("n") >= min_count))


def tokenized(texts: DataFrame, text_col: str = "text", id_col: str = "paper_id") -> DataFrame:
    """F4 per document: (id, tokens)."""
    return texts.select(id_col, tokenize(text_col).alias("tokens"))
