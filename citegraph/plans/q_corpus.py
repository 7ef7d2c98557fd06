"""Registered queries: corpus ETL over documents + doc_cites (S3 core, P*, J1-J3, U1, U2, A1-A7, F1-F5)."""

from __future__ import annotations

from pyspark.sql import functions as F

from citegraph.functions.text import TOKEN_PATTERN, tokenize
from citegraph.operators import corpus as C
from citegraph.plans import views as V
from citegraph.plans.catalog import register

MIN_DEGREE = 81  # "more than 81 references", as in the reference's listing


def tok_sql(expr: str) -> str:
    return f"regexp_extract_all(lower({expr}), '{TOKEN_PATTERN}')"
ACTIVE_SQL = "SELECT target AS paper_id FROM doc_cites UNION SELECT source FROM doc_cites"
TEXT_SQL = ("SELECT a.paper_id, coalesce(p.title, '') || ' ' || coalesce(p.abstract, '') AS text "
            "FROM active a LEFT JOIN papers p ON p.paper_id = a.paper_id")


def _active(spark, d):
    return C.active_of(V.doc_cites(spark, d))


def _texts(spark, d):
    return C.paper_text(_active(spark, d), V.papers(spark, d))


@register("bib_parse", V.sql_with(["bib"], """
    SELECT paper_id, regexp_replace(title, '\\r?\\n', ' ', 'g') AS title,
           nullif(regexp_replace(abstract, '\\r?\\n', ' ', 'g'), '') AS abstract,
           len(refs) AS n_refs, array_to_string(refs, ',') AS refs
    FROM bib"""))
def q_bib_parse(spark, d):
    """S3 core (F1, F2, P4, F5): format every paper as a tagged record and parse it back."""
    parsed = C.parse_records(C.format_records(V.bib(spark, d)).withColumn("_order", F.lit(0)),
                             order_cols=["_order"])
    p = C.last_record_wins(parsed, "_order")
    return p.select("paper_id", "title", "abstract", F.size("refs").cast("bigint").alias("n_refs"),
                    F.array_join("refs", ",").alias("refs"))


@register("active_papers", V.sql_with(["doc_cites"], ACTIVE_SQL))
def q_active(spark, d):
    """Cited ids ∪ citing ids with at least one reference."""
    return _active(spark, d)


@register("edge_endpoints", V.sql_with(["doc_cites"],
                                       "SELECT source AS id FROM doc_cites UNION SELECT target FROM doc_cites"))
def q_endpoints(spark, d):
    """U2."""
    return C.edge_endpoints(V.doc_cites(spark, d))


@register("restrict_corpus", V.sql_with(["papers", "doc_cites"], """
    SELECT paper_id, title, abstract FROM papers WHERE paper_id IN (SELECT paper_id FROM active)""",
    [("active", ACTIVE_SQL)]))
def q_restrict(spark, d):
    """J2."""
    return C.restrict_corpus(V.papers(spark, d), _active(spark, d))


@register("paper_text", V.sql_with(["papers", "doc_cites"], "SELECT paper_id, text FROM t",
                                   [("active", ACTIVE_SQL), ("t", TEXT_SQL)]))
def q_paper_text(spark, d):
    """J1 (F3): title + ' ' + abstract for every active paper."""
    return _texts(spark, d)


@register("reference_text", V.sql_with(["papers", "doc_cites"], """
    SELECT c.source, c.target, p.paper_id IS NOT NULL AS has_title,
           md5(coalesce(p.title, '') || ' ' || coalesce(p.abstract, '')) AS text_md5
    FROM doc_cites c LEFT JOIN papers p ON p.paper_id = c.target"""))
def q_reference_text(spark, d):
    """Text of each cited id per citation (reported as md5)."""
    return C.reference_text(V.doc_cites(spark, d), V.papers(spark, d), digest=True)


@register("adjacency", V.sql_with(["doc_cites"], """
    SELECT c.source, (""" + "('0x' || substr(md5(concat_ws('|', c.target)), 1, 15))::BIGINT" + """
            % greatest(1, ceil(g.deg / 1024.0))::BIGINT) AS part,
           count(*) AS n_targets, array_to_string(list_sort(list(c.target)), ',') AS targets
    FROM doc_cites c JOIN (SELECT source, count(*) AS deg FROM doc_cites GROUP BY source) g
      ON g.source = c.source GROUP BY 1, 2"""))
def q_adjacency(spark, d):
    """A1: sorted target list per source (hubs split into parts of <= ~1024)."""
    a = C.adjacency(V.doc_cites(spark, d))
    return a.select("source", "part", "n_targets", F.array_join("targets", ",").alias("targets"))


@register("degree_filter", V.sql_with(["doc_cites"], f"""
    SELECT source, count(*) AS n_refs FROM doc_cites GROUP BY source HAVING count(*) > {MIN_DEGREE}"""))
def q_degree(spark, d):
    """A2: papers with more than 81 references."""
    return C.degree_filter(V.doc_cites(spark, d), MIN_DEGREE)


@register("distinct_refs", V.sql_with(["papers", "doc_cites"], """
    SELECT DISTINCT c.target AS paper_id, p.paper_id IS NOT NULL AS has_title,
           md5(coalesce(p.title, '') || ' ' || coalesce(p.abstract, '')) AS text_md5
    FROM doc_cites c LEFT JOIN papers p ON p.paper_id = c.target"""))
def q_distinct_refs(spark, d):
    """A4: distinct cited ids with their text (md5) and whether they have a title."""
    r = C.distinct_refs(V.doc_cites(spark, d), V.papers(spark, d))
    return r.select("paper_id", "has_title", F.md5("text").alias("text_md5"))


@register("duplicate_texts", V.sql_with(["papers", "doc_cites"], """
    SELECT md5(text) AS text_md5, length(text) AS n_chars, count(*) AS n
    FROM t GROUP BY text HAVING count(*) > 1""", [("active", ACTIVE_SQL), ("t", TEXT_SQL)]))
def q_duplicates(spark, d):
    """A5: texts that occur more than once among the active papers."""
    return C.duplicate_texts(_texts(spark, d))


@register("corpus_counts", V.sql_with(["bib", "doc_cites"], """
    SELECT count(*) AS n_papers, count(title) AS n_titles, count(nullif(abstract, '')) AS n_abstracts,
           sum(CASE WHEN len(refs) > 0 THEN 1 ELSE 0 END)::BIGINT AS n_citing,
           sum(len(refs))::BIGINT AS n_citations,
           (SELECT count(*) FROM active)::BIGINT AS n_active FROM bib""", [("active", ACTIVE_SQL)]))
def q_counts(spark, d):
    """A6."""
    return C.corpus_counts(V.papers(spark, d), V.doc_cites(spark, d))


@register("vocabulary", V.sql_with(["papers", "doc_cites"], f"""
    SELECT token, count(*) AS n FROM (SELECT unnest({tok_sql('text')}) AS token FROM t)
    GROUP BY token""", [("active", ACTIVE_SQL), ("t", TEXT_SQL)]))
def q_vocabulary(spark, d):
    """A7 + F4: token counts over the active papers' texts (min_count 1)."""
    return C.vocabulary(C.tokenized(_texts(spark, d)))


@register("token_counts", V.sql_with(["papers"], f"""
    SELECT paper_id, len({tok_sql("coalesce(title, '') || ' ' || abstract")}) AS n_tokens,
           len(list_distinct({tok_sql("coalesce(title, '') || ' ' || abstract")})) AS n_distinct
    FROM papers"""))
def q_token_counts(spark, d):
    """F4 per paper: token and distinct-token counts."""
    toks = tokenize(F.concat(F.coalesce("title", F.lit("")), F.lit(" "), "abstract"))
    return V.papers(spark, d).select("paper_id", F.size(toks).cast("bigint").alias("n_tokens"),
                                     F.size(F.array_distinct(toks)).cast("bigint").alias("n_distinct"))


@register("nonempty_abstracts", V.sql_with(["papers"], """
    SELECT paper_id, nullif(abstract, '') IS NOT NULL AS has_abstract FROM papers"""))
def q_nonempty(spark, d):
    """P5."""
    return C.nonempty_abstracts(V.papers(spark, d)).select(
        "paper_id", F.col("abstract").isNotNull().alias("has_abstract"))


@register("papers_with_refs", V.sql_with(["bib"], """
    SELECT paper_id, len(refs) AS n_refs FROM bib WHERE len(refs) > 0"""))
def q_with_refs(spark, d):
    """P6."""
    return C.with_ref_counts(V.papers(spark, d), V.doc_cites(spark, d)).where("n_refs > 0").select("paper_id", "n_refs")


@register("lookup_papers", V.sql_with(["papers"], """
    SELECT paper_id, title FROM papers WHERE paper_id IN (SELECT vec_id FROM embeddings)"""))
def q_lookup(spark, d):
    """Papers whose id is in a second table (here: ids that have a vector)."""
    ids = V.table(spark, d, "embeddings").select(F.col("vec_id").alias("paper_id"))
    return C.lookup_papers(V.papers(spark, d), ids).select("paper_id", "title")
