"""Registered queries: dictionary encoding (A16, J4, J10) over documents + doc_cites."""

from __future__ import annotations

from pyspark.sql import functions as F

from citegraph.operators import corpus as C
from citegraph.operators import encode as E
from citegraph.plans import views as V
from citegraph.plans.catalog import register

ACTIVE = ("active", "SELECT target AS paper_id FROM doc_cites UNION SELECT source FROM doc_cites")
DIMP = ("dimp", """SELECT row_number() OVER (ORDER BY a.paper_id) - 1 AS idx, a.paper_id,
        coalesce(p.title, '') || ' ' || coalesce(p.abstract, '') AS text
        FROM active a LEFT JOIN papers p ON p.paper_id = a.paper_id""")
DIMR = ("dimr", """SELECT row_number() OVER (ORDER BY c.paper_id) - 1 AS idx, c.paper_id,
        coalesce(p.title, '') || ' ' || coalesce(p.abstract, '') AS text
        FROM (SELECT DISTINCT target AS paper_id FROM doc_cites) c LEFT JOIN papers p ON p.paper_id = c.paper_id""")


def active(spark, d):
    return C.active_of(V.doc_cites(spark, d))


def dim_paper(spark, d):
    return E.paper_index(active(spark, d))


def dim_ref(spark, d):
    return E.ref_index(V.doc_cites(spark, d))


@register("encode_papers", V.sql_with(["papers", "doc_cites"],
                                      "SELECT idx, paper_id, md5(text) AS text_md5 FROM dimp", [ACTIVE, DIMP]))
def q_encode_papers(spark, d):
    """Active papers numbered 0..n-1 in id order, with their text (md5)."""
    out = E.encode_papers(active(spark, d), V.papers(spark, d))
    return out.select("idx", "paper_id", F.md5("text").alias("text_md5"))


@register("encode_refs", V.sql_with(["papers", "doc_cites"],
                                    "SELECT idx, paper_id, md5(text) AS text_md5 FROM dimr", [DIMR]))
def q_encode_refs(spark, d):
    """A4 + A16: cited ids numbered 0..n-1."""
    out = E.encode_refs(V.doc_cites(spark, d), V.papers(spark, d))
    return out.select("idx", "paper_id", F.md5("text").alias("text_md5"))


@register("encode_pairs", V.sql_with(["papers", "doc_cites"], """
    SELECT p.idx AS paper_idx, r.idx AS ref_idx FROM doc_cites c
    JOIN dimp p ON p.paper_id = c.source JOIN dimr r ON r.paper_id = c.target""", [ACTIVE, DIMP, DIMR]))
def q_encode_pairs(spark, d):
    """Citations → (paper_idx, ref_idx)."""
    return E.encode_pairs(V.doc_cites(spark, d), dim_paper(spark, d), dim_ref(spark, d))


@register("decode_pairs", V.sql_with(["papers", "doc_cites"], """
    SELECT e.paper_idx, e.ref_idx, p.paper_id, r.paper_id AS ref_id, md5(r.text) AS ref_text_md5
    FROM (SELECT p.idx AS paper_idx, r.idx AS ref_idx FROM doc_cites c
          JOIN dimp p ON p.paper_id = c.source JOIN dimr r ON r.paper_id = c.target) e
    JOIN dimp p ON p.idx = e.paper_idx JOIN dimr r ON r.idx = e.ref_idx""", [ACTIVE, DIMP, DIMR]))
def q_decode(spark, d):
    """Idx → paper id and text, on both ends of the encoded pairs."""
    dp, dr = dim_paper(spark, d), dim_ref(spark, d)
    enc = E.encode_pairs(V.doc_cites(spark, d), dp, dr)
    out = E.decode(enc, dp.select("idx", "paper_id"), "paper_idx")
    ref = E.with_text(dr, V.papers(spark, d)).select(  # the digest is taken before the join with the pairs
        "idx", F.col("paper_id").alias("ref_id"), F.md5("text").alias("ref_text_md5"))
    out = E.decode(out, ref, "ref_idx")
    return out.select("paper_idx", "ref_idx", "paper_id", "ref_id", "ref_text_md5")
