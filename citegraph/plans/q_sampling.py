"""Registered queries: sampling and splitting (T6-T12, J7) over vec_cites / pairs."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from citegraph.functions.hashing import hash_threshold, sql_hash64 as H
from citegraph.operators import graph as G
from citegraph.operators import sampling as S
from citegraph.plans import views as V
from citegraph.plans.catalog import register

SEED = 42
P_HELD_OUT = 0.1   # share of links held out, as in the reference's splits
N_POSITIVE = 500   # positives per minibatch of the pair model
NEG_RATIO = 2      # negatives per positive
BATCH = 20         # links per minibatch of the GraphSAGE run
K_HOP1 = 20        # neighbours sampled at hop 1
T_HELD = hash_threshold(P_HELD_OUT)

UND = ("und", "SELECT DISTINCT least(source, target) AS source, greatest(source, target) AS target "
              "FROM vec_cites WHERE source <> target")
POS = ("pos", f"SELECT source, target FROM und WHERE {H(SEED, 'source', 'target')} < {T_HELD}")
NEG = [
    ("dim", "SELECT id AS node, row_number() OVER (ORDER BY id) - 1 AS idx FROM vectors"),
    ("cand", f"""SELECT 0 AS round, i, {H(SEED, 0, 'i', "'a'")} % nn AS ia, {H(SEED, 0, 'i', "'b'")} % nn AS ib
                FROM (SELECT unnest(range(0, (SELECT CAST(ceil(2.0 * count(*)) AS BIGINT) + 1000 FROM pos))) AS i),
                     (SELECT count(*) AS nn FROM vectors)"""),
    ("c2", """SELECT round, i, least(x.node, y.node) AS a, greatest(x.node, y.node) AS b
              FROM cand JOIN dim x ON x.idx = cand.ia JOIN dim y ON y.idx = cand.ib WHERE x.node <> y.node"""),
    ("c3", """SELECT a, b, min(i) AS i FROM c2
              WHERE NOT EXISTS (SELECT 1 FROM und u WHERE u.source = c2.a AND u.target = c2.b) GROUP BY a, b"""),
    ("neg", """SELECT a AS source, b AS target, 0 AS round, i FROM (
               SELECT *, row_number() OVER (ORDER BY i) AS rn FROM c3) WHERE rn <= (SELECT count(*) FROM pos)"""),
]


def und(spark, d):
    return V.stored(spark, d, "und", ("lineitem", "embeddings"), lambda: G.simple_graph(V.vec_cites(spark, d)))


def positives(spark, d):
    return S.sample_edges(und(spark, d), P_HELD_OUT, SEED)


def negatives(spark, d):
    pos = positives(spark, d)
    return S.sample_negative_links(V.vectors(spark, d), und(spark, d), pos.count(), SEED)


def links(spark, d):
    """Held-out positives (label 1) + as many sampled non-edges (label 0), stored once per session."""
    return V.stored(spark, d, "links", ("lineitem", "embeddings"), lambda: (
        positives(spark, d).withColumn("label", F.lit(1))
        .unionByName(negatives(spark, d).select("source", "target", F.lit(0).alias("label")))))


LINKS_CTES = [UND, POS] + NEG + [
    ("links", "SELECT source, target, 1 AS label FROM pos UNION ALL SELECT source, target, 0 FROM neg")]


@register("sample_edges", V.sql_with(["vec_cites"], "SELECT source, target FROM pos", [UND, POS]))
def q_sample_edges(spark, d):
    """Bernoulli(0.1) sample of the undirected links, keyed by md5."""
    return positives(spark, d)


@register("sample_edges_exact", V.sql_with(["vec_cites"], f"""
    SELECT source, target FROM (
        SELECT source, target, row_number() OVER (ORDER BY {H(SEED, 'source', 'target')}, source, target) AS rn
        FROM und) WHERE rn <= (SELECT floor({P_HELD_OUT} * count(*) + 0.5) FROM und)""", [UND]))
def q_sample_edges_exact(spark, d):
    """T6 exact: the round(0.1 m) links of smallest hash."""
    return S.sample_edges(und(spark, d), P_HELD_OUT, SEED, exact=True)


@register("sample_positives", V.sql_with(["pairs"], f"""
    SELECT paper_idx, ref_idx, copy FROM (
        SELECT paper_idx, ref_idx, unnest(range(0, c)) AS copy FROM (
            SELECT paper_idx, ref_idx, count(*) AS c FROM pairs GROUP BY 1, 2))
    ORDER BY {H(SEED, 0, 'paper_idx', 'ref_idx', 'copy')}, paper_idx, ref_idx, copy LIMIT {N_POSITIVE}"""))
def q_sample_positives(spark, d):
    """500 pairs without replacement (duplicates are separate rows)."""
    return S.sample_positive_pairs(V.pairs(spark, d), N_POSITIVE, SEED, 0)


def _pair_sizes(spark, d):
    r = V.pairs(spark, d).agg(F.max("paper_idx").alias("p"), F.max("ref_idx").alias("r")).first()
    return r["p"] + 1, r["r"] + 1


N_NEG = N_POSITIVE * NEG_RATIO
CAND_SQL = ("cand", f"""SELECT 0 AS round, i, {H(SEED, 0, 0, 'i', "'p'")} % np AS paper_idx,
        {H(SEED, 0, 0, 'i', "'r'")} % nr AS ref_idx
    FROM range(0, {int(math.ceil(N_NEG * 1.5)) + 16}) t(i),
         (SELECT max(paper_idx) + 1 AS np, max(ref_idx) + 1 AS nr FROM pairs)""")
KEPT_SQL = ("kept", """SELECT * FROM cand WHERE NOT EXISTS (
    SELECT 1 FROM pairs p WHERE p.paper_idx = cand.paper_idx AND p.ref_idx = cand.ref_idx)""")


@register("reject_known", V.sql_with(["pairs"], "SELECT round, i, paper_idx, ref_idx FROM kept",
                                     [CAND_SQL, KEPT_SQL]))
def q_reject_known(spark, d):
    """Candidate pairs of the first draw that are not known pairs."""
    n_p, n_r = _pair_sizes(spark, d)
    c = S.negative_candidates(spark, int(math.ceil(N_NEG * 1.5)) + 16, n_p, n_r, SEED, 0, 0)
    return S.reject_known(c, V.pairs(spark, d)).select("round", "i", "paper_idx", "ref_idx")


def _negative_pairs(spark, d):
    n_p, n_r = _pair_sizes(spark, d)
    return S.sample_negative_pairs(V.pairs(spark, d), N_NEG, n_p, n_r, SEED, 0)


@register("sample_negatives", V.sql_with(["pairs"], f"""
    SELECT paper_idx, ref_idx, round, i FROM kept ORDER BY round, i LIMIT {N_NEG}""", [CAND_SQL, KEPT_SQL]))
def q_sample_negatives(spark, d):
    """1,000 uniform non-pairs (repeats allowed), first by draw order."""
    return _negative_pairs(spark, d)


@register("labelled_pairs", V.sql_with(["pairs"], f"""
    SELECT paper_idx, ref_idx, label, {H(SEED, 0, 's', 'paper_idx', 'ref_idx', 'n')} AS shuffle_key FROM (
        SELECT paper_idx, ref_idx, 1.0::DOUBLE AS label, 'p' AS s, copy AS n FROM pos
        UNION ALL SELECT paper_idx, ref_idx, -1.0::DOUBLE, 'n', round * {1 << 40} + i FROM neg)""",
    [CAND_SQL, KEPT_SQL,
     ("neg", f"SELECT * FROM kept ORDER BY round, i LIMIT {N_NEG}"),
     ("pos", f"""SELECT paper_idx, ref_idx, copy FROM (
        SELECT paper_idx, ref_idx, unnest(range(0, c)) AS copy FROM (
            SELECT paper_idx, ref_idx, count(*) AS c FROM pairs GROUP BY 1, 2))
        ORDER BY {H(SEED, 0, 'paper_idx', 'ref_idx', 'copy')}, paper_idx, ref_idx, copy LIMIT {N_POSITIVE}""")]))
def q_labelled_pairs(spark, d):
    """One minibatch: positives label 1, negatives -1, with a shuffle key."""
    pos = S.sample_positive_pairs(V.pairs(spark, d), N_POSITIVE, SEED, 0)
    return S.labelled_pairs(pos, _negative_pairs(spark, d), seed=SEED, epoch=0)


@register("negative_links", V.sql_with(["vec_cites", "vectors"], "SELECT source, target, round, i FROM neg",
                                       [UND, POS] + NEG))
def q_negative_links(spark, d):
    """As many non-edges as held-out positives, uniform over node pairs."""
    return negatives(spark, d)


@register("batches", V.sql_with(["vec_cites", "vectors"], f"""
    SELECT source, target, label, CAST(floor((row_number() OVER (
        ORDER BY {H(SEED, 0, 'source', 'target')}, source, target) - 1) / {BATCH}) AS BIGINT) AS batch
    FROM links""", LINKS_CTES))
def q_batches(spark, d):
    """Shuffled minibatches of 20 links."""
    return S.assign_batches(links(spark, d), BATCH, ["source", "target"], seed=SEED, epoch=0)


@register("sample_neighbours", V.sql_with(["vec_cites"], f"""
    SELECT source, target, CAST(rn AS INTEGER) AS slot FROM (
        SELECT source, target, row_number() OVER (
            PARTITION BY source ORDER BY {H(SEED, 1, 'source', 'target')}, target) AS rn
        FROM (SELECT source, target FROM und UNION ALL SELECT target, source FROM und))
    WHERE rn <= {K_HOP1}""", [UND]))
def q_sample_neighbours(spark, d):
    """At most 20 neighbours per node (hop 1), md5-keyed, without replacement."""
    return S.sample_neighbours(G.symmetric(und(spark, d)), K_HOP1, SEED, hop=1)
