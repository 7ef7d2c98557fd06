"""Registered queries: vector search and the text-route recommendation."""

from __future__ import annotations

from pyspark.sql import functions as F

from citegraph.operators import metrics, recommend, vectors
from citegraph.plans import views as V
from citegraph.plans.catalog import r6, register

K = 10  # neighbours per query, as in the reference notebook
N_SIMILAR = 20  # find_similar default list length

# -------------------------------------------------------------- SQL fragments
_L2 = "list_distance(q.embedding::DOUBLE[], v.embedding::DOUBLE[])"
_KNN_SQL = lambda self_clause: f"""SELECT query_id, neighbour_id, rk, dist FROM (
    SELECT q.id AS query_id, v.id AS neighbour_id, {_L2} AS dist,
           row_number() OVER (PARTITION BY q.id ORDER BY round({_L2}, 9), v.id) AS rk
    FROM vectors q, vectors v {self_clause}) WHERE rk <= {K}"""

_RECS_CTES = [
    ("knn", _KNN_SQL("WHERE q.id <> v.id")),
    ("recs", """SELECT query_id, neighbour_id AS rec_id FROM knn
                UNION SELECT k.query_id, c.target FROM knn k JOIN vec_cites c ON c.source = k.neighbour_id"""),
]


def _knn_self_excluded(spark, d):
    vec = V.vectors(spark, d)
    return vectors.knn(vec, vec, K, exclude_self=True)


def _recs(spark, d):
    return recommend.expand_neighbours(_knn_self_excluded(spark, d), V.vec_cites(spark, d))


@register("knn_l2", V.sql_with(["vectors"], f"""
    SELECT query_id AS paper_id, neighbour_id, CAST(rk AS INTEGER) AS rank,
           round(dist, 6) AS distance FROM knn""", [("knn", _KNN_SQL(""))]))
def q_knn_l2(spark, d):
    """Every paper's 10 nearest vectors (self included, as in the reference)."""
    vec = V.vectors(spark, d)
    return vectors.knn(vec, vec, K).select(
        F.col("query_id").alias("paper_id"), "neighbour_id", "rank", r6("distance").alias("distance"))


@register("neighbour_recs", V.sql_with(["vectors", "vec_cites"],
                                       "SELECT query_id AS paper_id, rec_id FROM recs", _RECS_CTES))
def q_neighbour_recs(spark, d):
    """J8 + U4: neighbours (self excluded) and their references, per query paper."""
    return _recs(spark, d).select(F.col("query_id").alias("paper_id"), "rec_id")


@register("matched_refs", V.sql_with(["vectors", "vec_cites"], """
    SELECT query_id AS paper_id, rec_id FROM recs
    INTERSECT SELECT source, target FROM vec_cites""", _RECS_CTES))
def q_matched_refs(spark, d):
    """Recommended ids that are true references."""
    return recommend.matched_references(_recs(spark, d), V.vec_cites(spark, d)).select(
        F.col("query_id").alias("paper_id"), "rec_id")


REC_QUALITY_SQL = V.sql_with(["vectors", "vec_cites"], """
    SELECT m.query_id AS paper_id, coalesce(t.n_true, 0) AS n_true, m.n_recommended, m.n_matched,
           round(m.n_matched / m.n_recommended, 6) AS precision,
           round(m.n_matched / nullif(t.n_true, 0), 6) AS recall,
           round(CASE WHEN t.n_true IS NULL THEN NULL
                      WHEN m.n_matched = 0 THEN 0.0
                      ELSE 2.0 * (m.n_matched / m.n_recommended) * (m.n_matched / t.n_true)
                           / ((m.n_matched / m.n_recommended) + (m.n_matched / t.n_true)) END, 6) AS f1
    FROM m LEFT JOIN t ON t.source = m.query_id""", _RECS_CTES + [
    ("m", """SELECT r.query_id, count(*) AS n_recommended, count(c.target) AS n_matched
             FROM recs r LEFT JOIN vec_cites c ON c.source = r.query_id AND c.target = r.rec_id
             GROUP BY r.query_id"""),
    ("t", "SELECT source, count(*) AS n_true FROM vec_cites GROUP BY source"),
])


def rec_quality(spark, d):
    q = metrics.recommendation_quality(_recs(spark, d), V.vec_cites(spark, d))
    return q.select(F.col("query_id").alias("paper_id"), "n_true", "n_recommended", "n_matched",
                    r6("precision").alias("precision"), r6("recall").alias("recall"),
                    r6("f1").alias("f1"))


register("rec_quality", REC_QUALITY_SQL)(rec_quality)


_UNIT = "list_transform(embedding::DOUBLE[], lambda x: x / sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda y: y * y))))"


@register("unit_vectors", V.sql_with(["vectors"], """
    SELECT id, round(sqrt(list_sum(list_transform(u, lambda x: x * x))), 6) AS norm,
           round(u[1], 6) AS first_component, round(list_sum(u), 6) AS component_sum
    FROM (SELECT id, """ + _UNIT + """ AS u FROM vectors)"""))
def q_unit_vectors(spark, d):
    """Unit rows; reported as norm (1.0), first component and component sum."""
    u = vectors.unit_embeddings(V.vectors(spark, d))
    return u.select("id",
                    r6(F.sqrt(F.aggregate(F.transform("embedding", lambda x: x * x),
                                          F.lit(0.0), lambda a, x: a + x))).alias("norm"),
                    r6(F.col("embedding")[0]).alias("first_component"),
                    r6(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x)).alias("component_sum"))


def _sim_sql(desc: bool) -> str:
    order = "DESC" if desc else "ASC"
    return V.sql_with(["vectors"], f"""
    SELECT query_id AS paper_id, neighbour_id, CAST(rk AS INTEGER) AS rank,
           round(sim, 6) AS similarity FROM (
        SELECT q.id AS query_id, v.id AS neighbour_id, list_inner_product(q.u, v.u) AS sim,
               row_number() OVER (PARTITION BY q.id
                                  ORDER BY round(list_inner_product(q.u, v.u), 9) {order}, v.id) AS rk
        FROM u q, u v) WHERE rk <= {N_SIMILAR}""", [("u", f"SELECT id, {_UNIT} AS u FROM vectors")])


@register("similar_cosine", _sim_sql(True))
def q_similar(spark, d):
    """For every paper, the 20 most similar unit rows (itself included)."""
    u = vectors.unit_embeddings(V.vectors(spark, d))
    return vectors.find_similar(u, u, N_SIMILAR).select(
        F.col("query_id").alias("paper_id"), "neighbour_id", "rank", r6("similarity").alias("similarity"))


@register("dissimilar_cosine", _sim_sql(False))
def q_dissimilar(spark, d):
    """T4: for every paper, the 20 least similar unit rows."""
    u = vectors.unit_embeddings(V.vectors(spark, d))
    return vectors.find_similar(u, u, N_SIMILAR, least=True).select(
        F.col("query_id").alias("paper_id"), "neighbour_id", "rank", r6("similarity").alias("similarity"))


@register("rank_all", V.sql_with(["vectors"], """
    SELECT q.id AS paper_id, v.id AS neighbour_id,
           row_number() OVER (ORDER BY round(list_inner_product(q.u, v.u), 9), v.id) AS rank,
           round(list_inner_product(q.u, v.u), 6) AS similarity
    FROM u q, u v WHERE q.id = (SELECT min(id) FROM vectors)""",
    [("u", f"SELECT id, {_UNIT} AS u FROM vectors")]))
def q_rank_all(spark, d):
    """T5: full ascending order of every paper's similarity to the first paper (min id)."""
    u = vectors.unit_embeddings(V.vectors(spark, d))
    first = u.agg(F.min("id").alias("id"))
    query = u.join(first, "id", "left_semi")
    return vectors.rank_all(query, u).select(
        F.col("query_id").alias("paper_id"), "neighbour_id", "rank", r6("similarity").alias("similarity"))
