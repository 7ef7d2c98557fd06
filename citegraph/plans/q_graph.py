"""Registered queries: graph operators over vectors + vec_cites (G1-G12, J11, J12, A8, components)."""

from __future__ import annotations

from pyspark.sql import functions as F

from citegraph.functions.hashing import sql_hash64 as H
from citegraph.operators import gnn
from citegraph.operators import graph as G
from citegraph.operators import sampling as S
from citegraph.operators.cells import Cells
from citegraph.plans import views as V
from citegraph.plans.catalog import ORACLE, r6, register
from citegraph.plans.q_sampling import POS, SEED, UND, positives, und
from citegraph.session import cut_lineage

DIM = 64          # embedding width of the driver's vectors
GCN_UNITS = 16    # GCN layer width, as in the reference
SAGE_UNITS = 20   # GraphSAGE layer width (two halves of 10), as in the reference
K1, K2 = 20, 10   # neighbour samples at hop 1 and 2, as in the reference

SYM = ("sym", "SELECT source, target FROM und UNION ALL SELECT target, source FROM und "
              "UNION ALL SELECT id, id FROM vectors")
NORM = [SYM,
        ("deg", "SELECT source AS n, count(*)::DOUBLE AS d FROM sym GROUP BY source"),
        ("ne", """SELECT s.target AS dst, s.source AS src, 1.0 / sqrt(a.d * b.d) AS w
                  FROM sym s JOIN deg a ON a.n = s.source JOIN deg b ON b.n = s.target""")]
HX = ("hx", "SELECT id, unnest(generate_series(0, len(embedding) - 1)) AS pos, "
            "unnest(embedding::DOUBLE[]) AS x FROM vectors")


def _w_sql(name: str, seed: int, fan_in: int, fan_out: int) -> str:
    import math
    lim = repr(math.sqrt(6.0 / (fan_in + fan_out)))
    return f"""SELECT i, j, ({H(seed, f"'{name}'", 'i', 'j')} / {float(1 << 60)!r} - 0.5) * (2.0 * {lim}) AS w
               FROM range(0, {fan_in}) a(i), range(0, {fan_out}) b(j)"""


def _h(spark, d):
    return V.vectors(spark, d).select("id", F.col("embedding").cast("array<double>").alias("h"))


def _norm(spark, d):
    return G.gcn_norm_edges(V.vectors(spark, d), und(spark, d))


def _blocks(spark, d):
    """Cells for the edges of :func:`_norm`, whose number follows from stored tables."""
    n = V.vectors(spark, d).count()
    return Cells.of(n, 2 * und(spark, d).count() + n, spark.sparkContext.defaultParallelism)


def _cells(h):
    return gnn.exploded(h).select("id", F.col("pos").cast("bigint").alias("pos"), r6("x").alias("x"))


@register("simple_graph", V.sql_with(["vec_cites"], "SELECT source, target FROM und", [UND]))
def q_simple_graph(spark, d):
    """G1: undirected simple graph of vec_cites."""
    return und(spark, d)


@register("typed_nodes", "SELECT vec_id AS id, 'paper' AS node_type, len(embedding) AS n_features FROM embeddings")
def q_typed_nodes(spark, d):
    """G2 + G3 + J11: every node typed 'paper' with its feature row attached."""
    v = V.vectors(spark, d)
    g = G.attach_features(v.select("id"), v.select("id", F.col("embedding").alias("features")))
    return G.typed_nodes(g).select("id", "node_type", F.size("features").cast("bigint").alias("n_features"))


@register("attributed_graph", V.sql_with(["vec_cites", "vectors"], """
    SELECT u.source, u.target, round(list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS product,
           (SELECT count(DISTINCT id) FROM (SELECT source AS id FROM und UNION ALL SELECT target FROM und)) AS n_nodes
    FROM und u JOIN vectors a ON a.id = u.source JOIN vectors b ON b.id = u.target""", [UND]))
def q_attributed_graph(spark, d):
    """Graph and features as one object: its edges with the inner product of their ends' features, and its number of nodes."""
    g = G.AttributedGraph.build(V.vec_cites(spark, d), V.vectors(spark, d).select("id", "embedding"))
    n = g.nodes.agg(F.count("*").alias("n_nodes"))
    scored = G.link_score(g.edges, g.nodes, act="linear", vec_col="embedding")
    return scored.select("source", "target", r6("score").alias("product")).join(n)  # one row


@register("graph_summary", V.sql_with(["vec_cites", "vectors"], """
    SELECT count(*) AS n_nodes, sum(CASE WHEN degree = 0 THEN 1 ELSE 0 END)::BIGINT AS n_isolated,
           min(degree) AS min_degree, avg(degree) AS mean_degree, max(degree) AS max_degree,
           (SELECT count(*) FROM und) AS n_edges, (SELECT max(len(embedding)) FROM vectors)::INTEGER AS feature_length
    FROM (SELECT v.id, coalesce(g.deg, 0)::BIGINT AS degree FROM vectors v LEFT JOIN (
            SELECT n, count(*) AS deg FROM (SELECT source AS n FROM und UNION ALL SELECT target FROM und)
            GROUP BY n) g ON g.n = v.id)""", [UND]))
def q_graph_summary(spark, d):
    """Graph description."""
    s = G.graph_summary(V.vectors(spark, d), und(spark, d))
    return s.select("n_nodes", "n_isolated", "min_degree", F.round("mean_degree", 6).alias("mean_degree"),
                    "max_degree", "n_edges", "feature_length")


@register("held_out_removed", V.sql_with(["vec_cites"], """
    SELECT source, target FROM und EXCEPT SELECT source, target FROM pos""", [UND, POS]))
def q_held_out_removed(spark, d):
    """Reduced graph = links minus the held-out sample."""
    return G.remove_edges(und(spark, d), positives(spark, d))


@register("components", V.sql_with(["vec_cites", "vectors"], """
    SELECT node AS id, min(label) AS component FROM cc GROUP BY node""",
    [UND, ("cc(node, label)", """SELECT id, id FROM vectors UNION
        SELECT e.t, c.label FROM cc c JOIN (SELECT source AS s, target AS t FROM und
                                            UNION ALL SELECT target, source FROM und) e ON e.s = c.node""")]
    ).replace("WITH ", "WITH RECURSIVE ", 1))
def q_components(spark, d):
    """Connected components (Borůvka rounds), label = smallest id."""
    return G.connected_components(V.vectors(spark, d), und(spark, d))


@register("gcn_step", V.sql_with(["vec_cites", "vectors"], """
    SELECT ne.dst AS id, hx.pos, round(sum(ne.w * hx.x), 6) AS x FROM ne JOIN hx ON hx.id = ne.src
    GROUP BY 1, 2""", [UND] + NORM + [HX]))
def q_gcn_step(spark, d):
    """One step Â·H, Â = D^-1/2 (A+I) D^-1/2, on the 64-wide vectors."""
    return _cells(G.propagate(_norm(spark, d), _h(spark, d), DIM, cells=_blocks(spark, d)))


@register("gcn_layer", V.sql_with(["vec_cites", "vectors"], """
    SELECT ne.dst AS id, hw.j AS pos, round(greatest(sum(ne.w * hw.v), 0.0), 6) AS x
    FROM ne JOIN hw ON hw.id = ne.src GROUP BY 1, 2""", [UND] + NORM + [HX, ("W", _w_sql("gcn0", SEED, DIM, GCN_UNITS)),
    ("hw", "SELECT hx.id, W.j, sum(hx.x * W.w) AS v FROM hx JOIN W ON W.i = hx.pos GROUP BY 1, 2")]))
def q_gcn_layer(spark, d):
    """relu(Â·(H·W)) with Glorot weights fixed by md5 of the seed."""
    W = gnn.glorot(SEED, "gcn0", DIM, GCN_UNITS)
    return _cells(gnn.gcn_layer(_norm(spark, d), _h(spark, d), W, cells=_blocks(spark, d)))


SAMPLED = ("smp", f"""SELECT source, target FROM (
    SELECT source, target, row_number() OVER (PARTITION BY source ORDER BY {H(SEED, 1, 'source', 'target')}, target) AS rn
    FROM (SELECT source, target FROM und UNION ALL SELECT target, source FROM und)) WHERE rn <= {K1}""")


def _sampled(spark, d):
    return S.sample_neighbours(G.symmetric(und(spark, d)), K1, SEED, hop=1)


@register("mean_aggregate", V.sql_with(["vec_cites", "vectors"], f"""
    SELECT v.id, p.pos, round(coalesce(m.x, 0.0), 6) AS x
    FROM vectors v CROSS JOIN (SELECT unnest(generate_series(0, {DIM - 1})) AS pos) p
    LEFT JOIN (SELECT smp.source AS id, hx.pos, avg(hx.x) AS x FROM smp JOIN hx ON hx.id = smp.target
               GROUP BY 1, 2) m ON m.id = v.id AND m.pos = p.pos""", [UND, SAMPLED, HX]))
def q_mean_aggregate(spark, d):
    """Mean of the sampled (k=20) neighbours' vectors; isolated → zeros."""
    v = V.vectors(spark, d)
    return _cells(G.mean_aggregate(_sampled(spark, d), _h(spark, d), v, DIM))


@register("sage_layer", V.sql_with(["vec_cites", "vectors"], f"""
    SELECT id, pos, round(greatest(v + b.w, 0.0), 6) AS x FROM (
        SELECT hx.id, W.j AS pos, sum(hx.x * W.w) AS v FROM hx JOIN Ws W ON W.i = hx.pos GROUP BY 1, 2
        UNION ALL
        SELECT v.id, {SAGE_UNITS // 2} + p.j, coalesce(m.v, 0.0) FROM vectors v
        CROSS JOIN (SELECT unnest(generate_series(0, {SAGE_UNITS // 2 - 1})) AS j) p
        LEFT JOIN (SELECT smp.source AS id, hw.j, avg(hw.v) AS v FROM smp JOIN hw ON hw.id = smp.target
                   GROUP BY 1, 2) m ON m.id = v.id AND m.j = p.j) z
    JOIN B b ON b.j = z.pos""",
    [UND, SAMPLED, HX, ("Ws", _w_sql("sage_self", SEED, DIM, SAGE_UNITS // 2)),
     ("Wn", _w_sql("sage_neigh", SEED, DIM, SAGE_UNITS // 2)),
     ("B", f"SELECT j, w FROM ({_w_sql('sage_bias', SEED, 1, SAGE_UNITS)})"),
     ("hw", "SELECT hx.id, W.j, sum(hx.x * W.w) AS v FROM hx JOIN Wn W ON W.i = hx.pos GROUP BY 1, 2")]))
def q_sage_layer(spark, d):
    """relu(concat(H·W_self, mean_sampled(H)·W_neigh) + b), fixed md5 weights."""
    Ws = gnn.glorot(SEED, "sage_self", DIM, SAGE_UNITS // 2)
    Wn = gnn.glorot(SEED, "sage_neigh", DIM, SAGE_UNITS // 2)
    b = gnn.glorot(SEED, "sage_bias", 1, SAGE_UNITS)[0]
    return _cells(gnn.sage_layer(_sampled(spark, d), _h(spark, d), V.vectors(spark, d), Ws, Wn, b))


@register("link_blocks", V.sql_with(["vec_cites", "vectors"], f"""
    SELECT l.source, l.target, e.side, h1.rn AS slot, h1.target AS hop1, string_agg(CAST(h2.target AS VARCHAR), ',' ORDER BY h2.rn) AS hop2
    FROM pos l, (VALUES ('source'), ('target')) e(side)
    JOIN h1 ON h1.source = CASE WHEN e.side = 'source' THEN l.source ELSE l.target END JOIN h2 ON h2.source = h1.target
    GROUP BY 1, 2, 3, 4, 5""",
    [UND, POS, ("s", "SELECT source, target FROM und UNION ALL SELECT target, source FROM und")] + [
        (f"h{hop}", f"""SELECT source, target, rn FROM (SELECT source, target, row_number() OVER (PARTITION BY source
            ORDER BY {H(SEED, hop, 'source', 'target')}, target) - 1 AS rn FROM s) WHERE rn < {k}""") for hop, k in ((1, K1), (2, K2))]))
def q_link_blocks(spark, d):
    """The sampled 2-hop neighbourhoods [20, 10] of both ends of every held-out link, in the order of the draws."""
    blocks = G.link_neighbourhoods(positives(spark, d), und(spark, d), (K1, K2), SEED)
    sides = [blocks.select("source", "target", F.lit(s).alias("side"), F.posexplode(f"{s}_hops").alias("slot", "b")) for s in ("source", "target")]
    return (sides[0].unionByName(sides[1])
            .select("source", "target", "side", F.col("slot").cast("bigint").alias("slot"), "b.hop1",
                    F.array_join(F.col("b.hop2").cast("array<string>"), ",").alias("hop2")))


@register("sage_layer_unit", "SELECT id, pos, round(x / greatest(sqrt(sum(x * x) OVER (PARTITION BY id)), 1e-6), 6) AS x FROM ("
          + ORACLE["sage_layer"].replace("round(greatest(v + b.w, 0.0), 6) AS x", "v + b.w AS x") + ")")
def q_sage_layer_unit(spark, d):
    """The last layer: linear, and divided by its L2 norm."""
    Ws, Wn = (gnn.glorot(SEED, n, DIM, SAGE_UNITS // 2) for n in ("sage_self", "sage_neigh"))
    b = gnn.glorot(SEED, "sage_bias", 1, SAGE_UNITS)[0]
    return _cells(gnn.sage_layer(_sampled(spark, d), _h(spark, d), V.vectors(spark, d), Ws, Wn, b, act="linear", unit=True))


@register("link_score", V.sql_with(["vec_cites", "vectors"], """
    SELECT p.source, p.target, round(1.0 / (1.0 + exp(-list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]))), 6) AS score
    FROM pos p JOIN vectors a ON a.id = p.source JOIN vectors b ON b.id = p.target""", [UND, POS]))
def q_link_score(spark, d):
    """Sigmoid of the inner product of both ends' vectors, on the held-out links."""
    s = G.link_score(positives(spark, d), _h(spark, d), op="ip", act="sigmoid")
    return s.select("source", "target", r6("score").alias("score"))


@register("two_hop", V.sql_with(["vec_cites"], f"""
    SELECT h1.source AS node, h1.target AS hop1, h2.target AS hop2 FROM h1 LEFT JOIN h2 ON h2.source = h1.target""",
    [UND, ("s", "SELECT source, target FROM und UNION ALL SELECT target, source FROM und"),
     ("h1", f"""SELECT source, target FROM (SELECT source, target, row_number() OVER (PARTITION BY source
               ORDER BY {H(SEED, 1, 'source', 'target')}, target) AS rn FROM s) WHERE rn <= {K1}"""),
     ("h2", f"""SELECT source, target FROM (SELECT source, target, row_number() OVER (PARTITION BY source
               ORDER BY {H(SEED, 2, 'source', 'target')}, target) AS rn FROM s) WHERE rn <= {K2}""")]))
def q_two_hop(spark, d):
    """Sampled 2-hop neighbourhood [20, 10] of every node."""
    return G.two_hop_neighbourhood(und(spark, d), (K1, K2), SEED)


@register("spanning_forest")
def q_spanning_forest(spark, d):
    """Minimum spanning forest under md5 weights (rows = nodes - components)."""
    return G.spanning_forest(V.vectors(spark, d), und(spark, d), SEED)


CC = ("cc(node, label)", """SELECT id, id FROM vectors UNION
    SELECT e.t, c.label FROM cc c JOIN (SELECT source AS s, target AS t FROM und
                                        UNION ALL SELECT target, source FROM und) e ON e.s = c.node""")
COMPONENTS = ("comps", "SELECT count(DISTINCT label) AS k FROM (SELECT node, min(label) AS label FROM cc GROUP BY node)")


def _recursive(body, ctes):
    return V.sql_with(["vec_cites", "vectors"], body, ctes).replace("WITH ", "WITH RECURSIVE ", 1)


def _n_components(nodes, edges):
    return G.connected_components(nodes, edges).agg(F.countDistinct("component").alias("n_components"))


def _n(df, name):
    return df.agg(F.count("*").alias(name))


@register("forest_check", _recursive("""
    SELECT n - k AS n_edges, n - k AS n_in_graph, k AS n_components
    FROM comps, (SELECT count(*) AS n FROM vectors)""", [UND, CC, COMPONENTS]))
def q_forest_check(spark, d):
    """A forest has nodes - components edges, all of the graph, and the graph's components."""
    v, e = V.vectors(spark, d), und(spark, d)
    forest = cut_lineage(G.spanning_forest(v, e, SEED))
    inside = forest.join(e, ["source", "target"], "left_semi")
    return _n(forest, "n_edges").join(_n(inside, "n_in_graph")).join(_n_components(v, forest))


def _split_facts(nodes, graph, reduced, links):
    """One row of facts about a split of ``graph``."""
    pos, neg = links.where("label = 1"), links.where("label = 0")
    pair = ["source", "target"]
    return (_n(pos, "n_pos").join(_n(neg, "n_neg")).join(_n(reduced, "n_reduced"))
            .join(_n(pos.join(graph, pair, "left_semi").join(reduced, pair, "left_anti"), "n_removed"))
            .join(_n(neg.select(pair).distinct().join(graph, pair, "left_anti").where("source < target"), "n_non_edges"))
            .join(_n_components(nodes, reduced)))


def _split_sql(m: str) -> str:
    return f"""SELECT held AS n_pos, held AS n_neg, m - held AS n_reduced, held AS n_removed, held AS n_non_edges, k AS n_components
               FROM (SELECT m, CAST(floor(0.1 * m + 0.5) AS BIGINT) AS held FROM (SELECT {m} AS m)), comps"""


@register("split_check", _recursive(_split_sql("(SELECT count(*) FROM und)"), [UND, CC, COMPONENTS]))
def q_split_check(spark, d):
    """0.1 m positives that are edges no more, as many non-edges, and no component split."""
    v, e = V.vectors(spark, d), und(spark, d)
    reduced, links = G.split_links(v, e, 0.1, SEED)
    return _split_facts(v, e, cut_lineage(reduced), cut_lineage(links))


@register("chained_split_check", _recursive(
    _split_sql("(SELECT count(*) - CAST(floor(0.1 * count(*) + 0.5) AS BIGINT) FROM und)"), [UND, CC, COMPONENTS]))
def q_chained_split_check(spark, d):
    """The second split is one of the first one's reduced graph."""
    from citegraph.plans.q_models import chained

    train_edges, train_links, test_edges, _test_links = chained(spark, d)
    return _split_facts(V.vectors(spark, d), test_edges, train_edges, train_links)


@register("split_links")
def q_split_links(spark, d):
    """Held-out positives outside the forest + as many negatives (rows only; see ``split_check``)."""
    _reduced, links = G.split_links(V.vectors(spark, d), und(spark, d), 0.1, SEED)
    return links
