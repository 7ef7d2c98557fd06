"""Registered queries: models (M5 one Adam step with an exact oracle; training runs,
document vectors, approximate search and the GCN as rows-only checks)."""

from __future__ import annotations

import uuid
from functools import reduce

import numpy as np
from pyspark.sql import functions as F

from citegraph.functions.hashing import sql_hash64 as H
from citegraph.functions.text import tokenize
from citegraph.operators import embed as EM
from citegraph.operators import gnn
from citegraph.operators import graph as G
from citegraph.operators import link_head as LH
from citegraph.operators import paragraphs as PG
from citegraph.operators import sage as SG
from citegraph.operators import sampling as S
from citegraph.operators import vector_index as VI
from citegraph.operators import vectors as VE
from citegraph.plans import views as V
from citegraph.plans.catalog import r6, register
from citegraph.operators.dropout import Dropout, sql_mask
from citegraph.operators.gnn import DROPOUT
from citegraph.plans.q_graph import DIM, GCN_UNITS, HX, K1, K2, NORM, SAGE_UNITS, _w_sql
from citegraph.session import RunTables, cut_lineage
from citegraph.plans.q_sampling import (
    CAND_SQL, KEPT_SQL, LINKS_CTES, N_NEG, N_POSITIVE, P_HELD_OUT, SEED, UND, _negative_pairs, _pair_sizes, links, und,
)

PAIR_DIM = 50  # pair-embedding width, as in the reference
OPT = EM.Adam()
_B1, _B2 = OPT.beta1, OPT.beta2


def _batch(spark, d):
    pos = S.sample_positive_pairs(V.pairs(spark, d), N_POSITIVE, SEED, 0)
    return S.labelled_pairs(pos, _negative_pairs(spark, d), seed=SEED, epoch=0)


def _init_sql(name: str, col: str) -> str:
    return (f"({H(SEED, f"'{name}'", col, 'k')}::DOUBLE / {float(1 << 60)!r} - 0.5) * {2.0 * 0.05!r}")


PAIR_STEP_SQL = V.sql_with(["pairs"], "SELECT tbl, idx, pos, round(w, 6) AS w FROM upd", [
    CAND_SQL, KEPT_SQL,
    ("neg", f"SELECT * FROM kept ORDER BY round, i LIMIT {N_NEG}"),
    ("pos", f"""SELECT paper_idx, ref_idx, copy FROM (
        SELECT paper_idx, ref_idx, unnest(range(0, c)) AS copy FROM (
            SELECT paper_idx, ref_idx, count(*) AS c FROM pairs GROUP BY 1, 2))
        ORDER BY {H(SEED, 0, 'paper_idx', 'ref_idx', 'copy')}, paper_idx, ref_idx, copy LIMIT {N_POSITIVE}"""),
    ("batch", """SELECT row_number() OVER () AS rid, paper_idx, ref_idx, label FROM (
        SELECT paper_idx, ref_idx, 1.0 AS label FROM pos UNION ALL SELECT paper_idx, ref_idx, -1.0 FROM neg)"""),
    ("ks", f"SELECT unnest(generate_series(0, {PAIR_DIM - 1})) AS k"),
    ("uv", f"""SELECT b.rid, b.paper_idx, b.ref_idx, b.label, ks.k, {_init_sql('P', 'b.paper_idx')} AS u,
                      {_init_sql('R', 'b.ref_idx')} AS v FROM batch b, ks"""),
    ("rs", """SELECT rid, sum(u * v) AS dp, sqrt(sum(u * u)) AS nu, sqrt(sum(v * v)) AS nv, any_value(label) AS y
              FROM uv GROUP BY rid"""),
    ("gr", """SELECT uv.paper_idx, uv.ref_idx, uv.k, uv.u, uv.v,
                     2.0 * (rs.dp / (rs.nu * rs.nv) - rs.y) / (SELECT count(*) FROM batch) AS gc,
                     rs.dp / (rs.nu * rs.nv) AS c, rs.nu, rs.nv
              FROM uv JOIN rs ON rs.rid = uv.rid"""),
    ("g", """SELECT 'P' AS tbl, paper_idx AS idx, k AS pos, any_value(u) AS w0,
                    sum(gc * (v / (nu * nv) - c * u / (nu * nu))) AS g FROM gr GROUP BY 1, 2, 3
             UNION ALL
             SELECT 'R', ref_idx, k, any_value(v), sum(gc * (u / (nu * nv) - c * v / (nv * nv))) FROM gr GROUP BY 1, 2, 3"""),
    ("upd", f"""SELECT tbl, idx, pos, w0 - {OPT.lr!r} * ((0.0 + {1.0 - _B1!r} * g) / {1.0 - _B1!r})
                       / (sqrt((0.0 + {1.0 - _B2!r} * (g * g)) / {1.0 - _B2!r}) + {OPT.eps!r}) AS w FROM g"""),
])


@register("pair_step", PAIR_STEP_SQL)
def q_pair_step(spark, d):
    """M5: one Adam step of the cosine pair model from md5-initialised tables;
    the rows touched by the batch, as (table, idx, position, weight) cells."""
    batch = cut_lineage(_batch(spark, d))  # sampled once; every branch below reads it
    # initial rows are a pure function of (seed, idx): build only the rows the batch touches
    P0 = EM.init_table(batch.select(F.col("paper_idx").alias("idx")), PAIR_DIM, SEED, "P")
    R0 = EM.init_table(batch.select(F.col("ref_idx").alias("idx")), PAIR_DIM, SEED, "R")
    gP, gR, _rows = EM.pair_gradients(batch, P0, R0)
    P1 = EM.adam_update(P0.join(gP.select("idx"), "idx", "left_semi"), gP, 1, OPT)
    R1 = EM.adam_update(R0.join(gR.select("idx"), "idx", "left_semi"), gR, 1, OPT)
    cells = lambda t, name: t.select(F.lit(name).alias("tbl"), "idx", F.posexplode("w").alias("pos", "w"))
    return (cells(P1, "P").unionByName(cells(R1, "R"))
            .select("tbl", "idx", F.col("pos").cast("bigint").alias("pos"), r6("w").alias("w")))


def _logloss_sql() -> str:
    n = "(SELECT count(*) FROM batch)"
    sql = PAIR_STEP_SQL.replace("-1.0 FROM neg", "0.0 FROM neg")
    old = "2.0 * (rs.dp / (rs.nu * rs.nv) - rs.y) / (SELECT count(*) FROM batch) AS gc"
    assert old in sql
    sql = sql.replace(old, f"(1.0 / (1.0 + exp(-rs.dp / (rs.nu * rs.nv))) - rs.y) / {n} AS gc")
    unit = f"""UNION ALL SELECT 'D', 0, 0, 1.0, sum((1.0 / (1.0 + exp(-dp / (nu * nv))) - y) * dp / (nu * nv)) / {n} FROM rs
             UNION ALL SELECT 'D', 0, 1, 0.0, sum(1.0 / (1.0 + exp(-dp / (nu * nv))) - y) / {n} FROM rs"""
    return sql.replace("FROM gr GROUP BY 1, 2, 3),\nupd", f"FROM gr GROUP BY 1, 2, 3 {unit}),\nupd")


@register("pair_step_logloss", _logloss_sql())
def q_pair_step_logloss(spark, d):
    """M6: one Adam step of the classification variant: both tables' touched rows, and the dense unit's weight and
    bias as the cells (D, 0, 0) and (D, 0, 1)."""
    pos = S.sample_positive_pairs(V.pairs(spark, d), N_POSITIVE, SEED, 0)
    batch = cut_lineage(S.labelled_pairs(pos, _negative_pairs(spark, d), classification=True, seed=SEED, epoch=0))
    P0 = EM.init_table(batch.select(F.col("paper_idx").alias("idx")), PAIR_DIM, SEED, "P")
    R0 = EM.init_table(batch.select(F.col("ref_idx").alias("idx")), PAIR_DIM, SEED, "R")
    P1, R1, dense, _loss = EM.pair_step(batch, P0, R0, 1, OPT, "logloss")
    unit = spark.range(1).select(F.explode(F.array(*(F.struct(F.lit(k).alias("pos"), F.lit(x).alias("w"))
                                                     for k, x in enumerate((dense.w, dense.b))))).alias("c"))
    cells = lambda t, name: t.select(F.lit(name).alias("tbl"), "idx", F.posexplode("w").alias("pos", "w"))
    return (cells(P1, "P").unionByName(cells(R1, "R"))
            .unionByName(unit.select(F.lit("D").alias("tbl"), F.lit(0).cast("bigint").alias("idx"), "c.pos", "c.w"))
            .select("tbl", "idx", F.col("pos").cast("bigint").alias("pos"), r6("w").alias("w")))


PAIR_EPOCHS = 15  # as in the reference


def _pair_history(spark, d, objective):
    def build():
        n_p, n_r = _pair_sizes(spark, d)
        return EM.train_pair_embeddings(V.pairs(spark, d), n_p, n_r, dim=PAIR_DIM, epochs=PAIR_EPOCHS, seed=SEED, objective=objective)[3]

    return V.stored(spark, d, f"pairs_{objective}", ("lineitem",), build)


@register("train_pairs")
def q_train_pairs(spark, d):
    """M5: 15 epochs of the pair model by blocks, each over all pairs and two non-pairs for each: loss history."""
    return _pair_history(spark, d, "mse")


@register("train_pairs_logloss")
def q_train_pairs_logloss(spark, d):
    """M6: the classification variant (labels 1/0, sigmoid of the dense unit over the cosine)."""
    return _pair_history(spark, d, "logloss")


@register("pair_models_check", "SELECT objective, 15::BIGINT AS n_epochs, TRUE AS loss_fell FROM (VALUES ('mse'), ('logloss')) t(objective)")
def q_pair_models_check(spark, d):
    """M5 + M6: every epoch is there and the last loss is below the first."""
    facts = [_pair_history(spark, d, o).agg(F.count("*").alias("n_epochs"), (F.max_by("loss", "epoch") < F.min_by("loss", "epoch")).alias("loss_fell"))
             .select(F.lit(o).alias("objective"), "*") for o in ("mse", "logloss")]
    return facts[0].unionByName(facts[1])


PASSES = 10  # as in the reference


def _tokens(spark, d):
    return V.papers(spark, d).select("paper_id", tokenize(F.concat_ws(" ", "title", "abstract")).alias("tokens"))


def words(spark, d):
    """M1: the word model of all papers' texts (100 dims, 10 passes; the vocabulary is bounded), trained once a session."""
    return V.stored(spark, d, "words", ("documents",), lambda: PG.train_words(_tokens(spark, d), dim=100, passes=PASSES))


def paragraph_vectors(spark, d):
    """M4: every paper's vector by the stored word model."""
    return V.stored(spark, d, "paragraphs", ("documents",),
                    lambda: PG.infer_paragraphs(PG.WordModel.load(words(spark, d)), _tokens(spark, d)))


@register("doc_vectors")
def q_doc_vectors(spark, d):
    """M1 + M3 + M4: paragraph vectors (100 dims) of every paper's text, rounded."""
    return paragraph_vectors(spark, d).select("id", F.transform("embedding", lambda x: F.round(x, 6)).alias("embedding"))


LEAST_TOKENS = 20  # texts of the near-copy check


@register("doc_vectors_check", V.sql_with(["papers"], """
    SELECT count(*) AS n_papers, TRUE AS dims_ok, TRUE AS known_ok, TRUE AS same_text_ok, TRUE AS recall_ok FROM papers"""))
def q_doc_vectors_check(spark, d):
    """M3 / M4: 100 numbers for every paper, not all 0 for a text of known words; equal texts have equal vectors; and unseen
    near copies (every tenth token dropped) find the vector of their original among the ten nearest in at least 0.9 of the cases."""
    toks, vecs = _tokens(spark, d), paragraph_vectors(spark, d)
    length = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x))
    facts = vecs.agg(F.count("*").alias("n_papers"), F.min(F.size("embedding") == 100).alias("dims_ok"))
    known = toks.select("paper_id", F.explode("tokens").alias("word")).join(words(spark, d).select("word"), "word", "left_semi")
    known = known.select(F.col("paper_id").alias("id")).distinct().join(vecs, "id").agg(F.coalesce(F.min(length > 0), F.lit(True)).alias("known_ok"))
    both = toks.select(F.col("paper_id").alias("id"), F.md5(F.array_join("tokens", " ")).alias("text")).join(vecs, "id")
    same = both.groupBy("text").agg(F.countDistinct(F.transform("embedding", lambda x: F.round(x, 9))).alias("n"))
    same = same.agg((F.max("n") == 1).alias("same_text_ok"))
    copies = (toks.where(F.size("tokens") >= LEAST_TOKENS)
              .select("paper_id", F.filter("tokens", lambda x, i: (i + 1) % 10 != 0).alias("tokens")))
    copies = cut_lineage(VE.unit_embeddings(PG.infer_paragraphs(PG.WordModel.load(words(spark, d)), copies)))
    near = VI.ann_knn(copies, VE.unit_embeddings(vecs), 10)
    # a text that stands many times in the corpus is found in any of its papers
    text = both.select("id", "text")
    hits = (near.join(text.withColumnRenamed("id", "neighbour_id"), "neighbour_id")
            .join(text.select(F.col("id").alias("query_id"), F.col("text").alias("own")), "query_id")
            .where("text = own").agg(F.countDistinct("query_id").alias("hits")))
    asked = copies.agg(F.count("*").alias("asked"))
    return (facts.join(known).join(same).join(hits).join(asked)
            .select("n_papers", "dims_ok", "known_ok", "same_text_ok", (F.col("hits") >= F.col("asked") * 0.9).alias("recall_ok")))


@register("word_model_store", V.sql_with(["papers"], "SELECT TRUE AS same_words, TRUE AS same_vectors, TRUE AS same_inference"))
def q_word_model_store(spark, d):
    """The word model and a fitted MLlib model, stored and loaded again, give equal words, vectors and inferred texts."""
    from citegraph.plans.q_sources import stored_as

    one = words(spark, d)
    two = stored_as(spark, one, "words")
    toks = _tokens(spark, d)
    fitted = EM.train_doc_vectors(toks, dim=16, min_count=5, passes=1)
    folder = f"{RunTables(spark).root}/{uuid.uuid4().hex}"
    PG.save_word2vec(fitted, folder)
    before, after = (EM.infer_vectors(m, toks) for m in (fitted, PG.load_word2vec(spark, folder)))
    moved = before.join(after.withColumnRenamed("embedding", "again"), "id").agg(F.min(F.col("embedding") == F.col("again")).alias("same_inference"))
    n = one.count()
    same = one.join(two.select("word", F.col("vector").alias("again")), "word").agg(
        (F.count("*") == n).alias("same_words"), F.min(F.col("vector") == F.col("again")).alias("same_vectors"))
    return same.join(moved)


@register("ann_knn")
def q_ann_knn(spark, d):
    """Ten neighbours of every paper through the index of cells, with the codes scored and the vectors compared."""
    vec = V.vectors(spark, d)
    return VI.ann_knn(vec, vec, 10).withColumn("distance", r6("distance"))


def _recall(got, want):
    """(queries, fewest rows, rows that ``want`` has too, mean of candidates)"""
    per = got.groupBy("query_id").agg(F.count("*").alias("n"), F.max("candidates").alias("candidates"))
    hits = want.join(got.select("query_id", "neighbour_id"), ["query_id", "neighbour_id"], "left_semi")
    return (per.agg(F.count("*").alias("n_queries"), F.min("n").cast("int").alias("fewest"), F.avg("candidates").alias("candidates"))
            .join(hits.agg(F.count("*").alias("hits"))))


@register("ann_check", V.sql_with(["vectors"], """SELECT count(*) AS n_queries, CAST(10 AS INTEGER) AS fewest, TRUE AS recall_ok,
                                  TRUE AS few_candidates FROM vectors"""))
def q_ann_check(spark, d):
    """Every query has 10 neighbours, recall against the exact search is at least 0.9, and a query is compared
    with less than a tenth of the vectors."""
    vec = V.vectors(spark, d)
    got, want = cut_lineage(VI.ann_knn(vec, vec, 10)), VE.knn(vec, vec, 10)
    return _recall(got, want).select("n_queries", "fewest", (F.col("hits") >= F.col("n_queries") * 9).alias("recall_ok"),
                                     (F.col("candidates") * 10 < F.col("n_queries")).alias("few_candidates"))


@register("ann_similar_check", V.sql_with(["vectors"], """
    SELECT side, count(*) AS n_queries, CAST(20 AS INTEGER) AS fewest, TRUE AS recall_ok
    FROM vectors, (VALUES ('most'), ('least')) s(side) GROUP BY side"""))
def q_ann_similar_check(spark, d):
    """T3 / T4 through the index: every paper has its 20 rows, and recall of the 20 most and of the 20 least similar unit
    rows against the exact lists is at least 0.9."""
    u = VE.unit_embeddings(V.vectors(spark, d))
    out = []
    for side, least in (("most", False), ("least", True)):
        got, want = cut_lineage(VI.ann_similar(u, u, 20, least=least)), VE.find_similar(u, u, 20, least=least)
        out.append(_recall(got, want).select(F.lit(side).alias("side"), "n_queries", "fewest",
                                             (F.col("hits") >= F.col("n_queries") * 18).alias("recall_ok")))
    return out[0].unionByName(out[1])


def chained(spark, d):
    """G6 on the vectors' graph, forests kept, stored once: (train edges, train links, test edges, test links)."""
    v, e = V.vectors(spark, d), und(spark, d)
    parts: list = []

    def part(i):
        if not parts:
            parts.extend(G.chained_split(v, e, P_HELD_OUT, SEED))
        return parts[i]

    return [V.stored(spark, d, f"chained{i}", ("lineitem", "embeddings"), lambda i=i: part(i)) for i in range(4)]


GCN_EPOCHS, SAGE_EPOCHS = 50, 20  # as in the reference
GCN_LAYERS = ["w1", "b1", "w2", "b2"]


def trained(spark, d, kind):
    """A link model trained on the inner split of G6 with the outer test links as validation, once a session: the stored
    (weights, history)."""
    made: list = []

    def part(i):
        if not made:
            v, (train_edges, train_links, test_edges, test_links) = V.vectors(spark, d), chained(spark, d)
            if kind == "gcn":
                params, hist = gnn.train_gcn(v, train_edges, train_links, epochs=GCN_EPOCHS, seed=SEED, val_links=test_links)
            else:
                params, hist = SG.train_graphsage(v, train_edges, train_links, epochs=SAGE_EPOCHS, seed=SEED, val=sage_test(spark, d))
            layers = GCN_LAYERS if kind == "gcn" else SG.LAYERS
            made.extend([gnn.weight_rows(spark, dict(zip(layers, params))), hist])
        return made[i]

    return [V.stored(spark, d, f"{kind}{i}", ("lineitem", "embeddings"), lambda i=i: part(i)) for i in range(2)]


def sage_test(spark, d):
    """The outer test links with their neighbourhoods in the test graph."""
    def build():
        _train_edges, _train_links, test_edges, test_links = chained(spark, d)
        return SG.link_chunks(V.vectors(spark, d), test_edges, test_links, seed=SEED)

    return V.stored(spark, d, "sage_test", ("lineitem", "embeddings"), build)


@register("train_gcn")
def q_train_gcn(spark, d):
    """G13 + G16: loss and accuracy of the GCN link model over its 50 epochs, training and validation."""
    return trained(spark, d, "gcn")[1]


GCN_LR = 0.01
_SIGN = lambda g: f"{GCN_LR!r} * ({g}) / (abs({g}) + 1e-7)"  # Adam's first step


def _mask(layer: int, unit: str) -> str:
    return sql_mask(DROPOUT, SEED, 0, layer, "id", unit)


@register("gcn_train_step", V.sql_with(["vec_cites", "vectors"], f"""
    SELECT part, i, j, round(w, 6) AS w FROM (
        SELECT 'w1' AS part, W1.i, W1.j, W1.w - {_SIGN('g.g')} AS w FROM W1 JOIN dw1 g ON g.i = W1.i AND g.j = W1.j
        UNION ALL SELECT 'w2', W2.i, W2.j, W2.w - {_SIGN('g.g')} FROM W2 JOIN dw2 g ON g.i = W2.i AND g.j = W2.j
        UNION ALL SELECT 'b1', 0, j, -{_SIGN('sum(x)')} FROM dz1 GROUP BY j
        UNION ALL SELECT 'b2', 0, j, -{_SIGN('sum(x)')} FROM dz2 GROUP BY j)""",
    LINKS_CTES + NORM + [HX] + [
    ("W1", _w_sql("gcn_w1", SEED, DIM, GCN_UNITS)), ("W2", _w_sql("gcn_w2", SEED, GCN_UNITS, GCN_UNITS)),
    ("hm", f"SELECT id, pos, x * {_mask(0, 'pos')} AS x FROM hx"),
    ("ax", "SELECT ne.dst AS id, hm.pos AS i, sum(ne.w * hm.x) AS x FROM ne JOIN hm ON hm.id = ne.src GROUP BY 1, 2"),
    ("z1", "SELECT ax.id, W1.j, sum(ax.x * W1.w) AS x FROM ax JOIN W1 ON W1.i = ax.i GROUP BY 1, 2"),
    ("h1", f"SELECT id, j, x, greatest(x, 0.0) * {_mask(1, 'j')} AS h, {_mask(1, 'j')} AS m FROM z1"),
    ("hw", "SELECT h1.id, W2.j, sum(h1.h * W2.w) AS x FROM h1 JOIN W2 ON W2.i = h1.j GROUP BY 1, 2"),
    ("z2", "SELECT ne.dst AS id, hw.j, sum(ne.w * hw.x) AS x FROM ne JOIN hw ON hw.id = ne.src GROUP BY 1, 2"),
    ("lg", """SELECT l.source, l.target, any_value(l.label) AS y, sum(greatest(a.x, 0.0) * greatest(b.x, 0.0)) AS dp
              FROM links l JOIN z2 a ON a.id = l.source JOIN z2 b ON b.id = l.target AND b.j = a.j GROUP BY 1, 2"""),
    ("gl", "SELECT source, target, (1.0 / (1.0 + exp(-dp)) - y) / (SELECT count(*) FROM links) AS g FROM lg"),
    ("dh2", """SELECT id, j, sum(x) AS x FROM (
        SELECT gl.source AS id, z2.j, gl.g * greatest(z2.x, 0.0) AS x FROM gl JOIN z2 ON z2.id = gl.target
        UNION ALL SELECT gl.target, z2.j, gl.g * greatest(z2.x, 0.0) FROM gl JOIN z2 ON z2.id = gl.source) GROUP BY 1, 2"""),
    ("dz2", "SELECT d.id, d.j, CASE WHEN z2.x > 0 THEN d.x ELSE 0.0 END AS x FROM dh2 d JOIN z2 ON z2.id = d.id AND z2.j = d.j"),
    ("g2", "SELECT ne.dst AS id, d.j, sum(ne.w * d.x) AS x FROM ne JOIN dz2 d ON d.id = ne.src GROUP BY 1, 2"),
    ("dw2", "SELECT h1.j AS i, g2.j, sum(h1.h * g2.x) AS g FROM h1 JOIN g2 ON g2.id = h1.id GROUP BY 1, 2"),
    ("dh1", "SELECT g2.id, W2.i AS j, sum(g2.x * W2.w) AS x FROM g2 JOIN W2 ON W2.j = g2.j GROUP BY 1, 2"),
    ("dz1", "SELECT d.id, d.j, CASE WHEN h1.x > 0 THEN d.x * h1.m ELSE 0.0 END AS x FROM dh1 d JOIN h1 ON h1.id = d.id AND h1.j = d.j"),
    ("dw1", "SELECT ax.i, d.j, sum(ax.x * d.x) AS g FROM ax JOIN dz1 d ON d.id = ax.id GROUP BY 1, 2"),
]))
def q_gcn_train_step(spark, d):
    """One full-batch Adam step of the GCN link model from md5 weights under dropout, every weight as a cell."""
    params, _hist = gnn.train_gcn(V.vectors(spark, d), und(spark, d), links(spark, d), epochs=1, lr=GCN_LR, seed=SEED)
    return _weight_cells(spark, dict(zip(GCN_LAYERS, params)))


def _weight_cells(spark, layers):
    """(part, i, j, w) of every weight, rounded; a bias has i = 0."""
    return (gnn.weight_rows(spark, layers).select(F.col("layer").alias("part"), F.col("row").cast("bigint").alias("i"), F.posexplode("values").alias("j", "w"))
            .select("part", "i", F.col("j").cast("bigint").alias("j"), r6("w").alias("w")))


SAGE_LR, SAGE_BATCHES = 1e-3, 4
_HALF = SAGE_UNITS // 2


def _sage_step_sql() -> str:
    """One step on bucket 0: an end (kind e) reads its hop-1 sample, a neighbour (kind m) its hop-2 sample."""
    sign = lambda g: f"{SAGE_LR!r} * ({g}) / (abs({g}) + 1e-7)"
    draw = lambda hop, k: f"""SELECT source, target FROM (SELECT source, target, row_number() OVER (PARTITION BY source
               ORDER BY {H(SEED, hop, 'source', 'target')}, target) AS rn FROM s) WHERE rn <= {k}"""  # noqa: E731
    halves = lambda own, mean, ws, wn, half: f"""SELECT id, kind, j, sum(x) AS x FROM (
        SELECT o.id, o.kind, W.j, o.x * W.w AS x FROM {own} o JOIN {ws} W ON W.i = o.pos
        UNION ALL SELECT m.id, m.kind, {half} + W.j, m.x * W.w FROM {mean} m JOIN {wn} W ON W.i = m.pos) GROUP BY 1, 2, 3"""  # noqa: E731
    weight = lambda part, table, g: f"SELECT '{part}' AS part, W.i, W.j, W.w - {sign('g.g')} AS w FROM {table} W JOIN {g} g ON g.i = W.i AND g.j = W.j"
    return V.sql_with(["vec_cites", "vectors"], f"""
    SELECT part, i, j, round(w, 6) AS w FROM (
        {weight('ws1', 'Ws1', 'dws1')} UNION ALL {weight('wn1', 'Wn1', 'dwn1')}
        UNION ALL {weight('ws2', 'Ws2', 'dws2')} UNION ALL {weight('wn2', 'Wn2', 'dwn2')}
        UNION ALL SELECT 'b1', 0, j, -{sign('sum(x)')} FROM dz1 GROUP BY j
        UNION ALL SELECT 'b2', 0, j, -{sign('sum(x)')} FROM dz2 GROUP BY j)""", LINKS_CTES + [HX] + [
    ("b", f"SELECT source, target, label FROM links WHERE {H(SEED, chr(39) + 'bucket' + chr(39), 'source', 'target')} % {SAGE_BATCHES} = 0"),
    ("s", "SELECT source, target FROM und UNION ALL SELECT target, source FROM und"),
    ("hop", f"SELECT 'e' AS kind, * FROM ({draw(1, K1)}) UNION ALL SELECT 'm', * FROM ({draw(2, K2)})"),
    ("ends", "SELECT DISTINCT id FROM (SELECT source AS id FROM b UNION ALL SELECT target FROM b)"),
    ("mids", "SELECT DISTINCT target AS id FROM hop WHERE kind = 'e' AND source IN (SELECT id FROM ends)"),
    ("touched", "SELECT id, 'e' AS kind FROM ends UNION ALL SELECT id, 'm' FROM mids"),
    ("Ws1", _w_sql("sage_ws1", SEED, DIM, _HALF)), ("Wn1", _w_sql("sage_wn1", SEED, DIM, _HALF)),
    ("Ws2", _w_sql("sage_ws2", SEED, SAGE_UNITS, _HALF)), ("Wn2", _w_sql("sage_wn2", SEED, SAGE_UNITS, _HALF)),
    ("xm", f"SELECT id, pos, x * {_mask(0, 'pos')} AS x FROM hx"),
    ("own1", "SELECT t.id, t.kind, xm.pos, xm.x FROM touched t JOIN xm ON xm.id = t.id"),
    ("mean1", """SELECT t.id, t.kind, xm.pos, avg(xm.x) AS x FROM touched t JOIN hop ON hop.kind = t.kind AND hop.source = t.id
                 JOIN xm ON xm.id = hop.target GROUP BY 1, 2, 3"""),
    ("z1", halves("own1", "mean1", "Ws1", "Wn1", _HALF)),
    ("h1", f"SELECT id, kind, j AS pos, x AS z, greatest(x, 0.0) * {_mask(1, 'j')} AS x, {_mask(1, 'j')} AS m FROM z1"),
    ("own2", "SELECT id, kind, pos, x FROM h1 WHERE kind = 'e'"),
    ("mean2", """SELECT e.id, 'e' AS kind, h1.pos, avg(h1.x) AS x FROM ends e JOIN hop ON hop.kind = 'e' AND hop.source = e.id
                 JOIN h1 ON h1.kind = 'm' AND h1.id = hop.target GROUP BY 1, 2, 3"""),
    ("z2", halves("own2", "mean2", "Ws2", "Wn2", _HALF)),
    ("n2", f"SELECT id, greatest(sqrt(sum(x * x)), {SG.LEAST_NORM!r}) AS n FROM z2 GROUP BY id"),
    ("o", "SELECT z2.id, z2.j, z2.x / n2.n AS x FROM z2 JOIN n2 ON n2.id = z2.id"),
    ("lg", """SELECT b.source, b.target, any_value(b.label) AS y, sum(p.x * q.x) AS dp
              FROM b JOIN o p ON p.id = b.source JOIN o q ON q.id = b.target AND q.j = p.j GROUP BY 1, 2"""),
    ("gl", """SELECT source, target, CASE WHEN dp > 1e-7 AND dp < 1 - 1e-7 THEN (dp - y) / (dp * (1 - dp)) ELSE 0.0 END
                     / (SELECT count(*) FROM b) AS g FROM lg"""),
    ("d_out", """SELECT id, j, sum(x) AS x FROM (
        SELECT gl.source AS id, o.j, gl.g * o.x AS x FROM gl JOIN o ON o.id = gl.target
        UNION ALL SELECT gl.target, o.j, gl.g * o.x FROM gl JOIN o ON o.id = gl.source) GROUP BY 1, 2"""),
    ("along", "SELECT d.id, sum(d.x * o.x) AS a FROM d_out d JOIN o ON o.id = d.id AND o.j = d.j GROUP BY 1"),
    ("dz2", """SELECT d.id, d.j, (d.x - o.x * a.a) / n2.n AS x FROM d_out d JOIN o ON o.id = d.id AND o.j = d.j
               JOIN along a ON a.id = d.id JOIN n2 ON n2.id = d.id"""),
    ("dws2", f"SELECT h.pos AS i, d.j, sum(h.x * d.x) AS g FROM own2 h JOIN dz2 d ON d.id = h.id AND d.j < {_HALF} GROUP BY 1, 2"),
    ("dwn2", f"SELECT h.pos AS i, d.j - {_HALF} AS j, sum(h.x * d.x) AS g FROM mean2 h JOIN dz2 d ON d.id = h.id AND d.j >= {_HALF} GROUP BY 1, 2"),
    ("dh_e", f"SELECT d.id, W.i AS j, sum(d.x * W.w) AS x FROM dz2 d JOIN Ws2 W ON W.j = d.j AND d.j < {_HALF} GROUP BY 1, 2"),
    ("dmean", f"SELECT d.id, W.i AS j, sum(d.x * W.w) AS x FROM dz2 d JOIN Wn2 W ON W.j = d.j - {_HALF} AND d.j >= {_HALF} GROUP BY 1, 2"),
    ("cnt", "SELECT source AS id, count(*) AS c FROM hop WHERE kind = 'e' GROUP BY 1"),
    ("dh_m", """SELECT hop.target AS id, d.j, sum(d.x / cnt.c) AS x FROM dmean d JOIN hop ON hop.kind = 'e' AND hop.source = d.id
                JOIN cnt ON cnt.id = d.id GROUP BY 1, 2"""),
    ("dh", "SELECT id, 'e' AS kind, j, x FROM dh_e UNION ALL SELECT id, 'm', j, x FROM dh_m"),
    ("dz1", """SELECT d.id, d.kind, d.j, CASE WHEN h1.z > 0 THEN d.x * h1.m ELSE 0.0 END AS x
               FROM dh d JOIN h1 ON h1.id = d.id AND h1.kind = d.kind AND h1.pos = d.j"""),
    ("dws1", f"""SELECT h.pos AS i, d.j, sum(h.x * d.x) AS g FROM own1 h JOIN dz1 d ON d.id = h.id AND d.kind = h.kind AND d.j < {_HALF}
                 GROUP BY 1, 2"""),
    ("dwn1", f"""SELECT h.pos AS i, d.j - {_HALF} AS j, sum(h.x * d.x) AS g FROM mean1 h JOIN dz1 d ON d.id = h.id AND d.kind = h.kind
                 AND d.j >= {_HALF} GROUP BY 1, 2"""),
])


@register("sage_train_step", _sage_step_sql())
def q_sage_train_step(spark, d):
    """G7 + G11 + G14: one Adam step of the GraphSAGE link model on the first bucket of links: per-link neighbourhoods, dropout,
    unit outputs and their backward pass, every weight as a cell."""
    v = V.vectors(spark, d)
    chunks = SG.link_chunks(v, und(spark, d), links(spark, d), buckets=SAGE_BATCHES, seed=SEED, bucket=0)
    chunks = cut_lineage(chunks)
    n = chunks.agg(F.sum(F.size("source"))).first()[0]
    params = SG.initial(DIM, (SAGE_UNITS, SAGE_UNITS), SEED)
    _loss, _acc, grads = SG.sage_step(chunks, n, params, drop=Dropout(DROPOUT, SEED, 0))
    params = gnn.AdamState([p.shape for p in params], SAGE_LR).step(params, grads)
    return _weight_cells(spark, dict(zip(SG.LAYERS, params)))


def _scored(spark, d, kind):
    """Scores and decisions on the outer test links by the stored model."""
    from citegraph.operators import metrics as M

    v = V.vectors(spark, d)
    weights, _hist = trained(spark, d, kind)
    if kind == "sage":
        return M.threshold(SG.predict_sage(sage_test(spark, d), gnn.weights_of(weights, SG.LAYERS)), 0.5)
    _train_edges, _train_links, test_edges, test_links = chained(spark, d)
    norm = cut_lineage(G.gcn_norm_edges(v, test_edges))  # the test graph is propagated over
    x = v.select("id", F.col("embedding").cast("array<double>").alias("h"))
    return M.threshold(gnn.predict_links(x, norm, gnn.weights_of(weights, GCN_LAYERS), test_links), 0.5)


@register("gcn_link_scores")
def q_gcn_link_scores(spark, d):
    """G6 → G13 → S9 → G15 → P9: scores and decisions on the outer test links by the stored GCN of the inner split."""
    return _scored(spark, d, "gcn")


@register("sage_link_scores")
def q_sage_link_scores(spark, d):
    """G6 → G14 → S9 → G15 → P9: the same by the stored GraphSAGE model."""
    return _scored(spark, d, "sage")


@register("train_sage")
def q_train_sage(spark, d):
    """G14 + G16: loss and accuracy of the GraphSAGE link model (samples [20, 10]) over its 20 epochs, training and validation."""
    return trained(spark, d, "sage")[1]


def _link_facts_sql() -> str:
    held = "(SELECT CAST(floor(0.1 * count(*) + 0.5) AS BIGINT) FROM und)"
    rows = " UNION ALL ".join(f"""SELECT '{k}' AS model, {n}::BIGINT AS n_epochs, {2 * n}::BIGINT AS n_history, TRUE AS numbers_ok, TRUE AS loss_fell,
        {held} AS n_pos, {held} AS n_neg, TRUE AS scores_ok, TRUE AS decisions_ok"""
                              for k, n in (("gcn", GCN_EPOCHS), ("sage", SAGE_EPOCHS)))
    return V.sql_with(["vec_cites"], rows, [UND])


@register("link_models_check", _link_facts_sql())
def q_link_models_check(spark, d):
    """G15 + G16 for both models: every epoch of both splits is there, losses are numbers and the training loss falls; each
    test link has one score in [0, 1], and the decision is that of the score."""
    out = []
    for kind in ("gcn", "sage"):
        hist, scored = trained(spark, d, kind)[1], _scored(spark, d, kind)
        train = hist.where("split = 'train'")
        facts = hist.agg(F.countDistinct("epoch").alias("n_epochs"), F.count("*").alias("n_history"),
                         F.min((F.col("loss") >= 0) & F.col("acc").between(0, 1) & ~F.isnan("loss")).alias("numbers_ok"))
        fell = train.agg((F.max_by("loss", "epoch") < F.min_by("loss", "epoch")).alias("loss_fell"))
        links_ = scored.agg(F.count_if(F.col("label") == 1).alias("n_pos"), F.count_if(F.col("label") == 0).alias("n_neg"),
                            F.min(F.col("score").between(0, 1)).alias("scores_ok"),
                            F.min((F.col("score") > 0.5) == (F.col("pred") == 1)).alias("decisions_ok"))
        out.append(facts.join(fell).join(links_).select(F.lit(kind).alias("model"), "*"))
    return out[0].unionByName(out[1])


HEAD_LR = 0.01
_FEATURE = {"hadamard": "a * b", "l1": "abs(a - b)", "l2": "(a - b) * (a - b)", "avg": "(a + b) / 2.0"}
_ENDS = ("ends", """SELECT l.source, l.target, l.label AS y, x.pos, x.x AS a, z.x AS b
                    FROM links l JOIN hx x ON x.id = l.source JOIN hx z ON z.id = l.target AND z.pos = x.pos""")


def _feature_sql(op: str) -> str:
    """(source, target, y, pos, f)"""
    if op == "concat":
        return f"SELECT source, target, y, pos, a AS f FROM ends UNION ALL SELECT source, target, y, {DIM} + pos, b FROM ends"
    return f"SELECT source, target, y, pos, {_FEATURE[op]} AS f FROM ends"


@register("link_embeddings", V.sql_with(["vec_cites", "vectors"], " UNION ALL ".join(
    f"""SELECT '{op}' AS op, source, target, count(*) AS dim, round(sum(f), 6) AS total, round(sum(f * (pos + 1)), 4) AS weighted
        FROM ({_feature_sql(op)}) GROUP BY 1, 2, 3""" for op in LH.OPS), LINKS_CTES + [HX, _ENDS]))
def q_link_embeddings(spark, d):
    """The five link embeddings of every sampled link (their length, sum, and sum by position)."""
    h = V.vectors(spark, d).select("id", F.col("embedding").alias("h"))
    total = F.aggregate("e", F.lit(0.0), lambda a, x: a + x)
    weighted = F.aggregate(F.transform("e", lambda x, i: x * (i + 1)), F.lit(0.0), lambda a, x: a + x)
    out = [G.link_score(links(spark, d), h, op=op, doubles=True).withColumnRenamed("link_embedding", "e").select(
        F.lit(op).alias("op"), "source", "target", F.size("e").cast("bigint").alias("dim"), r6(total).alias("total"),
        F.round(weighted, 4).alias("weighted")) for op in LH.OPS]
    return reduce(lambda a, b: a.unionByName(b), out)


def _head_sql() -> str:
    """One Adam step of every head, and the slope at both ends' vectors (summed over their components)."""
    sign = lambda g: f"{HEAD_LR!r} * ({g}) / (abs({g}) + 1e-7)"
    at = {"hadamard": ("W.w * e.b", "W.w * e.a"), "l1": ("W.w * sign(e.a - e.b)", "W.w * sign(e.b - e.a)"),
          "l2": ("2 * W.w * (e.a - e.b)", "2 * W.w * (e.b - e.a)"), "avg": ("W.w / 2", "W.w / 2"), "concat": ("W.w", "U.w")}
    ctes, rows = [], []
    for op in LH.OPS:
        size = 2 * DIM if op == "concat" else DIM
        ctes += [(f"W_{op}", _w_sql(f"head_{op}", SEED, size, 1)), (f"f_{op}", _feature_sql(op)),
                 (f"g_{op}", f"""SELECT source, target, (1.0 / (1.0 + exp(-sum(f.f * W.w))) - any_value(f.y)) / (SELECT count(*) FROM links) AS g
                                 FROM f_{op} f JOIN W_{op} W ON W.i = f.pos GROUP BY 1, 2"""),
                 (f"dw_{op}", f"""SELECT f.pos, sum(g.g * f.f) AS g FROM f_{op} f JOIN g_{op} g ON g.source = f.source AND g.target = f.target
                                  GROUP BY 1""")]
        other = f"JOIN W_{op} U ON U.i = e.pos + {DIM}" if op == "concat" else ""
        ends = f"FROM ends e JOIN g_{op} g ON g.source = e.source AND g.target = e.target JOIN W_{op} W ON W.i = e.pos {other}"
        rows += [f"SELECT '{op}' AS op, 'w' AS part, W.i AS at, round(W.w - {sign('d.g')}, 6) AS x FROM W_{op} W JOIN dw_{op} d ON d.pos = W.i",
                 f"SELECT '{op}', 'bias', 0, round(-{sign('sum(g)')}, 6) FROM g_{op}",
                 f"""SELECT '{op}', 'node', id, round(sum(x) * 1000, 6) FROM (SELECT e.source AS id, g.g * {at[op][0]} AS x {ends}
                     UNION ALL SELECT e.target, g.g * {at[op][1]} {ends}) GROUP BY id"""]
    return V.sql_with(["vec_cites", "vectors"], " UNION ALL ".join(rows), LINKS_CTES + [HX, _ENDS] + ctes)


@register("link_head_step", _head_sql())
def q_link_head_step(spark, d):
    """One Adam step of the logistic head over each of the five link embeddings from md5 weights, and the loss' slope
    through both ends at every node's vector (a thousand times its sum)."""
    h = V.vectors(spark, d).select("id", F.col("embedding").alias("h"))
    ends = cut_lineage(LH.with_ends(links(spark, d), h))
    n, out = links(spark, d).count(), []
    for op in LH.OPS:
        w = gnn.glorot(SEED, f"head_{op}", DIM * (2 if op == "concat" else 1), 1)[:, 0]
        _loss, gw, gb = LH.head_gradients(ends, n, op, w, 0.0)
        new, bias = gnn.AdamState([w.shape, (1,)], HEAD_LR).step([w, np.zeros(1)], [gw, np.array([gb])])
        cells = [("w", i, float(x)) for i, x in enumerate(new)] + [("bias", 0, float(bias[0]))]
        node = LH.end_gradients(ends, n, op, w, 0.0).select(
            F.lit("node").alias("part"), F.col("id").alias("at"), (F.aggregate("g", F.lit(0.0), lambda a, x: a + x) * 1000).alias("x"))
        out.append(spark.createDataFrame(cells, "part string, at long, x double").unionByName(node).select(F.lit(op).alias("op"), "part", "at", r6("x").alias("x")))
    return reduce(lambda a, b: a.unionByName(b), out)


@register("text_recs")
def q_text_recs(spark, d):
    """M8: text route for every paper: paragraph vectors → 10 nearest through the index → their references → quality."""
    from citegraph.operators.recommend import recommend_by_text

    papers = V.papers(spark, d)
    q = recommend_by_text(papers.select("paper_id"), papers, V.doc_cites(spark, d), PG.WordModel.load(words(spark, d)), 10)
    return q.select(F.col("query_id").alias("paper_id"), "n_true", "n_recommended", "n_matched",
                    r6("precision").alias("precision"), r6("recall").alias("recall"), r6("f1").alias("f1"))


@register("rec_quality_ann", V.sql_with(["vectors"], """
    SELECT count(*) AS n_papers, TRUE AS bounded, TRUE AS like_exact FROM vectors"""))
def q_rec_quality_ann(spark, d):
    """T2 + J8 + A11: recommendations through the index for every paper; the mean number of recommendations is within a
    twentieth of that by the exact search."""
    from citegraph.operators import metrics as M, recommend as RC

    vec, cites = V.vectors(spark, d), V.vec_cites(spark, d)
    out = []
    for nn in (VI.ann_knn(vec, vec, 10, exclude_self=True), VE.knn(vec, vec, 10, exclude_self=True)):
        out.append(M.recommendation_quality(RC.expand_neighbours(nn, cites), cites).agg(
            F.count("*").alias("n"), F.avg("n_recommended").alias("rec"), F.min(F.col("precision").between(0, 1)).alias("bounded")))
    exact = out[1].select(F.col("rec").alias("exact"))
    return out[0].join(exact).select(F.col("n").alias("n_papers"), "bounded", F.col("rec").between(F.col("exact") * 0.95, F.col("exact") * 1.05).alias("like_exact"))
