"""M5 gradient vs finite difference; GCN loss falls on a planted-partition graph."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from citegraph.operators import embed as EM


def _cos(u, v):
    return u @ v / np.linalg.norm(u) / np.linalg.norm(v)


def test_pair_gradient_finite_difference(spark):
    rng = np.random.default_rng(0)
    U, W = rng.normal(size=(3, 4)), rng.normal(size=(2, 4))
    batch = [(0, 1, 1.0), (2, 0, -1.0), (1, 1, 1.0)]
    P = spark.createDataFrame([(i, U[i].tolist()) for i in range(3)], "idx long, w array<double>")
    R = spark.createDataFrame([(i, W[i].tolist()) for i in range(2)], "idx long, w array<double>")
    b = spark.createDataFrame(batch, "paper_idx long, ref_idx long, label double")
    gP, gR, _ = EM.pair_gradients(b, P, R)
    got_p = {r["idx"]: np.array(r["g"]) for r in gP.collect()}
    got_r = {r["idx"]: np.array(r["g"]) for r in gR.collect()}

    def loss(U_, W_):
        return np.mean([(_cos(U_[p], W_[r]) - y) ** 2 for p, r, y in batch])

    eps = 1e-6
    for table, got in ((0, got_p), (1, got_r)):
        for i in got:
            for k in range(4):
                up, down = [U.copy(), W.copy()], [U.copy(), W.copy()]
                up[table][i, k] += eps
                down[table][i, k] -= eps
                assert abs((loss(*up) - loss(*down)) / (2 * eps) - got[i][k]) < 1e-6


def test_logloss_gradients_finite_difference(spark):
    """M6: both tables, and the dense unit's weight and bias."""
    rng = np.random.default_rng(1)
    U, W, unit = rng.normal(size=(3, 4)), rng.normal(size=(2, 4)), [1.3, -0.4]
    batch = [(0, 1, 1.0), (2, 0, 0.0), (1, 1, 1.0), (0, 0, 0.0)]
    P = spark.createDataFrame([(i, U[i].tolist()) for i in range(3)], "idx long, w array<double>")
    R = spark.createDataFrame([(i, W[i].tolist()) for i in range(2)], "idx long, w array<double>")
    b = spark.createDataFrame(batch, "paper_idx long, ref_idx long, label double")
    gP, gR, rows = EM.pair_gradients(b, P, R, objective="logloss", dense_w=unit[0], dense_b=unit[1])
    got = rows.agg(F.sum("gw"), F.sum("gb")).first()
    got_p = {r["idx"]: np.array(r["g"]) for r in gP.collect()}
    got_r = {r["idx"]: np.array(r["g"]) for r in gR.collect()}

    def loss(U_, W_, w, c):
        p = [1 / (1 + np.exp(-(w * _cos(U_[a], W_[r]) + c))) for a, r, _ in batch]
        return -np.mean([y * np.log(q) + (1 - y) * np.log(1 - q) for q, (_, _, y) in zip(p, batch)])

    eps = 1e-6
    for k in range(2):
        up, down = list(unit), list(unit)
        up[k] += eps
        down[k] -= eps
        assert abs((loss(U, W, *up) - loss(U, W, *down)) / (2 * eps) - got[k]) < 1e-6
    for k in range(4):
        up, down = U.copy(), U.copy()
        up[0, k] += eps
        down[0, k] -= eps
        assert abs((loss(up, W, *unit) - loss(down, W, *unit)) / (2 * eps) - got_p[0][k]) < 1e-6
        up, down = W.copy(), W.copy()
        up[1, k] += eps
        down[1, k] -= eps
        assert abs((loss(U, up, *unit) - loss(U, down, *unit)) / (2 * eps) - got_r[1][k]) < 1e-6


def test_pair_training_uses_all_pairs_and_loss_falls(spark):
    pairs = spark.createDataFrame([(p, p % 3) for p in range(12)] * 2, "paper_idx long, ref_idx long")
    for objective, blocks in (("mse", 1), ("logloss", 1), ("mse", 2)):
        before = tables(spark)
        P, R, dense, hist = EM.train_pair_embeddings(pairs, 12, 3, dim=4, epochs=5, objective=objective, opt=EM.Adam(lr=0.05), blocks=blocks)
        assert len(tables(spark) - before) == 1  # the last state, which P and R are read from
        losses = [r["loss"] for r in hist.orderBy("epoch").collect()]
        assert losses[-1] < losses[0] and P.count() == 12 and R.count() == 3
        assert (dense.w, dense.b) != (1.0, 0.0) if objective == "logloss" else (dense.w, dense.b) == (1.0, 0.0)


def test_block_training_equals_the_step(spark):
    """One block: the step over all pairs, by plain DataFrame operations. Several: every pair once an epoch, no block in two
    tasks, and each round is the step over its pairs."""
    from functools import reduce

    rng = np.random.default_rng(3)
    n_p, n_r, dim = 11, 7, 4
    rows = [(int(p), int(r), float(y)) for p, r, y in zip(rng.integers(0, n_p, 60), rng.integers(0, n_r, 60), rng.integers(0, 2, 60))]
    batch = spark.createDataFrame(rows, "paper_idx long, ref_idx long, label double").cache()
    ids = lambda n: spark.range(n).withColumnRenamed("id", "idx")
    table = lambda df: {r["idx"]: np.array([r["w"], r["m"], r["s"]]) for r in df.collect()}
    for objective in ("mse", "logloss"):
        for blocks in (1, 3):
            P, R, unit = EM.init_table(ids(n_p), dim, 5, "P"), EM.init_table(ids(n_r), dim, 5, "R"), EM.DenseUnit()
            state = reduce(lambda a, b: a.unionByName(b), [EM.block_state(n, blocks, dim, 5, s, spark) for n, s in ((n_p, "P"), (n_r, "R"))]).cache()
            opt = EM.Adam(lr=0.05)
            for rnd in range(blocks):
                now = batch.where((F.col("ref_idx") % blocks - F.col("paper_idx") % blocks + blocks) % blocks == rnd)
                n = now.count()
                P, R, after, loss = EM.pair_step(now, P, R, rnd + 1, opt, objective, unit)
                P, R = P.cache(), R.cache()
                counted = now.groupBy("paper_idx", "ref_idx", "label").agg(F.count("*").alias("times"))
                state = EM.block_round(state, counted, rnd, n, rnd + 1, dim=dim, blocks=blocks, opt=opt, objective=objective, unit=unit).cache()
                part = np.sum([r["w"] for r in state.where("side = 'loss'").collect()], axis=0)
                assert np.isclose(part[0] / n, loss)
                unit = unit.step(part[1], part[2], rnd + 1, opt) if objective != "mse" else unit
                assert np.isclose((unit.w, unit.b), (after.w, after.b)).all()
            for side, want in (("P", table(P)), ("R", table(R))):
                got = table(EM.block_rows(state, side, blocks, dim))
                assert got.keys() == want.keys() and all(np.allclose(got[i], want[i]) for i in want)


def test_doc_vectors_same_text_same_vector(spark):
    """M1, M3: equal texts have equal vectors, near copies are nearer than others."""
    rng = np.random.default_rng(0)
    texts = [" ".join(f"t{x}" for x in rng.integers(20 * (i % 3), 20 * (i % 3) + 20, 30)) for i in range(30)]
    texts += [texts[0], texts[0] + " t1"]
    rows = spark.createDataFrame([(i, t.split()) for i, t in enumerate(texts)], "paper_id long, tokens array<string>")
    got = {r["id"]: np.array(r["embedding"]) for r in
           EM.infer_vectors(EM.train_doc_vectors(rows, dim=16, passes=3, partitions=1), rows).collect()}
    assert np.allclose(got[0], got[30])
    near = np.linalg.norm(got[0] - got[31])
    assert all(near < np.linalg.norm(got[0] - got[i]) for i in range(1, 30))


def test_paragraph_vectors(spark, tmp_out):
    """M3: same text, same vector, in any company; unseen near copies are nearest to their original; odd texts; S9."""
    from citegraph.operators import paragraphs as PG
    from citegraph.sources import io

    rng = np.random.default_rng(0)
    texts = [[f"t{x}" for x in rng.integers(20 * (i % 4), 20 * (i % 4) + 30, 60)] for i in range(60)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(100, texts[5]), (101, []), (102, None), (103, ["never", "seen"])]
    df = spark.createDataFrame(rows, "paper_id long, tokens array<string>")
    words = PG.train_words(df.where("paper_id <> 103"), dim=16, passes=5, partitions=2)
    io.save_table(words, f"{tmp_out}/words", "words")
    model = PG.WordModel.load(io.load_table(spark, f"{tmp_out}/words", "words"))
    got = {r["id"]: np.array(r["embedding"]) for r in PG.infer_paragraphs(model, df.repartition(5)).collect()}
    assert len(got) == 64 and (got[5] == got[100]).all() and not any(got[i].any() for i in (101, 102, 103))
    alone = PG.infer_paragraphs(model, df.where("paper_id = 7")).first()["embedding"]
    assert np.allclose(alone, got[7], atol=1e-6)
    unit = {i: v / np.linalg.norm(v) for i, v in got.items() if i < 60}
    hits = 0
    for i, t in enumerate(texts):
        v = model.infer([w for k, w in enumerate(t) if k % 10])
        near = sorted(unit, key=lambda j: -unit[j] @ v)[:10]
        hits += i in near
    assert hits >= 54
    # more negatives' scores than the words' would mean that nothing was learned
    d = model.infer(texts[0])
    own = model.vectors[[model.index[w] for w in texts[0]]] @ d
    assert own.mean() > (model.vectors @ d).mean()


def test_paragraphs_are_dealt_over_the_cores(spark):
    """Texts of one file are inferred by many tasks, and get what one task gives them."""
    from citegraph.operators import paragraphs as PG

    rng = np.random.default_rng(1)
    texts = [[f"t{x}" for x in rng.integers(0, 9, 40)] for _ in range(200)]
    model = PG.WordModel({f"t{i}": i for i in range(9)}, rng.normal(size=(9, 4)).astype(np.float32), np.arange(1, 10) / 9)
    out = PG.infer_paragraphs(model, spark.createDataFrame(list(enumerate(texts)), "paper_id long, tokens array<string>").coalesce(1))
    assert len(set(out.select(F.spark_partition_id()).toPandas().iloc[:, 0])) >= spark.sparkContext.defaultParallelism
    assert all((np.array(r["embedding"]) == model.infer(texts[r["id"]])).all() for r in out.collect())


def test_vocabulary_bound(spark):
    from citegraph.operators import paragraphs as PG

    df = spark.createDataFrame([(i, [f"w{k}" for k in range(i)]) for i in range(1, 31)], "paper_id long, tokens array<string>")
    from citegraph.operators.corpus import vocabulary

    counts = vocabulary(df)  # w0 stands 30 times, w29 once
    assert PG.least_count(counts, 1, 100) == 1 and PG.least_count(counts, 5, 100) == 5
    floor = PG.least_count(counts, 1, 10)
    assert counts.where(F.col("n") >= floor).count() == 10
    assert PG.train_words(df, dim=4, max_words=10, passes=1, partitions=1).count() == 10


def test_learning_rate_schedule():
    r = EM.learning_rate_schedule()
    assert len(r) == 10 and r[0] == 0.025 and abs(r[-1] - (0.025 - 9 * 0.0002)) < 1e-15


def tables(spark):
    """Tables in the shared folder."""
    import os

    from citegraph.session import RunTables

    root = RunTables(spark).root.removeprefix("file:")
    return set(os.listdir(root)) if os.path.isdir(root) else set()


def test_gcn_learns_planted_partition(spark):
    from citegraph.operators import gnn
    from citegraph.operators import graph as G
    from citegraph.operators.sampling import sample_negative_links

    rng = np.random.default_rng(1)
    n, half = 40, 20
    edges = set()
    for a in range(n):
        for b in range(a + 1, n):
            same = (a < half) == (b < half)
            if rng.random() < (0.35 if same else 0.01):
                edges.add((a, b))
    feats = [(i, [1.0 if i < half else 0.0, 0.0 if i < half else 1.0, float(rng.random())]) for i in range(n)]
    nodes = spark.createDataFrame(feats, "id long, embedding array<double>")
    e = spark.createDataFrame(sorted(edges), "source long, target long")
    neg = sample_negative_links(nodes, e, len(edges), 5)
    links = e.withColumn("label", F.lit(1)).unionByName(neg.select("source", "target", F.lit(0).alias("label")))
    before = tables(spark)
    params, hist = gnn.train_gcn(nodes, e, links, units=(8, 8), epochs=8, lr=0.05, seed=3, val_links=links)
    assert tables(spark) == before  # all tables of the run are dropped
    rows = hist.orderBy("epoch").collect()
    val = [r["loss"] for r in rows if r["split"] == "validation"]
    assert len(rows) == 16 and val[-1] < val[0]
    again, _hist = gnn.train_gcn(nodes, e, links, units=(8, 8), epochs=8, lr=0.05, seed=3)
    assert all(np.allclose(a, b) for a, b in zip(params, again))
    # a stored model gives the same scores
    names = ["w1", "b1", "w2", "b2"]
    loaded = gnn.weights_of(gnn.weight_rows(spark, dict(zip(names, params))), names)
    norm = G.gcn_norm_edges(nodes, e)
    x = nodes.select("id", F.col("embedding").alias("h"))
    score = lambda ps: {(r["source"], r["target"], r["label"]): r["score"] for r in gnn.predict_links(x, norm, ps, links).collect()}
    one, two = score(params), score(loaded)
    assert one.keys() == two.keys() and all(np.isclose(one[k], two[k], rtol=1e-12) for k in one)


def planted(spark, n=40, half=20, seed=2):
    from citegraph.operators.sampling import sample_negative_links

    rng = np.random.default_rng(seed)
    edges = [(a, b) for a in range(n) for b in range(a + 1, n) if rng.random() < (0.35 if (a < half) == (b < half) else 0.01)]
    feats = [(i, [1.0 if i < half else 0.0, 0.0 if i < half else 1.0, float(rng.random())]) for i in range(n)]
    nodes = spark.createDataFrame(feats, "id long, embedding array<double>")
    e = spark.createDataFrame(edges, "source long, target long")
    neg = sample_negative_links(nodes, e, len(edges), 5)
    return nodes, e, e.withColumn("label", F.lit(1)).unionByName(neg.select("source", "target", F.lit(0).alias("label")))


def test_graphsage_learns_planted_partition(spark):
    from citegraph.operators import sage

    nodes, e, links = planted(spark)
    val = sage.link_chunks(nodes, e, links, num_samples=(5, 3), seed=3)
    params, hist = sage.train_graphsage(nodes, e, links, units=(8, 8), num_samples=(5, 3), epochs=8, batches=2, lr=0.02, act="sigmoid", seed=3, val=val)
    rows = hist.collect()
    loss = {s: [r["loss"] for r in sorted(rows, key=lambda r: r["epoch"]) if r["split"] == s] for s in ("train", "validation")}
    assert len(loss["train"]) == len(loss["validation"]) == 8 and loss["validation"][-1] < loss["validation"][0]
    scored = sage.predict_sage(val, params, act="sigmoid")
    assert scored.count() == links.count() and scored.exceptAll(scored.where("score between 0 and 1")).count() == 0
    assert scored.select("source", "target", "label").exceptAll(links).count() == 0


def test_link_chunks_are_whole_and_bounded(spark, monkeypatch):
    """Every link in one chunk of its bucket; the chunk's indices say the neighbourhoods of G7; a link that repeats stays."""
    from citegraph.operators import graph as G
    from citegraph.operators import sage

    nodes, e, links = planted(spark)
    alone = spark.createDataFrame([(1000, [0.5, 0.5, 0.5])], "id long, embedding array<double>")
    links = links.unionByName(links.limit(3)).unionByName(spark.createDataFrame([(0, 1000, 0)], "source long, target long, label int"))
    monkeypatch.setattr(sage, "CHUNK_LINKS", 16)
    rows = sage.link_chunks(nodes.unionByName(alone), e, links, num_samples=(4, 2), buckets=3, seed=1).collect()
    assert len({(r["bucket"], r["chunk"]) for r in rows}) == len(rows) and {r["bucket"] for r in rows} == {0, 1, 2}
    got = sorted((s, t, int(y)) for r in rows for s, t, y in zip(r["source"], r["target"], r["label"]))
    assert got == sorted((r["source"], r["target"], r["label"]) for r in links.collect())
    feats = {r["id"]: r["embedding"] for r in nodes.unionByName(alone).collect()}
    blocks = {}
    for r in G.link_neighbourhoods(links, e, (4, 2), 1).collect():
        for end in ("source", "target"):
            blocks[r[end]] = [(b["hop1"], b["hop2"]) for b in r[f"{end}_hops"] or []]
    assert blocks[1000] == [] and max(map(len, blocks.values())) <= 4
    for r in rows:
        assert [x for i in r["nodes"] for x in feats[i]] == r["x"]
        name, mid = r["nodes"], [r["nodes"][i] for i in r["mids"]]
        ends = np.cumsum([0, *r["mid_n"]])
        hop2 = {m: [name[i] for i in r["mid_nb"][a:b]] for m, a, b in zip(mid, ends, ends[1:])}
        ends = np.cumsum([0, *r["head_n"]])
        for h, a, b in zip(r["heads"], ends, ends[1:]):
            assert [(mid[k], hop2[mid[k]]) for k in r["head_nb"][a:b]] == blocks[name[h]]


def test_graphsage_gradients_finite_difference(spark):
    """All six parameters, with dropout, unit outputs, an isolated end and both activations."""
    from citegraph.operators import sage
    from citegraph.operators.dropout import Dropout

    rng = np.random.default_rng(6)
    n, dim = 14, 3
    edges = [(a, b) for a in range(n) for b in range(a + 1, n) if rng.random() < 0.4]
    nodes = spark.createDataFrame([(i, rng.normal(size=dim).tolist()) for i in range(n + 1)], "id long, embedding array<double>")
    e = spark.createDataFrame(edges, "source long, target long")
    links = spark.createDataFrame([(a, b, int(rng.random() < 0.5)) for a in range(n) for b in range(a + 1, n + 1, 3)],
                                  "source long, target long, label int")
    rows = [r.asDict() for r in sage.link_chunks(nodes, e, links, num_samples=(4, 2), seed=3).collect()]
    total = links.count()
    params = [p + rng.normal(size=p.shape) * 0.2 for p in sage.initial(dim, (6, 4), 3)]
    drop = Dropout(0.3, 3, 1)

    def loss(ps, act):
        return sum(sage.loss_and_slope((c := sage.Chunk(r, drop)).forward(ps), c.label, act)[0].sum() for r in rows) / total

    for act in ("sigmoid", "relu"):
        mean, _acc, grads = sage.sage_step(spark.createDataFrame(rows, sage.CHUNK), total, params, drop=drop, act=act)
        assert np.isclose(mean, loss(params, act))
        for which in range(6):
            for at in list(np.ndindex(params[which].shape))[::2]:
                slope = []
                for eps in (1e-6, -1e-6):
                    moved = [p.copy() for p in params]
                    moved[which][at] += eps
                    slope.append(loss(moved, act))
                assert np.isclose((slope[0] - slope[1]) / 2e-6, grads[which][at], rtol=1e-4, atol=1e-6), (act, which, at)


def test_gcn_epoch_writes_three_tables(spark, monkeypatch):
    """An epoch writes its two layers' and its links' tables, with validation beside the training pass, and the losses of
    validation are those of a pass of its own by the same weights."""
    from citegraph.operators import gnn
    from citegraph.operators import graph as G
    from citegraph.session import RunTables

    rng = np.random.default_rng(6)
    nodes = spark.createDataFrame([(i, rng.normal(size=3).tolist()) for i in range(12)], "id long, embedding array<double>")
    e = spark.createDataFrame([(a, (a + k) % 12) for a in range(12) for k in (1, 3)], "source long, target long")
    links = spark.createDataFrame([(a, (a + 2) % 12, a % 2) for a in range(12)], "source long, target long, label int")
    val = spark.createDataFrame([(a, (a + 5) % 12, a % 2) for a in range(7)], "source long, target long, label int")
    written = []
    put = RunTables.put
    monkeypatch.setattr(RunTables, "put", lambda self, df: written.append(df.columns) or put(self, df))
    counts, runs = [], []
    for epochs in (1, 3):
        written.clear()
        runs.append(gnn.train_gcn(nodes, e, links, units=(4, 4), epochs=epochs, lr=0.05, seed=3, val_links=val))
        counts.append(len(written))
    assert counts[1] - counts[0] == 2 * 3
    params, hist = runs[0][0], {(r["epoch"], r["split"]): (r["loss"], r["acc"]) for r in runs[1][1].collect()}
    x, norm = nodes.select("id", F.col("embedding").alias("h")), G.gcn_norm_edges(nodes, e)
    own = gnn.link_loss(gnn.score_links(val, gnn.gcn_forward(x, norm, params)[1]))
    assert len(hist) == 6 and np.allclose(hist[0, "validation"], own, rtol=1e-12)


def test_dropout_masks():
    """A function of seed, epoch, layer, node and unit, with the kept share and the same mean."""
    from citegraph.operators.dropout import Dropout

    ids = list(range(4000))
    m = Dropout(0.3, 1, 2).mask(0, ids, 20)
    assert abs((m > 0).mean() - 0.7) < 0.01 and abs(m.mean() - 1.0) < 0.01
    assert (m[17] == Dropout(0.3, 1, 2).mask(0, [17], 20)[0]).all()
    for other in (Dropout(0.3, 2, 2).mask(0, ids, 20), Dropout(0.3, 1, 3).mask(0, ids, 20), Dropout(0.3, 1, 2).mask(1, ids, 20)):
        assert 0.3 < (m == other).mean() < 0.7
    assert (Dropout(0.0, 1, 1).mask(0, [1, 2], 3) == 1).all()


def test_gcn_gradient_finite_difference(spark):
    from citegraph.operators import gnn
    from citegraph.operators import graph as G
    from citegraph.operators.dropout import Dropout

    rng = np.random.default_rng(4)
    n = 10
    edges = sorted({(a, b) for a in range(n) for b in range(a + 1, n) if rng.random() < 0.35})
    nodes = spark.createDataFrame([(i, rng.normal(size=3).tolist()) for i in range(n)],
                                  "id long, embedding array<double>")
    e = spark.createDataFrame(edges, "source long, target long")
    links = spark.createDataFrame([(a, b, int(rng.random() < 0.5)) for a, b in
                                   [(0, 1), (2, 5), (3, 7), (4, 9), (1, 8), (6, 2)]],
                                  "source long, target long, label int")
    norm = G.gcn_norm_edges(nodes, e)
    x = nodes.select("id", F.col("embedding").alias("h"))
    drop = Dropout(0.3, 9, 4)
    params = [rng.normal(size=(3, 4)), rng.normal(size=4) * 0.1 + 0.2,
              rng.normal(size=(4, 3)), rng.normal(size=3) * 0.1 + 0.2]
    _loss, _acc, grads = gnn.gcn_loss_grads(x, norm, links, 6, params, drop=drop)

    def loss_of(ps):
        return gnn.link_loss(gnn.score_links(links, gnn.gcn_forward(x, norm, ps, drop=drop)[1]))[0]

    eps = 1e-5
    for which, idx in [(0, (0, 1)), (0, (2, 3)), (1, (2,)), (2, (1, 0)), (3, (1,))]:
        up = [p.copy() for p in params]
        dn = [p.copy() for p in params]
        up[which][idx] += eps
        dn[which][idx] -= eps
        fd = (loss_of(up) - loss_of(dn)) / (2 * eps)
        assert abs(fd - grads[which][idx]) < 1e-5 + 1e-3 * abs(fd), (which, idx, fd, grads[which][idx])


def test_link_head(spark):
    """Slopes of the head and of both ends by finite differences, all five embeddings; training lowers the loss."""
    from citegraph.operators import link_head as LH

    rng = np.random.default_rng(4)
    n, dim = 9, 3
    x = rng.normal(size=(n, dim))
    rows = [(int(a), int(b), int(y)) for a, b, y in zip(rng.integers(0, n, 30), rng.integers(0, n, 30), rng.integers(0, 2, 30)) if a != b]
    links = spark.createDataFrame(rows + rows[:2], "source long, target long, label int")
    total = len(rows) + 2
    emb = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, h array<double>")
    ends = LH.with_ends(links, emb).cache()

    def loss(vectors, w, b, op):
        src, dst, y = (np.array(c) for c in zip(*(rows + rows[:2])))
        p = 1 / (1 + np.exp(-(LH.combine(vectors[src], vectors[dst], op) @ w + b)))
        return -np.mean(y * np.log(p) + (1 - y) * np.log(1 - p))

    for op in LH.OPS:
        w, b = rng.normal(size=dim * (2 if op == "concat" else 1)), 0.3
        got, gw, gb = LH.head_gradients(ends, total, op, w, b)
        assert np.isclose(got, loss(x, w, b, op))
        nodes = {r["id"]: np.array(r["g"]) for r in LH.end_gradients(ends, total, op, w, b).collect()}
        eps = 1e-6
        for k in range(len(w)):
            d = np.eye(len(w))[k] * eps
            assert np.isclose((loss(x, w + d, b, op) - loss(x, w - d, b, op)) / (2 * eps), gw[k], atol=1e-7)
        assert np.isclose((loss(x, w, b + eps, op) - loss(x, w, b - eps, op)) / (2 * eps), gb, atol=1e-7)
        for i, g in nodes.items():
            for k in range(dim):
                up, down = x.copy(), x.copy()
                up[i, k] += eps
                down[i, k] -= eps
                assert np.isclose((loss(up, w, b, op) - loss(down, w, b, op)) / (2 * eps), g[k], atol=1e-7), (op, i, k)
    w, b, losses = LH.train_link_head(links, emb, op="l2", epochs=8, lr=0.1)
    assert losses[-1] < losses[0] and LH.score_head(links, emb, "l2", w, b).where("score between 0 and 1").count() == total


def test_link_head_ends_hold_a_vector_once(spark):
    """A cell of links holds a node's vector once, not once a link; ids that repeat give a link for each of their vectors."""
    from citegraph.operators import link_head as LH

    links = spark.createDataFrame([(k % 3, 3 + k % 2, k % 2) for k in range(600)], "source long, target long, label int")
    rows = [(i, [float(i), 1.0 - i]) for i in range(5)]
    schema = "id long, h array<float>"
    ends = LH.with_ends(links, spark.createDataFrame(rows, schema)).cache()
    held = ends.agg(F.sum(F.size("a") + F.size("b")), F.sum(F.size("label")), F.count("*")).first()
    assert held[1] == 600 and held[0] <= 2 * 5 * held[2]
    w = np.array([0.3, -0.2])
    one = {r["id"]: np.array(r["g"]) for r in LH.end_gradients(ends, 600, "hadamard", w, 0.1).collect()}
    assert sorted(one) == [0, 1, 2, 3, 4]
    again = LH.with_ends(links, spark.createDataFrame(rows + rows[:1] + [(None, [1.0, 1.0]), (9, None)], schema)).cache()
    assert again.agg(F.sum(F.size("label"))).first()[0] == 800
    two = {r["id"]: np.array(r["g"]) for r in LH.end_gradients(again, 600, "hadamard", w, 0.1).collect()}
    assert np.allclose(two[0], 2 * one[0]) and np.allclose(two[1], one[1])
    with pytest.raises(Exception, match="link end without a vector"):
        LH.with_ends(links, spark.createDataFrame(rows[1:] + [(0, None)], schema)).collect()


def test_written_steps_leave_no_shuffle_files(spark):
    """What a table of a run was shuffled by is released once it is written."""
    import os
    import time

    from citegraph.session import RunTables

    jvm = spark.sparkContext._jvm
    folders = [d.getPath() for d in jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()]
    files = lambda: {f for d in folders for _, _, fs in os.walk(d) for f in fs if f.startswith("shuffle_") and f.endswith(".data")}
    before, run = files(), RunTables(spark)
    out = run.put(spark.range(5000).groupBy((F.col("id") % 97).alias("k")).agg(F.count("*").alias("n")))
    for _ in range(50):
        if not files() - before:
            break
        time.sleep(0.1)
    assert not files() - before and out.count() == 97
    run.clear()


def test_link_chunks_keep_floats(spark):
    """Features are stored as wide as they come, and a step over floats is the step over the same numbers as doubles."""
    from citegraph.operators import sage
    from citegraph.operators.dropout import Dropout

    nodes, e, links = planted(spark)
    floats = nodes.select("id", F.col("embedding").cast("array<float>").alias("embedding"))
    params, found = sage.initial(3, (6, 4), 3), []
    for x in (floats, floats.select("id", F.col("embedding").cast("array<double>").alias("embedding"))):
        chunks = sage.link_chunks(x, e, links, num_samples=(4, 2), seed=3)
        assert dict(chunks.dtypes)["x"] == dict(x.dtypes)["embedding"]
        found.append(sage.sage_step(chunks, links.count(), params, drop=Dropout(0.3, 3, 1), act="sigmoid"))
    assert np.isclose(found[0][0], found[1][0]) and all(np.allclose(a, b) for a, b in zip(found[0][2], found[1][2]))


def test_mean_of_rows_gathers_no_copy_of_them():
    """The mean over sampled neighbours holds a row a group at a time, not all that are averaged."""
    import tracemalloc

    from citegraph.operators import sage

    rng = np.random.default_rng(2)
    x, size = rng.normal(size=(500, 16)), np.append(rng.integers(0, 40, 200), [0, 400])
    nb, ends = rng.integers(0, 500, size.sum()), np.cumsum(size)
    tracemalloc.start()
    got = sage._mean(x, nb, size)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    want = [x[nb[e - n:e]].mean(0) if n else np.zeros(16) for e, n in zip(ends, size)]
    assert np.allclose(got, want) and most < nb.size * 16 * 8 / 4


def test_pair_blocks_move_in_bounded_pieces(spark, monkeypatch):
    """A block is stored as the bytes of pieces of bounded size, an epoch's pairs as one row for each two blocks that meet; a round by
    packed pairs is the round by single ones, and pairs of a null end meet in none."""
    rng = np.random.default_rng(5)
    n_p, n_r, dim, blocks = 23, 9, 3, 2
    monkeypatch.setattr(EM, "PIECE_ROWS", 4)
    state = EM.block_state(n_p, blocks, dim, 5, "P", spark).unionByName(EM.block_state(n_r, blocks, dim, 5, "R", spark)).cache()
    held = state.select("side", "blk", "part", F.length("state").alias("n")).collect()
    assert max(r["n"] for r in held) == 4 * 3 * dim * 8 and sum(r["n"] for r in held) == (n_p + n_r) * 3 * dim * 8
    rows = sorted({(int(p), int(r), 1.0) for p, r in zip(rng.integers(0, n_p, 80), rng.integers(0, n_r, 80))})
    pairs = spark.createDataFrame([(*x, 1 + k % 3) for k, x in enumerate(rows)], "paper_idx long, ref_idx long, label double, times long")
    lost = spark.createDataFrame([(3, None, 1.0, 7), (None, 2, 1.0, 4)], pairs.schema)
    packed = EM.pack_pairs(pairs.unionByName(lost), blocks).cache()
    assert packed.count() <= blocks * blocks + 2
    assert packed.where("rnd is null").select(F.explode("times").alias("t")).agg(F.sum("t")).first()[0] == 11
    for rnd in range(blocks):
        single = pairs.where((F.col("ref_idx") % blocks - F.col("paper_idx") % blocks + blocks) % blocks == rnd)
        got = [EM.block_round(state, x, rnd, 100, 1, dim=dim, blocks=blocks, opt=EM.Adam()) for x in (single, packed.where(F.col("rnd") == rnd))]
        for side in ("P", "R"):
            one, two = ({r["idx"]: (r["w"], r["m"], r["s"]) for r in EM.block_rows(g, side, blocks, dim).collect()} for g in got)
            assert one == two and len(one) == (n_p if side == "P" else n_r)
