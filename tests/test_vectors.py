"""T1 against brute force; T2 recall; entry contract."""

import numpy as np

from citegraph.operators import vector_index as VI
from citegraph.operators import vectors as VE
from citegraph.plans import views as V

SF = "/root/testdata/sf0.001"


def test_knn_brute_force(spark):
    vec = V.vectors(spark, SF)
    got = {(r["query_id"], r["rank"]): r["neighbour_id"]
           for r in VE.knn(vec, vec, 5, exclude_self=True, block_rows=128).collect()}
    rows = vec.orderBy("id").collect()
    ids = np.array([r["id"] for r in rows])
    X = np.array([r["embedding"] for r in rows], dtype=np.float64)
    for qi in range(0, len(ids), 37):
        d = np.sqrt(((X - X[qi]) ** 2).sum(1))
        d[qi] = np.inf
        order = np.lexsort((ids, np.round(d, 9)))[:5]
        for rank, j in enumerate(order, 1):
            assert got[(ids[qi], rank)] == ids[j]


def _recall(got, want):
    got, want = ({(r["query_id"], r["neighbour_id"]) for r in x.collect()} for x in (got, want))
    return len(got & want) / len(want)


def test_index_recall_and_candidates(spark):
    """T2 at two scales of the vectors: recall, few candidates, exact distances and ranks."""
    from pyspark.sql import functions as F

    vec = V.vectors(spark, SF)
    for k in (1, 10):
        by = vec.withColumn("embedding", F.transform("embedding", lambda x: x * F.lit(k)))
        want = VE.knn(by, by, 10)
        got = VI.ann_knn(by, by, 10).cache()
        assert _recall(got, want) >= 0.9
        assert got.agg(F.max("candidates")).first()[0] * 10 < by.count()
        dist = {(r["query_id"], r["neighbour_id"]): r["distance"] for r in VE.knn(by, by, 500).collect()}
        per = {}
        for r in got.collect():
            assert abs(r["distance"] - dist[r["query_id"], r["neighbour_id"]]) < 1e-6
            per.setdefault(r["query_id"], []).append((r["rank"], round(r["distance"], 9), r["neighbour_id"]))
        for rows in per.values():
            rows.sort()
            assert [x[0] for x in rows] == list(range(1, 11)) and [x[1:] for x in rows] == sorted(x[1:] for x in rows)


def test_clusters_need_few_probes(spark):
    """Where the vectors form clusters, a query scores only a small share of the codes."""
    from pyspark.sql import functions as F

    rng = np.random.default_rng(7)
    middle = rng.normal(size=(40, 16)) * 10
    df = spark.createDataFrame([(i, (middle[i % 40] + rng.normal(size=16)).tolist()) for i in range(1200)], "id long, embedding array<double>")
    got = VI.ann_knn(df, df, 5).cache()
    assert _recall(got, VE.knn(df, df, 5)) >= 0.9
    assert got.agg(F.avg("scanned")).first()[0] < 1200 * 0.3


def test_index_splits_hot_cells_and_copies_codes(spark, monkeypatch):
    """A third of the vectors in one cell, and groups that take few queries: the same neighbours."""
    rng = np.random.default_rng(9)
    x = rng.normal(size=(240, 8))
    x[:80] = x[0] + rng.normal(size=(80, 8)) * 1e-3
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, embedding array<double>")
    whole = VI.ann_knn(df, df, 5, target_recall=1.0, refine=20).drop("scanned", "candidates")
    monkeypatch.setattr(VI, "GROUP_ROWS", 30)
    monkeypatch.setattr(VI, "GROUP_QUERIES", 16)
    split = VI.ann_knn(df, df, 5, target_recall=1.0, refine=20).drop("scanned", "candidates")
    key = lambda r: (r["query_id"], r["rank"], r["neighbour_id"])
    assert sorted(map(key, whole.collect())) == sorted(map(key, split.collect()))
    group, parts = VI._groups(np.array([10, 10, 95, 5, 20, 8]), 30)
    assert group.tolist() == [0, 0, 1, 2, 2, 3] and parts.tolist() == [1, 4, 1, 1]


def test_similar_through_the_index(spark):
    """T3 / T4 by inner product, with vectors of unequal length."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 6)) * rng.uniform(0.2, 3, size=(300, 1))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, embedding array<double>")
    for least in (False, True):
        got = VI.ann_similar(df, df, 5, least=least).cache()
        assert _recall(got, VE.find_similar(df, df, 5, least=least)) >= 0.9
        assert all(abs(r["similarity"] - x[r["query_id"]] @ x[r["neighbour_id"]]) < 1e-6 for r in got.collect())


def test_entry_contract(spark):
    import __spark_entry__ as E

    df = E.entry(spark)
    assert df.count() > 0
    q, o = E.queries(), E.oracle_sql()
    assert set(o) <= set(q)
    assert len(q) >= 90


def test_rank_all_is_a_full_dense_order(spark):
    from pyspark.sql import functions as F

    u = VE.unit_embeddings(V.vectors(spark, SF))
    q = u.where(F.col("id") == 7)
    r = VE.rank_all(q, u).orderBy("rank").collect()
    assert [x["rank"] for x in r] == list(range(1, u.count() + 1))
    sims = [x["similarity"] for x in r]
    assert all(a <= b + 1e-12 for a, b in zip(sims, sims[1:]))
    assert r[-1]["neighbour_id"] == 7  # a unit row is most similar to itself


def test_recommend_by_text(spark):
    """M8 through the index and exactly: a row for every listed paper, the same counts for nearly all."""
    from pyspark.sql import functions as F

    from citegraph.functions.text import tokenize
    from citegraph.operators import paragraphs as PG
    from citegraph.operators.recommend import recommend_by_text

    papers = V.papers(spark, SF)
    toks = papers.select("paper_id", tokenize(F.concat_ws(" ", "title", "abstract")).alias("tokens"))
    model = PG.WordModel.load(PG.train_words(toks, dim=16, passes=2, partitions=2))
    ids = papers.select("paper_id").where("paper_id < 20")
    found = []
    for exact in (False, True):
        rows = recommend_by_text(ids, papers, V.doc_cites(spark, SF), model, 3, exact=exact).collect()
        assert len(rows) == 20
        assert all(r["n_recommended"] >= 3 and 0.0 <= r["precision"] <= 1.0 for r in rows)
        found.append({r["query_id"]: r["n_recommended"] for r in rows})
    assert sum(found[0][q] == n for q, n in found[1].items()) >= 16


def _copies(spark, norm, noise, n=400, near=60, dim=16):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(n, dim))
    x *= norm / np.linalg.norm(x, axis=1, keepdims=True)
    x[:near] = x[0] + rng.normal(size=(near, dim)) * noise
    return x, spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, embedding array<double>")


def test_near_copies_are_ranked_by_exact_distance(spark):
    """The narrowed block must not lose neighbours that differ in the last digits."""
    for norm, noise in ((30.0, 1e-6), (100.0, 1e-5)):
        x, df = _copies(spark, norm, noise)
        got = {}
        for r in VE.knn(df.where("id < 60"), df, 10).collect():
            got.setdefault(r["query_id"], []).append((r["rank"], r["neighbour_id"]))
        for q in range(60):
            d = np.round(np.sqrt(((x - x[q]) ** 2).sum(1)), 9)
            want = np.lexsort((np.arange(len(x)), d))[:10]
            assert [i for _, i in sorted(got[q])] == want.tolist()


def test_ann_is_complete(spark):
    """Every query has k rows, or as many as there are vectors."""
    from pyspark.sql import functions as F

    vec = V.vectors(spark, SF)
    mixed = vec.withColumn("embedding", F.transform("embedding", lambda x: F.when(F.col("id") % 97 == 0, x * 8).otherwise(x)))
    assert VI.ann_knn(mixed, mixed, 10).count() == 10 * vec.count()
    assert VI.ann_knn(vec.where("id < 3"), vec.where("id < 4"), 10).count() == 12
    assert VI.ann_knn(vec.where("id < 4"), vec.where("id < 4"), 10, exclude_self=True).count() == 12
    assert VI.ann_knn(vec.where("id < 0"), vec, 10).count() == 0
    assert VI.ann_knn(vec, vec.where("id < 0"), 10).count() == 0
    same = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(50)], "id long, embedding array<double>")
    got = VI.ann_knn(same, same, 5).collect()
    assert sorted((r["query_id"], r["neighbour_id"]) for r in got) == [(q, i) for q in range(50) for i in range(5)]


def test_block_is_screened_in_floats(monkeypatch):
    """A block of plain vectors is compared exactly only for the few pairs that floats leave; near copies, copies, repeated ids and
    odd numbers still get the lists that scores in doubles give."""
    import pandas as pd

    rng = np.random.default_rng(7)
    x = rng.normal(size=(300, 12))
    near = x.copy()
    near[:150] = 40 + x[0] + rng.normal(size=(150, 12)) * 1e-5
    nan = x.copy()
    nan[5, 3] = np.nan
    tables = {"plain": (x, x, range(300)), "near": (near, near, range(300)), "copies": (np.round(x), np.round(x), range(300)),
              "ids": (x, x, np.arange(300) // 3), "nan": (nan, x, range(300)), "huge": (x * 1e20, x * 1e20, range(300))}
    exact = VE._narrowed
    asked = []
    monkeypatch.setattr(VE, "SCREEN_ROWS", 64)
    monkeypatch.setattr(VE, "SCREEN_QUERIES", 70)
    monkeypatch.setattr(VE, "_narrowed", lambda *a: asked.append(1) or exact(*a))
    for name, (q, v, ids) in tables.items():
        frames = [pd.DataFrame({c[0]: np.array(ids), c[1]: list(y)}) for c, y in ((("qid", "qv"), q), (("nid", "vv"), v))]
        for metric, largest, alone in (("l2", False, True), ("l2", False, False), ("ip", True, False), ("ip", False, True)):
            run = VE._block_topk(5, metric, largest, alone)
            asked.clear()
            got = run(*frames)
            assert not (name == "plain" and asked)
            with monkeypatch.context() as m:
                m.setattr(VE, "_screened", lambda *a: None)
                want = run(*frames)
            assert asked and got.equals(want)
