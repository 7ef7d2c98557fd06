"""Graph invariants: components, spanning forest, link split, propagation."""

import random

import numpy as np
from pyspark.sql import functions as F

from citegraph.operators import graph as G


def _random_graph(spark, n=60, m=70, seed=3):
    rnd = random.Random(seed)
    edges = {(rnd.randrange(n), rnd.randrange(n)) for _ in range(m)}
    nodes = spark.range(n)
    return nodes, spark.createDataFrame(sorted(edges), "source long, target long"), n, edges


def _union_find(n, edges):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in edges:
        ra, rb = find(a), find(b)
        if ra != rb:
            parent[max(ra, rb)] = min(ra, rb)
    comp = {}
    for v in range(n):
        comp.setdefault(find(v), []).append(v)
    return {v: min(c) for c in comp.values() for v in c}


def test_components(spark):
    nodes, edges, n, es = _random_graph(spark)
    got = {r["id"]: r["component"] for r in G.connected_components(nodes, edges).collect()}
    assert got == _union_find(n, es)


def test_spanning_forest(spark):
    nodes, edges, n, es = _random_graph(spark)
    forest = G.spanning_forest(nodes, edges, 42)
    f = [tuple(r) for r in forest.collect()]
    comps = _union_find(n, es)
    assert len(f) == n - len(set(comps.values()))
    assert _union_find(n, f) == comps  # same components with forest edges only
    assert set(f) <= {(min(a, b), max(a, b)) for a, b in es}


def test_split_links(spark):
    nodes, edges, n, es = _random_graph(spark, n=40, m=120)
    reduced, links = G.split_links(nodes, edges, 0.1, 42)
    pos = links.where("label = 1")
    neg = links.where("label = 0")
    assert pos.count() == neg.count() > 0
    canon = G.simple_graph(edges)
    assert pos.join(canon, ["source", "target"], "left_anti").count() == 0
    assert neg.join(canon, ["source", "target"], "left_semi").count() == 0
    before = _union_find(n, [tuple(r) for r in canon.collect()])
    after = _union_find(n, [tuple(r) for r in reduced.collect()])
    assert before == after  # keep_connected


def test_gcn_propagation_matches_dense(spark):
    nodes, edges, n, es = _random_graph(spark, n=12, m=20)
    h = nodes.select("id", F.array(F.col("id").cast("double"), F.lit(1.0)).alias("h"))
    out = {r["id"]: r["h"] for r in G.propagate(G.gcn_norm_edges(nodes, G.simple_graph(edges)), h, 2).collect()}
    A = np.eye(n)
    for a, b in es:
        if a != b:
            A[a, b] = A[b, a] = 1.0
    d = A.sum(1)
    Ah = (A / np.sqrt(np.outer(d, d))) @ np.stack([np.arange(n), np.ones(n)], 1)
    for i in range(n):
        assert np.allclose(out[i], Ah[i])


def test_chained_split(spark):
    nodes, edges, n, es = _random_graph(spark, n=40, m=150, seed=9)
    train_e, train_l, test_e, test_l = G.chained_split(nodes, edges, 0.1, 42)
    # train graph is a subgraph of the test graph; train positives come from the test graph
    assert train_e.join(test_e, ["source", "target"], "left_anti").count() == 0
    assert train_l.where("label = 1").join(test_e, ["source", "target"], "left_anti").count() == 0
    assert train_l.where("label = 1").count() == train_l.where("label = 0").count()


def test_missing_vectors_are_errors(spark):
    import pytest

    from citegraph.operators import graph as G

    edges = spark.createDataFrame([(1, 2), (2, 3)], "source long, target long")
    feats = spark.createDataFrame([(1, [1.0]), (2, [0.5])], "id long, embedding array<double>")
    with pytest.raises(Exception, match="without features"):
        G.AttributedGraph.build(edges, feats).nodes.collect()
    with pytest.raises(Exception, match="without a vector"):
        G.link_score(edges, feats, vec_col="embedding").collect()
    whole = feats.union(spark.createDataFrame([(3, [2.0])], feats.schema))
    assert G.AttributedGraph.build(edges, whole).nodes.count() == 3
    for op in ("hadamard", "l1", "l2", "avg", "concat"):
        assert G.link_score(edges, whole, op=op, vec_col="embedding").count() == 2


def test_hub_is_split_into_parts(spark):
    from pyspark.sql import functions as F

    from citegraph.operators.corpus import adjacency

    e = spark.range(3000).select(F.lit(1).cast("long").alias("source"), F.col("id").alias("target"))
    parts = adjacency(e, chunk=1024).collect()
    assert len(parts) == 3 and sum(r["n_targets"] for r in parts) == 3000
    assert sorted(t for r in parts for t in r["targets"]) == list(range(3000))


def test_forest_of_a_long_path_and_isolated_nodes(spark):
    from citegraph.operators import graph as G

    nodes = spark.range(210)
    e = spark.createDataFrame([(i, i + 1) for i in range(200)], "source long, target long")
    assert G.spanning_forest(nodes, e).count() == 200
    comp = {r["id"]: r["component"] for r in G.connected_components(nodes, e).collect()}
    assert comp == {i: 0 if i <= 200 else i for i in range(210)}


def test_forest_is_the_same_with_and_without_rounds(spark, monkeypatch):
    """Contraction rounds, one task at the end, or both: one minimum forest, the same components."""
    import numpy as np

    from citegraph.operators import graph as G

    rng = np.random.default_rng(8)
    edges = sorted({tuple(sorted(map(int, rng.integers(0, 120, 2)))) for _ in range(260)} - {(i, i) for i in range(120)})
    edges += [(0, k) for k in range(200, 260)]  # a hub
    e = spark.createDataFrame(edges, "source long, target long")
    nodes = spark.range(300)
    found = []
    for most in (1 << 20, 40, 0):
        monkeypatch.setattr(G, "FINISH_EDGES", most)
        forest = {(r["source"], r["target"]) for r in G.spanning_forest(nodes, e, 7).collect()}
        comp = {r["id"]: r["component"] for r in G.connected_components(nodes, e, seed=7).collect()}
        assert len(comp) == 300 and len(forest) == 300 - len(set(comp.values()))
        found.append((forest, comp))
    assert found[0] == found[1] == found[2]


def test_hub_neighbours_are_dealt(spark, monkeypatch):
    """A neighbour of all queries, and one with very many references, land in no single join key; nothing is lost."""
    from pyspark.sql import functions as F

    from citegraph.operators import recommend as RC

    monkeypatch.setattr(RC, "KEY_ROWS", 50)
    knn = spark.createDataFrame([(q, n) for q in range(400) for n in (7, 8 + q % 30)], "query_id long, neighbour_id long")
    cites = spark.createDataFrame([(7, 1000 + k) for k in range(320)] + [(n, n + 1) for n in range(8, 38)], "source long, target long")
    asks, refs = RC.spread(knn.withColumnRenamed("neighbour_id", "source"), cites)
    key = ["source", "salt", "part"]
    for side in (asks, refs):
        assert side.groupBy(key).count().agg(F.max("count")).first()[0] < 110
    got = {(r[0], r[1]) for r in RC.expand_neighbours(knn, cites).collect()}
    out = {}
    for s, t in cites.collect():
        out.setdefault(s, set()).add(t)
    want = {(q, x) for q, n in knn.collect() for x in {n} | out.get(n, set())}
    assert got == want


def test_expanded_rows_are_dealt_over_tasks(spark, monkeypatch):
    """The tasks that drop the repeats grow with the found rows, and the search below runs once."""
    from citegraph.operators import recommend as RC

    monkeypatch.setattr(RC, "TASK_ROWS", 10)
    runs = spark.sparkContext.accumulator(0)

    def search(batches):
        for pdf in batches:
            runs.add(len(pdf))
            yield pdf

    knn = spark.createDataFrame([(q, n) for q in range(20) for n in (1, 2)], "query_id long, neighbour_id long").mapInPandas(
        search, "query_id long, neighbour_id long")
    cites = spark.createDataFrame([(1, t) for t in range(10, 30)] + [(2, t) for t in range(20, 40)], "source long, target long")
    got = RC.expand_neighbours(knn, cites)
    assert got.rdd.getNumPartitions() == 84  # 40 neighbours and 800 references, repeats included
    rows = [tuple(r) for r in got.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == {(q, x) for q in range(20) for x in (1, 2, *range(10, 40))}
    assert runs.value == 40


def test_dense_graph_is_thinned_to_the_same_forest(spark, monkeypatch):
    """A graph of many edges a vertex is cut to forests where it lies: few tables are written, the forest is the minimum one."""
    from citegraph.functions.hashing import hash64
    from citegraph.session import RunTables

    n = 30
    monkeypatch.setattr(G, "FINISH_EDGES", 64)
    nodes = spark.range(n)
    e = spark.createDataFrame([(a, b) for a in range(n) for b in range(a + 1, n) if (a < 20) == (b < 20)], "source long, target long")
    weights = {(r["source"], r["target"]): r["w"] for r in e.select("source", "target", hash64(F.lit(7), "source", "target").alias("w")).collect()}
    root, want = list(range(n)), set()
    for a, b in sorted(weights, key=weights.get):
        if root[a] != root[b]:
            want.add((a, b))
            root = [root[a] if x == root[b] else x for x in root]
    written, put = [], RunTables.put
    monkeypatch.setattr(RunTables, "put", lambda self, df: written.append(df.columns) or put(self, df))
    got = {tuple(r) for r in G.spanning_forest(nodes, e.repartition(3), 7, simple=True).collect()}
    assert got == want and len(got) == n - 2
    assert len(written) <= 4 and not any("moved" in c for c in written)  # no round of joins
    low = {r["id"]: r["component"] for r in G.connected_components(nodes, e, seed=7).collect()}
    assert low == {i: 0 if i < 20 else 20 for i in range(n)}
