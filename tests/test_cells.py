"""Edges and links dealt to cells of node blocks."""

import numpy as np
import pytest

from citegraph.operators import cells as C
from citegraph.operators import gnn
from citegraph.operators import graph as G


def plan(df):
    return df._jdf.queryExecution().toString()


def random_edges(spark, n=30, m=90, seed=5):
    rng = np.random.default_rng(seed)
    rows = [(int(a), int(b), float(w)) for a, b, w in zip(rng.integers(0, n, m), rng.integers(0, n, m), rng.normal(size=m))]
    x = rng.normal(size=(n, 3))
    return rows, x, spark.createDataFrame(rows, "dst long, src long, w double"), spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, h array<double>")


@pytest.mark.parametrize("cells", [C.Cells(1, 1), C.Cells(1, 4), C.Cells(3, 4)])
def test_propagation_adds_up_in_cells(spark, cells):
    rows, x, edges, h = random_edges(spark)
    want = {}
    for d, s, w in rows:
        want[d] = want.get(d, 0) + w * x[s]
    for e in (edges, C.pack_edges(edges, cells)):
        out = G.propagate(e, h, 3, cells=cells)
        assert "Summarizer" not in plan(out) and "ObjectHashAggregate" not in plan(out)  # spilled every message above 128 nodes
        got = {r["id"]: r["h"] for r in out.collect()}
        assert got.keys() == want.keys() and all(np.allclose(got[k], want[k]) for k in want)


def test_odd_ends_in_cells(spark):
    """Repeated states count as often as they stand, null ids meet nothing, unknown sources send nothing."""
    h = spark.createDataFrame([(1, [1.0]), (1, [2.0]), (None, [5.0])], "id long, h array<double>")
    e = spark.createDataFrame([(7, 1, 2.0), (8, 3, 1.0), (None, 1, 1.0), (9, None, 1.0)], "dst long, src long, w double")
    assert [(r["id"], r["h"]) for r in G.propagate(e, h, 1).collect()] == [(7, [6.0])]


def test_link_gradients_do_not_depend_on_the_cells(spark):
    rows, x, _edges, h = random_edges(spark)
    pairs = [(a, b, k % 2) for k, (a, b, _w) in enumerate(rows)]
    links = spark.createDataFrame(pairs, "source long, target long, label int")
    want, loss = np.zeros_like(x), 0.0
    for a, b, y in pairs:
        p = 1 / (1 + np.exp(-x[a] @ x[b]))
        want[a] += (p - y) / len(pairs) * x[b]
        want[b] += (p - y) / len(pairs) * x[a]
        loss -= np.log(p if y else 1 - p) / len(pairs)
    for cells in (C.Cells(1, 1), C.Cells(3, 4)):
        parts = C.over_links(links, h, cells, gnn._link_part(len(pairs), "id", True), "id long, h array<double>").cache()
        got = {r["id"]: r["h"] for r in C.add_up(parts, cells, "id", "h").collect()}
        assert all(np.allclose(got.get(i, 0), want[i]) for i in range(len(x)))
        assert np.isclose(gnn._totals(parts, len(pairs), "id")[0], loss)
    lost = links.unionByName(spark.createDataFrame([(1, 99, 0)], links.schema))
    with pytest.raises(Exception, match="link end without a vector"):
        C.over_links(lost, h, C.Cells(1, 2), gnn._link_part(3, "id", True), "id long, h array<double>").collect()


def test_norm_edges_are_joined_once_an_undirected_edge(spark):
    nodes = spark.range(4)
    edges = spark.createDataFrame([(0, 1), (1, 2), (0, 1)], "source long, target long")
    got = sorted((r["dst"], r["src"], round(r["w"], 9)) for r in G.gcn_norm_edges(nodes, edges).collect())
    deg = {0: 3, 1: 4, 2: 2, 3: 1}
    both = [(0, 1), (1, 2), (0, 1)]
    assert got == sorted((a, b, round(1 / (deg[a] * deg[b]) ** 0.5, 9)) for a, b in both + [(b, a) for a, b in both] + [(k, k) for k in deg])


def test_chunks_share_the_nodes_of_many_links():
    """Before, a chunk held 128 links however few nodes there were, and with them the features of nearly all nodes."""
    from citegraph.operators import sage

    few = sage.chunk_links(2_000, 26_000, (20, 10), 64, 8)
    assert few == 3_250  # one chunk a core
    assert sage.chunk_links(20_000, 2_000_000, (20, 10), 64, 8) == sage.MOST_LINKS
    assert sage.chunk_links(10_000_000, 2_000_000, (20, 10), 64, 8) == sage.CHUNK_LINKS  # links that may share no node
    assert sage.chunk_links(50, 10, (4, 2), 3, 8) == sage.CHUNK_LINKS


def test_a_block_is_scored_a_slice_of_queries_at_a_time(monkeypatch):
    import pandas as pd

    from citegraph.operators import vectors as VE

    rng = np.random.default_rng(2)
    x = rng.integers(-3, 4, (40, 5)).astype(float)  # many ties
    q, v = ({i: list(range(40)), c: list(x)} for i, c in (("qid", "qv"), ("nid", "vv")))
    for metric, largest in (("l2", False), ("ip", True), ("ip", False)):
        run = VE._block_topk(4, metric, largest, False)
        monkeypatch.setattr(VE, "SCORES", 1 << 22)
        whole = run(pd.DataFrame(q), pd.DataFrame(v))
        monkeypatch.setattr(VE, "SCORES", 100)
        sliced = run(pd.DataFrame(q), pd.DataFrame(v))
        assert whole.reset_index(drop=True).equals(sliced.reset_index(drop=True)) and set(whole["qid"]) == set(range(40))


def test_link_cosines_meet_in_cells(spark, monkeypatch):
    """The bits of the joined expression, whatever the blocks and however odd the ends; no link is shuffled with a vector."""
    from pyspark.sql import functions as F

    from citegraph.functions.vector import cosine

    rng = np.random.default_rng(3)
    rows = [(i, [float(v) for v in x]) for i, x in enumerate(rng.normal(size=(40, 7)).astype(np.float32))]
    rows += [(3, [1.0] * 7), (3, None), (None, [1.0] * 7), (50, [0.0] * 7), (51, [1.0, None] + [1.0] * 5), (52, [1.0, 2.0]), (53, []),
             (54, [float("nan")] * 7), (5, rows[5][1])]
    vec = spark.createDataFrame(rows, "id long, embedding array<float>")
    ids = [*range(42), *range(50, 55), None]
    pairs = [(ids[a], ids[b], k % 2) for k, (a, b) in enumerate(rng.integers(0, len(ids), (400, 2)).tolist())]
    links = spark.createDataFrame(pairs + pairs[:9], "source long, target long, label int")
    a, b = (vec.select(F.col("id").alias(end), F.col("embedding").alias(name)) for end, name in (("source", "a"), ("target", "b")))
    key = lambda df: sorted(map(repr, df.collect()))
    want = key(links.join(a, "source").join(b, "target").select("source", "target", "label", cosine("a", "b").alias("cosine")))
    for state_rows in (1 << 16, 9):
        monkeypatch.setattr(C, "STATE_ROWS", state_rows)
        assert key(C.link_cosines(links, vec)) == want
    assert C.link_cosines(links, vec.where("false")).count() == C.link_cosines(links.where("false"), vec).count() == 0


def test_scored_links_are_shuffled_without_vectors(spark, monkeypatch):
    from citegraph.plans import q_metrics as Q

    links = spark.createDataFrame([(0, 1, 1), (1, 2, 0)], "source long, target long, label int")
    monkeypatch.setattr(Q, "links", lambda *_: links)
    plans = plan(Q.scored(spark, "/root/testdata/sf0.001"))
    assert "FlatMapCoGroupsInArrow" in plans and "zip_with" not in plans


def test_packed_edges_are_bytes(spark):
    """An edge of a packed cell takes 12 bytes beside the ids of its nodes, and none is taken apart on the way; sources without a
    vector send nothing, and their receivers are not there if they have no other."""
    from pyspark.sql import functions as F

    rng = np.random.default_rng(8)
    rows = [(int(a), int(b), float(w)) for a, b, w in zip(rng.integers(0, 30, 900), rng.integers(0, 30, 900), rng.random(900))] + [(-7, 99, 1.0), (3, 99, 1.0)]
    edges = spark.createDataFrame(rows, "dst long, src long, w double")
    x = {i: rng.normal(size=3) for i in range(30) if i != 4}
    h = spark.createDataFrame([(i, v.tolist()) for i, v in x.items()], "id long, h array<double>")
    want = {}
    for dst, src, w in rows:
        if src in x:
            want[dst] = want.get(dst, 0.0) + w * x[src]
    for cells in (C.Cells(1, 3), C.Cells(2, 2)):
        packed = C.pack_edges(edges, cells).cache()
        assert {t for c, t in packed.dtypes if not c.startswith("_")} == {"binary"}
        size = packed.select(F.sum(F.length("at")), F.sum(F.length("w"))).first()
        assert tuple(size) == (4 * len(rows), 8 * len(rows))
        for e in (edges, packed):
            got = {r["id"]: r["h"] for r in C.weighted_sums(e, h, cells).collect()}
            assert got.keys() == want.keys() and -7 not in got and all(np.allclose(got[i], want[i]) for i in want)
