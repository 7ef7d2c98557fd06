"""Sampling: partition independence and split properties."""

from pyspark.sql import functions as F

from citegraph.operators import graph as G
from citegraph.operators import sampling as S
from citegraph.plans import views as V

SF = "/root/testdata/sf0.001"


def _rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_partition_independence(spark):
    e = G.simple_graph(V.vec_cites(spark, SF))
    outs = []
    for parts in (1, 4, 13):
        spark.conf.set("spark.sql.shuffle.partitions", str(parts))
        ee = e.repartition(parts)
        outs.append((_rows(S.sample_edges(ee, 0.1, 42)),
                     _rows(S.sample_neighbours(G.symmetric(ee), 5, 42)),
                     _rows(S.sample_edges(ee, 0.1, 42, exact=True))))
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert outs[0] == outs[1] == outs[2]


def test_negative_links_properties(spark):
    nodes = V.vectors(spark, SF)
    e = G.simple_graph(V.vec_cites(spark, SF))
    neg = S.sample_negative_links(nodes, e, 300, 42)
    assert neg.count() == 300
    assert neg.where(F.col("source") >= F.col("target")).count() == 0
    assert neg.select("source", "target").distinct().count() == 300
    assert neg.join(e, ["source", "target"], "left_semi").count() == 0


def test_negative_pairs_avoid_known(spark):
    pairs = V.pairs(spark, SF)
    neg = S.sample_negative_pairs(pairs, 700, 1500, 200, 42)
    assert neg.count() == 700
    assert neg.join(pairs, ["paper_idx", "ref_idx"], "left_semi").count() == 0


def test_batches_cover_all(spark):
    rows = spark.range(95).select(F.col("id").alias("source"), (F.col("id") + 1).alias("target"))
    b = S.assign_batches(rows, 20, ["source", "target"], seed=1)
    sizes = sorted(r["count"] for r in b.groupBy("batch").count().collect())
    assert sizes == [15, 20, 20, 20, 20]


def test_nearly_complete_graph_gives_all_that_is_asked_for(spark):
    import pytest

    nodes = spark.range(12)
    every = [(a, b) for a in range(12) for b in range(a + 1, 12)]
    gaps = {(0, 1), (3, 7), (10, 11)}
    e = spark.createDataFrame([x for x in every if x not in gaps], "source long, target long")
    got = S.sample_negative_links(nodes, e, 3, 42)
    assert {(r.source, r.target) for r in got.collect()} == gaps
    with pytest.raises(ValueError):
        S.sample_negative_links(nodes, e, 4, 42)


def test_nearly_complete_pairs(spark):
    import pytest

    full = [(p, r) for p in range(30) for r in range(30)]
    pairs = spark.createDataFrame(full[1:], "paper_idx long, ref_idx long")
    got = S.sample_negative_pairs(pairs, 9, 30, 30, 42)
    assert [(r.paper_idx, r.ref_idx) for r in got.collect()] == [(0, 0)] * 9
    with pytest.raises(ValueError):
        S.sample_negative_pairs(spark.createDataFrame(full, "paper_idx long, ref_idx long"), 5, 30, 30, 42)


def test_exact_cut_is_the_same_plan_for_every_n(spark):
    df = spark.range(5000).select(F.col("id").alias("source"), (F.col("id") * 7).alias("target"))
    for p in (0.001, 0.5, 1.0):
        got = S.sample_edges(df, p, 3, exact=True)
        assert got.count() == int(p * 5000)
