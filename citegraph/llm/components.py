"""Connected components of an edge list by distributed union-find.

Each task first contracts its own edges with a union-find (a forest of at most one edge a
node leaves it); rounds of large-star and small-star then bring the minimum to every node. Every round is
one written table; the former one is dropped.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citegraph.llm.common import Stored


def _contract(batches):
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        root = x
        while (p := parent.setdefault(root, root)) != root:
            root = p
        while parent[x] != root:
            parent[x], x = root, parent[x]
        return root

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            a, b = find(a), find(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
    nodes = [x for x in parent if find(x) != x]
    roots = [find(x) for x in nodes]
    for s in range(0, len(nodes), 1 << 16):
        yield pa.RecordBatch.from_pydict({"a": pa.array(nodes[s:s + (1 << 16)], pa.int64()),
                                          "b": pa.array(roots[s:s + (1 << 16)], pa.int64())})


def components(edges: DataFrame, store: Stored, name: str) -> DataFrame:
    """(node, root) for every node with an edge to another; root is the smallest node reachable.

    ``edges`` has long columns a, b; order, repeats and self edges do not matter.
    """
    e = store.put(edges.select("a", "b").where("a <> b").mapInArrow(_contract, "a long, b long"), f"{name}0")
    last = None
    for k in range(1, 1000):
        # large star: neighbours above a node go to the least of its neighbourhood
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        # small star: a node's lesser neighbours, and itself, go to the least of them
        down = large.where("a > b").distinct()
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        small = (down.join(least, "a").select(F.explode(F.array(F.col("a"), F.col("b"))).alias("a"), F.col("m").alias("b"))
                 .where("a <> b").distinct())
        nxt = store.put(small, f"{name}{k}")
        store.drop(f"{name}{k - 1}")
        e = nxt
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == last:
            return e.select(F.col("a").alias("node"), F.col("b").alias("root"))
        last = now
    raise RuntimeError("components did not converge")
