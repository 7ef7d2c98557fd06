"""Graph operators: G1-G8, G10, G12, J11, J12, A8 and connected components.

A graph is two DataFrames: ``nodes(id, features, ...)`` and canonical undirected
``edges(source < target)``. Message passing is a join of the edge list with node
states followed by a hash aggregate on the receiving node; partial aggregation
happens map-side, so a hub's incoming messages are pre-summed per partition
before the shuffle.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citegraph.operators.cells import Cells, cells_for, weighted_sums


# ---------------------------------------------------------------- G1-G3, J11
def simple_graph(edges: DataFrame) -> DataFrame:
    """G1: undirected simple graph: self loops dropped, reverse and parallel edges collapsed."""
    return (edges.where(F.col("source") != F.col("target"))
            .select(F.least("source", "target").alias("source"),
                    F.greatest("source", "target").alias("target")).distinct())


def symmetric(edges: DataFrame) -> DataFrame:
    """Both directions of every undirected edge."""
    e = edges.select("source", "target")
    return e.unionByName(e.select(F.col("target").alias("source"), F.col("source").alias("target")))


def typed_nodes(nodes: DataFrame, node_type: str = "paper") -> DataFrame:
    """One node type for all nodes."""
    return nodes.withColumn("node_type", F.lit(node_type))


def attach_features(graph_nodes: DataFrame, features: DataFrame, id_col: str = "id",
                    check: bool = True) -> DataFrame:
    """Match features to graph nodes; a node without a feature row, or with a null in it, is an error
    (raised by the query itself when it runs)."""
    out = graph_nodes.select(id_col).distinct().join(features.withColumn("_has", F.lit(True)), id_col, "left")
    if check:
        whole = F.col("_has")
        for c in features.columns:
            if c != id_col:
                whole = whole & F.col(c).isNotNull()
        out = out.where(F.when(F.coalesce(whole, F.lit(False)), F.lit(True)).otherwise(
            F.raise_error(F.concat(F.lit("graph node without features: "), F.col(id_col).cast("string"))).cast("boolean")))
    return out.drop("_has")


@dataclass
class AttributedGraph:
    """Graph + features as one object (two DataFrames)."""

    nodes: DataFrame
    edges: DataFrame

    @classmethod
    def build(cls, edges: DataFrame, features: DataFrame, id_col: str = "id") -> "AttributedGraph":
        e = simple_graph(edges)
        ends = e.select(F.col("source").alias(id_col)).union(e.select(F.col("target").alias(id_col)))
        return cls(attach_features(ends, features, id_col), e)


# ---------------------------------------------------------------- A8
def degrees(nodes: DataFrame, edges: DataFrame, id_col: str = "id") -> DataFrame:
    """Undirected degree of every node (0 for isolated nodes)."""
    d = symmetric(edges).groupBy(F.col("source").alias(id_col)).agg(F.count(F.lit(1)).alias("degree"))
    return (nodes.select(id_col).join(d, id_col, "left")
            .withColumn("degree", F.coalesce("degree", F.lit(0)).cast("bigint")))


def graph_summary(nodes: DataFrame, edges: DataFrame, id_col: str = "id",
                  feature_col: str | None = "embedding") -> DataFrame:
    """Nodes, edges, feature length, isolated nodes, min / mean / max degree."""
    deg = degrees(nodes, edges, id_col)
    s = deg.agg(F.count(F.lit(1)).alias("n_nodes"),
                F.sum(F.when(F.col("degree") == 0, 1).otherwise(0)).cast("bigint").alias("n_isolated"),
                F.min("degree").alias("min_degree"), F.avg("degree").alias("mean_degree"),
                F.max("degree").alias("max_degree"))
    s = s.join(edges.agg(F.count(F.lit(1)).alias("n_edges")))  # one row each
    if feature_col:
        s = s.join(nodes.agg(F.max(F.size(feature_col)).cast("int").alias("feature_length")))
    return s


# ---------------------------------------------------------------- J12
def remove_edges(edges: DataFrame, held_out: DataFrame) -> DataFrame:
    """Reduced graph = graph minus held-out edges (canonical pairs, anti join)."""
    h = held_out.select(F.least("source", "target").alias("source"),
                        F.greatest("source", "target").alias("target"))
    return edges.join(h, ["source", "target"], "left_anti")


# ---------------------------------------------------------------- G8, G10
def gcn_norm_edges(nodes: DataFrame, edges: DataFrame, id_col: str = "id") -> DataFrame:
    """Â = D^-1/2 (A + I) D^-1/2 as a weighted directed edge list (dst, src, w).

    Degrees come from one aggregation. Weights are joined to the undirected edges, which are half as many rows, and each
    edge then stands in both directions; self loops are added by a union.
    """
    loops = nodes.select(F.col(id_col).alias("source"), F.col(id_col).alias("target"))
    a = symmetric(edges).unionByName(loops)
    deg = a.groupBy(F.col("source").alias("n")).agg(F.count(F.lit(1)).cast("double").alias("d"))
    w = (F.lit(1.0) / F.sqrt(F.col("ds") * F.col("dt"))).alias("w")
    ds = deg.select(F.col("n").alias("source"), F.col("d").alias("ds"))
    one = (edges.select("source", "target").join(ds, "source")
           .join(deg.select(F.col("n").alias("target"), F.col("d").alias("dt")), "target").select("target", "source", w))
    own = loops.join(ds.withColumn("dt", F.col("ds")), "source").select("target", "source", w)
    return (one.select(F.col("target").alias("dst"), F.col("source").alias("src"), "w")
            .unionByName(one.select(F.col("source").alias("dst"), F.col("target").alias("src"), "w"))
            .unionByName(own.select(F.col("target").alias("dst"), F.col("source").alias("src"), "w")))


def propagate(norm_edges: DataFrame, h: DataFrame, dim: int, *, id_col: str = "id",
              vec_col: str = "h", cells: Cells | None = None) -> DataFrame:
    """One step H' = Â·H (weighted sum of neighbour rows, self included).

    Edges and states meet in cells of bounded size (:mod:`citegraph.operators.cells`), where messages are added up in
    numpy: what is shuffled are edges, a copy of the states for each block of receivers, and one vector a cell and node.
    ``cells`` spares counting both tables; ``norm_edges`` may be packed for them.
    """
    return weighted_sums(norm_edges, h, cells or cells_for(h, norm_edges), id_col=id_col, vec_col=vec_col)


def sum_vectors(rows: DataFrame, key: str, vec_col: str, out_col: str, weight_col: str | None = None,
                metric: str = "sum") -> DataFrame:
    """Element-wise (weighted) sum or mean of array columns per key: (key, out_col)."""
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    vec = array_to_vector(F.transform(vec_col, lambda x: x.cast("double")))
    weight = F.col(weight_col) if weight_col else F.lit(1.0)
    total = Summarizer.metrics(metric).summary(vec, weight).getField(metric)
    return rows.groupBy(key).agg(total.alias("_s")).select(key, vector_to_array("_s").alias(out_col))


def mean_aggregate(sampled: DataFrame, h: DataFrame, nodes: DataFrame, dim: int, *,
                   id_col: str = "id", vec_col: str = "h") -> DataFrame:
    """Mean of the (sampled) neighbours' rows; isolated node → zero vector."""
    msg = (sampled.select(F.col("source").alias(id_col), F.col("target").alias("src"))
           .join(h.select(F.col(id_col).alias("src"), F.col(vec_col).alias("_v")), "src"))
    vecs = sum_vectors(msg, id_col, "_v", "_m", metric="mean")
    zero = F.array_repeat(F.lit(0.0), dim)
    return (nodes.select(id_col).join(vecs, id_col, "left")
            .select(id_col, F.coalesce("_m", zero).alias(vec_col)))


# ---------------------------------------------------------------- G12
#: Links with their vectors that one task joins, on average.
LINK_ROWS = 1 << 18


def link_score(links: DataFrame, emb: DataFrame, *, op: str = "ip", act: str = "sigmoid",
               id_col: str = "id", vec_col: str = "h", doubles: bool = False) -> DataFrame:
    """Join both ends' vectors, combine, activate → ``score``. A link end without a vector is an error. With ``doubles`` vectors
    of a narrower type are combined as doubles, but joined as they are.

    ``op``: ``ip`` (inner product; others return the link embedding array:
    ``hadamard``, ``l1``, ``l2``, ``avg``, ``concat``). ``act``: sigmoid, relu, linear.
    """
    from citegraph.functions.vector import dot, relu, sigmoid

    a = emb.select(F.col(id_col).alias("source"), F.col(vec_col).alias("_a"))
    b = emb.select(F.col(id_col).alias("target"), F.col(vec_col).alias("_b"))
    j = links.join(a, "source", "left")
    if op != "ip":  # rows as wide as two vectors: tasks of a bounded number of them
        tasks = math.ceil(links.count() / LINK_ROWS)
        if tasks > int(links.sparkSession.conf.get("spark.sql.shuffle.partitions")):
            j = j.repartition(tasks, "target")
    j = j.join(b, "target", "left").where(
        F.when(F.col("_a").isNotNull() & F.col("_b").isNotNull(), F.lit(True)).otherwise(F.raise_error(
            F.concat_ws(" ", F.lit("link end without a vector:"), "source", "target")).cast("boolean")))
    if doubles:
        j = j.withColumn("_a", F.col("_a").cast("array<double>")).withColumn("_b", F.col("_b").cast("array<double>"))
    if op == "ip":
        raw = dot("_a", "_b")
        score = {"sigmoid": sigmoid(raw), "relu": relu(raw), "linear": raw}[act]
        return j.withColumn("score", score).drop("_a", "_b")
    ops = {
        "hadamard": F.zip_with("_a", "_b", lambda x, y: x * y),
        "l1": F.zip_with("_a", "_b", lambda x, y: F.abs(x - y)),
        "l2": F.zip_with("_a", "_b", lambda x, y: (x - y) * (x - y)),
        "avg": F.zip_with("_a", "_b", lambda x, y: (x + y) / 2.0),
        "concat": F.concat("_a", "_b"),
    }
    return j.withColumn("link_embedding", ops[op]).drop("_a", "_b")


# ---------------------------------------------------------------- components, G4
def connected_components(nodes: DataFrame, edges: DataFrame, *, id_col: str = "id",
                         seed: int = 42) -> DataFrame:
    """Component label = smallest node id in the component: (id, component).

    Components come out of the Borůvka rounds of :func:`spanning_forest`
    (O(log n) rounds, each with pointer jumping), not from label propagation,
    whose round count grows with the graph's diameter. Each component's root is
    then relabelled to its smallest member by one hash aggregate.
    """
    _forest, comp = _boruvka(nodes, edges, seed, id_col=id_col)
    low = comp.groupBy("c").agg(F.min("v").alias("component"))
    return comp.join(low, "c").select(F.col("v").alias(id_col), "component")


def spanning_forest(nodes: DataFrame, edges: DataFrame, seed: int = 42, *, id_col: str = "id", simple: bool = False) -> DataFrame:
    """The minimum spanning forest under unique md5 edge weights (Borůvka). ``simple`` says that the edges are a
    simple graph already (G1)."""
    return _boruvka(nodes, edges, seed, id_col=id_col, simple=simple)[0]


#: Edges of a contracted graph that one task takes (five numbers each).
FINISH_EDGES = 1 << 20


def _forest_of(e):
    """(edges, lightest first; which of them the spanning forest takes; parent pointers) of a contracted graph."""
    import numpy as np

    e = e.sort_values(["w", "a", "b"])
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        root = x
        while (p := parent.setdefault(root, root)) != root:
            root = p
        while parent[x] != root:
            parent[x], x = root, parent[x]
        return root

    taken = np.zeros(len(e), bool)
    for k, (x, y) in enumerate(zip(e["ca"].tolist(), e["cb"].tolist())):
        x, y = find(x), find(y)
        if x != y:
            parent[max(x, y)] = min(x, y)
            taken[k] = True
    return e, taken, {x: find(x) for x in list(parent)}


def _kruskal(batches):
    """The spanning forest's edges among the components of a contracted graph, lightest first, and the root of every
    component: rows ('edge', a, b) and ('root', component, root)."""
    import pandas as pd

    parts = [pdf for pdf in batches if len(pdf)]
    if not parts:
        return
    e, taken, root = _forest_of(pd.concat(parts))
    yield pd.DataFrame({"kind": "edge", "a": e["a"][taken], "b": e["b"][taken]})
    yield pd.DataFrame({"kind": "root", "a": list(root), "b": list(root.values())})


def _thinned(most: int):
    """Of the edges that a task reads those that a spanning forest may take: ``most`` at a time, with the ones left of those
    before, are cut to their own forest. (The heaviest edge of a cycle is in no minimum forest.)"""
    def run(batches):
        import pandas as pd

        held, n = [], 0
        for pdf in batches:
            held.append(pdf)
            n += len(pdf)
            if n >= most:
                e, taken, _root = _forest_of(pd.concat(held))
                held, n = [e[taken]], 0
                if 2 * len(held[0]) > most:  # no task holds more, however many components there are
                    yield held.pop()
        if sum(map(len, held)):
            e, taken, _root = _forest_of(pd.concat(held))
            yield e[taken]

    return run


#: Edges a vertex from which a graph is thinned, and those that a task reads for every vertex.
THIN_FROM, THIN_READ = 4, 8


def _boruvka(nodes: DataFrame, edges: DataFrame, seed: int = 42, *, id_col: str = "id", simple: bool = False):
    """Borůvka rounds → (forest edges, component of every node).

    A contracted graph of at most ``FINISH_EDGES`` edges is finished by one task (:func:`_kruskal`). One of many edges a vertex is first
    thinned where it lies (:func:`_thinned`), without a shuffle, to a forest a task. Above that, each round every component picks its lightest outgoing edge (``min`` of a
    (weight, a, b) struct, combined map-side), the picked edges join the forest, and components
    merge: each points to the component at the other end of its pick (a mutual pick is broken
    towards the smaller id), and pointer jumping finds the roots. The edge table is then contracted: edges
    inside a component go, and of those between two components only the lightest stays, so it
    shrinks with the components (at least by half a round). Each round's picks and root maps are written
    once and put together at the end; tables that no later round reads are dropped.
    """
    from citegraph.functions.hashing import hash64
    from citegraph.session import RunTables

    run = RunTables(edges.sparkSession)
    e = run.put((edges if simple else simple_graph(edges)).select(
        F.col("source").alias("a"), F.col("target").alias("b"), F.col("source").alias("ca"), F.col("target").alias("cb"),
        hash64(F.lit(seed), "source", "target").alias("w")))
    picks, maps = [], []
    vertices, thin = nodes.count(), True
    while (left := e.count()):
        if left <= FINISH_EDGES:
            rest = run.put(e.select("w", "a", "b", "ca", "cb").coalesce(1).mapInPandas(
                _kruskal, "kind string, a long, b long"))
            picks.append(rest.where("kind = 'edge'").select("a", "b"))
            maps.append(rest.where("kind = 'root'").select(F.col("a").alias("c"), F.col("b").alias("p")))
            break
        if thin and left > THIN_FROM * vertices:
            tasks = max(1, math.ceil(left / (THIN_READ * max(1, vertices))))
            less = run.put(e.coalesce(tasks).mapInPandas(_thinned(FINISH_EDGES), e.schema))
            run.drop(e)
            e, thin = less, 2 * less.count() < left
            continue
        vertices, thin = vertices // 2, True  # every component joins another one
        side = (e.select(F.col("ca").alias("c"), "w", "a", "b", F.col("cb").alias("other"))
                .unionByName(e.select(F.col("cb").alias("c"), "w", "a", "b", F.col("ca").alias("other"))))
        pick = run.put(side.groupBy("c").agg(F.min(F.struct("w", "a", "b", "other")).alias("p"))
                       .select("c", F.col("p.a").alias("a"), F.col("p.b").alias("b"), F.col("p.other").alias("other")))
        picks.append(pick)
        # parent pointers; a mutual pick (a 2-cycle) is rooted at the smaller id
        rev = pick.select(F.col("c").alias("other"), F.col("other").alias("back"))
        parent = run.put(pick.join(rev, "other", "left").select(
            "c", F.when((F.col("back") == F.col("c")) & (F.col("c") < F.col("other")), F.col("c"))
            .otherwise(F.col("other")).alias("p")).distinct())
        while True:  # two jumps a write
            up = parent.select(F.col("c").alias("p"), F.col("p").alias("p2"))
            up2 = parent.select(F.col("c").alias("p2"), F.col("p").alias("p3"))
            hop = run.put(parent.join(up, "p").join(up2, "p2").select("c", F.col("p3").alias("p"), (F.col("p3") != F.col("p")).alias("moved")))
            run.drop(parent)
            parent = hop
            if hop.where("moved").isEmpty():
                break
        root = parent.select("c", "p")
        maps.append(root)
        nxt = run.put(
            e.join(root.select(F.col("c").alias("ca"), F.col("p").alias("pa")), "ca")
            .join(root.select(F.col("c").alias("cb"), F.col("p").alias("pb")), "cb").where("pa <> pb")
            .groupBy(F.least("pa", "pb").alias("ca"), F.greatest("pa", "pb").alias("cb"))
            .agg(F.min(F.struct("w", "a", "b")).alias("m"))
            .select("m.a", "m.b", "ca", "cb", "m.w"))
        run.drop(e)
        e = nxt
    # the last round's roots, carried back through the (larger) maps of the rounds before
    comp = nodes.select(F.col(id_col).alias("v"), F.col(id_col).alias("c"))
    whole = None
    for root in reversed(maps):
        if whole is not None:
            root = (root.join(whole.select(F.col("c").alias("p"), F.col("p").alias("q")), "p", "left")
                    .select("c", F.coalesce("q", "p").alias("p")))
        whole = root
    if whole is None:
        return edges.sparkSession.createDataFrame([], "source bigint, target bigint"), comp
    comp = comp.join(whole, "c", "left").select("v", F.coalesce("p", "c").alias("c"))
    forest = reduce(DataFrame.unionByName, [p.select("a", "b") for p in picks]).distinct()
    return forest.select(F.col("a").alias("source"), F.col("b").alias("target")), comp


# ---------------------------------------------------------------- G5, G6
def split_links(nodes: DataFrame, edges: DataFrame, p: float = 0.1, seed: int = 42, *,
                keep_connected: bool = True, id_col: str = "id"):
    """(reduced edges, links(source, target, label)).

    Positives: ``round(p * m)`` edges of smallest md5 weight among those outside
    the spanning forest when ``keep_connected`` (removing them cannot split a
    component; all of them when there are fewer), else among all edges. Negatives: as many non-edges (T9).
    """
    from citegraph.operators.sampling import least_hashed, sample_negative_links
    from citegraph.functions.hashing import hash64

    from citegraph.session import cut_lineage

    e = cut_lineage(simple_graph(edges))
    m = e.count()
    n_pos = int(math.floor(p * m + 0.5))
    pool = e
    if keep_connected:
        pool = e.join(spanning_forest(nodes, e, seed, id_col=id_col, simple=True), ["source", "target"], "left_anti")
    keyed = pool.withColumn("_h", hash64(F.lit(seed), F.lit("split"), "source", "target"))
    pos = cut_lineage(least_hashed(keyed, n_pos, "_h", ["source", "target"]).select("source", "target"))
    n_taken = pos.count()  # fewer than n_pos when the graph has fewer edges outside the forest
    neg = sample_negative_links(nodes, e, n_taken, seed, id_col=id_col)
    links = (pos.withColumn("label", F.lit(1))
             .unionByName(neg.select("source", "target", F.lit(0).alias("label"))))
    return remove_edges(e, pos), links


def chained_split(nodes: DataFrame, edges: DataFrame, p: float = 0.1, seed: int = 42, **kw):
    """Split, then split the reduced graph again → (train_edges, train_links,
    test_edges, test_links); the train graph is a subgraph of the test graph."""
    test_edges, test_links = split_links(nodes, edges, p, seed, **kw)
    train_edges, train_links = split_links(nodes, test_edges, p, seed + 1, **kw)
    return train_edges, train_links, test_edges, test_links


# ---------------------------------------------------------------- G7
def two_hop_neighbourhood(edges: DataFrame, sizes: tuple[int, int] = (20, 10), seed: int = 42) -> DataFrame:
    """Sampled 2-hop neighbourhood of every node: (node, hop1, hop2).

    ``sizes[0]`` neighbours at hop 1 (T12, hop=1) and ``sizes[1]`` of each of
    those at hop 2 (T12, hop=2); a hop-1 node without neighbours has hop2 NULL.
    A link's input is the neighbourhoods of its two ends (join on node).
    """
    from citegraph.operators.sampling import sample_neighbours

    sym = symmetric(edges)
    h1 = sample_neighbours(sym, sizes[0], seed, hop=1).select(
        F.col("source").alias("node"), F.col("target").alias("hop1"))
    h2 = sample_neighbours(sym, sizes[1], seed, hop=2).select(
        F.col("source").alias("hop1"), F.col("target").alias("hop2"))
    return h1.join(h2, "hop1", "left").select("node", "hop1", "hop2")


def link_neighbourhoods(links: DataFrame, edges: DataFrame, sizes: tuple[int, int] = (20, 10), seed: int = 42) -> DataFrame:
    """G7 for links: ``links`` with ``source_hops`` and ``target_hops``: for both ends the sampled neighbours in the order of
    their draws, each as (hop1, hop2: its own sampled neighbours). An end without neighbours has a null there.

    Lists are bounded by ``sizes``. A node's neighbourhood is built once and joined to all links it ends.
    """
    from citegraph.operators.sampling import sample_neighbours

    sym = symmetric(edges)
    in_order = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("slot", c))), lambda x: x[c])
    hop2 = (sample_neighbours(sym, sizes[1], seed, hop=2).groupBy(F.col("source").alias("hop1"))
            .agg(in_order("target").alias("hop2")))
    hop1 = sample_neighbours(sym, sizes[0], seed, hop=1).select(F.col("source").alias("node"), F.col("target").alias("hop1"), "slot")
    block = F.struct("slot", "hop1", "hop2")
    hops = (hop1.join(hop2, "hop1").groupBy("node").agg(F.array_sort(F.collect_list(block)).alias("b"))
            .select("node", F.transform("b", lambda x: F.struct(x["hop1"].alias("hop1"), x["hop2"].alias("hop2"))).alias("hops")))
    for end in ("source", "target"):
        links = links.join(hops.select(F.col("node").alias(end), F.col("hops").alias(f"{end}_hops")), end, "left")
    return links
