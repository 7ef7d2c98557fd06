"""Work on pairs of node blocks: edges or links are dealt to cells (block of one end, block of the other end), and a cell meets
the vectors of its blocks in one Arrow task.

No message becomes a row: a cell adds up, in numpy, what its edges send to a node, so one vector a cell and node is
shuffled. A block holds about ``STATE_ROWS`` nodes and a cell about ``CELL_EDGES`` edges, by hash; a node's row is copied
once for each block of the other side.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Nodes of a block and edges of a cell, on average.
STATE_ROWS, CELL_EDGES = 1 << 16, 1 << 20
#: Edges whose messages exist at a time, within a task.
SLICE = 1 << 15


@dataclass(frozen=True)
class Cells:
    """Blocks of the sending (a) and of the receiving side (b)."""

    a: int
    b: int

    @classmethod
    def of(cls, n_nodes: int, n_edges: int, cores: int) -> Cells:
        """At least as many cells as cores, unless there are fewer nodes."""
        a = max(1, math.ceil(n_nodes / STATE_ROWS))
        b = max(math.ceil(n_edges / (a * CELL_EDGES)), math.ceil(cores / a), a)
        return cls(a, max(1, min(b, n_nodes)))


def cells_for(nodes: DataFrame, edges: DataFrame) -> Cells:
    """By counting both tables, which should be stored."""
    return Cells.of(nodes.count(), edges.count(), nodes.sparkSession.sparkContext.defaultParallelism)


def block(col: str, n: int):
    return F.pmod(F.xxhash64(F.col(col).cast("long")), F.lit(n)).cast("int")


def all_blocks(n: int):
    return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))


# ---------------------------------------------------------------- in a task
def column(table: pa.Table, name: str) -> np.ndarray:
    """A column as numpy; of a packed table (one row of lists), the list."""
    col = table[name].combine_chunks()
    if pa.types.is_list(col.type):
        col = col.flatten()
    return col.to_numpy(zero_copy_only=False)


def matrix(table: pa.Table, ids: str, vectors: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct ids in order, and the sum of the vectors of each."""
    table = table.filter(pc.is_valid(table[ids]))
    if table[vectors].null_count:
        raise ValueError(f"null vector of {table.filter(pc.is_null(table[vectors]))[ids][0].as_py()}")
    key = column(table, ids)
    if not len(key):
        return key, np.zeros((0, 1))
    rows = column(table, vectors).astype(np.float64, copy=False).reshape(len(key), -1)
    order = np.argsort(key, kind="stable")
    key, rows = key[order], rows[order]
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    return (key, rows) if len(first) == len(key) else (key[first], np.add.reduceat(rows, first, axis=0))


def places(ids: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Where each of ``of`` stands in the sorted ``ids``; -1 where it does not."""
    if not len(ids):
        return np.full(len(of), -1)
    at = np.minimum(np.searchsorted(ids, of), len(ids) - 1)
    return np.where(ids[at] == of, at, -1)


def add_to(out: np.ndarray, to: np.ndarray, rows: np.ndarray) -> None:
    """``out[to] += rows`` where ``to`` is sorted."""
    if len(to):
        first = np.flatnonzero(np.r_[True, to[1:] != to[:-1]])
        out[to[first]] += np.add.reduceat(rows, first, axis=0)


def vector_table(ids: np.ndarray, rows: np.ndarray, id_col: str, vec_col: str) -> pa.Table:
    n, width = rows.shape
    lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * width, pa.int32()), pa.array(rows.ravel(), pa.float64()))
    return pa.table({id_col: pa.array(ids, pa.int64()), vec_col: lists})


# ---------------------------------------------------------------- on tables
PACKED = "_a int, _b int, node binary, at binary, w binary, dst binary, n binary"


def pack_edges(norm_edges: DataFrame, cells: Cells) -> DataFrame:
    """(dst, src, w) edges as one row a cell (PACKED), for tables that are propagated over again and again: the sources' ids in
    order, for every edge which of them it comes from and its weight, the receivers' ids in order and how many edges each has.
    They are stored as bytes, which nothing between the file and numpy takes apart."""
    def run(t: pa.Table) -> pa.Table:
        order = np.lexsort((column(t, "src"), column(t, "dst")))
        node, at = np.unique(column(t, "src")[order], return_inverse=True)
        dst, n = np.unique(column(t, "dst")[order], return_counts=True)
        parts = {"node": node, "at": at.astype(np.int32), "w": column(t, "w")[order].astype(np.float64, copy=False), "dst": dst, "n": n.astype(np.int32)}
        return pa.table({"_a": t["_a"][:1].cast(pa.int32()), "_b": t["_b"][:1].cast(pa.int32()),
                         **{c: pa.array([x.tobytes()], pa.binary()) for c, x in parts.items()}})

    return _dealt_edges(norm_edges, cells).groupBy("_a", "_b").applyInArrow(run, PACKED)


def _unpacked(left: pa.Table) -> list[np.ndarray]:
    """node, at, w, dst and n of a cell; empty if it has no edges."""
    kinds = (("node", np.int64), ("at", np.int32), ("w", np.float64), ("dst", np.int64), ("n", np.int32))
    return [np.frombuffer(left[c][0].as_buffer(), kind) if left.num_rows else np.zeros(0, kind) for c, kind in kinds]


def _dealt_edges(norm_edges: DataFrame, cells: Cells) -> DataFrame:
    return norm_edges.where("dst is not null and src is not null").select("dst", "src", "w", block("src", cells.a).alias("_a"), block("dst", cells.b).alias("_b"))


def weighted_sums(edges: DataFrame, h: DataFrame, cells: Cells, *, id_col: str = "id", vec_col: str = "h") -> DataFrame:
    """(id, sum over its edges (dst, src, w) of ``w`` times the source's vector), for every node that receives any. ``edges`` may be
    packed (:func:`pack_edges`) for the same cells."""
    packed = "_a" in edges.columns

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        ids, x = matrix(right, id_col, vec_col)
        if packed:
            node, at, w, to, n = _unpacked(left)
            at, where = places(ids, node)[at], np.repeat(np.arange(len(to)), n)
        else:
            dst, src, w = (column(left, c) for c in ("dst", "src", "w"))
            order = np.argsort(dst, kind="stable")
            to, where = np.unique(dst[order], return_inverse=True)
            at, w = places(ids, src[order]), w[order]
        known = at >= 0
        if not known.all():
            got, where = np.unique(where[known], return_inverse=True)
            to, at, w = to[got], at[known], w[known]
        out = np.zeros((len(to), x.shape[1]))
        step = max(1 << 10, SLICE * 4 // max(x.shape[1], 1))  # messages that exist at a time: a megabyte, as long as rows are short
        for s in range(0, len(at), step):
            part = slice(s, s + step)
            add_to(out, where[part], x[at[part]] * w[part, None])
        return vector_table(to, out, id_col, vec_col)

    left = edges if packed else _dealt_edges(edges, cells)
    right = h.select(F.col(id_col).cast("long").alias(id_col), F.col(vec_col).cast("array<double>").alias(vec_col), block(id_col, cells.a).alias("_a"), all_blocks(cells.b).alias("_b"))
    part = left.groupBy("_a", "_b").cogroup(right.groupBy("_a", "_b")).applyInArrow(run, f"{id_col} long, {vec_col} array<double>")
    return part if cells.a == 1 else add_up(part, cells, id_col, vec_col)


def add_up(parts: DataFrame, cells: Cells, id_col: str, vec_col: str, groups: int | None = None) -> DataFrame:
    """Sums of the cells' vectors, one row a node: (id, vec). Rows of a null id are left out."""
    groups = groups or max(cells.b, cells.a * cells.a)  # some STATE_ROWS rows a group

    def run(t: pa.Table) -> pa.Table:
        ids, x = matrix(t, id_col, vec_col)
        return vector_table(ids, x, id_col, vec_col)

    out = parts.select(id_col, vec_col, F.pmod(F.xxhash64(id_col, F.lit("sum")), F.lit(groups)).cast("int").alias("_g"))
    return out.groupBy("_g").applyInArrow(run, f"{id_col} long, {vec_col} array<double>")


def over_links(links: DataFrame, h: DataFrame, cells: Cells, fn, schema: str, *, id_col: str = "id", vec_col: str = "h",
               extra: str | None = None) -> DataFrame:
    """``fn(source, target, label, a, b)`` per cell of links (source, target, label; one ``extra`` column comes last); ``a`` and ``b`` are (ids, their vectors, where each
    link's end stands among them) of the cell's two blocks. A link end without a vector is an error."""
    more = [extra] if extra else []
    left = links.select("source", "target", F.col("label").cast("double").alias("label"), *more, block("source", cells.a).alias("_a"), block("target", cells.b).alias("_b"))
    copies = lambda side, n, cell: F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: F.struct(F.lit(side).alias("_side"), *cell(k)))
    at = lambda x, y: (x.alias("_a"), y.alias("_b"))
    right = (h.select(F.col(id_col).cast("long").alias("_id"), F.col(vec_col).cast("array<double>").alias("_v"))
             .withColumn("_c", F.explode(F.concat(copies("a", cells.b, lambda k: at(block("_id", cells.a), k)),
                                                  copies("b", cells.a, lambda k: at(k, block("_id", cells.b))))))
             .select("_id", "_v", "_c.*"))
    empty = pa.schema(_arrow(schema)).empty_table()

    def run(l: pa.Table, r: pa.Table) -> pa.Table:  # noqa: E741
        if not l.num_rows:
            return empty
        sides = []
        for side, end in (("a", "source"), ("b", "target")):
            ids, x = matrix(r.filter(pc.equal(r["_side"], side)), "_id", "_v")
            if l[end].null_count:
                raise ValueError("link end without a vector: null")
            at = places(ids, column(l, end))
            if (at < 0).any():
                raise ValueError(f"link end without a vector: {column(l, end)[at < 0][0]}")
            sides.append((ids, x, at))
        return fn(column(l, "source"), column(l, "target"), column(l, "label"), *sides, *(column(l, c) for c in more))

    return left.groupBy("_a", "_b").cogroup(right.groupBy("_a", "_b")).applyInArrow(run, schema)


def towards_ends(a, b, slopes, n_links: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids, vectors): what ``slopes(xa, xb, part)``, the slopes at both ends' vectors of a slice of links, sends to each end."""
    ids, out = [], []
    sums = [np.zeros_like(side[1]) for side in (a, b)]
    for s in range(0, n_links, SLICE):
        part = slice(s, s + SLICE)
        for total, (_ids, _x, at), d in zip(sums, (a, b), slopes(a[1][a[2][part]], b[1][b[2][part]], part)):
            order = np.argsort(at[part], kind="stable")
            add_to(total, at[part][order], d[order])
    for total, (key, _x, at) in zip(sums, (a, b)):
        touched = np.unique(at)
        ids.append(key[touched])
        out.append(total[touched])
    return np.concatenate(ids), np.concatenate(out)


def _ends(r: pa.Table, side: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of one side of a cell: sorted ids (they may repeat), their vectors as columns (shorter ones end in zeros), the length of
    each (-1: no vector), and norms. Sums go from the first component to the last, as in ``functions.vector``."""
    r = r.filter(pc.equal(r["_side"], side))
    ids = column(r, "_id")
    order = np.argsort(ids, kind="stable")
    vec = r["_v"].combine_chunks().take(pa.array(order))
    size = pc.fill_null(pc.list_value_length(vec), -1).to_numpy(zero_copy_only=False)
    full = np.maximum(size, 0)
    x = np.zeros((int(full.max(initial=0)), len(ids)))
    row = np.repeat(np.arange(len(ids)), full)
    x[np.arange(len(row)) - np.repeat(np.cumsum(full) - full, full), row] = vec.flatten().to_numpy(zero_copy_only=False)
    norm = np.zeros(len(ids))
    for c in x:
        norm += c * c
    return ids[order], x, size, np.sqrt(norm)


def _cosine_cell(l: pa.Table, r: pa.Table) -> pa.Table:  # noqa: E741
    (ids_a, x, size_a, norm_a), (ids_b, y, size_b, norm_b) = _ends(r, "a"), _ends(r, "b")
    first_a, first_b = (np.searchsorted(ids, column(l, end)) for ids, end in ((ids_a, "source"), (ids_b, "target")))
    n_a, n_b = (np.searchsorted(ids, column(l, end), "right") - first for ids, end, first in (
        (ids_a, "source", first_a), (ids_b, "target", first_b)))
    out = [pa.nulls(0, pa.float64())]
    times = n_a * n_b  # a link stands as often as its ends' vectors do
    link = np.repeat(np.arange(len(times)), times)
    nth = np.arange(len(link)) - np.repeat(np.cumsum(times) - times, times)
    for s in range(0, len(link), SLICE):
        at, k = link[s:s + SLICE], nth[s:s + SLICE]
        a, b = first_a[at] + k // n_b[at], first_b[at] + k % n_b[at]
        product = np.zeros(len(at))
        for u, v in zip(x, y):
            product += u[a] * v[b]
        norms = norm_a[a] * norm_b[b]
        known = (size_a[a] >= 0) & (size_a[a] == size_b[b]) & (norms != 0)
        out.append(pa.array(np.divide(product, norms, out=np.zeros(len(at)), where=known), mask=~known))
    take = pa.array(link)
    return pa.table({"source": l["source"].take(take), "target": l["target"].take(take), "label": l["label"].take(take),
                     "cosine": pa.chunked_array(out)})


def link_cosines(links: DataFrame, vectors: DataFrame, *, id_col: str = "id", vec_col: str = "embedding") -> DataFrame:
    """(source, target, label, cosine of both ends' vectors) of the links (source, target, label) whose ends have a vector row; null where
    an end has a zero vector, none, one of missing components or of another length. What repeats, repeats in the result.

    No link is shuffled with a vector: a cell gets the vector of a source once, if it has links of it, and those of its block of
    targets. Both tables should be stored.
    """
    n, m = vectors.count(), links.count()
    cells = max(math.ceil(m / CELL_EDGES), links.sparkSession.sparkContext.defaultParallelism)
    b = max(math.ceil(n / STATE_ROWS), math.ceil(math.sqrt(cells)))  # copies of a source; a target has ``a`` of them
    a = math.ceil(cells / b)
    left = (links.where("source is not null and target is not null").select("source", "target", F.col("label").cast("int").alias("label"))
            .withColumn("_a", block("source", a)).withColumn("_b", block("target", b)))
    whole = F.when(~F.exists(vec_col, lambda x: x.isNull()), F.col(vec_col))
    v = vectors.select(F.col(id_col).cast("long").alias("_id"), whole.alias("_v")).where("_id is not null")
    used = left.select(F.col("source").alias("_id"), "_a", "_b").distinct()
    at = lambda side, a, b: (F.lit(side).alias("_side"), F.col("_id"), F.col("_v"), a.alias("_a"), b.alias("_b"))
    right = (v.join(used, "_id").select(*at("a", F.col("_a"), F.col("_b")))
             .unionByName(v.withColumn("_k", all_blocks(a)).select(*at("b", F.col("_k"), block("_id", b)))))
    return left.groupBy("_a", "_b").cogroup(right.groupBy("_a", "_b")).applyInArrow(
        _cosine_cell, "source long, target long, label int, cosine double")


_TYPES = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "array<double>": pa.list_(pa.float64()),
          "array<long>": pa.list_(pa.int64())}


def _arrow(schema: str) -> list:
    return [(n, _TYPES[t]) for n, t in (c.strip().split(" ") for c in schema.split(","))]
