"""Hard negatives by exact integer inner products, several candidates to a multiplication.

Components are scaled and rounded down to integers. Shifted by their minimum they are not negative, so the components
that several candidates have at one position fit side by side into separate fields of one wide integer (Kronecker
packing). A multiplication by an anchor's component and a sum over the positions then give all of these
candidates' products at once; a field is as wide as the largest sum possible, so none runs over, and the shifts are taken
off after unpacking. Words of up to 53 bits are multiplied as whole numbers in doubles, where every product and
partial sum is exact (two fields of 26 bits for components of 9 bits at 64 positions); wider fields go into Python
integers of any length.

Anchors and rows meet in cells of (block of anchors, block of rows), both of bounded size, so no pair becomes a row
of a table: a cell gives at most ``k`` rows for each anchor (positives) or for each anchor and positive (negatives),
and a window over these picks the first ones of all cells.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citegraph.llm.common import Stored

#: Rows of a cell, on average.
ANCHORS, ROWS = 4096, 65536
#: Anchors scored together, candidates in the first and the largest slice.
GROUP, FIRST, LARGEST = 256, 512, 8192
MANTISSA = 53
#: Candidates in one integer where their fields do not fit a double.
WIDE = 64
NEVER = np.iinfo(np.int64).max


class Packed:
    """Rows of integers, packed for products with anchors between ``low`` and ``high``."""

    def __init__(self, rows: np.ndarray, low: int, high: int):
        self.n, self.low = len(rows), low
        dims = rows.shape[1]
        self.shift = int(rows.min(initial=0))
        top = int(rows.max(initial=0)) - self.shift
        self.width = max(1, (dims * (high - low) * top).bit_length())
        largest = max(abs(low), abs(high), 1) * max(abs(self.shift), abs(top + self.shift), 1) * max(dims, 1)
        self.exact = self.width <= MANTISSA and largest < 1 << 60
        self.fields = MANTISSA // self.width if self.exact else WIDE
        kind = np.int64 if self.exact else object
        moved = rows.astype(kind) - self.shift
        self.sums = moved.sum(1)
        pad = -self.n % self.fields
        moved = np.concatenate([moved, np.zeros((pad, dims), kind)]).reshape(self.fields, -1, dims)  # field, word, position
        words = sum((moved[i] << (self.width * i) if self.exact else moved[i] * (1 << self.width * i) for i in range(self.fields)))
        self.words = (words.astype(np.float64) if self.exact else words).T

    def scores(self, anchors: np.ndarray) -> np.ndarray:
        """Inner products of all rows with every anchor."""
        dims = anchors.shape[1]
        moved = anchors.astype(np.int64 if self.exact else object) - self.low
        words = moved.astype(self.words.dtype) @ self.words
        if self.exact:
            words = words.astype(np.int64)
        mask = (1 << self.width) - 1
        fields = np.concatenate([(words >> (self.width * i)) & mask for i in range(self.fields)], axis=1)[:, :self.n]
        out = fields + (moved.sum(1) * self.shift)[:, None] + (self.sums * self.low)[None, :] + dims * self.low * self.shift
        if not self.exact:
            if out.size and max(out.max(), -out.min()) > NEVER:
                raise OverflowError("inner products beyond a long")
            out = out.astype(np.int64)
        return out


class Best:
    """The first ``k`` candidates of every (slot, anchor) with a score from ``low`` to ``high``, highest score first.
    Candidates are added in ascending order of id, so that on ties the earlier one stays."""

    def __init__(self, low: np.ndarray, high: np.ndarray, k: int):
        self.high, self.k, self.floor = high, k, low.copy()
        self.ask = self.score = self.at = np.empty(0, np.int64)

    def add(self, scores: np.ndarray, allowed: np.ndarray, start: int) -> None:
        anchors = scores.shape[0]
        r, c = np.nonzero(allowed & (scores >= self.floor.min(0)[:, None]))
        if not len(r):
            return
        s = scores[r, c]
        ask, score, at = [self.ask], [self.score], [self.at]
        for slot in range(len(self.high)):
            ok = (s >= self.floor[slot][r]) & (s <= self.high[slot][r])
            ask.append(slot * anchors + r[ok])
            score.append(s[ok])
            at.append(start + c[ok])
        ask, score, at = np.concatenate(ask), np.concatenate(score), np.concatenate(at)
        order = np.lexsort((at, -score, ask))
        ask, score, at = ask[order], score[order], at[order]
        rank = np.arange(len(ask)) - np.searchsorted(ask, ask)
        keep = rank < self.k
        self.ask, self.score, self.at = ask[keep], score[keep], at[keep]
        full = rank[keep] == self.k - 1
        self.floor.reshape(-1)[self.ask[full]] = self.score[full] + 1


def _matrix(col: pa.ChunkedArray) -> np.ndarray:
    """Rows of a list column; a missing component at the end counts as 0."""
    col = col.combine_chunks()
    col = col.chunk(0) if isinstance(col, pa.ChunkedArray) else col
    flat, size = col.flatten().to_numpy(zero_copy_only=False), np.diff(col.offsets.to_numpy())
    dims = int(size.max(initial=1))
    if (size == dims).all():
        return flat.reshape(len(size), dims)
    out = np.zeros((len(size), dims), np.int64)
    out[np.arange(dims) < size[:, None]] = flat
    return out


def _wide(rows: np.ndarray, dims: int) -> np.ndarray:
    return np.pad(rows, ((0, 0), (0, dims - rows.shape[1])))


def _search(anchors: np.ndarray, rows: np.ndarray, low: np.ndarray, high: np.ndarray, k: int, allowed):
    """(slot, anchor, row, score) of the first ``k`` allowed rows of every slot; rows come in ascending order of id."""
    out = []
    if len(anchors) and len(rows):
        packed, start, size = [], 0, FIRST
        bounds = int(anchors.min()), int(anchors.max())
        while start < len(rows):
            packed.append((start, Packed(rows[start:start + size], *bounds)))
            start, size = start + size, min(2 * size, LARGEST)
        for g in range(0, len(anchors), GROUP):
            part = slice(g, g + GROUP)
            best = Best(low[:, part], high[:, part], k)
            for start, block in packed:
                best.add(block.scores(anchors[part]), allowed(part, slice(start, start + block.n)), start)
            n = min(GROUP, len(anchors) - g)
            out.append((best.ask // n, g + best.ask % n, best.at, best.score))
    return [np.concatenate(x) for x in zip(*out)] if out else [np.empty(0, np.int64)] * 4


def _cell(k: int, same_label: bool):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        anchors, rows = _matrix(left["v"]), _matrix(right["v"])
        dims = max(anchors.shape[1], rows.shape[1])
        anchors, rows = _wide(anchors, dims), _wide(rows, dims)
        ids, rid = right["id"].to_numpy(), right["rid"].to_numpy()
        a_rid = left["rid"].to_numpy()
        order = np.lexsort((rid, ids))
        rows, ids, rid = rows[order], ids[order], rid[order]
        labels = pa.concat_arrays([x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x
                                   for x in (left["label"], right["label"])]).dictionary_encode().indices.to_numpy()
        a_label, r_label = labels[:len(a_rid)], labels[len(a_rid):][order]
        if same_label:
            found = []
            for y in np.unique(a_label):
                a, r = np.flatnonzero(a_label == y), np.flatnonzero(r_label == y)
                least = np.full((1, len(a)), -NEVER)
                got = _search(anchors[a], rows[r], least, np.full((1, len(a)), NEVER), k,
                              lambda i, j, a=a, r=r: rid[r[j]] != a_rid[a[i]][:, None])
                found.append((got[0], a[got[1]], r[got[2]], got[3]))
            slot, anchor, at, score = (np.concatenate(x) for x in zip(*found)) if found else [np.empty(0, np.int64)] * 4
        else:
            low, high = _matrix(left["low"]).T, _matrix(left["high"]).T
            count = np.diff(left["low"].combine_chunks().offsets.to_numpy())
            low = np.where(np.arange(len(low))[:, None] < count, low, NEVER)
            slot, anchor, at, score = _search(anchors, rows, low, high, k, lambda i, j: r_label[j] != a_label[i][:, None])
        return pa.table({"anchor": a_rid[anchor], "slot": slot.astype(np.int32), "id": ids[at], "rid": rid[at], "score": score})

    return run


FOUND = "anchor long, slot int, id long, rid long, score long"


def _first(anchors: DataFrame, rows: DataFrame, n_anchors: int, n_rows: int, k: int, same_label: bool) -> DataFrame:
    """FOUND rows with their ``rank``: the first ``k`` of every (anchor, slot) over all cells."""
    cores = anchors.sparkSession.sparkContext.defaultParallelism
    ba = max(1, math.ceil(n_anchors / ANCHORS))
    bd = max(1, math.ceil(n_rows / ROWS), min(math.ceil(2 * cores / ba), math.ceil(n_rows / 2048)))
    block = lambda n: F.pmod(F.xxhash64("rid"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = anchors.withColumn("ba", block(ba)).withColumn("bd", every(bd))
    right = rows.select("rid", "id", "label", "v").withColumn("bd", block(bd)).withColumn("ba", every(ba))
    found = left.groupBy("ba", "bd").cogroup(right.groupBy("ba", "bd")).applyInArrow(_cell(k, same_label), FOUND)
    order = Window.partitionBy("anchor", "slot").orderBy(F.desc("score"), "id", "rid")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def mine_hard_negatives(vectors: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 10, low: int = 30,
                        high: int = 90, scale: int = 256, id_col: str = "vec_id", label_col: str = "label",
                        vec_col: str = "embedding") -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score`` for the rows where ``is_anchor`` holds.

    A score is the inner product of two rows' components, each ``floor(scale * x)``. An anchor's positives are the first
    ``positives`` other rows with its label, highest score first, then smallest id. The negatives of an anchor and a
    positive are the first ``negatives`` rows of other labels with ``low`` to ``high`` percent of the positive's score.

    Rows with a null id, label or vector, or with a null or non-finite component, take no part. Every other row counts
    for itself, also where ids or whole rows repeat (a copy of an anchor is another row, and an anchor too). Vectors of
    unequal length are compared as if the shorter ones went on with zeros. Scores beyond a long are an error. An empty
    table, no anchors or a label of one row give no rows. Columns other than these three are read only by ``is_anchor``.
    """
    store = Stored(vectors.sparkSession)
    scaled = lambda x: F.lit(float(scale)) * x.cast("double")
    fits = lambda x: F.when(F.abs(scaled(x)) < 2.0 ** 63, F.floor(scaled(x))).otherwise(
        F.raise_error(F.lit("component beyond a long")).cast("long"))
    finite = lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf"))
    usable = F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & F.col(vec_col).isNotNull()
    rows = store.put(vectors.where(usable & F.forall(vec_col, finite)).select(
        F.monotonically_increasing_id().alias("rid"), F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label"),
        F.coalesce(is_anchor, F.lit(False)).alias("is_anchor"), F.transform(vec_col, fits).alias("v")), "rows")
    n_rows, n_anchors = rows.agg(F.count("*"), F.count_if("is_anchor")).first()
    anchors = rows.where("is_anchor").drop("is_anchor")
    one = F.struct("rank", F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    near = (_first(anchors, rows, n_anchors, n_rows, positives, True)
            .groupBy("anchor").agg(F.array_sort(F.collect_list(one)).alias("near")))  # at most ``positives`` of them
    asked = store.put(anchors.join(near.withColumnRenamed("anchor", "rid"), "rid"), "asked")
    part = lambda x, percent: x["positive_score"].cast("decimal(19,0)") * F.lit(percent) / F.lit(100)
    asks = asked.select("rid", "label", "v", F.transform("near", lambda x: F.ceil(part(x, low)).cast("long")).alias("low"),
                        F.transform("near", lambda x: F.floor(part(x, high)).cast("long")).alias("high"))
    found = _first(asks, rows, n_anchors, n_rows, negatives, False)
    names = asked.select(F.col("rid").alias("anchor"), F.col("id").alias("anchor_id"), "near")
    return (found.withColumnRenamed("id", "negative_id").withColumnRenamed("score", "negative_score").join(names, "anchor")
            .withColumn("p", F.get("near", F.col("slot")))
            .select("anchor_id", "p.positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "p.positive_score",
                    "negative_score"))
