"""Packing of documents into sequences of bounded length, by bin completion over the histogram of lengths.

Documents of one length are alike to the packing, so it is decided on the number of pieces of every length: at most
``capacity`` numbers, whatever the size of the corpus. A filling (a multiset of lengths) is used as many times as the
numbers allow. Best-fit decreasing over the histogram gives the first incumbent. Where it does not
meet the lower bound, branch and bound looks for fewer sequences: it takes the largest length left,
enumerates the undominated fillings of the space beside it by rising waste, prunes by the waste that an
improvement can still afford and by the lower bound of the rest, and completes nodes best-fit for new incumbents.

Spark does the work on the documents: tokenising, the histogram, numbering the pieces within their length (hot
lengths in buckets of bounded size), and looking up each piece's place. What is broadcast are the
fillings: best-fit decreasing opens at most three for each length, the search one at each node, and one holds at most
sqrt(2 * capacity) lengths, so their size is bounded by the capacity and does not grow with the documents.
"""

from __future__ import annotations

import math
import zlib
from bisect import bisect_left, insort
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from citegraph.llm.byte_bpe import ByteBpe
from citegraph.llm.common import Stored, per_batch

CAPACITY = 2048
#: Nodes of the search, and fillings tried at each (the problem is NP-hard; the incumbent stands when they are used up).
NODES, WIDTH = 4000, 12
#: A node this often on the way down, and all with fewer lengths left, are completed best-fit.
COMPLETE = 16
#: Pieces of one length that one task numbers, on average.
BUCKET = 1 << 16

Filling = tuple[tuple[int, int], ...]


# ---------------------------------------------------------------- lengths
def lower_bound(counts: dict[int, int], capacity: int) -> int:
    """No packing has fewer sequences: all space filled, or, for some k, pieces that leave less than k alone, those above
    the half apart from each other, and the ones from k on in the space that these leave."""
    n = np.zeros(capacity + 1, np.int64)
    for s, c in counts.items():
        n[s] = c
    total = np.concatenate([[0], np.cumsum(n * np.arange(capacity + 1))])  # below s
    number = np.concatenate([[0], np.cumsum(n)])
    half = capacity // 2 + 1
    k = np.arange(0, capacity // 2 + 1)
    alone = number[-1] - number[capacity - k + 1]
    apart, apart_sum = number[capacity - k + 1] - number[half], total[capacity - k + 1] - total[half]
    rest = total[half] - total[k] - (apart * capacity - apart_sum)
    return int(max(-(-total[-1] // capacity), (alone + apart + np.maximum(0, -(-rest // capacity))).max()))


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[Filling, int]]:
    """Best-fit decreasing, alike bins together: (filling, times)."""
    open_: dict[int, list[tuple[Filling, int]]] = {}
    spaces: list[int] = []  # of the open bins, ascending

    def put(space: int, filling: Filling, times: int) -> None:
        if space not in open_:
            open_[space] = []
            insort(spaces, space)
        open_[space].append((filling, times))

    for s in sorted(counts, reverse=True):
        n = counts[s]
        while n:
            at = bisect_left(spaces, s)  # the tightest bins that can take it
            if at < len(spaces):
                space = spaces[at]
                filling, m = open_[space].pop()
                if not open_[space]:
                    del open_[space], spaces[at]
            else:
                space, filling, m = capacity, (), math.inf
            k = space // s
            whole = int(min(m, n // k))
            if whole:
                put(space - k * s, filling + ((s, k),), whole)
                n, m = n - whole * k, m - whole
            if n and m:
                put(space - n * s, filling + ((s, n),), 1)
                n, m = 0, m - 1
            if m and m != math.inf:
                put(space, filling, int(m))
    return [x for group in open_.values() for x in group]


def _spread(bits: int, most: int) -> int:
    """Bits 1 to ``most`` places above those set."""
    out, width = bits << 1, 1
    while width < most:
        step = min(width, most - width)
        out |= out << step
        width += step
    return out if most else 0


def _dominated(filling: Filling, waste: int, counts: dict[int, int], have: int) -> bool:
    """Another length can stand for some of these: it fills the space better, or leaves several shorter pieces for it."""
    sums, several, spare = 1, 0, have
    for s, k in filling:
        if counts[s] == k:
            spare &= ~(1 << s)
        for _ in range(k):
            several |= several << s | (sums & ~1) << s
            sums |= sums << s
    return bool((_spread(sums & ~1, waste) | several) & spare)


def fillings(space: int, counts: dict[int, int], most_waste: int):
    """Undominated (filling, waste) of the space by rising waste; ``counts`` are the pieces left."""
    sizes = sorted((s for s, c in counts.items() if c and s <= space), reverse=True)
    have, mask = sum(1 << s for s in sizes), (1 << (space + 1)) - 1
    reach = 1  # sums of any number of these lengths
    for s in reversed(sizes):
        if reach >> s == mask >> s:
            break  # longer ones add nothing
        step = s
        while step <= space:
            reach |= (reach << step) & mask
            step *= 2

    def cuts(left: int, first: int):
        if not left:
            yield ()
        for i in range(first, len(sizes)):
            s = sizes[i]
            for k in range(min(counts[s], left // s), 0, -1):
                if reach >> (left - k * s) & 1:
                    for more in cuts(left - k * s, i + 1):
                        yield ((s, k), *more)

    if have >> space & 1:  # one piece that fills it dominates all else
        yield ((space, 1),), 0
        return
    for waste in range(min(most_waste, space) + 1):
        if reach >> (space - waste) & 1:
            for filling in cuts(space - waste, 0):
                if not _dominated(filling, waste, counts, have):
                    yield filling, waste


def bin_completion(counts: dict[int, int], capacity: int = CAPACITY, nodes: int = NODES, width: int = WIDTH) -> list[tuple[Filling, int]]:
    """(filling, times) of as few sequences as the search finds; never more than best-fit decreasing. A filling is
    ((length, how many), ...) and every piece stands in one."""
    counts = {s: c for s, c in counts.items() if c}
    number = lambda plan: sum(m for _, m in plan)
    best = best_fit(counts, capacity)
    least, total = lower_bound(counts, capacity), sum(s * c for s, c in counts.items())
    path: list[tuple[Filling, int]] = []  # fillings taken so far
    open_nodes: list[tuple] = []  # (pieces left, sequences used, waste, fillings to try)

    def enter(rest: dict[int, int], used: int, waste: int) -> None:
        nonlocal best
        if not len(open_nodes) % COMPLETE or len(rest) < COMPLETE:
            whole = best_fit(rest, capacity)
            if used + number(whole) < number(best):
                best = path + whole
        if rest and used + lower_bound(rest, capacity) < number(best):
            top = max(rest)
            afford = (number(best) - 1) * capacity - total - waste
            tries = fillings(capacity - top, {**rest, top: rest[top] - 1}, afford)
            open_nodes.append((rest, used, waste, islice(tries, width)))
        elif path:
            path.pop()

    enter(counts, 0, 0)
    while open_nodes and nodes > 0 and number(best) > least:
        rest, used, waste, tries = open_nodes[-1]
        top, spare = max(rest), (number(best) - 1) * capacity - total - waste  # what an improvement can still waste
        filling, lost = next(tries, (None, 0))
        if filling is None or lost > spare:
            open_nodes.pop()
            if path:
                path.pop()
            continue
        nodes -= 1
        need = dict(filling)
        need[top] = need.get(top, 0) + 1
        times = min(rest[s] // k for s, k in need.items())
        if lost:
            times = min(times, spare // lost)
        after = {s: c - times * need.get(s, 0) for s, c in rest.items()}
        path.append((tuple(sorted(need.items(), reverse=True)), times))
        enter({s: c for s, c in after.items() if c}, used + times, waste + times * lost)
    return best


class Places:
    """Place of the r-th piece of a length: sorted intervals of ranks, one for each filling and length."""

    def __init__(self, plan: list[tuple[Filling, int]]):
        rows, given, base = [], {}, 0
        for filling, times in plan:
            offset = 0
            for s, k in filling:
                rows.append((s, given.get(s, 0), k, base, offset))
                given[s] = given.get(s, 0) + times * k
                offset += s * k
            base += times
        rows.sort()
        self.length, self.start, self.each, self.base, self.offset = np.array(rows, np.int64).reshape(-1, 5).T.copy()
        self.key = (self.length << 44) + self.start

    def find(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(sequence, offset) of pieces by length and rank."""
        at = np.searchsorted(self.key, (length << 44) + rank, "right") - 1
        copy, slot = np.divmod(rank - self.start[at], self.each[at])
        return self.base[at] + copy, self.offset[at] + slot * length


# ---------------------------------------------------------------- documents
PIECES = "id long, piece int, start long, length long, ids_crc32 long"


def _cutter(bc, capacity: int, end_id: int, keep_ids: bool):
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        tokenizer = bc.value
        cols: list[list] = [[], [], [], [], [], []]
        for i, text in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist()):
            ids = np.append(tokenizer.encode(text, special=True) if text else np.empty(0, "<u4"), end_id).astype("<u4")
            ends = range(len(ids) % capacity or capacity, len(ids) + 1, capacity)
            start = 0
            for piece, end in enumerate(ends):
                part = ids[start:end]
                for col, x in zip(cols, (i, piece, start, end - start, zlib.crc32(part.tobytes()), part if keep_ids else None)):
                    col.append(x)
                start = end
        out = {"id": pa.array(cols[0], pa.int64()), "piece": pa.array(cols[1], pa.int32())}
        out |= {n: pa.array(c, pa.int64()) for n, c in zip(("start", "length", "ids_crc32"), cols[2:])}
        if keep_ids:
            out["ids"] = pa.array(cols[5], pa.list_(pa.int32()))
        return pa.RecordBatch.from_pydict(out)

    return per_batch(run, 256)


def token_pieces(docs: DataFrame, tokenizer: ByteBpe, capacity: int = CAPACITY, end_id: int = 0, id_col: str = "doc_id",
                 text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """``id, piece, start, length, ids_crc32`` (and ``ids``): every document's ids and ``end_id`` after them, in pieces of
    ``capacity`` tokens, of which the first may be shorter. A null or empty text is the one token ``end_id``. ``ids_crc32`` is
    taken over little-endian 32-bit ids. Strings of special tokens are those tokens. Repeated rows each give their pieces; a
    null id stays null; other columns are not read."""
    bc = docs.sparkSession.sparkContext.broadcast(tokenizer)
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(
        _cutter(bc, capacity, end_id, keep_ids), PIECES + ", ids array<int>" * keep_ids)


def _placer(bc):
    def run(batches):
        for batch in batches:
            number = lambda c: batch.column(c).to_numpy(zero_copy_only=False)
            sequence, offset = bc.value.find(number("length"), number("rank"))
            keep = [c for c in batch.schema.names if c != "rank"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(sequence), pa.array(offset)],
                                             names=[*keep, "sequence_id", "offset"])

    return run


def place(pieces: DataFrame, capacity: int = CAPACITY, nodes: int = NODES, width: int = WIDTH) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``: sequences hold at most ``capacity`` tokens without gaps, and each piece
    stands in one. ``pieces`` has a long ``length`` from 1 to ``capacity``; other columns stay. An empty table stays empty."""
    columns = pieces.columns
    store = Stored(pieces.sparkSession)
    clash = set(columns)
    if clash & {"sequence_id", "offset", "rank"}:
        raise ValueError("pieces have no columns sequence_id, offset or rank")
    rid = next(n for n in ("rid" + "_" * k for k in range(len(columns) + 1)) if n not in clash)
    rows = store.put(pieces.withColumn(rid, F.monotonically_increasing_id()), "pieces")
    counts = {r.length: r.n for r in rows.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most ``capacity`` rows
    if any(s is None or not 0 < s <= capacity for s in counts):
        raise ValueError("lengths must be from 1 to the capacity")
    bc = rows.sparkSession.sparkContext.broadcast(Places(bin_completion(counts, capacity, nodes, width)))
    hot = {int(s): math.ceil(c / BUCKET) for s, c in counts.items() if c > BUCKET}
    if hot:
        bucket = rid + "bucket"
        buckets = F.create_map(*(F.lit(x) for pair in hot.items() for x in pair))
        many = F.coalesce(F.element_at(buckets, F.col("length")), F.lit(1))
        rows = rows.withColumn(bucket, F.pmod(F.xxhash64(rid), many))
        before = Window.partitionBy("length").orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
        starts = (rows.where(F.col("length").isin(list(hot))).groupBy("length", bucket).agg(F.count("*").alias(rid + "n"))
                  .select("length", bucket, F.coalesce(F.sum(rid + "n").over(before), F.lit(0)).alias(rid + "first")))
        rank = F.row_number().over(Window.partitionBy("length", bucket).orderBy(rid)) - 1
        rows = rows.withColumn("rank", rank.cast("long")).join(starts, ["length", bucket], "left").select(
            *columns, (F.col("rank") + F.coalesce(rid + "first", F.lit(0))).alias("rank"))
    else:
        rank = F.row_number().over(Window.partitionBy("length").orderBy(rid)) - 1
        rows = rows.select(*columns, rank.cast("long").alias("rank"))
    schema = rows.select(*columns, F.lit(0).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset")).schema
    return rows.mapInArrow(_placer(bc), schema)


def sequences(placed: DataFrame) -> DataFrame:
    """``sequence_id, length, ids`` of placed pieces that carry their ``ids``."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))  # at most the capacity of one sequence
    return placed.groupBy("sequence_id").agg(F.sum("length").alias("length"),
                                             F.flatten(F.transform(parts, lambda x: x["ids"])).alias("ids"))
