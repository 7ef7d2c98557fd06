"""Alignment of two tokenizers' tokens over the same bytes, with corpus-wide counts of the linked ids.

A document's tokens end at cumulative byte offsets. The ends of one id list are searched in those of the other; the
ends that both have slice the two lists into groups, and the links of a group are expanded from its two slices.

A link's weight is the number of documents that hold its id pair. Documents are aligned in slices of bounded size. A slice
gives its distinct id pairs once, with the number of its documents that hold each, so that what is shuffled to
count the pairs over the corpus, and what is joined back, is the vocabulary of slices and not every link. A
document's links are kept as positions in its slice's pairs.
"""

from __future__ import annotations

import hashlib
import uuid
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citegraph.llm.byte_bpe import ByteBpe
from citegraph.llm.common import Stored, per_batch

#: Rows and bytes of text in a slice.
SLICE_ROWS, SLICE_BYTES = 4096, 4 << 20
#: Links expanded at a time.
EXPANDED = 1 << 20


class ByteSide:
    """Byte-level BPE over a space and the text; strings of special tokens are plain text."""

    def __init__(self, path: str):
        self.bpe = ByteBpe.read(path)

    def token_bytes(self) -> list[bytes]:
        return self.bpe.token_bytes()

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return [self.bpe.encode(" " + t).astype(np.int64) for t in texts]


class PieceSide:
    """SentencePiece model that puts a space before the text itself; U+2581 stands for a space, <0xHH> for a byte."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.proto = f.read()

    def _processor(self):
        if getattr(self, "_loaded", None) is None:
            import sentencepiece

            self._loaded = sentencepiece.SentencePieceProcessor(model_proto=self.proto)
        return self._loaded

    def __getstate__(self):
        return {"proto": self.proto}

    def token_bytes(self) -> list[bytes]:
        p = self._processor()
        pieces = [p.id_to_piece(i) for i in range(p.get_piece_size())]
        return [bytes([int(w[3:5], 16)]) if p.is_byte(i) else w.replace("▁", " ").encode() for i, w in enumerate(pieces)]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(x, np.int64) for x in self._processor().encode(texts, num_threads=1)]


class Aligner:
    """Both sides' tables of a worker."""

    def __init__(self, a, b):
        self.a, self.b = a, b
        self.bytes_a, self.bytes_b = a.token_bytes(), b.token_bytes()
        self.size_a, self.size_b = (np.array(list(map(len, x)), np.int64) for x in (self.bytes_a, self.bytes_b))
        self.ids = max(len(self.bytes_a), len(self.bytes_b))
        self.names = [f"{i}{mark}" for mark in ",|;" for i in range(self.ids)]

    def groups(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index after the last token of every group, in both lists."""
        ends_a, ends_b = np.cumsum(self.size_a[a]), np.cumsum(self.size_b[b])
        at_b = np.searchsorted(ends_b, ends_a, "right")
        shared = at_b > 0
        shared[shared] = ends_b[at_b[shared] - 1] == ends_a[shared]
        shared[:-1] &= ends_a[1:] != ends_a[:-1]  # tokens without bytes end with the one before
        return np.flatnonzero(shared) + 1, at_b[shared]

    def same(self, a: np.ndarray, b: np.ndarray, text: str) -> bool:
        """Whether the tokens of both sides spell a space and the text."""
        whole = (" " + text).encode("utf-8", "surrogatepass")
        return (b"".join(map(self.bytes_a.__getitem__, a.tolist())) == whole
                and b"".join(map(self.bytes_b.__getitem__, b.tolist())) == whole)

    def written(self, a: np.ndarray, b: np.ndarray, end_a: np.ndarray, end_b: np.ndarray) -> str:
        """``a1,a2|b1;a3|b2,b3``: every id with the mark that follows it, in one gather."""
        if not len(end_a):
            return ""
        start_a, start_b = np.append(0, end_a[:-1]), np.append(0, end_b[:-1])
        name_a, name_b = a.copy(), b.copy()
        name_a[end_a - 1] += self.ids
        name_b[end_b - 1] += 2 * self.ids
        out = np.empty(len(a) + len(b), np.int64)
        out[np.arange(len(a)) + np.repeat(start_b, end_a - start_a)] = name_a
        out[np.arange(len(b)) + np.repeat(end_a, end_b - start_b)] = name_b
        return "".join(map(self.names.__getitem__, out.tolist()))[:-1]

    def links(self, a: np.ndarray, b: np.ndarray, end_a: np.ndarray, end_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct id pairs (as a * number of b ids + b) that share a group, and how many token pairs are such a link."""
        start_a, start_b = np.append(0, end_a[:-1]), np.append(0, end_b[:-1])
        na, nb = end_a - start_a, end_b - start_b
        size, base = na * nb, len(self.bytes_b)
        keys, times = [], []
        big = size > EXPANDED
        for g in np.flatnonzero(big).tolist():  # one long group: its distinct ids are multiplied out
            ua, ca = np.unique(a[start_a[g]:end_a[g]], return_counts=True)
            ub, cb = np.unique(b[start_b[g]:end_b[g]], return_counts=True)
            keys.append((ua[:, None] * base + ub).ravel())
            times.append((ca[:, None] * cb).ravel())
        left = np.flatnonzero(~big)
        part = np.cumsum(size[left]) // EXPANDED
        for k in np.unique(part).tolist():
            g = left[part == k]
            n = size[g]
            within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            width = np.repeat(nb[g], n)
            pairs = a[np.repeat(start_a[g], n) + within // width] * base + b[np.repeat(start_b[g], n) + within % width]
            u, c = np.unique(pairs, return_counts=True)
            keys.append(u)
            times.append(c)
        if len(keys) == 1:
            return keys[0], times[0]
        u, at = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.zeros(len(u), np.int64)
        np.add.at(total, at, np.concatenate(times))
        return u, total


ROWS = ("id long, n_a long, n_b long, n_groups long, n_links long, groups string, part long, codes array<int>, times array<long>, "
        "pairs array<long>, holders array<long>")
#: The aligner of this worker process, by key.
_ALIGNERS: dict[str, Aligner] = {}


def _lists(values: list, kind: pa.DataType) -> pa.Array:
    return pa.array(values, pa.list_(kind))


def _slice(x: Aligner, batch: pa.RecordBatch, part: int, digest: bool) -> pa.RecordBatch:
    texts = batch.column("text").to_pylist()
    rows = [i for i, t in enumerate(texts) if t]
    both = list(zip(rows, x.a.encode([texts[i] for i in rows]), x.b.encode([texts[i] for i in rows])))
    numbers = np.zeros((4, len(texts)), np.int64)
    groups, keys, times = [""] * len(texts), [np.empty(0, np.int64)] * len(texts), [np.empty(0, np.int64)] * len(texts)
    for i, a, b in both:
        if not x.same(a, b, texts[i]):
            continue
        end_a, end_b = x.groups(a, b)
        groups[i] = x.written(a, b, end_a, end_b)
        if digest:
            groups[i] = hashlib.sha256(groups[i].encode()).hexdigest()
        keys[i], times[i] = x.links(a, b, end_a, end_b)
        numbers[:, i] = len(a), len(b), len(end_a), times[i].sum()
    pairs, codes, holders = np.unique(np.concatenate([np.empty(0, np.int64), *keys]), return_inverse=True, return_counts=True)
    size = np.cumsum([0, *map(len, keys)])
    flat = lambda values, kind: pa.ListArray.from_arrays(pa.array(size, pa.int32()), pa.array(values, kind))
    first = lambda values: _lists([values] + [None] * (len(texts) - 1), pa.int64())
    return pa.RecordBatch.from_arrays(
        [batch.column("id"), *map(pa.array, numbers), pa.array(groups, pa.string()), pa.array(np.full(len(texts), part)),
         flat(codes, pa.int32()), flat(np.concatenate([np.empty(0, np.int64), *times]), pa.int64()), first(pairs), first(holders)],
        names=["id", "n_a", "n_b", "n_groups", "n_links", "groups", "part", "codes", "times", "pairs", "holders"])


def _aligner(bc, key: str, digest: bool):
    def run(batches):
        if key not in _ALIGNERS:
            _ALIGNERS.clear()
            _ALIGNERS[key] = Aligner(*bc.value)
        x, number = _ALIGNERS[key], count(TaskContext.get().partitionId() << 32)
        yield from per_batch(lambda batch: _slice(x, batch, next(number), digest), SLICE_ROWS, SLICE_BYTES)(batches)

    return run


OUT = "id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups string"


def _weigh(left: pa.Table, right: pa.Table) -> pa.Table:
    """The documents of a slice, and its pairs with their counts."""
    order = np.argsort(right["pair"].to_numpy())
    n, best = right["n"].to_numpy()[order], right["n"].to_numpy()[order] == right["most"].to_numpy()[order]
    codes, times = (left[c].combine_chunks() for c in ("codes", "times"))
    ends = np.cumsum(np.diff(codes.offsets.to_numpy()))
    at, k = codes.flatten().to_numpy(), times.flatten().to_numpy()
    summed = lambda v: np.diff(np.append(0, np.append(0, np.cumsum(v))[ends]))
    keep = left.select(["id", "n_a", "n_b", "n_groups", "n_links"])
    return (keep.append_column("n_best", pa.array(summed(k * best[at]))).append_column("count_sum", pa.array(summed(k * n[at])))
            .append_column("groups", left["groups"]))


def align(docs: DataFrame, a, b, id_col: str = "doc_id", text_col: str = "text", digest: bool = False) -> DataFrame:
    """``id_col, n_a, n_b, n_groups, n_links, n_best, count_sum, groups`` for every row of ``docs``.

    ``a`` and ``b`` are the two sides; both encode a space and the text. Byte offsets where tokens of both end cut them
    into groups, written in ``groups`` as ``a1,a2|b1;a3|b2,b3`` (with ``digest`` the lowercase SHA-256 of that). All token
    pairs of a group are links. The count of an id pair is the number of rows that hold it linked; ``count_sum`` adds it up
    over the links, and ``n_best`` are the links whose count is the highest of their ``a`` id in the corpus, ties included.

    Null and empty texts, and those that the tokens of a side do not spell (a text with U+2581, say), have no tokens: zeros
    and an empty ``groups``. Repeated rows and ids count row by row; a null id stays null; other columns are not read; an empty
    table stays empty. A document's distinct pairs are held in memory at once.
    """
    spark = docs.sparkSession
    store, base = Stored(spark), len(b.token_bytes())
    bc = spark.sparkContext.broadcast((a, b))
    rows = store.put(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
                     .mapInArrow(_aligner(bc, uuid.uuid4().hex, digest), ROWS), "rows")
    held = (rows.where("pairs is not null").select("part", F.explode(F.arrays_zip("pairs", "holders")).alias("x"))
            .select("part", F.col("x.pairs").alias("pair"), F.col("x.holders").alias("holders")))
    counts = held.groupBy("pair").agg(F.sum("holders").alias("n")).withColumn("a", F.floor(F.col("pair") / base))
    counts = store.put(counts, "counts")
    most = counts.groupBy("a").agg(F.max("n").alias("most"))
    weights = counts.join(most, "a").select("pair", "n", "most")
    left = rows.select("id", "n_a", "n_b", "n_groups", "n_links", "groups", "part", "codes", "times")
    right = held.select(F.col("part").alias("of"), "pair").join(weights, "pair")
    return (left.groupBy("part").cogroup(right.groupBy("of")).applyInArrow(_weigh, OUT)
            .withColumnRenamed("id", id_col))
