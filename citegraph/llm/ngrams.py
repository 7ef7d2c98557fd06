"""Hashed character n-gram counts of Arrow string columns, with numpy."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes handled at once: working memory follows this and not the length of a text.
CHUNK = 1 << 20
MIX = (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F, 0x165667B1)


def utf8(col: pa.Array, table: bytes | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts one after another, and where each begins and the last ends."""
    if pa.types.is_string(col.type):
        offsets = np.frombuffer(col.buffers()[1], np.int32, len(col) + 1, col.offset * 4).astype(np.int64)
    else:
        offsets = np.frombuffer(col.buffers()[1], np.int64, len(col) + 1, col.offset * 8)
    raw = col.buffers()[2]
    data = memoryview(raw)[int(offsets[0]):int(offsets[-1])] if raw is not None else b""
    data = bytes(data)
    if table is not None:
        data = data.translate(table)
    return np.frombuffer(data, np.uint8), offsets - offsets[0]


def buckets(data: np.ndarray, offsets: np.ndarray, ns: tuple[int, ...], bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, bucket) of every n-gram inside a row, chunk after chunk."""
    rows = np.arange(len(offsets) - 1)
    shift = np.uint32(32 - bits)
    for start in range(0, len(data), CHUNK):
        end = min(start + CHUNK, len(data))
        held = np.clip(offsets, start, end)
        row = np.repeat(rows, np.diff(held))
        window = data[start:end + max(ns) - 1].astype(np.uint32)
        for n in ns:
            size = min(end - start, len(window) - n + 1)
            if size <= 0:
                continue
            key = np.full(size, MIX[0] * n & 0xFFFFFFFF, np.uint32)
            for j in range(n):
                key ^= window[j:j + size]
                key *= np.uint32(MIX[j % len(MIX)])
                key ^= key >> np.uint32(15)
            whole = np.ones(size, bool)
            for j in range(1, n):  # the last n - 1 starts of a row run into the next one
                at = offsets[1:] - j - start
                whole[at[(at >= 0) & (at < size)]] = False
            yield row[:size][whole], (key >> shift)[whole]


def counts(col: pa.Array, ns: tuple[int, ...], bits: int, table: bytes | None = None) -> np.ndarray:
    """float32 matrix (texts, 2**bits) of n-gram counts. A null text counts as empty."""
    data, offsets = utf8(col, table)
    size = len(col) << bits
    out = np.zeros(size, np.float32)
    for row, bucket in buckets(data, offsets, ns, bits):
        out += np.bincount((row << bits) + bucket, minlength=size).astype(np.float32)
    return out.reshape(len(col), 1 << bits)


def tf_idf(found: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """log(1 + count) * idf, rows of unit length (zero rows stay zero)."""
    out = np.log1p(found) * idf
    norm = np.sqrt((out * out).sum(1, keepdims=True))
    return (out / np.maximum(norm, 1e-12)).astype(np.float32)


def inverse_frequencies(docs: DataFrame, text_col: str, found: Callable[[pa.Array], np.ndarray], width: int,
                        rows: int = 128) -> np.ndarray:
    """1 + log((1 + N) / (1 + df)) of each of the ``width`` features that ``found`` counts, over all rows of
    ``docs``: one partial count for each feature and task, summed by Spark; ``width`` numbers reach the driver."""

    def partial(batches):
        df, n = np.zeros(width, np.int64), 0
        for batch in batches:
            for start in range(0, batch.num_rows, rows):
                part = batch.column(0).slice(start, rows)
                df += (found(part) > 0).sum(0)
                n += len(part)
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_pydict({"feature": pa.array(np.append(at, -1).astype(np.int32)),
                                          "n": pa.array(np.append(df[at], n))})

    got = (docs.select(F.col(text_col)).mapInArrow(partial, "feature int, n long")
           .groupBy("feature").agg(F.sum("n").alias("n")).toPandas())
    df = np.zeros(width)
    inside = got[got["feature"] >= 0]
    df[inside["feature"].to_numpy()] = inside["n"].to_numpy()
    total = float(got.loc[got["feature"] < 0, "n"].sum())
    return (1 + np.log((1 + total) / (1 + df))).astype(np.float32)
