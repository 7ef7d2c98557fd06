"""Exact dedup by content sort.

Texts are normalised (each run of white space becomes one space) and range-partitioned
on sampled splitters, sorted inside each partition (Spark's external sort), and
neighbouring texts are compared in full. The sort key is (first characters of the text,
SHA-256 of the text, id): equal texts are adjacent, and what Spark's splitter sample
brings to the driver is bounded per row whatever the length of a text. As the id is
part of the key, a group of copies may span any number of partitions, so one huge group
is split evenly; its pieces are stitched afterwards from the first and last group
of every partition (two rows a partition).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citegraph.llm.common import Stored

SPACE = "[\\x20\\x09-\\x0D]+"
PREFIX = 32
PIECES = "id long, sha string, piece long, head boolean, n long, keep long, edge_text string"


def normalised(text: str) -> F.Column:
    return F.regexp_replace(F.coalesce(F.col(text), F.lit("")), SPACE, " ")


def _pieces(batches):
    """Sorted rows of one partition -> one row per document, with the size and the smallest
    id of its group as far as this partition holds it. The partition's first and last
    groups carry their text on their first row."""
    base = TaskContext.get().partitionId() << 32
    held: list[tuple[pa.Array, pa.Array]] = []
    state = {"g": 0}
    open_text = None

    def out(ids, sha, sizes, edge_text):
        """Rows of consecutive whole groups of the given sizes."""
        sizes = np.asarray(sizes, np.int64)
        heads = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        first = np.zeros(len(ids), bool)
        first[heads] = True
        group = state["g"] + np.repeat(np.arange(len(sizes)), sizes)
        state["g"] += len(sizes)
        edge = pa.nulls(len(ids), pa.string()) if edge_text is None else pa.array(
            [edge_text] + [None] * (len(ids) - 1), pa.string())
        return pa.RecordBatch.from_arrays(
            [ids, sha, pa.array(base + group), pa.array(first), pa.array(np.repeat(sizes, sizes)),
             ids.take(pa.array(np.repeat(heads, sizes))), edge],
            names=["id", "sha", "piece", "head", "n", "keep", "edge_text"])

    def close(edge):
        """The open group, whole."""
        ids = pa.concat_arrays([x[0] for x in held])
        sha = pa.concat_arrays([x[1] for x in held])
        held.clear()
        return out(ids, sha, [len(ids)], open_text if edge else None)

    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        ids, sha, text = batch.column(0), batch.column(1), batch.column(2)
        new = np.ones(n, bool)
        new[0] = open_text is None or text[0].as_py() != open_text
        if n > 1:
            new[1:] = ~pc.equal(text.slice(1), text.slice(0, n - 1)).to_numpy(zero_copy_only=False)
        starts = np.flatnonzero(new)
        lead = starts[0] if len(starts) else n
        if lead:
            held.append((ids.slice(0, lead), sha.slice(0, lead)))
        for k, s in enumerate(starts):
            if open_text is not None:
                yield close(edge=state["g"] == 0)
                open_text = None
            if k == len(starts) - 1:
                held.append((ids.slice(s), sha.slice(s)))
                open_text = text[int(s)].as_py()
            elif state["g"] == 0:  # the partition's first group ends inside its first batch
                yield out(ids.slice(s, starts[k + 1] - s), sha.slice(s, starts[k + 1] - s),
                          [starts[k + 1] - s], text[int(s)].as_py())
            else:  # whole groups up to the last start of the batch, at once
                e = starts[-1]
                yield out(ids.slice(s, e - s), sha.slice(s, e - s), np.diff(starts[k:]), None)
                held.append((ids.slice(e), sha.slice(e)))
                open_text = text[int(e)].as_py()
                break
    if open_text is not None:
        yield close(edge=True)


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``id_col, keep_id, group_size, kept, text_sha256``.

    Texts are equal when they are identical after each run of white space became one space;
    the row with the smallest id of a group stays. A null text counts as empty. A null id
    sorts last: such a row stays only in a group without any id, and ``keep_id`` is
    then null. Of repeated rows (same id, same text) exactly one stays. Other
    columns are not read, so their names cannot clash; an empty table gives no rows.
    """
    spark = docs.sparkSession
    store = Stored(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), normalised(text_col).alias("text"))
    rows = rows.select("id", F.sha2("text", 256).alias("sha"), "text",
                       F.substring("text", 1, PREFIX).alias("prefix"))
    order = [F.col("prefix"), F.col("sha"), F.col("id").asc_nulls_last()]
    pieces = store.put(
        rows.repartitionByRange(*order).sortWithinPartitions(*order).select("id", "sha", "text")
        .mapInArrow(_pieces, PIECES), "pieces")
    whole = store.put(
        pieces.where(F.col("edge_text").isNotNull()).groupBy("edge_text")
        .agg(F.sum("n").alias("total"), F.min("keep").alias("least"), F.min("piece").alias("first_piece"),
             F.collect_list("piece").alias("parts"))
        .select(F.explode("parts").alias("piece"), "total", "least", "first_piece"), "edges")
    return pieces.join(whole, "piece", "left").select(
        F.col("id").alias(id_col),
        F.coalesce("least", "keep").alias("keep_id"),
        F.coalesce("total", "n").alias("group_size"),
        (F.col("head") & (F.col("piece") == F.coalesce("first_piece", "piece"))).alias("kept"),
        F.col("sha").alias("text_sha256"))
