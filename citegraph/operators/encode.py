"""Dense numbering and dictionary encoding: A16, J4, J10.

``dense_index`` gives rows the numbers 0..n-1 in a total order without a
single-partition window: range-partition and sort, tag each row with its
partition id and in-partition position, write the table to the shared folder
(so the tags are fixed under retries), count rows per partition, and add each
partition's offset by a join. Ids are numbered alone; text is joined afterwards, by
the caller that wants it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from citegraph.functions.text import join_text
from citegraph.session import RunTables, cut_lineage

_ROW_BITS = 33  # monotonically_increasing_id keeps the row number in the low 33 bits


def dense_index(df: DataFrame, order_cols: list[str], *, index_col: str = "idx", tables: RunTables | None = None) -> DataFrame:
    """Add ``index_col`` = position (0-based) of the row in ``order_cols`` order. The rows lie in a table of their own, one of
    ``tables`` if given, which then drop it.

    The order should be total (make the last column a unique id). The number of range partitions is left to
    adaptive execution.
    """
    # partition id and in-partition position are fixed in the same task that
    # writes the table, so re-reading (in any file grouping) cannot change them
    ranged = (df.repartitionByRange(*order_cols).sortWithinPartitions(*order_cols)
              .withColumn("_pid", F.spark_partition_id())
              .withColumn("_loc", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << _ROW_BITS) - 1))))
    tagged = tables.put(ranged) if tables else cut_lineage(ranged)
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (tagged.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))  # one row a partition
               .select("_pid", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset")))
    return (tagged.join(offsets, "_pid")
            .select(*df.columns, (F.col("_offset") + F.col("_loc")).alias(index_col)))


def dictionary_encode(ids: DataFrame, id_col: str = "paper_id", *,
                      index_col: str = "idx") -> DataFrame:
    """Distinct ids numbered 0..n-1 in id order → (idx, id, other columns)."""
    distinct = ids.dropDuplicates([id_col])
    out = dense_index(distinct, [id_col], index_col=index_col)
    return out.select(index_col, *[c for c in out.columns if c != index_col])


def paper_index(active: DataFrame) -> DataFrame:
    """A16 over the active ids: (idx, paper_id)."""
    return dictionary_encode(active.select("paper_id"), "paper_id")


def ref_index(citations: DataFrame) -> DataFrame:
    """A16 over the distinct cited ids: (idx, paper_id)."""
    return dictionary_encode(citations.select(F.col("target").alias("paper_id")).distinct(), "paper_id")


def with_text(dim: DataFrame, papers: DataFrame, sep: str = " ") -> DataFrame:
    """(idx, paper_id, text): the text of every numbered id, '' where the corpus has none."""
    return (dim.join(papers.select("paper_id", "title", "abstract"), "paper_id", "left")
            .select("idx", "paper_id", join_text("title", "abstract", sep).alias("text")))


def encode_papers(active: DataFrame, papers: DataFrame, sep: str = " ") -> DataFrame:
    """A16 + J1: dim_paper(idx, paper_id, text) for the active ids."""
    return with_text(paper_index(active), papers, sep)


def encode_refs(citations: DataFrame, papers: DataFrame, sep: str = " ") -> DataFrame:
    """A4 + A16: dim_ref(idx, paper_id, text) over distinct cited ids."""
    return with_text(ref_index(citations), papers, sep)


def encode_pairs(citations: DataFrame, dim_paper: DataFrame, dim_ref: DataFrame) -> DataFrame:
    """(source, target) → (paper_idx, ref_idx); duplicates kept.

    Two equi-joins; Spark broadcasts a dimension only when AQE measures it under
    ``autoBroadcastJoinThreshold``, otherwise both sides shuffle on the key.
    """
    p = dim_paper.select(F.col("paper_id").alias("source"), F.col("idx").alias("paper_idx"))
    r = dim_ref.select(F.col("paper_id").alias("target"), F.col("idx").alias("ref_idx"))
    return citations.join(p, "source").join(r, "target").select("paper_idx", "ref_idx")


def decode(hits: DataFrame, dim: DataFrame, idx_col: str = "idx") -> DataFrame:
    """Idx → paper id and text."""
    return hits.join(dim.withColumnRenamed("idx", idx_col), idx_col)
