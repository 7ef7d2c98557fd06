"""Deterministic sampling: T6-T12, J7.

Every draw is keyed on md5(seed, ..., row ids) (see ``functions.hashing``), so
a sample does not depend on partitioning, task retries or the engine: DuckDB
reproduces it exactly. "First n" cuts use the two-pass
:func:`~citegraph.operators.encode.dense_index`, after a hash threshold where the
order is that of a hash; the plan is the same for every n.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from citegraph.functions.hashing import bernoulli, hash64, hash_threshold
from citegraph.operators.encode import dense_index, dictionary_encode
from citegraph.session import RunTables

def first_n(df: DataFrame, n: int, order_cols: list[str], tables: RunTables | None = None) -> DataFrame:
    """The first ``n`` rows in a total order: rows are numbered in two passes, no task grows with ``n``."""
    return dense_index(df, order_cols, index_col="_ix", tables=tables).where(F.col("_ix") < n).drop("_ix")


def least_hashed(df: DataFrame, n: int, hash_col: str, tie_cols: list[str], tables: RunTables | None = None) -> DataFrame:
    """The ``n`` rows of smallest hash. One plan for every ``n``: rows under a threshold of n / count plus slack
    (six standard deviations; doubled in the rare case that it is short) are stored, and only these are numbered."""
    count = df.count()
    share = (n + 6.0 * math.sqrt(n) + 16.0) / max(count, 1)
    run = RunTables(df.sparkSession)
    while True:
        near = run.put(df if share >= 1.0 else df.where(F.col(hash_col) < hash_threshold(share)))
        if share >= 1.0 or near.count() >= n:
            break
        run.drop(near)
        share *= 2.0
    out = first_n(near, n, [hash_col, *tie_cols], tables)
    run.drop(near)  # the numbered rows are a table of their own
    return out


# ---------------------------------------------------------------- T6
def sample_edges(edges: DataFrame, p: float = 0.1, seed: int = 42, *, exact: bool = False) -> DataFrame:
    """Uniform fraction ``p`` of the edges.

    Bernoulli by default (each edge kept when its hash falls under ``p``); with
    ``exact`` the ``round(p * m)`` edges of smallest hash are kept.
    """
    if not exact:
        return edges.where(bernoulli(p, F.lit(seed), "source", "target"))
    m = edges.count()
    keyed = edges.withColumn("_h", hash64(F.lit(seed), "source", "target"))
    return least_hashed(keyed, int(math.floor(p * m + 0.5)), "_h", ["source", "target"]).drop("_h")


# ---------------------------------------------------------------- T7
def with_copy_index(pairs: DataFrame, cols: list[str]) -> DataFrame:
    """Number identical rows 0..c-1 so that duplicates are distinct draws."""
    return (pairs.groupBy(*cols).agg(F.count(F.lit(1)).alias("_c"))
            .select(*cols, F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_c") - 1)).alias("copy")))


def sample_positive_pairs(pairs: DataFrame, n: int = 500, seed: int = 42, epoch: int = 0,
                          tables: RunTables | None = None) -> DataFrame:
    """``n`` pairs without replacement (duplicate pairs are separate rows)."""
    cols = ["paper_idx", "ref_idx"]
    keyed = with_copy_index(pairs, cols).withColumn(
        "_h", hash64(F.lit(seed), F.lit(epoch), "paper_idx", "ref_idx", "copy"))
    return least_hashed(keyed, n, "_h", ["paper_idx", "ref_idx", "copy"], tables).select(*cols, "copy")


# ---------------------------------------------------------------- J7, T8
def reject_known(cands: DataFrame, pairs: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Drop candidates that are known pairs (left anti join on the pair)."""
    cols = cols or ["paper_idx", "ref_idx"]
    return cands.join(pairs.select(*cols), cols, "left_anti")


def negative_candidates(spark: SparkSession, count: int, n_papers: int, n_refs: int,
                        seed: int, epoch: int, rnd: int) -> DataFrame:
    """Candidate draw ``i`` of round ``rnd``: uniform (paper_idx, ref_idx)."""
    i = F.col("id")
    return spark.range(count).select(
        F.lit(rnd).alias("round"), i.alias("i"),
        F.pmod(hash64(F.lit(seed), F.lit(epoch), F.lit(rnd), i, F.lit("p")), F.lit(n_papers)).alias("paper_idx"),
        F.pmod(hash64(F.lit(seed), F.lit(epoch), F.lit(rnd), i, F.lit("r")), F.lit(n_refs)).alias("ref_idx"))


def sample_negative_pairs(pairs: DataFrame, n: int, n_papers: int, n_refs: int, seed: int = 42,
                          epoch: int = 0, tables: RunTables | None = None) -> DataFrame:
    """``n`` uniform (paper, reference) pairs that are not known pairs.

    Repeats are allowed (as in the reference, Q14). Candidates ``range(1.5n+16)`` in the first round; while the
    anti join leaves fewer than ``n``, further rounds draw with the round number in the key, as many as the share of
    free pairs asks for. Kept: the first ``n`` by (round, i). Without any free pair a positive ``n`` is an error.
    """
    spark = pairs.sparkSession
    run = RunTables(spark)
    cells = n_papers * n_refs
    inside = (F.col("paper_idx") >= 0) & (F.col("paper_idx") < n_papers) & (F.col("ref_idx") >= 0) & (F.col("ref_idx") < n_refs)
    free = None
    draws, have, rnd = [], 0, 0
    while not draws or have < n:
        need = math.ceil((n - have) * 1.5)
        if rnd:
            if free is None:
                free = cells - pairs.where(inside).select("paper_idx", "ref_idx").distinct().count()
            if free <= 0:
                raise ValueError("every (paper, reference) pair is known: there is nothing to draw")
            need = math.ceil(need * cells / free)
        draws.append(run.put(reject_known(
            negative_candidates(spark, need + 16, n_papers, n_refs, seed, epoch, rnd), pairs)))
        have += draws[-1].count()
        rnd += 1
    out = first_n(reduce(DataFrame.unionByName, draws), n, ["round", "i"], tables).select("paper_idx", "ref_idx", "round", "i")
    run.drop(*draws)
    return out


# ---------------------------------------------------------------- T9
def sample_negative_links(nodes: DataFrame, edges: DataFrame, n: int, seed: int = 42, *,
                          id_col: str = "id", oversample: float = 2.0) -> DataFrame:
    """``n`` distinct node pairs (a < b) that are not edges (method "global").

    Node ids are dictionary-encoded (A16) so that a draw is a uniform index;
    candidates are canonicalised, self pairs and edges removed, repeats removed
    (first draw wins), then the first ``n`` by (round, i) are kept. Rounds go on until there are ``n``; asking for
    more non-edges than there are is an error.
    """
    spark = nodes.sparkSession
    run = RunTables(spark)
    dim = dictionary_encode(nodes.select(F.col(id_col).alias("node")), "node")
    n_nodes = dim.count()
    canon = edges.where("source <> target").select(F.least("source", "target").alias("a"),
                                                   F.greatest("source", "target").alias("b")).distinct()
    cells = n_nodes * (n_nodes - 1) // 2
    possible = None
    draws, have, rnd = [], 0, 0
    while not draws or have < n:
        cnt = math.ceil((n - have) * oversample)
        if rnd:
            if possible is None:
                ids = dim.select("node")
                known = canon.join(ids.withColumnRenamed("node", "a"), "a", "left_semi").join(
                    ids.withColumnRenamed("node", "b"), "b", "left_semi")
                possible = cells - known.count()
            if n > possible:
                raise ValueError(f"{n} non-edges asked for, the graph has {possible}")
            cnt = math.ceil(cnt * cells / (possible - have))
        i = F.col("id")
        drawn = spark.range(cnt + 1000).select(
            F.lit(rnd).alias("round"), i.alias("i"),
            F.pmod(hash64(F.lit(seed), F.lit(rnd), i, F.lit("a")), F.lit(n_nodes)).alias("ia"),
            F.pmod(hash64(F.lit(seed), F.lit(rnd), i, F.lit("b")), F.lit(n_nodes)).alias("ib")).where("ia <> ib")
        if not n_nodes:
            drawn = drawn.where("false")
        da = dim.select(F.col("idx").alias("ia"), F.col("node").alias("na"))
        db = dim.select(F.col("idx").alias("ib"), F.col("node").alias("nb"))
        draws.append(run.put(
            drawn.join(da, "ia").join(db, "ib")
            .select("round", "i", F.least("na", "nb").alias("a"), F.greatest("na", "nb").alias("b"))
            .join(canon, ["a", "b"], "left_anti")))
        # a pair drawn twice keeps its first draw (hash aggregate, map-side combined)
        firsts = reduce(DataFrame.unionByName, draws).groupBy("a", "b").agg(
            F.min(F.struct("round", "i")).alias("_f")).select(
            "a", "b", F.col("_f.round").alias("round"), F.col("_f.i").alias("i"))
        have = firsts.count()
        rnd += 1
    out = first_n(firsts, n, ["round", "i"]).select(
        F.col("a").alias("source"), F.col("b").alias("target"), "round", "i")
    run.drop(*draws)
    return out


# ---------------------------------------------------------------- T10, T11
def labelled_pairs(pos: DataFrame, neg: DataFrame, *, classification: bool = False,
                   seed: int = 42, epoch: int = 0) -> DataFrame:
    """Positives label 1, negatives -1 (regression) or 0 (classification),
    with a deterministic shuffle key."""
    neg_label = 0.0 if classification else -1.0
    p = pos.select("paper_idx", "ref_idx", F.lit(1.0).alias("label"), F.lit("p").alias("_s"),
                   F.col("copy").alias("_n"))
    q = neg.select("paper_idx", "ref_idx", F.lit(neg_label).alias("label"), F.lit("n").alias("_s"),
                   (F.col("round") * F.lit(1 << 40) + F.col("i")).alias("_n"))
    u = p.unionByName(q)
    return u.withColumn("shuffle_key", hash64(F.lit(seed), F.lit(epoch), "_s", "paper_idx",
                                              "ref_idx", "_n")).drop("_s", "_n")


def assign_batches(rows: DataFrame, size: int, order_cols: list[str], *, seed: int = 42,
                   epoch: int = 0, shuffle: bool = True, hash_cols: list[str] | None = None) -> DataFrame:
    """Minibatch number = floor(position / size).

    With ``shuffle`` the position follows md5(seed, epoch, row); otherwise the
    ``order_cols`` order (test links stay in order).
    """
    if shuffle:
        keyed = rows.withColumn("_h", hash64(F.lit(seed), F.lit(epoch), *(hash_cols or order_cols)))
        ordered = dense_index(keyed, ["_h", *order_cols], index_col="_pos").drop("_h")
    else:
        ordered = dense_index(rows, order_cols, index_col="_pos")
    return ordered.withColumn("batch", F.floor(F.col("_pos") / size).cast("bigint")).drop("_pos")


# ---------------------------------------------------------------- T12
def sample_neighbours(edges: DataFrame, k: int, seed: int = 42, hop: int = 1) -> DataFrame:
    """At most ``k`` neighbours per node, chosen by md5(seed, hop, node, nbr).

    Without replacement and deterministic (the library samples with replacement).
    ``row_number() <= k`` is planned as a partial WindowGroupLimit, so a hub is
    cut to ``k`` rows per map partition before it is shuffled.
    """
    keyed = edges.select("source", "target").withColumn(
        "_h", hash64(F.lit(seed), F.lit(hop), "source", "target"))
    w = Window.partitionBy("source").orderBy("_h", "target")
    return (keyed.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k)
            .select("source", "target", F.col("_r").cast("int").alias("slot")))
