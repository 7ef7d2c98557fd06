"""Evaluation: A9-A15, J5, J6, P9-P11.

Every metric is one aggregation (map-side partial sums, one small shuffle), or,
for the ROC curve, a prefix sum over distinct scores computed in two passes over
range partitions so that no single task sees every score.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from citegraph.session import cut_lineage

EPS = 1e-7  # probability clip for the cross-entropy


def _c(x):
    return F.col(x) if isinstance(x, str) else x


# ---------------------------------------------------------------- P9-P11
def threshold(scored: DataFrame, cut: float = 0.5, score_col: str = "score",
              pred_col: str = "pred") -> DataFrame:
    """pred = 1 when score > cut (strictly), else 0."""
    return scored.withColumn(pred_col, F.when(F.col(score_col) > cut, 1).otherwise(0))


def partition_decisions(scored: DataFrame, pred_col: str = "pred") -> tuple[DataFrame, DataFrame]:
    """P10: (predicted positive edges, predicted negative edges)."""
    return scored.where(F.col(pred_col) == 1), scored.where(F.col(pred_col) == 0)


def edges_of(edges: DataFrame, paper_id: int) -> DataFrame:
    """The (paper, target) edges of one paper."""
    return edges.where(F.col("source") == F.lit(paper_id))


# ---------------------------------------------------------------- J5, J6, A9
def hits_in_truth(decisions: DataFrame, truth: DataFrame) -> DataFrame:
    """Decisions whose (source, target) is a true edge (directional)."""
    return decisions.join(truth.select("source", "target").distinct(),
                          ["source", "target"], "left_semi")


def label_truth(truth: DataFrame, decisions: DataFrame) -> DataFrame:
    """One label per true edge: 1 / 0 as predicted, NULL when unscored.

    An edge in both decision lists counts as predicted 1 (SURVEY Q20).
    """
    d = decisions.groupBy("source", "target").agg(F.max("pred").alias("pred"))
    return truth.select("source", "target").distinct().join(d, ["source", "target"], "left")


def truth_hits(decisions: DataFrame, truth: DataFrame) -> DataFrame:
    """Per paper, true edges predicted 1 (true_positive), predicted 0
    (false_negative; the reference called it true_negative, Q19) and unscored."""
    lab = label_truth(truth, decisions)
    return lab.groupBy("source").agg(
        F.count(F.lit(1)).alias("n_true"),
        F.sum(F.when(F.col("pred") == 1, 1).otherwise(0)).cast("bigint").alias("true_positive"),
        F.sum(F.when(F.col("pred") == 0, 1).otherwise(0)).cast("bigint").alias("false_negative"),
        F.sum(F.when(F.col("pred").isNull(), 1).otherwise(0)).cast("bigint").alias("unscored"),
    )


# ---------------------------------------------------------------- A10-A12, A15
def confusion_matrix(df: DataFrame, actual: str = "label", pred: str = "pred") -> DataFrame:
    """A10: 2x2 counts as rows (actual, pred_0, pred_1); both rows always present."""
    a, p = F.col(actual), F.col(pred)
    sums = df.agg(
        F.sum(F.when((a == 0) & (p == 0), 1).otherwise(0)).cast("bigint").alias("tn"),
        F.sum(F.when((a == 0) & (p == 1), 1).otherwise(0)).cast("bigint").alias("fp"),
        F.sum(F.when((a == 1) & (p == 0), 1).otherwise(0)).cast("bigint").alias("fn"),
        F.sum(F.when((a == 1) & (p == 1), 1).otherwise(0)).cast("bigint").alias("tp"),
    )
    return sums.select(F.expr("stack(2, 0, coalesce(tn, 0L), coalesce(fp, 0L), "
                              "1, coalesce(fn, 0L), coalesce(tp, 0L)) AS (actual, pred_0, pred_1)"))


def f1(scored: DataFrame, label: str = "label", pred: str = "pred") -> DataFrame:
    """Precision, recall and F1 of the positive class in one aggregation."""
    y, p = F.col(label), F.col(pred)
    s = scored.agg(
        F.sum(F.when((y == 1) & (p == 1), 1).otherwise(0)).alias("tp"),
        F.sum(F.when((y == 0) & (p == 1), 1).otherwise(0)).alias("fp"),
        F.sum(F.when((y == 1) & (p == 0), 1).otherwise(0)).alias("fn"),
    )
    prec = F.try_divide(F.col("tp"), F.col("tp") + F.col("fp"))
    rec = F.try_divide(F.col("tp"), F.col("tp") + F.col("fn"))
    return s.select(
        F.col("tp").cast("bigint").alias("tp"), F.col("fp").cast("bigint").alias("fp"),
        F.col("fn").cast("bigint").alias("fn"),
        F.coalesce(prec, F.lit(0.0)).alias("precision"),
        F.coalesce(rec, F.lit(0.0)).alias("recall"),
        F.coalesce(F.try_divide(2.0 * F.col("tp"), 2.0 * F.col("tp") + F.col("fp") + F.col("fn")),
                   F.lit(0.0)).alias("f1"),
    )


def accuracy_log_loss(scored: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """Accuracy at 0.5 and mean binary cross-entropy with p clipped to [1e-7, 1-1e-7]."""
    y = F.col(label).cast("double")
    p = F.least(F.greatest(F.col(score).cast("double"), F.lit(EPS)), F.lit(1.0 - EPS))
    hit = F.when((F.col(score) > 0.5) == (F.col(label) == 1), 1.0).otherwise(0.0)
    return scored.agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(hit).alias("accuracy"),
        F.avg(-(y * F.log(p) + (F.lit(1.0) - y) * F.log(F.lit(1.0) - p))).alias("log_loss"),
    )


# ---------------------------------------------------------------- A13, A14
def roc_curve(scored: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """One ROC point per distinct score, thresholds descending.

    Returns (threshold, fpr, tpr, n_pos, n_neg) where n_pos / n_neg are the counts
    at exactly that score. The origin (0, 0) is implicit, as in the usual curve.
    Cumulative sums are two-pass: range partitions by score, running totals over the
    partitions (one row each), then a window inside each partition.
    """
    grouped = scored.groupBy(F.col(score).alias("threshold")).agg(
        F.sum(F.when(F.col(label) == 1, 1).otherwise(0)).cast("bigint").alias("n_pos"),
        F.sum(F.when(F.col(label) == 1, 0).otherwise(1)).cast("bigint").alias("n_neg"))
    ranged = cut_lineage(grouped.repartitionByRange(F.col("threshold").desc())
                         .withColumn("_pid", F.spark_partition_id()))
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy(F.lit(0))
    totals = (ranged.groupBy("_pid").agg(F.sum("n_pos").alias("p"), F.sum("n_neg").alias("n"))
              .select("_pid", F.coalesce(F.sum("p").over(before), F.lit(0)).alias("_p0"),
                      F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_n0"),
                      F.sum("p").over(every).alias("_P"), F.sum("n").over(every).alias("_N")))
    w = (Window.partitionBy("_pid").orderBy(F.col("threshold").desc())
         .rowsBetween(Window.unboundedPreceding, Window.currentRow))

    def rate(n: str, first: str, total: str):
        return F.coalesce(F.try_divide((F.sum(n).over(w) + F.col(first)).cast("double"), F.col(total).cast("double")), F.lit(0.0))

    return ranged.join(totals, "_pid").select(
        "threshold", rate("n_neg", "_n0", "_N").alias("fpr"), rate("n_pos", "_p0", "_P").alias("tpr"), "n_pos", "n_neg")


def auc(scored: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """Area under the ROC curve, ties counted half (equals the trapezoid area).

    AUC = sum over distinct scores s of pos(s) * (neg(< s) + neg(s) / 2) / (P * N).
    """
    return _auc_from_roc(roc_curve(scored, label, score))


def _auc_from_roc(roc: DataFrame) -> DataFrame:
    s = roc.agg(F.sum("n_pos").alias("P"), F.sum("n_neg").alias("N"),
                F.sum(F.col("n_pos") * (F.lit(1.0) - F.col("fpr"))).alias("pos_x_below_frac"),
                F.sum(F.col("n_pos") * F.col("n_neg")).alias("ties"))
    # negatives strictly below s = N*(1-fpr(s)); ties add half a negative per pair
    area = F.try_divide(F.col("pos_x_below_frac") * F.col("N") + 0.5 * F.col("ties"),
                        (F.col("P") * F.col("N")).cast("double"))
    return s.select(area.alias("auc"), F.col("P").cast("bigint").alias("n_pos"),
                    F.col("N").cast("bigint").alias("n_neg"))


# ---------------------------------------------------------------- A11
def recommendation_quality(recs: DataFrame, truth: DataFrame) -> DataFrame:
    """Per query, true references, recommended, matched, precision, recall, F1.

    ``recs`` (query_id, rec_id) distinct; ``truth`` (source, target) edges.
    No true references → recall and F1 NULL; precision + recall = 0 → F1 = 0 (Q9).
    """
    t = truth.select("source", "target").distinct()
    hits = (recs.select("query_id", "rec_id")
            .join(t.select(F.col("source").alias("query_id"), F.col("target").alias("rec_id"),
                           F.lit(1).alias("_hit")), ["query_id", "rec_id"], "left")
            .groupBy("query_id")
            .agg(F.count(F.lit(1)).alias("n_recommended"),
                 F.count("_hit").alias("n_matched")))
    n_true = t.groupBy(F.col("source").alias("query_id")).agg(F.count(F.lit(1)).alias("n_true"))
    q = hits.join(n_true, "query_id", "left").withColumn("n_true", F.coalesce("n_true", F.lit(0)))
    prec = F.try_divide(F.col("n_matched").cast("double"), F.col("n_recommended"))
    rec = F.try_divide(F.col("n_matched").cast("double"), F.col("n_true"))
    return q.select(
        "query_id", F.col("n_true").cast("bigint").alias("n_true"),
        F.col("n_recommended").cast("bigint").alias("n_recommended"),
        F.col("n_matched").cast("bigint").alias("n_matched"),
        prec.alias("precision"), rec.alias("recall"),
        F.when(rec.isNull(), None).when(prec + rec == 0, 0.0)
        .otherwise(2.0 * prec * rec / (prec + rec)).alias("f1"))
