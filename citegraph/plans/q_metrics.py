"""Registered queries: evaluation over scored links.

Links = held-out undirected vec_cites positives (label 1) + as many sampled
non-edges (label 0); score = (1 + cosine of the two embeddings) / 2, a number
in [0, 1] (no model needed, so the oracle is exact); pred = score > 0.5.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from citegraph.operators import metrics as M
from citegraph.operators import recommend as R
from citegraph.operators.cells import link_cosines
from citegraph.plans import views as V
from citegraph.plans.catalog import r6, register
from citegraph.plans.q_sampling import LINKS_CTES, links, und

CUT = 0.5
SCORED = LINKS_CTES + [
    ("scored", """SELECT l.source, l.target, l.label,
        (1.0 + list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[])) / 2.0 AS score
        FROM links l JOIN vectors a ON a.id = l.source JOIN vectors b ON b.id = l.target"""),
    ("dec", f"SELECT *, CASE WHEN score > {CUT} THEN 1 ELSE 0 END AS pred FROM scored"),
]
VIEWS = ["vec_cites", "vectors"]


def scored(spark, d):
    found = link_cosines(links(spark, d), V.vectors(spark, d))
    return found.select("source", "target", "label", ((F.lit(1.0) + F.col("cosine")) / 2.0).alias("score"))


def decisions(spark, d):
    return M.threshold(scored(spark, d), CUT)


@register("threshold", V.sql_with(VIEWS, "SELECT source, target, label, round(score, 6) AS score, pred FROM dec",
                                  SCORED))
def q_threshold(spark, d):
    """Score > 0.5 → 1, else 0."""
    return decisions(spark, d).select("source", "target", "label", r6("score").alias("score"), "pred")


@register("decisions_positive", V.sql_with(VIEWS, "SELECT source, target FROM dec WHERE pred = 1", SCORED))
def q_positive(spark, d):
    """P10: the predicted-positive edge list (the negative list is its complement)."""
    pos, _neg = M.partition_decisions(decisions(spark, d))
    return pos.select("source", "target")


@register("confusion", V.sql_with(VIEWS, """
    SELECT 0 AS actual, count(*) FILTER (WHERE label = 0 AND pred = 0) AS pred_0,
           count(*) FILTER (WHERE label = 0 AND pred = 1) AS pred_1 FROM dec
    UNION ALL SELECT 1, count(*) FILTER (WHERE label = 1 AND pred = 0),
           count(*) FILTER (WHERE label = 1 AND pred = 1) FROM dec""", SCORED))
def q_confusion(spark, d):
    """A10: 2x2 confusion matrix as two rows."""
    return M.confusion_matrix(decisions(spark, d), "label", "pred")


@register("f1", V.sql_with(VIEWS, """
    SELECT tp, fp, fn, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS precision,
           round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall,
           round(coalesce(2.0 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1
    FROM (SELECT count(*) FILTER (WHERE label = 1 AND pred = 1) AS tp,
                 count(*) FILTER (WHERE label = 0 AND pred = 1) AS fp,
                 count(*) FILTER (WHERE label = 1 AND pred = 0) AS fn FROM dec)""", SCORED))
def q_f1(spark, d):
    """Precision, recall, F1 of the positive class."""
    f = M.f1(decisions(spark, d))
    return f.select("tp", "fp", "fn", r6("precision").alias("precision"), r6("recall").alias("recall"),
                    r6("f1").alias("f1"))


ROC_SQL = ("roc", """SELECT threshold, n_pos, n_neg,
        sum(n_neg) OVER (ORDER BY threshold DESC) / (SELECT count(*) FILTER (WHERE label = 0) FROM dec) AS fpr,
        sum(n_pos) OVER (ORDER BY threshold DESC) / (SELECT count(*) FILTER (WHERE label = 1) FROM dec) AS tpr
    FROM (SELECT {col} AS threshold, count(*) FILTER (WHERE label = 1) AS n_pos,
                 count(*) FILTER (WHERE label = 0) AS n_neg FROM dec GROUP BY 1)""")


@register("roc_points", V.sql_with(VIEWS, """
    SELECT round(threshold, 6) AS threshold, round(fpr, 6) AS fpr, round(tpr, 6) AS tpr, n_pos, n_neg
    FROM roc""", SCORED + [(ROC_SQL[0], ROC_SQL[1].format(col="score"))]))
def q_roc(spark, d):
    """ROC points, one per distinct score (prefix sums over range partitions)."""
    r = M.roc_curve(decisions(spark, d), "label", "score")
    return r.select(r6("threshold").alias("threshold"), r6("fpr").alias("fpr"), r6("tpr").alias("tpr"),
                    "n_pos", "n_neg")


def _auc_sql(col: str) -> str:
    return f"""(SELECT (sum(n_pos * (1.0 - fpr)) * max(nn) + 0.5 * sum(n_pos * n_neg)) / (max(np) * max(nn))
        FROM (SELECT *, (SELECT count(*) FILTER (WHERE label = 1) FROM dec) AS np,
                        (SELECT count(*) FILTER (WHERE label = 0) FROM dec) AS nn FROM roc_{col}))"""


@register("auc", V.sql_with(VIEWS, f"""
    SELECT round({_auc_sql('score')}, 6) AS auc_score, round({_auc_sql('pred')}, 6) AS auc_pred""",
    SCORED + [("roc_score", ROC_SQL[1].format(col="score")), ("roc_pred", ROC_SQL[1].format(col="pred"))]))
def q_auc(spark, d):
    """Area under the ROC curve of the score and, as the reference did (Q18), of the 0/1 decision."""
    dec = decisions(spark, d)
    a = M.auc(dec, "label", "score").first()["auc"]
    b = M.auc(dec, "label", "pred").first()["auc"]
    return dec.sparkSession.createDataFrame([(a, b)], "auc_score double, auc_pred double").select(
        r6("auc_score").alias("auc_score"), r6("auc_pred").alias("auc_pred"))


@register("log_loss", V.sql_with(VIEWS, """
    SELECT count(*) AS n, round(avg(CASE WHEN (score > 0.5) = (label = 1) THEN 1.0 ELSE 0.0 END), 6) AS accuracy,
           round(avg(-(label * ln(p) + (1 - label) * ln(1 - p))), 6) AS log_loss
    FROM (SELECT label, score, least(greatest(score, 1e-7), 1 - 1e-7) AS p FROM dec)""", SCORED))
def q_log_loss(spark, d):
    """Accuracy and binary cross-entropy of the score as a probability."""
    a = M.accuracy_log_loss(decisions(spark, d), "label", "score")
    return a.select("n", r6("accuracy").alias("accuracy"), r6("log_loss").alias("log_loss"))


TRUTH = ("truth", "SELECT source, target FROM und")


@register("truth_hits", V.sql_with(VIEWS, """
    SELECT t.source, count(*) AS n_true,
           sum(CASE WHEN d.pred = 1 THEN 1 ELSE 0 END)::BIGINT AS true_positive,
           sum(CASE WHEN d.pred = 0 THEN 1 ELSE 0 END)::BIGINT AS false_negative,
           sum(CASE WHEN d.pred IS NULL THEN 1 ELSE 0 END)::BIGINT AS unscored
    FROM truth t LEFT JOIN (SELECT source, target, max(pred) AS pred FROM dec GROUP BY 1, 2) d
      ON d.source = t.source AND d.target = t.target GROUP BY t.source""", SCORED + [TRUTH]))
def q_truth_hits(spark, d):
    """A9 (+ J6): per paper, true links predicted 1, predicted 0, unscored."""
    return M.truth_hits(decisions(spark, d), und(spark, d))


@register("label_truth", V.sql_with(VIEWS, """
    SELECT t.source, t.target, d.pred FROM truth t
    LEFT JOIN (SELECT source, target, max(pred) AS pred FROM dec GROUP BY 1, 2) d
      ON d.source = t.source AND d.target = t.target""", SCORED + [TRUTH]))
def q_label_truth(spark, d):
    """One label per true link (NULL when unscored)."""
    return M.label_truth(und(spark, d), decisions(spark, d))


@register("hits_in_truth", V.sql_with(VIEWS, """
    SELECT source, target, pred FROM dec d WHERE EXISTS (
        SELECT 1 FROM truth t WHERE t.source = d.source AND t.target = d.target)""", SCORED + [TRUTH]))
def q_hits(spark, d):
    """Scored links that are true links (directional semi join)."""
    return M.hits_in_truth(decisions(spark, d), und(spark, d)).select("source", "target", "pred")


@register("recommend_citations", V.sql_with(VIEWS + ["papers"], """
    SELECT d.source, d.target, p.title AS target_title FROM dec d
    JOIN papers p ON p.paper_id = d.target
    WHERE d.pred = 1 AND EXISTS (SELECT 1 FROM truth t WHERE t.source = d.source AND t.target = d.target)""",
    SCORED + [TRUTH]))
def q_recommend(spark, d):
    """Every paper's predicted-positive true citations, with the cited title."""
    return R.recommend_citations(decisions(spark, d), und(spark, d), V.papers(spark, d))


@register("edges_of", V.sql_with(VIEWS, """
    SELECT source, target FROM truth WHERE source = (SELECT min(source) FROM truth)""", SCORED + [TRUTH]))
def q_edges_of(spark, d):
    """The true links of one paper (the paper with the smallest id that has links)."""
    t = und(spark, d)
    first = t.agg(F.min("source")).first()[0]
    return M.edges_of(t, first).select("source", "target")


@register("metrics_report", V.sql_with(VIEWS, """
    SELECT 'precision' AS metric, round(coalesce(tp / nullif(tp + fp, 0), 0), 4) AS value FROM c
    UNION ALL SELECT 'recall', round(coalesce(tp / nullif(tp + fn, 0), 0), 4) FROM c
    UNION ALL SELECT 'f1', round(coalesce(2.0 * tp / nullif(2 * tp + fp + fn, 0), 0), 4) FROM c""",
    SCORED + [("c", """SELECT count(*) FILTER (WHERE label = 1 AND pred = 1) AS tp,
                              count(*) FILTER (WHERE label = 0 AND pred = 1) AS fp,
                              count(*) FILTER (WHERE label = 1 AND pred = 0) AS fn FROM dec""")]))
def q_metrics_report(spark, d):
    """S11 + F12: the printed report as a table: one row per metric, shown to 4 decimals."""
    from citegraph.functions.text import format_metric

    f = M.f1(decisions(spark, d))
    return f.select(F.expr("stack(3, 'precision', precision, 'recall', recall, 'f1', f1) AS (metric, value)")) \
        .select("metric", format_metric("value").alias("value"))
