"""A hand-made label set, counts worked out beside it; area against the rank statistic."""

import math

import pytest

from citegraph.operators import metrics as M

# 3 true positives, 2 false negatives, 1 false positive, 4 true negatives
CELLS = {(1, 1): 3, (1, 0): 2, (0, 1): 1, (0, 0): 4}


@pytest.fixture
def labels(spark):
    rows = [cell for cell, n in CELLS.items() for _ in range(n)]
    return spark.createDataFrame(rows, "label int, pred int")


def test_confusion_counts(labels):
    rows = {r["actual"]: (r["pred_0"], r["pred_1"]) for r in M.confusion_matrix(labels).collect()}
    assert rows == {0: (4, 1), 1: (2, 3)}


def test_f1_by_hand(labels):
    r = M.f1(labels).first()
    assert math.isclose(r["precision"], 3 / 4)
    assert math.isclose(r["recall"], 3 / 5)
    assert math.isclose(r["f1"], 2 / 3)  # 2 * 3 / (2 * 3 + 1 + 2)


def test_auc_matches_rank_statistic(spark):
    import random

    rnd = random.Random(7)
    rows = [(rnd.randint(0, 1), round(rnd.random(), 2)) for _ in range(300)]
    df = spark.createDataFrame(rows, "label int, score double")
    got = M.auc(df).first()["auc"]
    pos = [s for y, s in rows if y == 1]
    neg = [s for y, s in rows if y == 0]
    want = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
    assert math.isclose(got, want, rel_tol=1e-12)


def test_auc_on_thresholded_labels(spark):
    # the reference fed 0/1 predictions: area = (1 + TPR - FPR) / 2
    df = spark.createDataFrame([(1, 1), (1, 1), (1, 0), (0, 0), (0, 1)], "label int, score int")
    tpr, fpr = 2 / 3, 1 / 2
    assert math.isclose(M.auc(df).first()["auc"], (1 + tpr - fpr) / 2)


def test_recommendation_quality_edges(spark):
    recs = spark.createDataFrame([(1, 10), (1, 11), (2, 12)], "query_id long, rec_id long")
    truth = spark.createDataFrame([(1, 10), (1, 13)], "source long, target long")
    q = {r["query_id"]: r for r in M.recommendation_quality(recs, truth).collect()}
    assert q[1]["n_matched"] == 1 and q[1]["precision"] == 0.5 and q[1]["recall"] == 0.5
    assert q[2]["recall"] is None and q[2]["f1"] is None  # no truth (Q9)


def test_label_truth_unscored_is_null(spark):
    truth = spark.createDataFrame([(1, 2), (1, 3)], "source long, target long")
    dec = spark.createDataFrame([(1, 2, 1), (1, 2, 0)], "source long, target long, pred int")
    lab = {r["target"]: r["pred"] for r in M.label_truth(truth, dec).collect()}
    assert lab == {2: 1, 3: None}
