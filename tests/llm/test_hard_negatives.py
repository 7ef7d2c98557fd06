import random

import numpy as np
import pytest
from pyspark.sql import functions as F

SCHEMA = "vec_id long, label int, embedding array<float>, id string, rid string, v string, near string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", "x", "x", "x") for r in rows], SCHEMA).repartition(3)


def brute(rows, anchor, positives=5, negatives=10, scale=256):
    """Every pair scored with Python integers."""
    ok = [(i, y, [int(np.floor(scale * float(np.float32(x)))) for x in v]) for i, y, v in rows if i is not None and y is not None
          and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for k, (i, y, v) in enumerate(ok):
        if not anchor(i):
            continue
        scored = sorted((-sum(a * b for a, b in zip(v, w)), j, z == y) for n, (j, z, w) in enumerate(ok) if n != k)
        for s, p, _ in [x for x in scored if x[2]][:positives]:
            near = [(j, -t) for t, j, same in scored if not same and 30 * -s <= 100 * -t <= 90 * -s][:negatives]
            out += [(i, p, r, j, -s, t) for r, (j, t) in enumerate(near, 1)]
    return sorted(out)


def vectors(n, dims=8, seed=0, size=0.5):
    r = random.Random(seed)
    return [(i, r.randrange(4) if i % 3 else 1, [r.uniform(-size, size) for _ in range(dims)]) for i in range(n)]


def mined(df, **kw):
    from citegraph.llm.hard_negatives import mine_hard_negatives

    return sorted(map(tuple, mine_hard_negatives(df, F.col("vec_id") % 10 == 0, **kw).collect()))


def test_equals_brute_force(spark):
    rows = vectors(200)
    rows += [rows[20], rows[33], rows[33], (40, 1, rows[41][2]), (500, None, rows[1][2]), (510, 1, None), (None, 1, rows[1][2]),
             (520, 1, [0.1, None]), (530, 1, [float("nan")] * 8), (540, 2, [float("inf")] * 8), (550, 3, []), (560, 1, [0.4] * 3)]
    rows += [(600 + i, i % 2, [0.25] * 8) for i in range(40)]  # ties
    want = brute(rows, lambda i: i % 10 == 0)
    assert want and mined(frame(spark, rows)) == want


def test_blocks_and_few_rows(spark, monkeypatch):
    from citegraph.llm import hard_negatives as h

    rows = vectors(150, seed=1) + [(7000, 9, [0.1] * 8)]  # an anchor that is alone with its label
    monkeypatch.setattr(h, "ANCHORS", 4)
    monkeypatch.setattr(h, "ROWS", 20)
    assert mined(frame(spark, rows), positives=3, negatives=4) == brute(rows, lambda i: i % 10 == 0, 3, 4)
    assert mined(frame(spark, [])) == [] and mined(frame(spark, rows[1:9])) == []


def test_large_components(spark):
    """Fields wider than a double's 53 bits: Python integers."""
    rows = vectors(60, dims=3, seed=2, size=3e5)
    assert mined(frame(spark, rows), scale=1 << 8) == brute(rows, lambda i: i % 10 == 0)
    with pytest.raises(Exception, match="beyond a long"):
        mined(frame(spark, [(i, 1, [3e17, 1.0]) for i in range(20)]))


@pytest.mark.parametrize("size", [1, 40, 300, 40000, 2 ** 30, 2 ** 40])
def test_packed_scores(size):
    from citegraph.llm.hard_negatives import Packed

    r = np.random.default_rng(size)
    a, b = (r.integers(-size, size + 1, (n, 5)) for n in (7, 130))
    want = [[sum(int(x) * int(y) for x, y in zip(p, q)) for q in b] for p in a]
    if size < 2 ** 31:
        assert Packed(b, int(a.min()), int(a.max())).scores(a).tolist() == want
    else:
        with pytest.raises(OverflowError):
            Packed(b, int(a.min()), int(a.max())).scores(a)
