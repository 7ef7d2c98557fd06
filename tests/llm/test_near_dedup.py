import random

import numpy as np
import pytest

from tests.llm.helpers import clashing, frame, near_components, shingles, words


def corpus(seed=5):
    r = random.Random(seed)
    base = [words(r.choice([8, 40, 120]), seed=s) for s in range(12)]
    rows = []
    for i in range(150):
        w = list(r.choice(base[:3] if i % 3 else base))
        for _ in range(r.choice([0, 1, 2, 4, 8, 12])):
            w[r.randrange(len(w))] = f"new{r.randrange(10_000)}"
        rows.append((i, " ".join(w) if i % 7 else "\n".join(w).upper()))
    rows += [(200, None), (201, ""), (202, " \t"), (203, "one"), (204, "One"), (205, "two words"), (206, "two  WORDS"),
             (207, " ".join(words(30_000, 20_000, seed=9))), (208, " ".join(words(30_000, 20_000, seed=9)) + " end"),
             (None, rows[3][1]), (None, None), (3, rows[3][1]), (5, "quite another text")]
    return rows


@pytest.mark.parametrize("k", [2, 5])
def test_components_match_all_pairs(spark, k):
    from citegraph.llm.near_dedup import near_groups

    rows = corpus()
    want = near_components(rows, k)
    got = near_groups(clashing(frame(spark, rows), "id", "rep", "kept"), shingle_words=k).collect()
    assert len(got) == len(rows)
    assert sorted(((r.doc_id, r.n_shingles) for r in got), key=str) == sorted(((i, len(shingles(t, k))) for i, t in rows), key=str)
    for r in got:
        assert r.component_id == want.get(r.doc_id)
        assert r.kept == (r.doc_id is None or r.doc_id == r.component_id)


def test_large_group_around_the_threshold(spark):
    """One group of edited copies, many of which are not linked to its centre."""
    from citegraph.llm.near_dedup import near_groups

    r, base, rows = random.Random(8), words(150, 5000, seed=1), []
    for i in range(300):
        w = list(base)
        for p in r.sample(range(150), r.randrange(14)):
            w[p] = f"x{i}y{p}"
        rows.append((1000 - i, " ".join(w)))
    got = {r.doc_id: r.component_id for r in near_groups(frame(spark, rows, 5), shingle_words=2).collect()}
    assert got == near_components(rows, 2)


def test_empty_and_keep_one(spark):
    from citegraph.llm.near_dedup import keep_one, near_groups

    assert near_groups(frame(spark, [])).count() == 0
    docs = frame(spark, [(1, "a b c d e f g h"), (2, "A b c d e f g h"), (3, None), (None, "z"), (4, "other")])
    kept = keep_one(docs, near_groups(docs))
    assert kept.columns == docs.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == [1, 3, 4, None]


def test_signatures_estimate_similarity_with_less_variance():
    from citegraph.llm.near_dedup import signatures

    rng, got = np.random.default_rng(0), []
    for _ in range(150):
        u = rng.integers(0, 2**63, 200).astype(np.uint64)
        a, b = signatures([u[:150], u[50:]], 128)
        got.append((a == b).mean())
    assert abs(np.mean(got) - 0.5) < 0.015
    assert np.std(got) < np.sqrt(0.25 / 128)  # plain MinHash
    sizes = [1, 2, 500, 90_000]  # one element fills all slots; sets larger than a block
    sig = signatures([np.arange(1, n + 1, dtype=np.uint64) for n in sizes], 64)
    assert (sig < np.iinfo(np.uint64).max).all()


def test_components_of_chains(spark):
    from citegraph.llm.common import Stored
    from citegraph.llm.components import components

    chain = [(i, i + 1) for i in range(0, 300)] + [(1000 + i, 1000) for i in range(50)] + [(7, 7), (2000, 2001), (2001, 2000)]
    random.Random(0).shuffle(chain)
    edges = spark.createDataFrame(chain, "a long, b long").repartition(6)
    got = {r.node: r.root for r in components(edges, Stored(spark), "t").collect()}
    assert got == {**{i: 0 for i in range(1, 301)}, **{1000 + i: 1000 for i in range(1, 50)}, 2001: 2000}
