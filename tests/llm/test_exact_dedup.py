import hashlib
import random
import re

from tests.llm.helpers import clashing, frame


def brute(rows):
    norm = [(i, re.sub("[\x20\x09-\x0d]+", " ", t or "")) for i, t in rows]
    groups = {}
    for i, t in norm:
        groups.setdefault(t, []).append(i)
    out = []
    for i, t in norm:
        ids = [x for x in groups[t] if x is not None]
        out.append((i, min(ids) if ids else None, len(groups[t]), hashlib.sha256(t.encode()).hexdigest()))
    return sorted(out, key=str)


def check(spark, rows, partitions=3):
    from citegraph.llm.exact_dedup import exact_groups

    got = exact_groups(clashing(frame(spark, rows, partitions), "kept", "prefix", "id", "sha")).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=str) == brute(rows)
    kept = [r for r in got if r.kept]
    assert len(kept) == len({r.text_sha256 for r in got})
    assert all(r.doc_id == r.keep_id for r in kept)


def test_groups_match_brute_force(spark):
    r = random.Random(1)
    texts = ["a b", "a  b", "a\tb\n", "", " ", None, "é", "x" * 200_000, "x" * 199_999 + "y", "p" * 40 + "1", "p" * 40 + "2"]
    rows = [(i, r.choice(texts) if i % 3 else "hot copy " * 9) for i in range(400)]
    rows += [(7, "same row")] * 3 + [(None, "no id"), (None, "no id"), (None, "a b"), (-5, "a b")]
    check(spark, rows, 7)


def test_one_group_over_all_partitions(spark):
    check(spark, [(i, "the very same text") for i in range(3000)] + [(5000, "another")], 9)


def test_empty_table(spark):
    check(spark, [])
