import random
import re

import pytest

from tests.llm.helpers import clashing, frame

WORD = "[^\x00-\x2f\x3a-\x60\x7b-\x7f]+"


def tokens(t):
    return re.findall(WORD, "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))


def brute(docs, items, window=10):
    wins = [(i, w[s:s + min(len(w), window)]) for i, t in items if i is not None for w in [tokens(t)] if w
            for s in range(max(1, len(w) - window + 1))]
    out = []
    for d, t in docs:
        w, hit, found = tokens(t), set(), set()
        for i, g in wins:
            for s in range(len(w) - len(g) + 1):
                if w[s:s + len(g)] == g:
                    hit.update(range(s, s + len(g)))
                    found.add(i)
        out.append((d, len(w), len(hit), tuple(sorted(found))))
    return sorted(out, key=str)


def cases(seed=3):
    r = random.Random(seed)
    some = lambda n: " ".join(r.choice("a b c d e f g é 12".split()) for _ in range(n))
    items = [(i, some(r.choice([12, 15, 30]))) for i in range(20)]
    items += [(20, "only three words"), (21, "A, b; C"), (22, None), (23, ""), (24, "!!"), (None, "g g g g g g g g g g g"),
              (1, items[1][1]), (25, items[2][1])]
    docs = []
    for i in range(80):
        parts = [some(r.randrange(60))]
        if i % 2:
            w = items[r.randrange(20)][1].split()
            s = r.randrange(len(w) - 9)
            parts.append("\n".join(w[s:s + r.choice([9, 10, 12])]).upper())
        docs.append((i, " x, ".join([*parts, some(20)])))
    docs += [(100, None), (101, ""), (102, "Only THREE-words"), (103, "x" * 300_000), (None, items[0][1]), (0, items[0][1])]
    docs += [(104, (items[3][1] + " zzz ") * 2000)]
    return docs, items


@pytest.mark.parametrize("block_bytes", [1 << 20, 300])
def test_hits_match_brute_force(spark, block_bytes):
    from citegraph.llm.decontaminate import find_contamination

    docs, items = cases()
    got = find_contamination(clashing(frame(spark, docs), "items", "spans", "id", "n_hit"),
                             clashing(spark.createDataFrame(items, "item_id long, text string"), "id"), block_bytes=block_bytes)
    rows = got.collect()
    assert sorted(((r.doc_id, r.n_words, r.n_hit, tuple(r["items"])) for r in rows), key=str) == brute(docs, items)
    assert all(sum(s.end - s.start for s in r.spans) == r.n_hit for r in rows)


def test_removal(spark):
    from citegraph.llm.decontaminate import remove_contamination

    docs, items = cases()
    long = [(i, t) for i, t in items if len(tokens(t)) > 9]
    src = clashing(frame(spark, docs), "words")
    out = remove_contamination(src, spark.createDataFrame(long, "item_id long, text string"))
    assert out.columns == src.columns
    rows = [(r.doc_id, r.text) for r in out.collect()]
    assert not any(n for _, _, n, _ in brute(rows, long))
    hit = {d: (n, h) for d, n, h, _ in brute(docs, long) if d not in (0, None)}
    left = dict(r for r in rows if r[0] not in (0, None))
    assert 104 not in left and left[100] is None and left[101] == ""
    for d, t in docs:
        if d in hit and not hit[d][1]:
            assert left[d] == t  # clean documents stay as they are


def test_removal_does_not_depend_on_the_blocks(spark):
    """Cutting item B joins the halves of item A, which may be in a block that has passed: nothing is left with any number of
    blocks, and the texts are the same."""
    from citegraph.llm.decontaminate import Blocks, remove_contamination

    items = [(k, " ".join(f"{c}{k}x{i}" for i in range(12))) for k in range(6) for c in "a"]
    items += [(10 + k, " ".join(f"b{k}x{i}" for i in range(12))) for k in range(6)]
    filler = " ".join(f"f{i}" for i in range(60))
    docs = []
    for d in range(30):
        a, b = items[d % 6][1].split(), items[6 + d % 5][1].split()
        docs.append((d, f"{filler} " + " ".join(a[:6] + b + a[6:]) + f" end{d}"))
    table = spark.createDataFrame(items, "item_id long, text string")
    out = []
    for size in (1 << 23, 300, 100):
        blocks = Blocks(table, 10, size, "item_id", "text").n
        assert (blocks == 1) == (size > 1000)
        left = {r.doc_id: r.text for r in remove_contamination(clashing(frame(spark, docs), "words"), table, block_bytes=size).collect()}
        assert len(left) == 30 and not any(n for _, _, n, _ in brute(left.items(), items))
        out.append({d: t.split() for d, t in left.items()})
    assert out[0] == out[1] == out[2]


def test_empty_tables(spark):
    from citegraph.llm.decontaminate import find_contamination, remove_contamination

    none = spark.createDataFrame([], "item_id long, text string")
    docs = frame(spark, [(1, "a b c")])
    assert [(r.n_words, r.n_hit) for r in find_contamination(docs, none).collect()] == [(3, 0)]
    assert remove_contamination(docs, none).count() == 1
    assert find_contamination(frame(spark, []), none).count() == 0
