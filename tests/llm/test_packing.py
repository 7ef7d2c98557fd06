import itertools
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from tests.llm.helpers import clashing, frame

FILE = "/opt/tokenizers/byte_bpe_50k.json"


@pytest.fixture(scope="module")
def tokenizer():
    from citegraph.llm.byte_bpe import ByteBpe

    return ByteBpe.read(FILE)


def used(plan, capacity):
    out = Counter()
    for filling, times in plan:
        assert sum(s * k for s, k in filling) <= capacity and times > 0
        for s, k in filling:
            out[s] += k * times
    return out


def fewest(sizes, capacity):
    """The least number of bins, all assignments tried."""
    best = len(sizes)

    def go(i, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if i == len(sizes):
            best = len(bins)
            return
        for k in range(len(bins)):
            if bins[k] + sizes[i] <= capacity and bins[k] not in bins[:k]:
                go(i + 1, bins[:k] + [bins[k] + sizes[i]] + bins[k + 1:])
        go(i + 1, bins + [sizes[i]])

    go(0, [])
    return best


def test_bin_completion_is_optimal_on_small_lists():
    from citegraph.llm.packing import best_fit, bin_completion, lower_bound

    r, better = random.Random(5), 0
    for _ in range(150):
        capacity = r.choice([20, 50, 100])
        sizes = sorted((r.randrange(1, capacity * r.choice([4, 7, 10]) // 10 + 1) for _ in range(r.randrange(1, 12))), reverse=True)
        counts = Counter(sizes)
        plan = bin_completion(counts, capacity)
        number = sum(m for _, m in plan)
        assert used(plan, capacity) == counts
        assert lower_bound(counts, capacity) <= number == fewest(sizes, capacity)
        fit = best_fit(counts, capacity)
        assert used(fit, capacity) == counts
        better += number < sum(m for _, m in fit)
    assert better
    assert bin_completion({}, 10) == []


def test_best_fit_equals_one_by_one():
    from citegraph.llm.packing import best_fit

    r = random.Random(8)
    for _ in range(40):
        sizes = sorted((r.randrange(1, 60) for _ in range(80)), reverse=True)
        bins = []
        for s in sizes:
            open_ = [b for b in bins if sum(b) + s <= 100]
            (max(open_, key=sum) if open_ else bins.append([]) or bins[-1]).append(s)
        got = Counter()
        for filling, times in best_fit(Counter(sizes), 100):
            got[100 - sum(s * k for s, k in filling)] += times
        assert got == Counter(100 - sum(b) for b in bins)


def test_dominated_fillings_are_left_out():
    from citegraph.llm.packing import fillings

    counts = Counter([7, 6, 5, 3, 3, 1])
    got = list(fillings(9, counts, 9))
    assert got[0][1] == 0 and (((6, 1), (3, 1)), 0) in got
    assert (((5, 1), (3, 1), (1, 1)), 0) not in got  # 6 stands for 5 and 1
    assert all(sum(s * k for s, k in f) + w == 9 for f, w in got)
    assert list(fillings(7, counts, 7)) == [(((7, 1),), 0)]


def texts():
    r = random.Random(1)
    word = lambda: "".join(r.choice("abcdeé ") for _ in range(r.randrange(1, 9)))
    rows = [(i, " ".join(word() for _ in range(r.choice([3, 30, 200, 700])))) for i in range(60)]
    rows += [(100, None), (101, ""), (102, "<|endoftext|> it's 漢字 😀\x00"), (103, "word " * 6000), (None, "no id"), (5, "other text"),
             (5, "other text"), (104, " a" * 2047), (105, " a" * 2048), (106, " a" * 4095)]
    return rows


def want_pieces(rows, capacity):
    """Pieces by the tokenizers library."""
    from tokenizers import Tokenizer

    t, out = Tokenizer.from_file(FILE), []
    for i, text in rows:
        ids = t.encode(text or "", add_special_tokens=False).ids + [0]
        first = len(ids) % capacity or capacity
        for k, a in enumerate([0, *range(first, len(ids), capacity)]):
            part = ids[a:first] if k == 0 else ids[a:a + capacity]
            out.append((i, k, a, len(part), zlib.crc32(np.array(part, "<u4").tobytes()), part))
    return out


def key(x):
    return tuple((v is None, v) for v in x)


@pytest.mark.parametrize("bucket", [1 << 16, 7])
def test_documents(spark, tokenizer, monkeypatch, bucket):
    from citegraph.llm import packing

    monkeypatch.setattr(packing, "BUCKET", bucket)
    rows = texts()
    docs = clashing(frame(spark, rows), "rid", "rank", "length", "ids", "piece")
    placed = packing.place(packing.token_pieces(docs, tokenizer, keep_ids=True)).cache()
    got = placed.collect()
    want = want_pieces(rows, 2048)
    assert sorted(((r.id, r.piece, r.start, r.length, r.ids_crc32, tuple(r.ids)) for r in got), key=key) == \
        sorted(((*w[:5], tuple(w[5])) for w in want), key=key)
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length, r.ids))
    for parts in by.values():
        end = 0
        for offset, length, _ in sorted(parts):
            assert offset == end
            end += length
        assert end <= 2048
    counts = Counter(w[3] for w in want)
    assert len(by) == packing.lower_bound(counts, 2048)
    whole = {r.sequence_id: r for r in packing.sequences(placed).collect()}
    assert {k: list(itertools.chain.from_iterable(x[2] for x in sorted(p))) for k, p in by.items()} == {k: r.ids for k, r in whole.items()}


def test_empty_table_and_wrong_input(spark, tokenizer):
    from citegraph.llm.packing import place, token_pieces

    assert place(token_pieces(frame(spark, []), tokenizer)).count() == 0
    with pytest.raises(ValueError):
        place(spark.createDataFrame([(3000,)], "length long"))
    other = spark.createDataFrame([("x", 3), ("y", 4), (None, 5)], "name string, length long")
    assert place(other, capacity=8).columns == ["name", "length", "sequence_id", "offset"]


def test_encoder_equals_the_tokenizers_library(tokenizer):
    from tokenizers import Tokenizer

    t, r = Tokenizer.from_file(FILE), random.Random(3)
    marks = ["a", "Z", "9", " ", "  ", "\n", "\t", "'s", "'ll", "é", "ß", "漢", "😀", "‍", "\x00", "<|endoftext|>", "!", "▁"]
    for _ in range(500):
        text = "".join(r.choice(marks) for _ in range(r.randrange(40)))
        assert tokenizer.encode(text, special=True).tolist() == t.encode(text, add_special_tokens=False).ids
    plain = Tokenizer.from_file(FILE)
    plain.encode_special_tokens = True
    text = "a <|endoftext|> b"
    assert tokenizer.encode(text).tolist() == plain.encode(text, add_special_tokens=False).ids
    assert b"".join(map(tokenizer.token_bytes().__getitem__, tokenizer.encode(text))) == text.encode()
