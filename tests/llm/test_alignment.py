import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from tests.llm.helpers import clashing, frame

A, B = "/opt/tokenizers/byte_bpe_50k.json", "/opt/tokenizers/piece_bpe_32k.model"


def brute(rows):
    """Per row (id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups), by the two libraries and plain loops."""
    import sentencepiece
    from tokenizers import Tokenizer

    ta, tb = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    ta.encode_special_tokens = True
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    byte_of = {chr(b): b for b in printable}
    byte_of |= {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in printable)}
    spell_b = lambda i: bytes([int(tb.id_to_piece(i)[3:5], 16)]) if tb.is_byte(i) else tb.id_to_piece(i).replace("▁", " ").encode()
    found = []
    for i, text in rows:
        groups = []
        if text:
            a, b = ta.encode(" " + text, add_special_tokens=False).ids, tb.encode(text)
            sa, sb = [bytes(byte_of[c] for c in ta.id_to_token(x)) for x in a], [spell_b(x) for x in b]
            if b"".join(sa) == b"".join(sb) == (" " + text).encode():
                ga, gb, j, ea, eb = [], [], 0, 0, 0
                for x, s in zip(a, sa):
                    ga.append(x)
                    ea += len(s)
                    while eb < ea:
                        gb.append(b[j])
                        eb += len(sb[j])
                        j += 1
                    if ea == eb:
                        groups.append((ga, gb))
                        ga, gb = [], []
                assert not ga and not gb
        found.append((i, groups))
    held = Counter(p for _, groups in found for p in {(x, y) for a, b in groups for x in a for y in b})
    most = {}
    for (x, _), n in held.items():
        most[x] = max(most.get(x, 0), n)
    out = []
    for i, groups in found:
        links = [(x, y) for a, b in groups for x in a for y in b]
        out.append((i, sum(len(a) for a, _ in groups), sum(len(b) for _, b in groups), len(groups), len(links),
                    sum(held[p] == most[p[0]] for p in links), sum(held[p] for p in links),
                    ";".join(f"{','.join(map(str, a))}|{','.join(map(str, b))}" for a, b in groups)))
    return out


def texts():
    r = random.Random(4)
    bits = ["the", "cat", "sat", "naïve", "漢字", "😀", "'s", "1234", "  ", "\n", "\t", "Straße", "of", "internationalisation", "!?", "x", "--", "<0x41>"]
    rows = [(i, " ".join(r.choice(bits) for _ in range(r.choice([1, 5, 60])))) for i in range(80)]
    rows += [(100, None), (101, ""), (102, " "), (103, "▁"), (104, "a ▁ b"), (105, "<|endoftext|> <s></s><unk>"), (106, "\x00 \x07"),
             (7, "the cat sat"), (7, "the cat sat"), (None, "the cat of"), (107, "=" * 5000), (108, "abcdefgh" * 3000), (109, "   lead and  trail  ")]
    return rows


def key(x):
    return tuple((v is None, v) for v in x)


@pytest.mark.parametrize("small", [False, True])
def test_equals_brute_force(spark, monkeypatch, small):
    from citegraph.llm import alignment as m

    if small:
        monkeypatch.setattr(m, "SLICE_ROWS", 3)
        monkeypatch.setattr(m, "EXPANDED", 4)
    rows = texts()
    docs = clashing(frame(spark, rows), "id", "pair", "n", "part", "groups", "most")
    got = m.align(docs, m.ByteSide(A), m.PieceSide(B))
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"]
    want = sorted(brute(rows), key=key)
    assert sorted(map(tuple, got.collect()), key=key) == want
    if small:
        hashed = m.align(docs, m.ByteSide(A), m.PieceSide(B), digest=True)
        assert sorted(map(tuple, hashed.collect()), key=key) == sorted(
            ((*w[:7], hashlib.sha256(w[7].encode()).hexdigest() if w[7] else "") for w in want), key=key)


def test_empty_tables(spark):
    from citegraph.llm import alignment as m

    assert m.align(frame(spark, []), m.ByteSide(A), m.PieceSide(B)).count() == 0
    nothing = m.align(frame(spark, [(1, None), (2, "")]), m.ByteSide(A), m.PieceSide(B))
    assert sorted(map(tuple, nothing.collect())) == [(1, 0, 0, 0, 0, 0, 0, ""), (2, 0, 0, 0, 0, 0, 0, "")]


def test_links_of_long_groups(monkeypatch):
    from citegraph.llm import alignment as m

    x = m.Aligner(m.ByteSide(A), m.PieceSide(B))
    r = np.random.default_rng(0)
    a, b = r.integers(0, 9, 60), r.integers(0, 9, 50)
    end_a, end_b = np.array([1, 40, 41, 60]), np.array([2, 30, 31, 50])
    want = Counter(p * len(x.bytes_b) + q for i, j, k, n in zip([0, *end_a], end_a, [0, *end_b], end_b) for p in a[i:j].tolist() for q in b[k:n].tolist())
    for size in (1 << 20, 500, 3):
        monkeypatch.setattr(m, "EXPANDED", size)
        keys, times = x.links(a, b, end_a, end_b)
        assert dict(zip(keys.tolist(), times.tolist())) == want


def test_groups_end_where_both_end():
    """Against the definition, tokens without bytes included; none where a side has no tokens."""
    from citegraph.llm import alignment as AL

    x, rng = AL.Aligner.__new__(AL.Aligner), np.random.default_rng(7)
    x.size_a, x.size_b = np.array([0, 1, 2, 5]), np.array([0, 1, 3, 4])
    for n, m in ((0, 0), (0, 3), (3, 0), *[(40, 45)] * 20):
        a, b = rng.integers(0, 4, n), rng.integers(0, 4, m)
        last = lambda sizes: {int(e): k + 1 for k, e in enumerate(np.cumsum(sizes))}
        at_a, at_b = last(x.size_a[a]), last(x.size_b[b])
        both = sorted(at_a.keys() & at_b.keys())
        got = x.groups(a, b)
        assert [g.tolist() for g in got] == [[at[e] for e in both] for at in (at_a, at_b)]
