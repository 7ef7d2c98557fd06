import os
import random
import struct

import numpy as np
import pytest

from tests.llm.helpers import clashing, frame

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
TEXTS = ["", " ", "Hello  world\n a\tb ñ 𝔘 ", "x" * 300, "aab" * 200, "é Ａ　 \x00 a\x00", "   lead", "a\r\nb\n\n", "the " * 500,
         "<s> <0x41> </s>", "ab" * 40 + " " + "-" * 100, "1234567890 3.14", "ﬁ ​"]


@pytest.fixture(scope="module")
def library():
    sp = pytest.importorskip("sentencepiece")
    if not os.path.exists(MODEL):
        pytest.skip("no tokenizer file")
    return sp.SentencePieceProcessor(model_file=MODEL)


def plain(model, text):
    words = model.word.findall(model.normalise(text)) if text else []
    return np.frombuffer(b"".join(model.encode_words(words)), np.int32).tolist()


def test_ids_equal_the_library(spark, library):
    from citegraph.llm.sentencepiece import LONG, Model, decode, encode

    r = random.Random(0)
    texts = TEXTS + ["".join(chr(r.choice([32, 10, 97, 98, 101, 116, 0xE9, 0x4E2D, 0x1F600, 0x2581])) for _ in range(r.randrange(90)))
                     for _ in range(60)] + ["".join(r.choice("the in er") for _ in range(LONG + 40))]
    model = Model.read(MODEL)
    assert [plain(model, t) for t in texts] == [library.encode(t) for t in texts]
    rows = list(enumerate(texts)) + [(None, "no id"), (0, ""), (999, None)]
    df = decode(encode(clashing(frame(spark, rows), "ids", "decoded"), model), model)
    for x in df.collect():
        if x.text is None:
            assert x.ids is None and x.decoded is None
        else:
            assert x.ids == library.encode(x.text) and x.decoded == library.decode(x.ids)
            assert x.decoded == x.text or "▁" in x.text
    assert encode(frame(spark, []), model).count() == 0


def unigram():
    from citegraph.llm.sentencepiece import BYTE, CONTROL, NORMAL, UNIGRAM, UNKNOWN, Model

    r = random.Random(4)
    pieces = [("<unk>", 0.0, UNKNOWN), ("<s>", 0.0, CONTROL)]
    subs = {"".join(r.choice("abc") for _ in range(r.randrange(1, 5))) for _ in range(40)} | {"▁", "a", "b", "▁a", "▁ab"}
    pieces += [(p, -r.random() * 10, NORMAL) for p in sorted(subs)]
    return Model(pieces, UNIGRAM, squeeze=False), pieces, BYTE


def test_viterbi_matches_exhaustive_search():
    model, pieces, _ = unigram()
    score = {p: float(np.float32(s)) for p, s, t in pieces if t == 1}
    worst = min(score.values()) - 10

    def best(word):
        top = [(0.0, [])]
        for e in range(1, len(word) + 1):
            cand = [(top[s][0] + score.get(word[s:e], worst if e == s + 1 else -1e18), [*top[s][1], word[s:e]]) for s in range(e)]
            top.append(max(cand, key=lambda c: c[0]))
        return top[-1]

    r = random.Random(1)
    words = list({"".join(r.choice("▁abcd")[0] for _ in range(r.randrange(1, 12))) for _ in range(300)})
    for w, ids in zip(words, model.encode_words(words)):
        total, cut = best(w)
        known = [pieces[i][0] for i in np.frombuffer(ids, np.int32) if i != model.unk]
        assert [c for c in cut if c in score] == known, (w, cut, total)


def field(n, kind, value):
    """A field of a model file."""
    def varint(x):
        out = b""
        while x > 127:
            out += bytes([x & 127 | 128])
            x >>= 7
        return out + bytes([x])

    head = varint(n << 3 | kind)
    return head + (varint(len(value)) + value if kind == 2 else struct.pack("<f", value) if kind == 5 else varint(value))


def test_unigram_file_and_library(tmp_path, library):
    """A hand-made unigram model file: the same ids as the library."""
    import sentencepiece as sp

    from citegraph.llm.sentencepiece import Model

    _, pieces, _ = unigram()

    data = b"".join(field(1, 2, field(1, 2, p.encode()) + field(2, 5, s) + field(3, 0, t)) for p, s, t in pieces)
    data += field(2, 2, field(3, 0, 1)) + field(3, 2, field(1, 2, b"identity") + field(3, 0, 1) + field(4, 0, 0) + field(5, 0, 1))
    path = tmp_path / "u.model"
    path.write_bytes(data)
    own, other = Model.read(str(path)), sp.SentencePieceProcessor(model_file=str(path))
    r = random.Random(3)
    for _ in range(200):
        t = "".join(r.choice("ab cd") for _ in range(r.randrange(20)))
        assert plain(own, t) == other.encode(t), t


def test_registered_path_equals_the_library(spark, tmp_path, library, monkeypatch):
    """The registered query's unigram model through Viterbi: ids as the library gives them for the same model, and the
    texts come back."""
    import hashlib

    import sentencepiece as sp

    from citegraph.llm import queries
    from citegraph.llm.sentencepiece import BYTE, LONG, NORMAL, Model, decode, encode, fields

    own = Model.read(MODEL, unigram=True)
    data, k = b"", 0
    for n, value in fields(open(MODEL, "rb").read()):
        if n == 1:
            f = dict(fields(value))
            t = f.get(3, NORMAL)
            data += field(1, 2, field(1, 2, f.get(1, b"")) + field(2, 5, float(own.scores[k])) + field(3, 0, t))
            k += 1
    data += field(2, 2, field(3, 0, 1) + field(35, 0, 1))
    data += field(3, 2, field(1, 2, b"identity") + field(3, 0, 1) + field(4, 0, 0) + field(5, 0, 1))
    path = tmp_path / "zipf.model"
    path.write_bytes(data)
    other = sp.SentencePieceProcessor(model_file=str(path))
    assert BYTE and np.isclose(np.exp(own.scores[sorted(own.ids.values())].astype(float)).sum(), 1, atol=1e-3)
    r = random.Random(5)
    texts = TEXTS + ["".join(chr(r.choice([32, 10, 97, 98, 101, 116, 104, 0xE9, 0x4E2D, 0x1F600])) for _ in range(r.randrange(90)))
                     for _ in range(60)] + ["".join(r.choice("thein") for _ in range(LONG * 3)), "internationalisation of words"]
    want = [other.encode(t) for t in texts]
    assert [plain(own, t) for t in texts] == want
    assert want[-1] != library.encode(texts[-1]) or want != [library.encode(t) for t in texts]  # another cut than by merges
    docs = frame(spark, list(enumerate(texts)) + [(1000, None)])
    got = {x.doc_id: x for x in decode(encode(docs, own), own).collect()}
    assert [got[i].ids for i in range(len(texts))] == want and got[1000].ids is None
    both = encode(clashing(docs, "decoded"), own, decoded_col="decoded").collect()  # in one pass
    assert {x.doc_id: (x.ids, x.decoded) for x in both} == {i: (x.ids, x.decoded) for i, x in got.items()}
    assert all(x.decoded == x.text for x in got.values())
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    for x in queries.op4_sentencepiece(spark, str(tmp_path)).collect():
        ids = want[x.doc_id] if x.doc_id < 1000 else None
        assert x.round_trip and x.n_tokens == (len(ids) if ids is not None else -1) or x.doc_id == 1000
        if ids is not None:
            assert x.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()


def test_long_words_and_full_cache(spark, monkeypatch):
    """One by one or together, with or without a cache: the same cut."""
    from citegraph.llm import sentencepiece as m

    model, r = unigram()[0], random.Random(9)
    words = ["".join(r.choice("abcd") for _ in range(r.randrange(1, 60))) for _ in range(80)]
    together = model.encode_words(words)
    monkeypatch.setattr(m, "LONG", 0)
    assert model.encode_words(words) == together
    rows = [(i, " ".join(words[i:i + 5])) for i in range(75)]
    want = {x.doc_id: x.ids for x in m.encode(frame(spark, rows), model).collect()}
    monkeypatch.setattr(m, "CACHED_BYTES", 1)
    assert {x.doc_id: x.ids for x in m.encode(frame(spark, rows), model).collect()} == want
