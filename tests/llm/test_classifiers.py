import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from tests.llm.helpers import clashing, frame

LANGS = {"aa": "ba da ga la ma na ra".split(), "bb": "strok plinz krant drumpf zwelt".split(), "cc": "öé üà ñó éç ùê".split()}
ODD = [(900, None), (901, ""), (902, " \n"), (903, "1234 !!"), (904, "w" * 300_000), (None, "ba da"), (5, "ba da ga")]


def fold(i, n):
    return zlib.crc32(str(i).encode()) % n


def texts(n=240, seed=0):
    r = random.Random(seed)
    return [(i, lang, " ".join(r.choice(v) for _ in range(r.randrange(5, 60)))) for i in range(n) for lang, v in [list(LANGS.items())[i % 3]]]


def test_ngram_counts_and_chunks(monkeypatch):
    from citegraph.llm import ngrams

    col = pa.array(["abcabc", None, "", "é", "xyz" * 50, "a"])
    whole = ngrams.counts(col, (1, 2, 3), 10)
    for k, t in enumerate(col.to_pylist()):
        size = len((t or "").encode())
        assert whole[k].sum() == sum(max(0, size - n + 1) for n in (1, 2, 3))
    monkeypatch.setattr(ngrams, "CHUNK", 7)
    assert (ngrams.counts(col, (1, 2, 3), 10) == whole).all()
    assert (ngrams.counts(col.slice(2, 3), (1, 2, 3), 10) == whole[2:5]).all()


def test_language(spark):
    from pyspark.sql import functions as F

    from citegraph.llm import langid

    rows = texts()
    df = spark.createDataFrame([(i, t, lang if i % 5 else None) for i, lang, t in rows]
                               + [(i, t, None) for i, t in ODD] + [(905, "яблоко груша слива", None)], "doc_id long, text string, lang string")
    model = langid.fit(df.where(F.expr("crc32(cast(doc_id as string)) % 4 <> 2")))
    src = clashing(df, "has_letter", "score")
    got = langid.predict(src, model).collect()
    assert len(got) == len(rows) + len(ODD) + 1
    by = {r.doc_id: r for r in got if r.doc_id not in (5, None)}
    assert all(by[i].lang_pred == lang and not by[i].rejected for i, lang, _ in rows if i != 5)
    assert all(by[i].lang_pred == "und" and by[i].score == 0 and by[i].rejected for i in (900, 901, 902, 903))
    assert by[904].lang_pred in LANGS and by[905].rejected  # an unknown script is far from all centroids
    assert all(0 <= r.score <= 1 for r in got)
    empty = langid.fit(df.where("false"))
    assert {r.lang_pred for r in langid.predict(src, empty).collect()} == {"und"}
    assert langid.predict(src.where("false"), model).count() == 0


def test_clusters_find_separate_groups():
    from citegraph.llm.langid import cluster

    x = np.eye(6, dtype=np.float32)[np.arange(60) % 3]
    c, least = cluster(x, 3)
    assert len(c) == 3 and np.allclose(least, 1)
    c, _ = cluster(x[:1], 3)
    assert len(c) == 1


@pytest.mark.parametrize("name", ["quality", "toxicity"])
def test_labelled_scores(spark, name):
    import importlib

    from pyspark.sql import functions as F

    op = importlib.import_module(f"citegraph.llm.{name}")
    r = random.Random(1)
    rows, marks = [], []
    for i, _, t in texts(400, 2):
        y = i % 4 == 0
        w = t.split()
        if y:
            w.insert(r.randrange(len(w)), "scoundrel") if name == "toxicity" else w.extend(["%%%", "$$$"] * 8)
        rows.append((i, " ".join(w)))
        marks.append((i, int(y)))
    held = {i for i, _ in rows if fold(i, 5) == 0}
    # held-out labels are wrong on purpose: they must not be learnt from
    labels = spark.createDataFrame([(i, 1 - y if i in held else y) for i, y in marks] + [(None, 1), (3, None), (7, 0), (7, 0)],
                                   "doc_id long, y int")
    docs = clashing(frame(spark, rows + [(i, t) for i, t in ODD if i != 5]), "score", "id")
    model = op.fit(docs, labels, "y")
    got = {x.doc_id: x.score for x in op.predict(docs, model).collect()}
    assert len(got) == len(rows) + len(ODD) - 1 and all(0 <= s <= 1 for s in got.values())
    wrong = sum((got[i] >= 0.5) != bool(y) for i, y in marks if i in held)
    assert wrong <= 0.05 * len(held)
    assert op.predict(docs.where("false"), model).count() == 0
    one = op.fit(docs, labels.where(F.col("y") == 5), "y")
    assert {x.score for x in op.predict(docs, one).collect()} == {0.5}


def test_samples_are_bounded_in_rows(spark):
    """One id holds a third of all rows: it gives the sample one row, and the other labelled documents still count."""
    from citegraph.llm.labelled import labelled_sample

    rows = [(i, f"text {i}") for i in range(1, 61)] + [(1, f"copy {k}") for k in range(30)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(61)], "doc_id long, y int")
    got = labelled_sample(frame(spark, rows), labels, "y", 20, 5).collect()
    ids = [r.id for r in got]
    assert len(ids) == len(set(ids)) <= 40 and 1 in ids
    again = {(r.id, r.text) for r in labelled_sample(frame(spark, rows, 7), labels, "y", 20, 5).collect()}
    assert {(r.id, r.text) for r in got} == again  # the same row wherever it lies


# -- scores by plain Python loops

MIX = (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F, 0x165667B1)


def grams(text, ns, bits, keep):
    """bucket -> count of the hashed byte n-grams of a text."""
    data = bytes(keep(b) for b in (text or "").encode())
    out = {}
    for n in ns:
        for i in range(len(data) - n + 1):
            h = MIX[0] * n & 0xFFFFFFFF
            for j in range(n):
                h = (h ^ data[i + j]) * MIX[j % len(MIX)] & 0xFFFFFFFF
                h ^= h >> 15
            out[h >> (32 - bits)] = out.get(h >> (32 - bits), 0) + 1
    return out


def lower(b):
    return b + 32 if 0x41 <= b <= 0x5A else b


def letters(b):
    return lower(b) if b >= 0x80 or 0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A else 0x20


def unit(counts, idf):
    v = {k: np.log1p(n) * float(idf[k]) for k, n in counts.items()}
    size = np.sqrt(sum(x * x for x in v.values()))
    return {k: x / size for k, x in v.items()} if size else {}


def sample_texts():
    return [(i, t) for i, _, t in texts(200, 3)] + [(i, t) for i, t in ODD if i not in (904, 5, None)] + [(950, "Strok BA ga 12"), (951, "é" * 40)]


def test_language_by_brute_force(spark):
    from citegraph.llm import langid

    learn = spark.createDataFrame([(i, t, lang) for i, lang, t in texts()], "doc_id long, text string, lang string")
    model = langid.fit(learn)
    rows = sample_texts()
    for r in langid.predict(frame(spark, rows).select("doc_id", "text"), model).collect():
        v = unit(grams(r.text, langid.NS, langid.BITS, letters), model.idf)
        if not any(c.isalpha() for c in r.text or ""):
            assert (r.lang_pred, r.score, r.rejected) == ("und", 0, True)
            continue
        sim = [sum(x * float(c[k]) for k, x in v.items()) for c in model.centroids]
        best = int(np.argmax(sim))
        assert r.lang_pred == model.langs[best] and abs(r.score - min(1, max(0, sim[best]))) < 1e-5
        limit = model.limits[best, min(int(np.log2(len(r.text))), langid.SIZES - 1)]
        assert r.rejected == (sim[best] < limit) or abs(sim[best] - limit) < 1e-5


def test_quality_by_brute_force(spark):
    from citegraph.llm import quality

    rows, r = sample_texts(), random.Random(4)
    learn = [(i, t if i % 3 else t + " junk junk" * r.randrange(2, 9)) for i, _, t in texts(300, 6)]
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i, _ in learn], "doc_id long, y int")
    model = quality.fit(frame(spark, learn), labels, "y")
    for x in quality.predict(frame(spark, rows), model).collect():
        text = dict(rows)[x.doc_id]
        v, w = np.zeros(quality.WIDTH), (text or "").split()
        for k, value in unit(grams(text, quality.NS, quality.BITS, lambda b: b), model.idf).items():
            v[k] = value
        v[-1] = quality.REPEATS * sum(a == b for a, b in zip(w, w[1:])) / max(1, len(w))
        z = v @ model.basis.astype(float)
        z = z / max(np.linalg.norm(z), 1e-9)
        near = sorted(((float(z @ o), k) for k, o in enumerate(model.vectors.astype(float))), key=lambda s: -s[0])
        weight = [(max(s, 0) ** 4, model.y[k]) for s, k in near[:quality.VOTERS]]
        total = sum(a for a, _ in weight)
        want = sum(a * y for a, y in weight) / total if total > 1e-9 else model.y.mean()
        # neighbours of equal similarity may stand in for each other
        assert abs(x.score - want) < 1e-3 or near[quality.VOTERS - 1][0] - near[quality.VOTERS][0] < 1e-5


def test_toxicity_by_brute_force(spark):
    from citegraph.llm import toxicity

    rows = sample_texts()
    learn = [(i, t + (" scoundrel" if i % 4 == 0 else "")) for i, _, t in texts(300, 7)]
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i, _ in learn], "doc_id long, y int")
    model = toxicity.fit(frame(spark, learn), labels, "y")
    for x in toxicity.predict(frame(spark, rows), model).collect():
        held = {int(model.kept[k]) for k in grams(dict(rows)[x.doc_id], toxicity.NS, toxicity.BITS, lower)} - {len(model.weight)}
        z = sum(model.weight[k] for k in held) + model.bias
        assert abs(x.score - 1 / (1 + np.exp(-np.clip(z, -40, 40)))) < 1e-6
