import random

import pytest

from tests.llm.helpers import DOC, clean_lines, near_components, words
from tests.llm.test_decontaminate import brute, tokens


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """A small corpus with copies, repeated lines, benchmark passages and odd rows."""
    r = random.Random(6)
    path = str(tmp_path_factory.mktemp("corpus"))
    items = [(i, " ".join(f"bench{r.randrange(900)}" for _ in range(14))) for i in range(5)]
    rows = []
    for i in range(60):
        lines = [" ".join(words(12, 3000, seed=100 * i + k)) for k in range(6)]
        if i % 4 == 1:
            lines.insert(2, "a line that stands in many documents of this corpus")
        if i % 4 == 2:
            lines.insert(3, "some text " + items[i % 5][1].upper() + " and after")
        rows.append((i, "\n".join(lines)))
    rows += [(60, rows[0][1]), (61, rows[3][1] + " x"), (62, None), (63, ""), (64, "123 !!"), (65, items[0][1]), (66, "w12 w77")]
    # near copies that line dedup cannot catch: every line has two words changed
    w = [x.split() for x in rows[7][1].split("\n")]
    rows.append((67, " ".join(" ".join(x) for x in w) + " tail"))
    docs = [(i, t, "en" if i % 3 else None, "s", 0) for i, t in rows] + [(None, "w1 w22 w333 w4", "en", None, None)]
    spark.createDataFrame(docs, DOC).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, items


def texts(df):
    return {r.doc_id: r.text for r in df.collect()}


def test_stages_match_brute_force(spark, folder):
    import corpus_pipeline as c

    path, items = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    names = [n for n, _ in c.STAGES]
    assert names == ["language_id", "line_dedup", "near_dedup", "decontamination", "sentencepiece"]
    f = dict(c.STAGES)

    out = f["language_id"](spark, docs, path)
    assert out.columns == docs.columns
    assert set(texts(docs)) - set(texts(out)) == {62, 63, 64}
    assert out.where("lang is null").count() == 0

    known = out.where("doc_id is not null").cache()
    rows = list(texts(known).items())
    lined = f["line_dedup"](spark, known, path)
    want = {i: t for i, t in clean_lines(rows).items() if t.strip()}
    assert lined.columns == docs.columns and texts(lined) == want and 60 not in want
    assert lined.where("n_chars <> length(text)").count() == 0

    near = f["near_dedup"](spark, known, path)
    root = near_components(rows, 5)
    assert set(texts(near)) == {i for i in root if root[i] == i} and near.columns == docs.columns

    clean = f["decontamination"](spark, known, path)
    left = texts(clean)
    assert 65 not in left and not any(h for _, _, h, _ in brute(left.items(), items))
    for i, n, h, _ in brute(rows, items):
        if not h:
            assert left[i] == dict(rows)[i]
        elif i in left:
            assert len(tokens(left[i])) == n - h


def test_run(spark, folder):
    import corpus_pipeline as c

    path, _ = folder
    rows = c.run(spark, path).collect()
    assert rows and all(r.round_trip and len(r.ids) == r.n_tokens for r in rows)
    assert c.ORACLE_SQL is None


def test_extra_columns_stay(spark, folder):
    """Every stage keeps extra columns named like its own, with their values."""
    from pyspark.sql import functions as F

    import corpus_pipeline as c

    path, _ = folder
    names = ["before", "lang_pred", "lang_score", "lang_rejected", "ids", "n_tokens", "decoded", "round_trip", "words", "lost", "id"]
    plain = spark.read.parquet(f"{path}/documents.parquet").where("doc_id is not null")
    docs = plain
    for n in names:
        docs = docs.withColumn(n, F.concat(F.lit(n), F.col("doc_id")))
    for name, stage in c.STAGES:
        out = stage(spark, docs, path)
        assert out.columns[:len(docs.columns)] == docs.columns, name
        for r in out.collect():
            assert all(r[n] == f"{n}{r.doc_id}" for n in names), name
        assert out.drop(*names).count() == stage(spark, plain, path).count()
    assert out.columns[len(docs.columns):] == ["ids_", "n_tokens_", "round_trip_"]


def test_empty_tables(spark, tmp_path):
    import corpus_pipeline as c

    spark.createDataFrame([], DOC).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert c.run(spark, str(tmp_path)).count() == 0
