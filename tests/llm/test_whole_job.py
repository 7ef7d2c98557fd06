"""Cases that an operator once left out."""

import random
import string

from tests.llm.helpers import edits, frame, near_components, norm_line, words


def test_short_lines_that_repeat_exactly_go(spark):
    from citegraph.llm.line_dedup import drop_lines, duplicate_lines

    rows = [(1, "}\nshort line\n\nfifteen letters"), (2, "  Short   LINE\nshort lime\n}\n\nfifteen letterz"),
            (3, "}\nsixteen letters!\né"), (4, "sixteen letters?\nÉ\n}\n \nnew"), (None, "new")]
    docs = frame(spark, rows)
    places = sorted((i, n, norm_line(x)) for i, t in rows if i is not None for n, x in enumerate(t.split("\n")))
    want = {(i, n) for k, (i, n, a) in enumerate(places) if a and any(
        a == b or (min(len(a), len(b)) >= 16 and edits(a, b) == 1) for _, _, b in places[:k])}
    gone = duplicate_lines(docs)
    assert {(r.doc_id, r.line_no) for r in gone.collect()} == want and (2, 0) in want and (2, 1) not in want
    left = {r.doc_id: r.text for r in drop_lines(docs, gone).collect()}
    assert left == {1: rows[0][1], 2: "short lime\n\nfifteen letterz", 3: "sixteen letters!\né", 4: " \nnew", None: "new"}


def test_language_that_was_not_learned_is_rejected(spark):
    from pyspark.sql import functions as F

    from citegraph.llm import langid
    from citegraph.llm.common import crc_mod

    r = random.Random(4)
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("lang is not null").select("doc_id", "text", "lang")
    letters = spark.createDataFrame([(-i, "".join(r.choice(string.ascii_lowercase + "    ") for _ in range(300)), "letters")
                                     for i in range(1, 101)], docs.schema)
    model = langid.fit(docs.where((F.col("lang") != "de") & (crc_mod("doc_id", 4) != 2)))
    got = langid.predict(docs.where((F.col("lang") == "de") | (crc_mod("doc_id", 4) == 2)).unionByName(letters), model)
    n = {x.lang: (x.n, x.gone) for x in got.groupBy("lang").agg(F.count("*").alias("n"), F.sum(F.col("rejected").cast("int")).alias("gone")).collect()}
    assert n["de"][1] >= 0.8 * n["de"][0] and n["letters"][1] >= 90
    assert sum(n[k][1] for k in ("en", "es", "fr")) <= 0.03 * sum(n[k][0] for k in ("en", "es", "fr"))
    print(n)


def test_near_copies_of_repeated_rows_meet(spark):
    """Pairs that are linked to each other (178 of 222 shingles) and not to the hub of their buckets (175 of 225), of rows that
    stand ten times and of ids with two texts."""
    from citegraph.llm.near_dedup import near_groups

    base = [f"w{i}" for i in range(201)]
    rows = [(5000, " ".join(base))]
    for p in range(30):
        at = random.Random(p).sample(range(4, 198, 2), 11)
        for side in "xy":
            w = list(base)
            w[0], w[2] = f"first{p}", f"second{p}"
            for k in at:
                w[k] = f"{side}{p}at{k}"
            i = 2 * p + (side == "y")
            rows += [(i, " ".join(w))] * (10 if side == "x" else 1)
            if p % 3 == 0 and side == "x":
                rows.append((i, " ".join(words(60, 5000, seed=100 + i))))
    got = {}
    for x in near_groups(frame(spark, rows, 5), shingle_words=2).collect():
        got.setdefault(x.doc_id, set()).add(x.component_id)
    assert got == {i: {c} for i, c in near_components(rows, 2).items()} and got[1] == {0}
