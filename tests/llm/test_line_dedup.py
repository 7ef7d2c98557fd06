import random
import string

from tests.llm.helpers import clashing, clean_lines, frame


def corpus(seed=2):
    r = random.Random(seed)
    line = lambda n: "".join(r.choice(string.ascii_lowercase[:4] + "é ") for _ in range(n))
    base = [line(r.choice([3, 15, 16, 17, 40, 127, 128, 129, 130, 300])) for _ in range(40)] + ["aaaaaaaaaaaaaaaaaaaa", "q" * 257]

    def edited(x):
        if not x:
            return x
        p = r.randrange(len(x))
        return r.choice([x, x[:p] + "z" + x[p:], x[:p] + x[p + 1:], x[:p] + "y" + x[p + 1:], x.upper(), x.replace(" ", "  ")])

    rows = [(i, "\n".join(edited(edited(r.choice(base))) for _ in range(r.randrange(1, 7)))) for i in range(70)]
    rows += [(100, None), (101, ""), (102, "\n\n"), (103, "a\n" * 50), (104, "the same line here\nthe same line here\n x"),
             (105, "z" * 5000 + "k" + "v" * 4999), (106, "z" * 5000 + "v" * 4999), (None, base[4])]
    return rows


def test_lines_match_brute_force(spark):
    from citegraph.llm.line_dedup import drop_lines, duplicate_lines

    rows = corpus()
    docs = clashing(frame(spark, rows), "line", "lost", "no", "id")
    gone = duplicate_lines(docs)
    left = drop_lines(docs, gone)
    assert left.columns == docs.columns
    want = clean_lines(rows)
    assert {r.doc_id: r.text for r in left.collect()} == want
    for r in gone.collect():
        assert (r.first_id, r.first_line) < (r.doc_id, r.line_no) and r.edits in (0, 1)


def test_native_plan(spark):
    from citegraph.llm.line_dedup import duplicate_lines

    plan = duplicate_lines(frame(spark, corpus()))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_repeated_rows_and_empty_table(spark):
    from citegraph.llm.line_dedup import drop_lines, duplicate_lines

    rows = [(1, "a line that is long enough")] * 2 + [(2, "A  line that is long enough\nnext one, also long enough")]
    docs = frame(spark, rows)
    assert sorted((r.doc_id, r.text) for r in drop_lines(docs, duplicate_lines(docs)).collect()) == [
        (1, rows[0][1]), (1, rows[0][1]), (2, "next one, also long enough")]
    assert duplicate_lines(frame(spark, [])).count() == 0


def test_one_edit_matches_at_any_length(spark):
    """With ``min_chars=1`` lines of any length match by one edit."""
    from citegraph.llm.line_dedup import drop_lines, duplicate_lines

    r = random.Random(3)
    rows = [(i, "\n".join("".join(r.choice("abc") for _ in range(r.randrange(0, 9))) for _ in range(3))) for i in range(12)]
    docs = frame(spark, rows)
    left = drop_lines(docs, duplicate_lines(docs, min_chars=1))
    assert {r.doc_id: r.text for r in left.collect()} == clean_lines(rows, least=1)
