"""Small frames and brute-force versions for the operator tests."""

import random
import re

DOC = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, rows, partitions=3):
    """documents of (doc_id, text); all other columns are null."""
    return spark.createDataFrame([(i, t, None, None, None) for i, t in rows], DOC).repartition(partitions)


def clashing(df, *names):
    """The frame with extra columns of these names."""
    from pyspark.sql import functions as F

    for n in names:
        df = df.withColumn(n, F.lit("extra"))
    return df


def words(n, vocabulary=400, seed=0):
    r = random.Random(seed)
    return [f"w{r.randrange(vocabulary)}" for _ in range(n)]


def shingles(text, k):
    w = re.findall("[^\x20\x09-\x0d]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return set() if not w else {tuple(w[i:i + k]) for i in range(max(1, len(w) - k + 1))}


def near_components(rows, k, percent=80):
    """doc_id -> smallest id reachable over links, all pairs compared."""
    sets = [(i, shingles(t, k)) for i, t in rows if i is not None]
    root = {i: i for i, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for n, (i, a) in enumerate(sets):
        for j, b in sets[:n]:
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i, _ in sets}


def norm_line(line):
    return re.sub("[\x20\x09-\x0d]+", " ", line).strip(" ").lower()


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def clean_lines(rows, least=16):
    """doc_id -> text without the lines that repeat an earlier one, or are one edit from one where both have ``least`` characters."""
    places = sorted((i, n, norm_line(x)) for i, t in rows if i is not None and t is not None for n, x in enumerate(t.split("\n")))
    gone = set()
    for k, (i, n, a) in enumerate(places):
        if a and any(a == b or (min(len(a), len(b)) >= least and abs(len(a) - len(b)) < 2 and edits(a, b) == 1)
                     for _, _, b in places[:k]):
            gone.add((i, n))
    return {i: None if t is None else "\n".join(x for n, x in enumerate(t.split("\n")) if (i, n) not in gone) for i, t in rows}
