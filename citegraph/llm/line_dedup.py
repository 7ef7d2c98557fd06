"""Near-duplicate lines by a deletion-neighbourhood join, in DataFrame functions only.

Lines within one edit of each other have a common variant: both without the character that differs
(substitution), or the longer one without its extra character and the shorter one as it is (insertion,
deletion). A variant is a hashed key of (number of characters before the gap, text before, text
after); lines that emit an equal key are joined and the edit distance is verified.

A line of n characters has n variants, so only lines that can have a partner emit theirs: one edit leaves the first
or the second half of a line as it is, and a count over hashed halves (four keys a line) finds the lines that share
a half with another of nearly equal length, and which half the edit must be in.

Long lines: the hash of the text before a gap is taken over (hash up to the last block boundary, rest of the
block), and likewise from the end, so a variant costs one block and not the whole line.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citegraph.llm.common import Stored

#: Shorter lines (characters after normalisation) go only when they repeat an earlier one exactly: one edit makes another
#: word of them.
MIN_CHARS = 16
BLOCK = 128


def normalised(text: str) -> F.Column:
    """Lower case, and within a line each run of white space as one space. Most texts hold only single spaces, and
    are not searched for runs."""
    messy = F.contains(F.col(text), F.lit("  "))
    for c in "\t\x0b\x0c\r":
        messy = messy | F.contains(F.col(text), F.lit(c))
    run = "[\\x09\\x0B-\\x0D][\\x20\\x09\\x0B-\\x0D]*|\\x20[\\x20\\x09\\x0B-\\x0D]+"
    return F.lower(F.when(messy, F.regexp_replace(text, run, " ")).otherwise(F.col(text)))


def _lines(docs: DataFrame, least: int = 1) -> DataFrame:
    """(id, no, norm, n, line) of every line of ``least`` characters; ``line`` is the digest of its normalised text."""
    rows = docs.where("id is not null").select("id", F.posexplode(F.split(normalised("text"), "\n")).alias("no", "norm"))
    rows = rows.select("id", "no", F.trim("norm").alias("norm")).withColumn("n", F.length("norm"))
    return rows.where(F.col("n") >= least).withColumn("line", F.unhex(F.md5("norm")))


def _half_keys() -> list[F.Column]:
    """Hashes of the halves of a line, as a line of its own length and as the longer of two."""
    out = []
    for shorter in (0, 1):
        size = F.col("n") - shorter
        half = F.floor(size / 2).cast("int")
        out.append(F.xxhash64(F.lit(0), size, F.substring(F.col("norm"), F.lit(1), half)))
        out.append(F.xxhash64(F.lit(1), size, F.right(F.col("norm"), size - half)))
    return out


def _variants() -> tuple[F.Column, F.Column]:
    """The blocks of a candidate line, and its hashed variants over the halves where an edit is possible."""
    n, b = F.col("n"), BLOCK
    blocks = F.sequence(F.lit(0), F.floor(n / b).cast("int"))
    norm = F.col("norm")
    from_left = F.transform(blocks, lambda k: F.struct(
        F.xxhash64(F.substring(norm, F.lit(1), k * b)).alias("h"), F.substring(norm, k * b + 1, F.lit(b)).alias("t")))
    from_right = F.transform(blocks, lambda k: F.struct(
        F.xxhash64(F.right(norm, k * b)).alias("h"),
        F.substring(norm, F.greatest(n - (k + 1) * b, F.lit(0)) + 1, F.least(n - k * b, F.lit(b))).alias("t")))

    def key(left: F.Column, right: F.Column, gap: F.Column, rest: F.Column) -> F.Column:
        """Hash of the variant with ``gap`` characters before and ``rest`` characters after the gap."""
        head, tail = F.get(left, F.floor(gap / b).cast("int")), F.get(right, F.floor(rest / b).cast("int"))
        return F.xxhash64(gap, head["h"], F.substring(head["t"], F.lit(1), gap % b), tail["h"], F.right(tail["t"], rest % b))

    half = F.floor(n / 2).cast("int")
    none = F.array().cast("array<bigint>")

    def over(flag: str, first: F.Column, last: F.Column, dropped: int) -> F.Column:
        gaps = F.sequence(first, last)
        return F.when(F.col(flag) & (last >= first),
                      F.transform(gaps, lambda g: key(F.col("from_left"), F.col("from_right"), g, n - g - dropped))
                      ).otherwise(none)

    middle = F.floor((n - 1) / 2).cast("int")
    return F.struct(from_left.alias("from_left"), from_right.alias("from_right")), F.array_distinct(F.concat(
        over("cut_head", F.lit(0), half - 1, 1), over("cut_tail", middle, n - 1, 1),
        over("gap_head", F.lit(0), half, 0), over("gap_tail", half, n, 0)))


def duplicate_lines(docs: DataFrame, min_chars: int = MIN_CHARS, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """``id_col, line_no, first_id, first_line, edits``: every line that goes, the earliest line that it repeats, and the
    edits between the two (0 or 1).

    Lines are the parts of a text between line feeds, numbered from 0, and compared after normalisation. A
    line goes when an earlier line, by (id, line number), is equal to it, or within one edit of it where both have
    ``min_chars`` characters, whether that line itself stays or not. Empty lines stay. Documents with a null id or text
    take no part. Rows that repeat an id share their line numbers: equal lines at one place are one line.
    """
    store = Stored(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    place = F.struct("id", "no")
    halves = F.when(F.col("n") >= min_chars, F.array(*_half_keys()))  # null: exact repeats only
    lines = store.put(_lines(rows).select("line", "id", "no", "n", halves.alias("halves")), "lines")
    classes = store.put(
        lines.select("line", "n", place.alias("place"), "halves").groupBy("line").agg(F.min("place").alias("first"), F.max("place").alias("last"), F.first("n").alias("n"),
                             F.first("halves").alias("halves")), "classes")

    # lines that share a half with another of the same length, or one character longer or shorter
    half = F.posexplode("halves").alias("k", "key")
    shared = (classes.select(half).groupBy("key")
              .agg(F.sum((F.col("k") < 2).cast("int")).alias("own"), F.sum((F.col("k") >= 2).cast("int")).alias("longer"))
              .where("own > 1 or (own = 1 and longer > 0)"))
    own, head = F.col("k") < 2, F.col("k") % 2 == 1  # an equal second half leaves the edit in the first
    cut = F.when(own, F.col("own") > 1).otherwise(F.col("own") > 0)
    gap = own & (F.col("longer") > 0)
    wanted = store.put(
        classes.select("line", half).join(shared, "key").groupBy("line")
        .agg(F.max(cut & head).alias("cut_head"), F.max(cut & ~head).alias("cut_tail"),
             F.max(gap & head).alias("gap_head"), F.max(gap & ~head).alias("gap_tail"))
        .where("cut_head or cut_tail or gap_head or gap_tail")
        .join(classes.select("line", "first"), "line"), "wanted")
    source = rows.join(wanted.select(F.col("first.id").alias("id")).distinct(), "id", "left_semi")
    texts = store.put(
        _lines(source, min_chars).join(wanted, "line").where(place == F.col("first"))
        .dropDuplicates(["line"]).drop("id", "no"), "texts")

    blocks, variants = _variants()
    emitted = store.put(
        texts.withColumn("blocks", blocks)
        .select("line", "first", "n", "norm", "cut_head", "cut_tail", "gap_head", "gap_tail", "blocks.from_left", "blocks.from_right")
        .select("line", "first", F.explode(variants).alias("variant")), "variants")
    least = F.min(F.struct("first", "line")).alias("least")
    met = (emitted.groupBy("variant").agg(F.count("*").alias("size"), least).where("size > 1")
           .select("variant", F.col("least.line").alias("other")))
    pairs = emitted.join(met, "variant").where("line <> other").select("line", "other").distinct()
    other = texts.select(F.col("line").alias("other"), F.col("first").alias("other_first"), F.col("norm").alias("other_norm"))
    near = (pairs.join(texts.select("line", "norm"), "line").join(other, "other")
            .where(F.levenshtein("norm", "other_norm", 1) == 1)
            .groupBy("line").agg(F.min("other_first").alias("near")))
    near = store.put(near, "near")
    gone = store.put(
        classes.join(near, "line", "left").where("near is not null or first <> last")
        .select("line", "first", "near"), "repeated")
    store.drop("variants", "texts", "wanted", "classes")
    earliest = F.least("near", "first")
    return (lines.select("line", "id", "no").join(gone, "line")
            .where((place != F.col("first")) | F.col("near").isNotNull())
            .select(F.col("id").alias(id_col), F.col("no").alias("line_no"), earliest["id"].alias("first_id"),
                    earliest["no"].alias("first_line"), (earliest != F.col("first")).cast("int").alias("edits")).distinct())


def drop_lines(docs: DataFrame, gone: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the lines in ``gone`` (from ``duplicate_lines``); all columns stay, null texts stay null."""
    lost, clash = "lost", set(docs.columns)
    while lost in clash:
        lost += "_"
    numbers = gone.groupBy(id_col).agg(F.collect_set("line_no").alias(lost))  # at most the lines of one text
    out = docs.join(numbers, id_col, "left")
    kept = F.filter(F.split(text_col, "\n"), lambda x, i: ~F.array_contains(F.col(lost), i))
    text = F.when(F.col(lost).isNull(), F.col(text_col)).otherwise(F.array_join(kept, "\n"))
    return out.select(*(text.alias(c) if c == text_col else F.col(c) for c in docs.columns),)
