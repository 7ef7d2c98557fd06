"""The registered queries of the operators: thin calls with production parameters."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citegraph.llm import license_scan
from citegraph.llm.common import crc_mod, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark windows in every document, by suffix automaton."""
    from citegraph.llm.decontaminate import find_contamination

    found = find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    ids = F.array_sort(F.transform("items", lambda x: x.cast("string")))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of equal texts, by content sort."""
    from citegraph.llm.exact_dedup import exact_groups

    return exact_groups(table(spark, sf_dir, "documents"))


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of near-duplicate documents, on sets of two-word shingles."""
    from citegraph.llm.near_dedup import near_groups

    return near_groups(table(spark, sf_dir, "documents"), shingle_words=2)


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the lines that repeat an earlier one (numbers of lines, digest of the text left)."""
    from citegraph.llm.line_dedup import drop_lines, duplicate_lines

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    left = drop_lines(docs.withColumn("clean", F.col("text")), duplicate_lines(docs), text_col="clean")
    count = lambda c: F.when(F.col(c).isNull() | (F.col(c) == ""), 0).otherwise(F.size(F.split(c, "\n"))).cast("long")
    return left.select("doc_id", count("text").alias("n_lines"), count("clean").alias("n_left"),
                       F.sha2(F.coalesce("clean", F.lit("")), 256).alias("text_sha256"))


#: Where the public tokenizer files lie.
TOKENIZER = os.environ.get("TOKENIZER_MODEL", "/opt/tokenizers/piece_bpe_32k.model")
BYTE_BPE = os.environ.get("BYTE_BPE_FILE", "/opt/tokenizers/byte_bpe_50k.json")


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document by Viterbi (their number and a digest), and whether decoding gives the text back."""
    from citegraph.llm.sentencepiece import Model, encode

    model = Model.read(TOKENIZER, unigram=True)
    return encode(table(spark, sf_dir, "documents").select("doc_id", "text"), model, decoded_col="decoded").select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.col("decoded").eqNullSafe(F.col("text")).alias("round_trip"))


def _scored(scores: DataFrame, limit: float) -> DataFrame:
    return scores.select("doc_id", _held_out(5, 0), "score", (F.col("score") >= limit).cast("int").alias("predicted"))


def _held_out(folds: int, fold: int) -> F.Column:
    return F.coalesce(crc_mod("doc_id", folds) == fold, F.lit(False)).alias("held_out")


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document, by neighbours in a latent space."""
    from citegraph.llm import quality

    docs = table(spark, sf_dir, "documents")
    return _scored(quality.predict(docs, quality.fit(docs, table(spark, sf_dir, "labels"))), 0.3)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document, by scaled character n-grams."""
    from citegraph.llm import toxicity

    docs = table(spark, sf_dir, "documents")
    return _scored(toxicity.predict(docs, toxicity.fit(docs, table(spark, sf_dir, "labels"))), 0.5)


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, by nearest centroid; ``rejected`` where it is too far from all."""
    from citegraph.llm import langid

    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs.where(crc_mod("doc_id", 4) != 2))
    return (langid.predict(docs.select("doc_id", "text"), model)
            .select("doc_id", _held_out(4, 2), "lang_pred", "score", "rejected"))


#: The rules of the URL query.
URL_RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"),
             ("allow", "com/fr/"), ("block", "com/de/")]


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every page's url, by rules and boosted trees."""
    from citegraph.llm.url_filter import judge

    return judge(table(spark, sf_dir, "pages"), URL_RULES)


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licenses whose notices a document holds."""
    from citegraph.llm.license_scan import scan_licenses

    return scan_licenses(table(spark, sf_dir, "documents"))


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two tokenizers' tokens of every document in groups that end together, and how common their links are."""
    from citegraph.llm.alignment import ByteSide, PieceSide, align

    out = align(table(spark, sf_dir, "documents"), ByteSide(BYTE_BPE), PieceSide(TOKENIZER), digest=True)
    return out.withColumnRenamed("groups", "groups_sha256")


def op12_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's tokens in sequences of 2,048, by bin completion."""
    from citegraph.llm.byte_bpe import ByteBpe
    from citegraph.llm.packing import place, token_pieces

    pieces = token_pieces(table(spark, sf_dir, "documents"), ByteBpe.read(BYTE_BPE))
    return place(pieces).withColumnRenamed("id", "doc_id")


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every hundredth vector, by packed integer products."""
    from citegraph.llm.hard_negatives import mine_hard_negatives

    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine_hard_negatives(table(spark, sf_dir, "embeddings").withColumn("label", label), F.col("vec_id") % 100 == 0)


QUERIES |= {f.__name__: f for f in (op1_decontaminate, op2_near_dedup, op3_line_dedup, op4_sentencepiece, op5_quality, op6_toxicity, op7_language, op8_url_filter,
                                    op9_exact_dedup, op10_license_scan, op11_alignment, op12_best_fit_packing, op13_hard_negatives)}

WORDS_SQL = "regexp_extract_all(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{}')"
ALNUM = "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"

ORACLE["op1_decontaminate"] = f"""
WITH item_words AS (SELECT item_id, {WORDS_SQL.format('text', ALNUM)} AS w FROM benchmark
                    WHERE text IS NOT NULL AND item_id IS NOT NULL),
windows AS (SELECT DISTINCT item_id, len(g) AS n, array_to_string(g, ' ') AS g FROM (
    SELECT item_id, w[s:s + least(len(w), 10) - 1] AS g
    FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS s FROM item_words WHERE len(w) > 0))),
doc_words AS (SELECT row_number() OVER () AS r, doc_id, coalesce({WORDS_SQL.format('text', ALNUM)}, []) AS w FROM documents),
sizes AS (SELECT DISTINCT n FROM windows),
starts AS (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM doc_words, sizes WHERE len(w) >= n),
hits AS (SELECT t.r, t.s, t.n, v.item_id
         FROM starts t JOIN windows v ON v.n = t.n AND v.g = array_to_string(t.w[t.s:t.s + t.n - 1], ' ')),
hit_words AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(s, s + n)) AS p FROM hits) GROUP BY r),
hit_items AS (SELECT r, count(DISTINCT item_id) AS n_items,
              string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM hits GROUP BY r)
SELECT d.doc_id, len(d.w) AS n_words, coalesce(h.n_hit, 0) AS n_hit, coalesce(i.n_items, 0) AS n_items,
       sha256(coalesce(i.ids, '')) AS items_sha256, coalesce(h.n_hit, 0) > 0 AS contaminated
FROM doc_words d LEFT JOIN hit_words h USING (r) LEFT JOIN hit_items i USING (r)
"""

ORACLE["op10_license_scan"] = license_scan.oracle()

ORACLE["op9_exact_dedup"] = """
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g') AS norm FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY norm) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
       row_number() OVER (PARTITION BY norm ORDER BY doc_id NULLS LAST) = 1 AS kept, sha256(norm) AS text_sha256
FROM t
"""

# Documents that share a shingle are compared in full; the groups by repeated spreading of the least id.
ORACLE["op2_near_dedup"] = """
WITH RECURSIVE w AS (
    SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                      '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
sets AS (SELECT doc_id, list_sort(list_distinct(CASE WHEN len(w) = 0 OR w IS NULL THEN [] WHEN len(w) = 1 THEN w
             ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END)) AS s FROM w),
classes AS (SELECT s, min(doc_id) AS rep FROM sets WHERE len(s) > 0 GROUP BY s),
items AS (SELECT rep, len(s) AS n, unnest(s) AS item FROM classes),
links AS (SELECT a.rep AS a, b.rep AS b FROM items a JOIN items b ON a.item = b.item AND a.rep <> b.rep
              AND a.n * 10 >= b.n * 8 AND b.n * 10 >= a.n * 8
          GROUP BY a.rep, b.rep, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
reach AS (SELECT rep AS node, rep AS root FROM classes UNION SELECT l.b, r.root FROM reach r JOIN links l ON l.a = r.node),
tops AS (SELECT node, min(root) AS top FROM reach GROUP BY node)
SELECT d.doc_id, len(d.s) AS n_shingles, coalesce(t.top, d.doc_id) AS component_id,
       d.doc_id = coalesce(t.top, d.doc_id) AS kept
FROM sets d LEFT JOIN classes c ON c.s = d.s LEFT JOIN tops t ON t.node = c.rep
"""

# One edit leaves a half of the line as it is: candidates share one, the edit distance decides.
ORACLE["op3_line_dedup"] = """
WITH raw AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS raw,
                    unnest(range(0, len(string_split(text, chr(10))))) AS no FROM documents),
lines AS (SELECT doc_id, no, raw, lower(trim(regexp_replace(raw, '[\\x20\\x09-\\x0D]+', ' ', 'g'))) AS norm FROM raw),
classes AS (SELECT norm, length(norm) AS n, min({'id': doc_id, 'no': no}) AS first FROM lines
            WHERE length(norm) >= 1 GROUP BY norm),
sized AS (SELECT *, unnest([n, n - 1]) AS size FROM classes WHERE n >= 16),
halves AS (SELECT *, 0 AS side, left(norm, size // 2) AS half FROM sized
           UNION ALL SELECT *, 1, right(norm, size - size // 2) FROM sized),
near AS (SELECT DISTINCT a.norm FROM halves a JOIN halves b ON a.size = b.size AND a.side = b.side AND a.half = b.half
         WHERE (a.n = a.size OR b.n = b.size) AND b.first < a.first AND levenshtein(a.norm, b.norm) = 1),
marked AS (SELECT l.*, c.norm IS NOT NULL AND (x.norm IS NOT NULL OR c.first <> {'id': l.doc_id, 'no': l.no}) AS gone
           FROM lines l LEFT JOIN classes c ON c.norm = l.norm LEFT JOIN near x ON x.norm = l.norm),
left_over AS (SELECT doc_id, string_agg(raw, chr(10) ORDER BY no) AS clean FROM marked WHERE NOT gone GROUP BY doc_id)
SELECT d.doc_id, CASE WHEN coalesce(d.text, '') = '' THEN 0 ELSE len(string_split(d.text, chr(10))) END AS n_lines,
       CASE WHEN coalesce(l.clean, '') = '' THEN 0 ELSE len(string_split(l.clean, chr(10))) END AS n_left,
       sha256(coalesce(l.clean, '')) AS text_sha256
FROM documents d LEFT JOIN left_over l USING (doc_id)
"""

ORACLE["op13_hard_negatives"] = """
WITH r AS (SELECT row_number() OVER () AS rid, vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                  list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
           FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
                           AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.rid AS a, a.id AS anchor_id, a.label = b.label AS same, b.rid, b.id,
             CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
      FROM r a JOIN r b ON a.rid <> b.rid WHERE a.id % 100 = 0),
p AS (SELECT a, rid AS p, anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same
      QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, id, rid) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, s.id AS negative_id, positive_score,
       s.score AS negative_score
FROM p JOIN s USING (a, anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * s.score AND 100 * s.score <= 90 * positive_score
WINDOW w AS (PARTITION BY a, p ORDER BY s.score DESC, s.id, s.rid)
QUALIFY row_number() OVER w <= 10
"""
