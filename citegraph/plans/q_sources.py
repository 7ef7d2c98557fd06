"""Registered queries: sources and sinks (S1-S10, P1-P3, P8, F8, F11). Every query writes a view of the
driver tables into the shared folder in the source's own format and reads it back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from citegraph.functions.text import capitalize
from citegraph.functions.vector import l2_distance
from citegraph.operators import corpus as C
from citegraph.plans import views as V
from citegraph.plans.catalog import r6, register
from citegraph.plans.q_graph import DIM
from citegraph.plans.q_metrics import SCORED, VIEWS, decisions
from citegraph.plans.q_sampling import POS, UND, positives
from citegraph.session import ensure_checkpoint_dir
from citegraph.sources import io

KEPT = 40        # feature positions kept by P2
BASE_YEAR = 2000  # a vector's label gives its subject and year


def place(spark, name: str) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/citegraph-io/{name}-{uuid.uuid4().hex}"


def stored_as(spark, df, kind: str):
    path = place(spark, kind)
    io.save_table(df, path, kind)
    return io.load_table(spark, path, kind)


@register("read_edge_list", V.sql_with(["vec_cites"], "SELECT source, target, 'cites' AS label FROM vec_cites"))
def q_edge_list(spark, d):
    """S1 + P1: the citation edges as TSV, read back with their type."""
    path = place(spark, "edges")
    io.write_edge_list(V.vec_cites(spark, d), path)
    return io.read_edge_list(spark, path)


def _nodes(spark, d, features):
    return V.vectors(spark, d).select(
        "id", features.alias("features"), F.concat(F.lit("c"), F.col("label").cast("string")).alias("subject"),
        (F.col("label") + BASE_YEAR).alias("year"))


def _written(spark, nodes, dense: bool):
    path = place(spark, "nodes")
    io.write_node_features(nodes, path)
    return io.read_node_features(spark, path, DIM, dense=dense)


@register("read_node_features", V.sql_with(["vectors"], f"""
    SELECT id, pos, round(embedding[pos + 1]::DOUBLE, 6) AS x
    FROM vectors, (SELECT unnest(generate_series(0, {KEPT - 1})) AS pos)"""))
def q_node_features(spark, d):
    """S2 + P2 + P3: dense features from a wide TSV, the first 40 kept, metadata dropped."""
    nodes = _written(spark, _nodes(spark, d, F.col("embedding")), dense=True)
    nodes = io.drop_metadata(io.select_features(nodes, KEPT))
    return nodes.select("id", F.posexplode("features").alias("pos", "x")).select(
        "id", F.col("pos").cast("bigint").alias("pos"), r6(F.col("x").cast("double")).alias("x"))


@register("read_sparse_features", V.sql_with(["vectors"], f"""
    SELECT id, {KEPT} AS size, array_to_string(list_filter(range(0, {KEPT}), lambda i: embedding[i + 1] > 0), ',') AS active,
           'c' || label AS subject, label + {BASE_YEAR} AS year FROM vectors"""))
def q_sparse_features(spark, d):
    """S2 + P2, sparse form: indices of the active features among the first 40."""
    hot = F.transform("embedding", lambda x: (x > 0).cast("int"))
    nodes = io.select_features(_written(spark, _nodes(spark, d, hot), dense=False), KEPT)
    return nodes.select("id", "features.size", F.array_join(F.col("features.indices").cast("array<string>"), ",").alias("active"),
                        "subject", "year")


@register("metadata_features", V.sql_with(["vectors"], f"""
    SELECT v.id, {KEPT} + p.pos AS pos,
           round(CASE WHEN p.pos < s.n THEN (p.subject = 'c' || v.label)::INT::DOUBLE
                 ELSE CAST((v.label - y.low) / (y.high - y.low) AS FLOAT)::DOUBLE END, 6) AS x
    FROM vectors v, (SELECT count(*) AS n FROM subjects) s, (SELECT min(label) AS low, max(label) AS high FROM vectors) y,
         (SELECT pos, subject FROM subjects UNION ALL SELECT count(*), NULL FROM subjects) p""",
    [("subjects", "SELECT row_number() OVER (ORDER BY subject) - 1 AS pos, subject FROM (SELECT DISTINCT 'c' || label AS subject FROM vectors)")]))
def q_metadata_features(spark, d):
    """P3 with metadata: one-hot subject and scaled year after the (sparse) keyword features."""
    hot = F.transform("embedding", lambda x: (x > 0).cast("int"))
    nodes = io.select_features(_written(spark, _nodes(spark, d, hot), dense=False), KEPT)
    nodes = io.drop_metadata(nodes, use_metadata=True)
    return (nodes.select("id", F.posexplode("features").alias("pos", "x")).where(F.col("pos") >= KEPT)
            .select("id", F.col("pos").cast("bigint").alias("pos"), r6(F.col("x").cast("double")).alias("x")))


AGAIN = 7  # every paper whose id it divides is written a second time, later, with another title


def _bibliography(spark, d):
    bib = V.bib(spark, d).withColumn("abstract", F.regexp_replace("abstract", "\\r?\\n", " "))
    bib = bib.withColumn("title", F.regexp_replace("title", "\\r?\\n", " "))
    again = bib.where(F.col("paper_id") % AGAIN == 0).select(
        "paper_id", F.concat(F.lit("again "), "title").alias("title"), F.lit("").alias("abstract"), F.slice("refs", 1, 1).alias("refs"))
    path = place(spark, "bib")
    io.write_bibliography(bib, f"{path}/1")
    io.write_bibliography(again, f"{path}/2")
    # records without an id: every citing paper's title alone
    bib.where(F.size("refs") > 0).select(F.concat(F.lit("#*"), "title", F.lit("\n")).alias("value")).write.text(f"{path}/3")
    return io.read_bibliography(spark, [f"{path}/1", f"{path}/2", f"{path}/3"], with_rejects=True)


@register("read_bibliography", V.sql_with(["bib"], f"""
    SELECT paper_id, CASE WHEN paper_id % {AGAIN} = 0 THEN 'again ' ELSE '' END || regexp_replace(title, '\r?\n', ' ', 'g') AS title,
           CASE WHEN paper_id % {AGAIN} <> 0 THEN nullif(regexp_replace(abstract, '\r?\n', ' ', 'g'), '') END AS abstract,
           array_to_string(CASE WHEN paper_id % {AGAIN} = 0 THEN refs[1:1] ELSE refs END, ',') AS refs
    FROM bib"""))
def q_bibliography(spark, d):
    """S3 from files: repeated ids (the last record wins whole, Q7)."""
    papers, _rejects = _bibliography(spark, d)
    return papers.select("paper_id", "title", "abstract", F.array_join(F.col("refs").cast("array<string>"), ",").alias("refs"))


@register("bibliography_rejects", V.sql_with(["bib"], "SELECT count(*) AS n_rejects FROM bib WHERE len(refs) > 0"))
def q_bibliography_rejects(spark, d):
    """S3: records without a usable id are counted."""
    _papers, rejects = _bibliography(spark, d)
    return rejects.agg(F.count("*").alias("n_rejects"))


@register("save_corpus", V.sql_with(["papers"], "SELECT paper_id, title, md5(abstract) AS abstract_md5 FROM papers"))
def q_save_corpus(spark, d):
    """The corpus as a stored table."""
    return stored_as(spark, V.papers(spark, d), "corpus").select("paper_id", "title", F.md5("abstract").alias("abstract_md5"))


@register("save_text", V.sql_with(["papers"], """
    SELECT paper_id, md5(title || ' ' || abstract) AS text_md5 FROM papers WHERE title || ' ' || abstract <> ''"""))
def q_save_text(spark, d):
    """S5 + J1 + P8: non-empty paper texts as a stored table."""
    text = C.paper_text(V.papers(spark, d), V.papers(spark, d))
    return C.nonempty_text(stored_as(spark, text, "text")).select("paper_id", F.md5("text").alias("text_md5"))


@register("save_pairs", V.sql_with(["pairs"], "SELECT paper_idx, ref_idx, count(*) AS n FROM pairs GROUP BY ALL"))
def q_save_pairs(spark, d):
    """Encoded pairs as a stored table, duplicates kept."""
    return stored_as(spark, V.pairs(spark, d), "pairs").groupBy("paper_idx", "ref_idx").agg(F.count("*").alias("n"))


@register("save_decisions", V.sql_with(VIEWS, "SELECT source, target, round(score, 6) AS score, pred FROM dec", SCORED))
def q_save_decisions(spark, d):
    """Decisions as a stored table, partitioned by the decision."""
    return stored_as(spark, decisions(spark, d), "decisions").select("source", "target", r6("score").alias("score"), "pred")


@register("save_truth_edges", V.sql_with(["vec_cites"], "SELECT DISTINCT source, target FROM pos", [UND, POS]))
def q_save_truth(spark, d):
    """Truth edges as a stored table."""
    return stored_as(spark, positives(spark, d), "truth_edges").select("source", "target").distinct()


@register("save_vectors", V.sql_with(["vectors"], "SELECT id, len(embedding) AS dim, round(list_sum(embedding::DOUBLE[]), 6) AS total FROM vectors"))
def q_save_vectors(spark, d):
    """Vectors as a stored table."""
    total = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double"))
    return stored_as(spark, V.vectors(spark, d), "vectors").select(
        "id", F.size("embedding").cast("bigint").alias("dim"), r6(total).alias("total"))


@register("link_distance", V.sql_with(["vec_cites", "vectors"], """
    SELECT p.source, p.target, round(list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS distance
    FROM pos p JOIN vectors a ON a.id = p.source JOIN vectors b ON b.id = p.target""", [UND, POS]))
def q_link_distance(spark, d):
    """F8: Euclidean distance of both ends of the held-out links."""
    v = V.vectors(spark, d)
    return (positives(spark, d).join(v.select(F.col("id").alias("source"), F.col("embedding").alias("a")), "source")
            .join(v.select(F.col("id").alias("target"), F.col("embedding").alias("b")), "target")
            .select("source", "target", r6(l2_distance("a", "b")).alias("distance")))


@register("capitalize", V.sql_with(["papers"], """
    SELECT paper_id, upper(left(title, 1)) || lower(substr(title, 2)) AS title FROM papers"""))
def q_capitalize(spark, d):
    """titles with only their first character raised."""
    return V.papers(spark, d).select("paper_id", capitalize("title").alias("title"))


@register("distinct_ids", V.sql_with(["doc_cites"], "SELECT DISTINCT target FROM doc_cites"))
def q_distinct_ids(spark, d):
    """A3: distinct cited ids."""
    return C.distinct_ids(V.doc_cites(spark, d), "target")
