"""URL filter: host and path rules, and gradient-boosted trees for the URLs that no rule fits.

The URLs that a rule decides are the labelled ones. The trees (Spark ML) learn from a bounded
sample of them on lexical features, all computed by SQL functions: lengths, depth, digit ratio,
character entropy, parameter counts, and statistics of the host's suffix.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citegraph.llm.common import Stored, smallest

#: Labelled URLs a verdict that the trees learn from.
PER_CLASS = 4000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FEATURES = ["f_length", "f_host", "f_path", "f_depth", "f_labels", "f_digits", "f_entropy", "f_params",
            "f_query", "f_fragment", "f_hyphens", "f_suffix_rate"]


def parts(url: str) -> tuple[F.Column, F.Column]:
    """Host (A-Z lower-cased) and path; both empty for a null url or one without ``://``."""
    at = F.instr(F.col(url), "://")
    rest = F.when(at > 0, F.expr(f"substring(`{url}`, instr(`{url}`, '://') + 3)")).otherwise("")
    host = F.translate(F.regexp_extract(rest, "^([^/?#]*)", 1), UPPER, LOWER)
    return host, F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def rule_for(host: F.Column, path: F.Column, rules: list[tuple[str, str]]) -> F.Column:
    """struct(size, rule, verdict) of the longest rule that fits, or null. ``rules`` is a short list (it is
    part of the plan) of (verdict, host + path)."""
    found = []
    for verdict, rule in rules:
        cut = rule.index("/") if "/" in rule else len(rule)
        own, start = rule[:cut], rule[cut:]
        fits = ((host == own) | host.endswith("." + own)) & path.startswith(start)
        found.append(F.when(fits, F.struct(F.lit(len(rule)).alias("size"), F.lit(rule).alias("rule"),
                                           F.lit(verdict).alias("verdict"))))
    return F.array_max(F.array(*found))


def lexical(url: str) -> dict[str, F.Column]:
    """Features of the url text alone, and its suffix: the last label of the host."""
    text = F.coalesce(F.col(url), F.lit(""))
    size = F.greatest(F.length(text), F.lit(1)).cast("double")
    chars = F.array_distinct(F.split(text, ""))
    share = F.transform(F.filter(chars, lambda c: c != ""),
                        lambda c: F.length(text) - F.length(F.replace(text, c, F.lit(""))))
    entropy = F.aggregate(share, F.lit(0.0), lambda s, n: s - (n / size) * F.log2(n / size))

    def count(what: str, pattern: str) -> F.Column:
        return F.regexp_count(F.expr(what), F.lit(pattern)).cast("double")

    return {
        "f_length": F.length(text).cast("double"), "f_host": F.length("host").cast("double"),
        "f_path": F.length("path").cast("double"), "f_depth": count("path", "/"), "f_labels": count("host", "\\."),
        "f_digits": F.regexp_count(text, F.lit("[0-9]")) / size, "f_entropy": entropy,
        "f_params": F.regexp_count(text, F.lit("[?&][^=&#]+=")).cast("double"),
        "f_query": F.contains(text, F.lit("?")).cast("double"), "f_fragment": F.contains(text, F.lit("#")).cast("double"),
        "f_hyphens": count("host", "-"), "suffix": F.substring_index("host", ".", -1),
    }


def judge(pages: DataFrame, rules: list[tuple[str, str]], id_col: str = "page_id", url_col: str = "url",
          per_class: int = PER_CLASS, trees: int = 20, depth: int = 4) -> DataFrame:
    """``id_col, host, path, rule, verdict, score`` of every row: the verdict of the longest rule
    that fits, else the trees' (block from a score of 0.5 on). ``score`` is the trees' probability of ``block``.

    The trees learn from up to ``per_class`` distinct labelled URLs of each verdict, those with the smallest hash. If the
    labelled URLs hold only one verdict or none, the others get that one, or ``allow``. Null urls are judged
    as empty ones; other columns are not read.
    """
    spark = pages.sparkSession
    store = Stored(spark)
    host, path = parts("url")
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"))
    rows = rows.withColumns({"host": host, "path": path})
    rows = rows.withColumn("fit", rule_for(F.col("host"), F.col("path"), rules)).withColumns(lexical("url"))

    labelled = rows.where("fit is not null").withColumn("y", (F.col("fit.verdict") == "block").cast("double"))
    # distinct urls: the copies of a hot one count as one (map-side first)
    labelled = labelled.select("y", "url", "suffix", *FEATURES[:-1]).dropDuplicates(["url"])
    sample = store.put(smallest(labelled, "y", per_class, "url"), "sample")
    classes = {r.y: r.n for r in sample.groupBy("y").agg(F.count("*").alias("n")).collect()}
    rate = classes.get(1.0, 0) / max(1, sum(classes.values()))
    suffixes = F.broadcast(sample.groupBy("suffix").agg(  # at most one row for each sampled url
        ((F.sum("y") + 2 * rate) / (F.count("*") + 2)).alias("f_suffix_rate")))

    def whole(df: DataFrame) -> DataFrame:
        df = df.join(suffixes, "suffix", "left").fillna({"f_suffix_rate": rate})
        return VectorAssembler(inputCols=FEATURES, outputCol="features").transform(df)

    if len(classes) == 2:
        learn = whole(sample).orderBy("url").coalesce(4).select("y", "features")  # at most 2 * per_class rows
        model = GBTClassifier(labelCol="y", maxIter=trees, maxDepth=depth, stepSize=0.3, seed=1).fit(learn)
        scored = model.transform(whole(rows)).withColumn("score", vector_to_array("probability")[1])
    else:
        scored = rows.withColumn("score", F.lit(rate))
    guess = F.when(F.col("score") >= 0.5, "block").otherwise("allow")
    return scored.select(F.col("id").alias(id_col), "host", "path", F.col("fit.rule").alias("rule"),
                         F.coalesce("fit.verdict", guess).alias("verdict"), "score")
