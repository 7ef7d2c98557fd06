import re

from pyspark.sql import functions as F

from tests.llm.helpers import clashing

URLS = [None, "", "no scheme", "http://", "HTTP://A.ORG/x", "http://org/", "https://a.org", "https://a.org?x=1/", "https://a.ORG/#/y",
        "http://example.org/es/1", "http://m.example.org/es/", "http://example.org/en/123.html", "http://example.org/en/2",
        "http://notexample.org/es/", "http://x.com/fr/1", "http://x.com/de/1?a=b&c=d", "http://x.com/en/", "http://acom/de/",
        "http://x.net/fr/\n1", "ftp://É.Com/de/ü", "http://x.com/de/" + "q" * 100_000, "x://y://com/de/", "http://x.com/fr"]


def brute(url, rules):
    at = (url or "").find("://")
    rest = url[at + 3:] if at >= 0 else ""
    raw = re.split("[/?#]", rest, maxsplit=1)[0]
    path = re.split("[?#]", rest[len(raw):], maxsplit=1)[0]
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in raw)
    fits = [(len(r), r, v) for v, r in rules for h, p in [(r[:r.index("/")], r[r.index("/"):])]
            if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, max(fits)[1:] if fits else (None, None)


def pages(spark, urls):
    return clashing(spark.createDataFrame(list(enumerate(urls)) + [(None, "http://a.org/")], "page_id long, url string"), "host", "y", "fit")


def test_rules_match_brute_force(spark):
    from citegraph.llm.queries import URL_RULES
    from citegraph.llm.url_filter import judge

    got = judge(pages(spark, URLS * 6), URL_RULES, trees=3).collect()
    assert len(got) == 6 * len(URLS) + 1
    for r in got:
        host, path, (rule, verdict) = brute(URLS[r.page_id % len(URLS)] if r.page_id is not None else "http://a.org/", URL_RULES)
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.verdict == verdict if rule else r.verdict == ("block" if r.score >= 0.5 else "allow")


def test_trees_learn_and_edge_cases(spark):
    from citegraph.llm.url_filter import judge

    urls = [f"http://h{i}.org/" + ("a-b-c-d/" * (i % 3 + 2) if i % 2 else f"p{i}") for i in range(300)]
    rules = [("block", f"h{i}.org/a") for i in range(1, 200, 2)] + [("allow", f"h{i}.org/p") for i in range(0, 200, 2)]
    got = {r.page_id: r for r in judge(pages(spark, urls), rules).collect()}
    assert all(got[i].rule is None and got[i].verdict == ("block" if i % 2 else "allow") for i in range(200, 300))
    none = judge(pages(spark, URLS), [("block", "nowhere/")])
    assert {r.verdict for r in none.collect()} == {"allow"}  # nothing is labelled
    one = judge(pages(spark, URLS), [("block", "org/")]).where(F.col("rule").isNull())
    assert {r.verdict for r in one.collect()} == {"block"}  # the only labelled verdict
    assert judge(pages(spark, URLS).where("false"), rules[:3]).count() == 0


def test_copies_do_not_fill_the_sample(spark):
    """A hot url, over ``per_class`` times in the table, is one url to the trees."""
    from citegraph.llm.url_filter import judge

    urls = [f"http://h{i}.org/" + ("a-b-c-d/" * (i % 3 + 2) if i % 2 else f"p{i}") for i in range(300)]
    rules = [("block", f"h{i}.org/a") for i in range(1, 200, 2)] + [("allow", f"h{i}.org/p") for i in range(0, 200, 2)]
    hot = [urls[1]] * 200 + [urls[0]] * 200
    plain = {r.url_id: (r.verdict, round(r.score, 9)) for r in judge(pages(spark, urls).withColumnRenamed("page_id", "url_id"), rules,
                                                                      id_col="url_id", per_class=100).collect()}
    full = judge(pages(spark, urls + hot).withColumnRenamed("page_id", "url_id"), rules, id_col="url_id", per_class=100).collect()
    assert {r.url_id: (r.verdict, round(r.score, 9)) for r in full if r.url_id is None or r.url_id < 300} == plain


def test_scores_follow_the_trees(spark):
    """The score of a url that no rule fits: the logistic of twice the trees' weighted sum, walked by hand."""
    import numpy as np
    from pyspark.ml.classification import GBTClassificationModel

    from citegraph.llm import url_filter as m

    kept = []
    fit = m.GBTClassifier.fit

    class Kept(m.GBTClassifier):
        def fit(self, *a, **k):
            kept.append(fit(self, *a, **k))
            return kept[-1]

    old, m.GBTClassifier = m.GBTClassifier, Kept
    seen = []
    transform = GBTClassificationModel.transform

    def watched(self, df, *a):
        seen.append(df)
        return transform(self, df, *a)

    GBTClassificationModel.transform = watched
    try:
        urls = [f"http://h{i}.org/" + ("a-b-c-d/" * (i % 3 + 2) if i % 2 else f"p{i}") for i in range(300)]
        rules = [("block", f"h{i}.org/a") for i in range(1, 200, 2)] + [("allow", f"h{i}.org/p") for i in range(0, 200, 2)]
        got = {r.page_id: r.score for r in m.judge(pages(spark, urls), rules, trees=4).collect()}
    finally:
        m.GBTClassifier, GBTClassificationModel.transform = old, transform
    model = kept[0]
    for r in seen[-1].select("id", "features").collect():
        z = sum(w * t.predict(r.features) for w, t in zip(model.treeWeights, model.trees))
        assert np.isclose(got[r.id], 1 / (1 + np.exp(-2 * z)), atol=1e-9)
