import re

from tests.llm.helpers import clashing, frame, words

FULL = "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"


def brute(rows, templates, percent=80):
    """(id, license) -> (largest share, windows) of the best licenses of every family."""
    from citegraph.llm.license_scan import prepared

    out, family = {}, {}
    for i, t in rows:
        w = re.findall("[a-z0-9]+", (t or "").lower())
        for x in prepared(templates, percent):
            s = [" ".join(w[p:p + x.width]) for p in range(len(w) - x.width + 1)]
            for start in range(0, len(s), x.size):
                share = len(set(s[start:start + 2 * x.size]) & set(x.shingles)) / len(x.shingles)
                if share * 100 >= percent:
                    best, n = out.get((i, x.name), (0, 0))
                    out[i, x.name] = (max(best, share), n + 1)
                    family[i, x.family] = max(family.get((i, x.family), 0), share)
    of = {x.name: x.family for x in prepared(templates, percent)}
    return {k: v for k, v in out.items() if v[0] == family[k[0], of[k[1]]]}


def corpus():
    from citegraph.llm.license_scan import TEMPLATES

    rows, pad = [], lambda s: " ".join(words(23 + s, seed=s))
    for k, (_, _, text) in enumerate(TEMPLATES):
        w = text.split()
        rows += [(10 * k, f"{pad(k)} {text} {pad(k + 1)}"), (10 * k + 1, text.upper()), (10 * k + 2, f"{pad(3)}\n" + " ".join(w[:-1])),
                 (10 * k + 3, " ".join(w[:len(w) // 2] + ["other", "words"] + w[len(w) // 2:])), (10 * k + 4, " ".join(w[1:]) + pad(7))]
    rows += [(900, None), (901, ""), (902, "licensed"), (903, ("All rights reserved. " * 4 + pad(9)) * 300), (None, TEMPLATES[0][2]),
             (904, "x" * 200_000 + " all rights reserved"), (0, TEMPLATES[1][2]), (905, "license copyright permission reserved under")]
    return rows


def test_matches_equal_brute_force(spark):
    from citegraph.llm.license_scan import TEMPLATES, scan_licenses

    rows = corpus()
    got = scan_licenses(clashing(frame(spark, rows), "words", "id", "license")).collect()
    assert {(r.doc_id, r.license): (r.containment, r.windows) for r in got} == brute(rows, TEMPLATES)
    assert scan_licenses(frame(spark, [])).count() == 0


def test_other_thresholds_and_native_plan(spark):
    from citegraph.llm.license_scan import scan_licenses, template_frame

    rows = [(1, FULL), (2, "zz " + FULL[:70] + " yy"), (3, FULL.replace("copy", "lump"))]
    df = scan_licenses(frame(spark, rows), template_frame(spark, [("own", "own", FULL)]), percent=50)
    assert {(r.doc_id, r.license): (r.containment, r.windows) for r in df.collect()} == brute(rows, [("own", "own", FULL)], 50)
    plan = df._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def found(spark, rows, templates=None, **kw):
    from citegraph.llm.license_scan import scan_licenses

    out = {}
    for r in scan_licenses(frame(spark, rows), templates, **kw).collect():
        out.setdefault(r.doc_id, set()).add(r.license)
    return out


def test_versions_and_families(spark):
    """The nearest wording of a family names the license: versions, LGPL and AGPL against GPL."""
    from citegraph.llm.license_scan import TEMPLATES

    rows = [(k, f"{' '.join(words(40, seed=k))} {text} {' '.join(words(40, seed=k + 99))}") for k, (_, _, text) in enumerate(TEMPLATES)]
    got = found(spark, rows)
    for k, (name, _, _) in enumerate(TEMPLATES):
        assert got[k] == {name}, (name, got[k])
    two = found(spark, [(1, TEMPLATES[13][2] + " " + " ".join(words(200)) + " " + TEMPLATES[15][2])])
    assert two == {1: {"GPL-2.0", "GPL-3.0"}}  # both whole


def test_full_texts_and_templates_of_ones_own(spark, monkeypatch):
    """Long templates from a table, at several percentages, with and without the broadcast."""
    from citegraph.llm import license_scan as m

    r = words(900, 5000, seed=3)
    long = [("one", "own", " ".join(r)), ("two", "own", " ".join(r[:450] + words(450, 5000, seed=4))), ("none", "own", "!!"), ("short", "short", "ab cd")]
    w = " ".join(r).split()
    rows = [(1, " ".join(w)), (2, "x " * 77 + " ".join(w[:800]) + " y" * 50), (3, " ".join(w[:500])), (4, long[1][2].upper()), (5, "zz ab cd"),
            (6, " ".join(v if i % 45 else "changed" for i, v in enumerate(w)))]
    plain = [t for t in long if t[0] != "none"]
    for percent in (50, 80, 95):
        want = brute(rows, plain, percent)
        for most in (1 << 17, 0):
            monkeypatch.setattr(m, "MOST_SHINGLES", most)
            got = m.scan_licenses(frame(spark, rows), m.template_frame(spark, long), percent=percent).collect()
            assert {(x.doc_id, x.license): (x.containment, x.windows) for x in got} == want
