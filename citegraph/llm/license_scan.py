"""License scan in DataFrame functions only: MinHash bands over overlapping windows, exact containment.

Templates are a stored table of (license, family, text): common notices and full texts, or one's own. Texts and templates are
words (``[a-z0-9]+`` after lower-casing) and their shingles of five words; a
template of fewer words is one shingle of its own length. Templates are put into classes by their number
of shingles (the next power of two, ``size``); for each class a text is cut into windows of 2 * size
shingles, one every ``size`` shingles, so any run of ``size`` shingles lies inside a window. A window and a template
that retrieve each other have an equal MinHash value in one of ``BANDS`` bands of one value.

A template with t shingles, size / 2 < t <= size, that is contained to 0.8 has a Jaccard similarity
of at least 0.8 t / (2 size + 0.2 t) > 0.19 with the window, so a match is missed with probability
under 0.81**64 = 1.4e-6.

Two filters come first and lose nothing: a text must hold one of a few words without which no template reaches the
containment, and a window must hold a shingle of some template of its class. Of several templates of one family, the one with the
highest containment in a document counts (a notice of version 2 is near to that of version 3).
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from citegraph.llm.common import Stored

WIDTH, BANDS, PERCENT = 5, 64, 80

#: Shingles of all templates up to which their tables are broadcast (8 bytes each, and BANDS values a template); a larger
#: set of templates is joined by shuffles. The words that every match must hold are sought on the driver for so many only.
MOST_SHINGLES = 1 << 17

#: Licenses, their families (licenses whose wording is close) and the wording of common notices and texts.
TEMPLATES = [
    ("AGPL-3.0", "gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General "
                        "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("all-rights-reserved", "all-rights-reserved", "All rights reserved."),
    ("Apache-2.0", "apache", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "apache", "Unless required by applicable law or agreed to in writing, software distributed under the License is "
                             "distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."),
    ("BSD", "bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
                   "that the following conditions are met"),
    ("CC-BY-4.0", "cc", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-4.0", "cc", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "cc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-NC-4.0", "cc", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "cc", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-SA-4.0", "cc", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "cc", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("EPL-2.0", "epl", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0"),
    ("GPL-2.0", "gpl", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", "gpl", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General "
                       "Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("GPL-3.0", "gpl", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
                       "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("ISC", "isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("LGPL-2.1", "gpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General "
                        "Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General "
                        "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("MIT", "mit", "Released under the MIT License."),
    ("MIT", "mit", "This project is licensed under the MIT License"),
    ("MIT", "mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
                   "documentation files (the \"Software\"), to deal in the Software without restriction"),
    ("MIT", "mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
                   "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to "
                   "use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the "
                   "Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall "
                   "be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY "
                   "KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND "
                   "NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER "
                   "IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS "
                   "IN THE SOFTWARE."),
    ("MPL-2.0", "mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Unlicense", "unlicense", "This is free and unencumbered software released into the public domain."),
]


class Template:
    """A template's distinct shingles, its class, and words one of which any match must hold."""

    def __init__(self, name: str, family: str, text: str, percent: int):
        words = re.findall("[a-z0-9]+", text.lower())
        if not words:
            raise ValueError(f"template {name!r} has no words")
        self.name, self.family = name, family
        self.width = min(WIDTH, len(words))
        runs = [words[i:i + self.width] for i in range(len(words) - self.width + 1)]
        self.shingles = list(dict.fromkeys(" ".join(r) for r in runs))
        self.size = 1 << (len(self.shingles) - 1).bit_length()
        need = -(-len(self.shingles) * percent // 100)
        left, self.anchors = set(self.shingles), []
        for w in sorted(set(words), key=lambda w: (-len(w), w)):
            if len(left) < need:
                break
            self.anchors.append(w)
            left = {s for s in left if w not in s.split(" ")}


def prepared(templates: list[tuple[str, str, str]], percent: int) -> list[Template]:
    return [Template(*t, percent) for t in templates]


def template_frame(spark: SparkSession, templates: list[tuple[str, str, str]] = TEMPLATES) -> DataFrame:
    """(license, family, text) rows of a short list. A long one is better read from a table."""
    if not templates:
        raise ValueError("no templates")
    rows = F.array(*(F.struct(*(F.lit(v).alias(n) for n, v in zip(("license", "family", "text"), t))) for t in templates))
    return spark.range(1).select(F.inline(rows))


def words(text: str) -> F.Column:
    return F.regexp_extract_all(F.lower(F.col(text)), F.lit("[a-z0-9]+"), F.lit(0))


def hashes(words: str, width: F.Column) -> F.Column:
    """Hashes of the shingles of ``width`` words at every position; the words are at least as many."""
    return F.transform(F.sequence(F.lit(1), F.size(words) - width + 1), lambda i: F.xxhash64(F.array_join(F.slice(words, i, width), " ")))


def _signature(shingles: str) -> F.Column:
    """The least of every band's hash over an array of shingle hashes."""
    return F.transform(F.sequence(F.lit(1), F.lit(BANDS)),
                       lambda b: F.array_min(F.transform(F.col(shingles), lambda s: F.xxhash64(b, s))))


def template_table(templates: DataFrame) -> DataFrame:
    """(template, license, family, width, size, wanted): distinct shingle hashes of every template, and its class."""
    rows = templates.select("license", "family", words("text").alias("words")).where(F.size("words") > 0)
    rows = rows.withColumn("width", F.least(F.lit(WIDTH), F.size("words")))
    rows = rows.withColumn("wanted", F.array_distinct(hashes("words", F.col("width"))))
    size = F.pow(F.lit(2.0), F.ceil(F.log2(F.size("wanted").cast("double")) - 1e-9)).cast("int")
    return rows.select(F.xxhash64("license", F.array_join("words", " ")).alias("template"), "license", "family", "width",
                       size.alias("size"), "wanted").dropDuplicates(["template"])


def scan_licenses(docs: DataFrame, templates: DataFrame | None = None, percent: int = PERCENT,
                  id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, license, containment, windows``: the licenses found in each document, the largest share of a
    template's shingles in one window, and the number of windows that reach ``percent``. Where several licenses of a family
    are found, those with the highest containment stay.

    ``templates`` has (license, family, text), by default the notices and texts of TEMPLATES; several texts may name one
    license, and a family is what the caller says it is. Templates without words match nothing. Null and empty texts match
    nothing. Rows that repeat an id, null included, are reported together. Other columns are not read.
    """
    spark = docs.sparkSession
    store = Stored(spark)
    given = (template_frame(spark) if templates is None else templates).select("license", "family", "text")
    table = store.put(template_table(given), "templates")
    small = (table.agg(F.sum(F.size("wanted"))).first()[0] or 0) <= MOST_SHINGLES
    sent = F.broadcast if small else lambda df: df

    rows = docs.select(F.col(id_col).alias("id"), F.lower(text_col).alias("lower"))
    if small:  # the words without one of which no template reaches the percentage
        items = prepared([t for t in map(tuple, given.collect()) if re.search("[a-z0-9]", t[2].lower())], percent)
        has = F.lit(False)
        for a in sorted({a for t in items for a in t.anchors}):
            has = has | F.contains(F.col("lower"), F.lit(a))
        rows = rows.where(has)
    widths = table.select("width").distinct()
    rows = (rows.select("id", words("lower").alias("words")).withColumn("width", F.explode(F.sequence(F.lit(1), F.lit(WIDTH))))
            .where(F.size("words") >= F.col("width")).join(F.broadcast(widths), "width"))  # at most WIDTH rows
    rows = store.put(rows.select(F.monotonically_increasing_id().alias("row"), "id", "width", hashes("words", F.col("width")).alias("all")), "shingled")

    known = table.select("width", "size", F.explode("wanted").alias("shingle")).distinct()
    hits = rows.select("row", "width", F.posexplode("all").alias("p", "shingle")).join(sent(known), ["width", "shingle"])
    # a position lies in the window that starts at its multiple of size, and in the one before
    own = (F.col("p") - F.col("p") % F.col("size")).cast("int")
    starts = (hits.select("row", "size", F.explode(F.array(own, own - F.col("size"))).alias("start")).where("start >= 0").distinct())
    windows = (starts.join(rows, "row")
               .select("row", "id", "width", "size", "start", F.array_distinct(F.slice("all", F.col("start") + 1, 2 * F.col("size"))).alias("window")))
    bands = table.select("template", "width", "size", F.posexplode(_signature("wanted")).alias("band", "value"))
    match = (windows.select("row", "id", "width", "size", "start", "window", F.posexplode(_signature("window")).alias("band", "value"))
             .join(sent(bands), ["width", "size", "band", "value"])  # templates * BANDS rows
             .select("row", "id", "start", "window", "template").distinct()
             .join(sent(table.select("template", "license", "family", "wanted")), "template")
             .withColumn("share", F.size(F.array_intersect("wanted", "window")) / F.size("wanted"))
             .where(F.col("share") * 100 >= percent))
    found = match.groupBy("id", "family", "license").agg(F.max("share").alias("containment"), F.count("*").alias("windows"))
    best = F.max("containment").over(Window.partitionBy("id", "family"))  # at most the licenses of a family
    return (found.withColumn("best", best).where("containment = best")
            .select(F.col("id").alias(id_col), "license", "containment", "windows"))


def oracle(templates: list[tuple[str, str, str]] = TEMPLATES, percent: int = PERCENT) -> str:
    """The same result in DuckDB SQL: every shingle of every text against every template's."""
    rows = ", ".join(f"({k}, '{t.name}', '{t.family}', {t.width}, {t.size}, {len(t.shingles)}, '{s}')"
                     for k, t in enumerate(prepared(templates, percent)) for s in t.shingles)
    return f"""
WITH wanted(template, license, family, width, size, total, shingle) AS (VALUES {rows}),
words AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w, row_number() OVER () AS r FROM documents),
widths AS (SELECT DISTINCT width FROM wanted),
places AS (SELECT doc_id, r, w, width, unnest(range(0, len(w) - width + 1)) AS p FROM words, widths WHERE len(w) >= width),
hits AS (SELECT p.doc_id, p.r, t.template, t.license, t.family, t.size, t.total, t.shingle, p.p
         FROM places p JOIN wanted t ON t.width = p.width AND t.shingle = array_to_string(p.w[p.p + 1:p.p + p.width], ' ')),
spread AS (SELECT *, p - p % size AS start FROM hits UNION ALL SELECT *, p - p % size - size FROM hits WHERE p >= size),
shares AS (SELECT doc_id, r, template, license, family, start, count(DISTINCT shingle) / any_value(total) AS share
           FROM spread GROUP BY ALL HAVING count(DISTINCT shingle) * 100 >= any_value(total) * {percent}),
found AS (SELECT doc_id, family, license, max(share) AS containment, count(*) AS windows FROM shares GROUP BY ALL)
SELECT doc_id, license, containment, windows FROM found QUALIFY containment = max(containment) OVER (PARTITION BY doc_id, family)
"""
