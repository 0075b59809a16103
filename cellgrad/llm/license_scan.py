"""License scan: MinHash bands over text windows, then shingle containment.

Words are the runs of letters and digits, lower-cased; a shingle is five words
(a shorter template is one shingle).  A template matches a document when some
stretch of at most ``span`` consecutive shingle places (1.25 times the
template's distinct shingles, rounded up) holds at least ``MIN_CONTAINED`` of
the template's distinct shingles.

1. Retrieval: documents and templates are cut into windows of ``WINDOW``
   shingles, the documents' at every half window and at the end (a shorter
   text is one window), the templates' at every place.  A window's signature is ``BANDS`` independent minima over its shingle
   hashes, one row to a band.  Windows with Jaccard similarity j share a band
   with probability 1 - (1 - j)^BANDS: above 0.995 from j = 0.5 on.  Templates
   that a document can match without such a pair of windows (``windowed``) use
   windows of one shingle, whose minimum is the shingle itself, so these
   collide for certain.
2. Verification: for each retrieved document and template the matched shingle
   places, the best stretch and its containment, from the words themselves.

DataFrame functions only.  The template index holds a few numbers per template
shingle and is cut into blocks of ``BLOCK_VALUES`` values, a pass each, so its
size is bounded in a task whatever the number of templates.  Texts are never
shuffled.

Defined cases: null, empty and wordless texts match nothing, as do wordless
templates; documents shorter than a shingle hold their words as one shorter
shingle, which only equals a template of just these words; repeated rows match
once each; empty tables give empty results.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cellgrad.llm import text as X

SHINGLE = 5
WINDOW = 8
BANDS = 8
MIN_CONTAINED = 0.8
BLOCK_VALUES = 50_000

# Notices of public licenses, the default templates.
TEMPLATES = [
    ("mit-line", "MIT", "Released under the MIT License."),
    ("apache-2.0-line", "Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("gpl-3.0-line", "GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("cc-by-nc-4.0-line", "CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("mit", "MIT",
     "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
     "associated documentation files (the \"Software\"), to deal in the Software without restriction, "
     "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
     "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
     "subject to the following conditions: The above copyright notice and this permission notice shall be "
     "included in all copies or substantial portions of the Software."),
    ("apache-2.0", "Apache-2.0",
     "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
     "compliance with the License. You may obtain a copy of the License at "
     "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
     "software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR "
     "CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing "
     "permissions and limitations under the License."),
    ("gpl-3.0", "GPL-3.0",
     "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
     "General Public License as published by the Free Software Foundation, either version 3 of the License, "
     "or (at your option) any later version. This program is distributed in the hope that it will be useful, "
     "but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A "
     "PARTICULAR PURPOSE. See the GNU General Public License for more details."),
    ("bsd-2-clause", "BSD-2-Clause",
     "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
     "that the following conditions are met: 1. Redistributions of source code must retain the above copyright "
     "notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must "
     "reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
     "documentation and/or other materials provided with the distribution."),
    ("isc", "ISC",
     "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
     "hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
]


def default_templates(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(TEMPLATES, "template_id string, license string, text string")


def license_words(text: Column) -> Column:
    """Runs of ASCII letters and digits, A-Z lower-cased; other characters
    part words.  Licenses are matched in their ASCII wording."""
    t = F.btrim(F.regexp_replace(F.coalesce(text, F.lit("")), "[^A-Za-z0-9]+", " "))
    return F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(F.lower(t), " "))


def with_shingles(df: DataFrame, text: Column) -> DataFrame:
    """Adds _words and _sh: the hash of the shingle at each place."""
    df = df.withColumn("_words", license_words(text))
    df = df.withColumn("_wh", F.transform("_words", lambda w: F.xxhash64(w)))
    wh, n = F.col("_wh"), F.size("_wh")
    # size() beside the element access keeps each array a computed column.
    sh = F.when(n >= SHINGLE, F.transform(F.sequence(F.lit(1), n - (SHINGLE - 1)),
                                          lambda k: F.xxhash64(F.slice(wh, k, SHINGLE)))) \
        .when(n > 0, F.array(F.xxhash64(wh))).otherwise(F.array().cast("array<bigint>"))
    return df.withColumn("_sh", sh)


def shingle_texts(words: Column) -> Column:
    """The shingle at each place, as text."""
    n = F.size(words)
    return F.when(n >= SHINGLE, F.transform(F.sequence(F.lit(1), n - (SHINGLE - 1)),
                                            lambda k: F.array_join(F.slice(words, k, SHINGLE), " "))) \
        .otherwise(F.array(F.array_join(words, " ")))


def signatures(hashes: Column, stride: int) -> list[Column]:
    """Per band an array of one minimum per window of ``WINDOW`` shingles.
    Half of the bands are maxima, the minima under the reversed order."""
    n = F.size(hashes)
    end = F.greatest(n - (WINDOW - 1), F.lit(1))
    starts = F.when(n > 0, F.array_union(F.sequence(F.lit(1), end, F.lit(stride)), F.array(end)))
    return [F.transform(starts, lambda k: F.array_min(F.slice(hashes, k, WINDOW))),
            F.transform(starts, lambda k: F.array_max(F.slice(hashes, k, WINDOW)))]


def banded(df: DataFrame, stride: int) -> DataFrame:
    """Adds _b0 .. _b7, the bands of every window."""
    def rehashed(seed: int) -> Column:
        return F.transform("_sh", lambda x: F.xxhash64(F.lit(seed), x))

    for k in range(BANDS // 2):
        h = "_sh" if k == 0 else f"_h{k}"
        if k:
            df = df.withColumn(h, rehashed(k))
        low, high = signatures(F.col(h), stride)
        df = df.withColumn(f"_b{2 * k}", low).withColumn(f"_b{2 * k + 1}", high)
    return df


def template_table(templates: DataFrame) -> list[dict]:
    """One entry per template with words: shingles and bands.  Templates are a
    parameter of the job, as its query set is, and are read to the driver."""
    df = banded(with_shingles(templates, F.col("text")), 1)
    rows = df.select("template_id", "license", "_sh", shingle_texts(F.col("_words")).alias("_ss"), *[f"_b{k}" for k in range(BANDS)]).collect()
    out = []
    for r in sorted(rows, key=lambda r: (r["template_id"] is None, str(r["template_id"]))):
        shingles = sorted(set(r["_sh"]))
        if shingles:
            bands = [sorted(set(r[f"_b{k}"] or [])) for k in range(BANDS)]
            out.append({"id": r["template_id"], "license": r["license"], "shingles": shingles, "places": len(r["_sh"]),
                        "texts": sorted(set(r["_ss"])), "bands": bands})
    return out


def windowed(template: dict, least: float) -> bool:
    """Whether every match has a run of ``WINDOW`` - 1 shingles in the
    template's order.  Of such a run some document window holds ``WINDOW`` - 2
    shingles, and some template window these: J = 6/10 at least.

    Where a run breaks off inside the stretch, a new word has come and the
    ``SHINGLE`` - 1 shingles over the joint are not the template's, which
    bounds the joints by the places that the stretch has to spare.  A template
    that repeats a shingle may hold such shingles and is left out."""
    n = len(template["shingles"])
    kept = math.ceil(n * least)
    runs = (math.ceil(n * 1.25) - kept) // (SHINGLE - 1) + 1
    return n >= WINDOW and n == template["places"] and -(-kept // runs) >= WINDOW - 1


def blocks(table: list[dict], most: int = BLOCK_VALUES) -> list[list[dict]]:
    out, size = [], most + 1
    for t in table:
        own = len(t["shingles"]) + sum(map(len, t["bands"]))
        if size + own > most:
            out.append([])
            size = 0
        out[-1].append(t)
        size += own
    return out


def longs(values) -> Column:
    return F.expr("array(" + ",".join(f"{v}L" if v != -(1 << 63) else "bigint('-9223372036854775808')"
                                      for v in sorted(set(values))) + ")") if values else \
        F.array().cast("array<bigint>")


def license_scan(docs: DataFrame, templates: DataFrame | None = None, id_col: str = "doc_id",
                 text_col: str = "text", least: float = MIN_CONTAINED) -> DataFrame:
    """(doc_id, template_id, license, n_shingles, n_found, containment,
    first_word, last_word): the best stretch (most shingles, then first) per
    document and matching template; places count words from 0."""
    spark = docs.sparkSession
    templates = default_templates(spark) if templates is None else templates
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("_text"))
    base = banded(with_shingles(base, F.col("_text")), WINDOW // 2).drop("_text")
    out = None
    for block in blocks(template_table(templates)):
        found = _scan(base, block, least)
        out = found if out is None else out.unionByName(found)
    if out is None:
        out = docs.select(F.col(id_col).alias("doc_id")).limit(0).select(
            "doc_id", *[F.lit(None).cast(t).alias(c) for c, t in (
                ("template_id", "string"), ("license", "string"), ("n_shingles", "long"), ("n_found", "long"),
                ("containment", "double"), ("first_word", "long"), ("last_word", "long"))])
    return out


def _scan(base: DataFrame, block: list[dict], least: float) -> DataFrame:
    wide = [t for t in block if windowed(t, least)]
    slim = [t for t in block if not windowed(t, least)]
    # Retrieved bands: window signatures that some template window shares.
    met = [F.array_intersect(F.coalesce(F.col(f"_b{k}"), longs([])),
                             longs([v for t in wide for v in t["bands"][k]])) for k in range(BANDS)]
    ones = F.array_intersect(F.col("_sh"), longs([v for t in slim for v in t["shingles"]]))
    got = X.fixed(base.select("doc_id", "_words", "_sh", *[f"_b{k}" for k in range(BANDS)]),
                  _words=F.col("_words"), _met=F.flatten(F.array(*met)), _ones=ones)
    got = got.where((F.size("_met") > 0) | (F.size("_ones") > 0))
    # Each retrieved template goes on as an index into the block.
    picks = [F.when(F.arrays_overlap(F.col("_ones" if t in slim else "_met"),
                                     longs(t["shingles"] if t in slim else [v for b in t["bands"] for v in b])),
                    F.lit(i)) for i, t in enumerate(block)]
    got = got.select("doc_id", F.size("_words").alias("_n"), shingle_texts(F.col("_words")).alias("_ss"),
                     F.explode(F.array_compact(F.array(*picks))).alias("_i"))
    # Verification on the shingles themselves: places of the template's.
    own = F.array(*[F.array(*[F.lit(x) for x in t["texts"]]) for t in block])
    named = F.array(*[F.struct(F.lit(t["id"]).cast("string").alias("id"),
                               F.lit(t["license"]).cast("string").alias("license")) for t in block])
    got = got.withColumn("_own", F.get(own, F.col("_i")))
    got = X.fixed(got, _at=F.filter(F.sequence(F.lit(0), F.size("_ss") - 1),
                                         lambda k: F.array_contains(F.col("_own"), F.get(F.col("_ss"), k))))
    n = F.size("_own")
    span = F.ceil(n * 1.25).cast("int")
    stretch = F.transform(F.col("_at"), lambda p: F.struct(
        F.size(F.array_intersect(F.slice(F.col("_ss"), p + 1, span), F.col("_own"))).alias("n"), (-p).alias("p")))
    got = X.fixed(got, _best=F.array_max(stretch)).where(F.col("_best.n") >= F.ceil(n * least))
    start = -F.col("_best.p")
    last = F.array_max(F.filter(F.col("_at"), lambda p: (p >= start) & (p < start + span)))
    who = F.get(named, F.col("_i"))
    return got.select(
        "doc_id", who["id"].alias("template_id"), who["license"].alias("license"), n.cast("long").alias("n_shingles"),
        F.col("_best.n").cast("long").alias("n_found"), F.round(F.col("_best.n") / n, 6).alias("containment"),
        start.cast("long").alias("first_word"),
        F.least(last + SHINGLE, F.col("_n")).cast("long").alias("last_word"))
