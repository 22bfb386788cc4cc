"""License scans: MinHash bands over overlapping text windows, then exact shingle containment.

Shingles are five words. For a template of s shingles, windows of s shingles
start every max(1, s // 8) shingles, so that some window has a Jaccard similarity
of 7/9 at least with a whole copy of the template, wherever it is. A band is the
least value of one hash function over a window; a window is a candidate for a
template if one of BANDS bands is the same, which happens with a chance of
1 - (2/9)^BANDS at least. Candidates are verified on the words themselves: the
share of the template's shingles that are in the window, with a stride of
shingles added on both sides, must be CONTAINED at least.

A window's band can be the template's only if it holds the very shingle that
gives the template's least value. So documents without any of these shingles
have no candidates, and no windows are made of them; this loses none. DataFrame
operations only.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .workspace import Workspace, buckets

N = 5
BANDS = 6
CONTAINED = 0.8
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: Notices and grants of public licenses.
TEMPLATES = {
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0',
        'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    ],
    "MIT": [
        "Released under the MIT License.",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "GPL-2.0": ["This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."],
    "LGPL-2.1": ["This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."],
    "BSD": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.',
    ],
    "ISC": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC-BY-4.0": ["This work is licensed under a Creative Commons Attribution 4.0 International License."],
}


def words(text: Column) -> Column:
    """Runs of ASCII letters and digits and characters beyond ASCII, A-Z lower-cased."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    flat = F.trim(F.regexp_replace(F.translate(F.coalesce(text.cast("string"), F.lit("")), upper, upper.lower()), SEPARATORS, " "))
    return let(flat, lambda x: F.when(x == "", F.array().cast("array<string>")).otherwise(F.split(x, " ")))


def let(x: Column, f):
    """f of x, with x made once a row however often f uses it."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def shingles(w: Column) -> Column:
    """The hash of each run of N words; empty if there are fewer."""
    n = F.size(w) - N
    each = lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(N)])
    return F.when(n >= 0, F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(0))), each)).otherwise(F.array().cast("array<bigint>"))


def band(x: Column, k: int) -> Column:
    """Hash function k of a shingle."""
    return F.xxhash64(x, F.lit(k + 1))


def value_of(k: int):
    """Hash function k, of one shingle."""
    return lambda x: band(x, k)


def hashed_by(k: int):
    """A shingle with its value of hash function k."""
    return lambda x: F.struct(band(x, k).alias("h"), x.alias("s"))


def least(x: Column, k: int) -> Column:
    """The MinHash value of function k over an array of shingles."""
    return F.array_min(F.transform(x, value_of(k)))


def stride(s: int) -> int:
    return max(1, s // 8)


def templates(spark: SparkSession, texts: dict[str, list[str]] | None = None) -> DataFrame:
    """(license, template, words, shingles, size): a row for each template of N words or more; a fixed, small table."""
    rows = []
    for name, parts in (TEMPLATES if texts is None else texts).items():
        for k, text in enumerate(parts):
            if len([w for w in re.split(SEPARATORS, text.lower()) if w]) >= N:
                rows.append((name, k, text))
    t = spark.createDataFrame(rows, "license string, template int, text string").withColumn("words", words(F.col("text")))
    return t.withColumn("shingles", shingles(F.col("words"))).withColumn("size", F.size("shingles")).drop("text")


def scan(docs: DataFrame, ws: Workspace, texts: dict[str, list[str]] | None = None, *, contained: float = CONTAINED) -> DataFrame:
    """(doc_id, license, template, containment, word, n_words): the best match of each template in each row of docs that has one.

    word is where the matching window starts in the row's words (the first of
    equal ones), n_words how long it is. Null and empty texts and those of fewer
    than N words match nothing; repeated rows match each; an empty table gives
    no rows. A very long text is read whole, all its windows are candidates. Other
    columns of docs are not read.
    """
    spark = docs.sparkSession
    t = templates(spark, texts).cache()
    try:
        known = t.collect()  # the fixed templates
        minima = t.select(F.array(*[F.array_min(F.transform("shingles", hashed_by(k)))["s"] for k in range(BANDS)]).alias("s"), F.array(*[least(F.col("shingles"), k) for k in range(BANDS)]).alias("h")).collect()
    finally:
        t.unpersist()
    holders = sorted({s for r in minima for s in r.s})
    sizes = sorted({r["size"] for r in known})
    if not known:
        return spark.createDataFrame([], "license string, template int, containment double, word int, n_words int").join(docs.select("doc_id").limit(0)).select("doc_id", "license", "template", "containment", "word", "n_words")
    bands = t.select("license", "template", F.col("size").alias("t_size"), F.col("words").alias("t_words"), F.array(*[least(F.col("shingles"), k) for k in range(BANDS)]).alias("t_bands"))
    cut = let(words(F.col("text")), lambda w: F.struct(w.alias("w"), shingles(w).alias("s")))
    hashed = docs.select("doc_id", cut.alias("x")).where(F.arrays_overlap("x.s", F.lit(holders).cast("array<bigint>")))
    # the few documents left; further steps read them from here and make nothing twice
    hashed = ws.write(hashed.select("doc_id", "x.w", "x.s", F.monotonically_increasing_id().alias("row")), "holders")
    # small tables are read by few tasks; windows are the work, so rows are dealt out again
    hashed = hashed.repartition(buckets(spark), "row")

    def starts(size: int) -> Column:
        step = stride(size)
        last = F.greatest(F.size("s") - F.lit(size), F.lit(0))
        # every stride, and the last whole window
        at = F.array_distinct(F.concat(F.sequence(F.lit(0), last, F.lit(step)), F.array(last)))
        return F.transform(at, lambda i: F.struct(F.lit(size).alias("size"), i.alias("i")))

    # one hash of every shingle for each band, then a minimum for each window; windows that share no band with any template go before rows are made
    hashes = F.struct(*[F.transform("s", value_of(k)).alias(f"h{k}") for k in range(BANDS)])
    window = lambda h: lambda a: F.struct(a["size"].alias("size"), a["i"].alias("i"), F.array(*[F.array_min(F.slice(h[f"h{k}"], a["i"] + 1, a["size"])) for k in range(BANDS)]).alias("bands"))
    values = [sorted({r.h[k] for r in minima}) for k in range(BANDS)]

    def collides(x: Column) -> Column:
        out = F.get(x["bands"], F.lit(0)).isin(values[0])
        for k in range(1, BANDS):
            out = out | F.get(x["bands"], F.lit(k)).isin(values[k])
        return out

    windows = let(hashes, lambda h: F.filter(F.transform(F.flatten(F.array(*[starts(x) for x in sizes])), window(h)), collides))
    seen = hashed.select("row", "doc_id", "w", F.explode(windows).alias("at")).select("row", "doc_id", "w", "at.size", "at.i", "at.bands")
    hit = F.lit(False)
    for k in range(BANDS):
        hit = hit | (F.get("bands", F.lit(k)) == F.get("t_bands", F.lit(k)))
    # bounded by the fixed templates
    pairs = seen.join(F.broadcast(bands), (F.col("size") == F.col("t_size")) & hit)
    step = F.greatest(F.lit(1), F.floor(F.col("size") / 8).cast("int"))
    a = F.greatest(F.col("i") - step, F.lit(0))
    length = F.least(F.col("i") + F.col("size") + (N - 1) + step, F.size("w")) - a
    grams = lambda w: F.array_distinct(F.transform(F.sequence(F.lit(1), F.size(w) - (N - 1)), lambda i: F.array_join(F.slice(w, i, N), " ")))
    share = let(grams(F.col("t_words")), lambda g: F.size(F.array_intersect(grams(F.slice("w", a + 1, length)), g)) / F.size(g))
    found = pairs.select("row", "doc_id", "license", "template", share.alias("containment"), a.alias("word"), length.alias("n_words")).where(F.col("containment") >= contained)
    best = found.groupBy("row", "doc_id", "license", "template").agg(F.max(F.struct("containment", (-F.col("word")).alias("at"), "n_words")).alias("b"))
    return best.select("doc_id", "license", "template", F.round("b.containment", 9).alias("containment"), (-F.col("b.at")).alias("word"), F.col("b.n_words").alias("n_words"))
