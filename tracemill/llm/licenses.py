"""License scans: lines and whole texts compared with license templates by Dice over word bigrams.

Built from DataFrame functions only. A unit is a line or, where a text has several lines, the whole text;
both are normalised to lower-case words of letters and digits. The Dice coefficient of two units is twice the
common bigrams, counted with repeats, over the sum of their bigrams. At a threshold t a unit with n bigrams can
only match a template with m if t / (2 - t) * m <= n <= (2 - t) / t * m, and it then holds all but few of the
template's bigrams; so of any few probe bigrams of a template a match holds one. Units without a probe's words
are dropped before any bigram is made, and the rest meet only templates whose sizes and probes they fit.

spans() finds notices and license texts wherever they stand in a text: wrapped over lines, inside a line or
between other prose. Its units are windows of a template's own number of words, each laid where a probe bigram of
the text meets its place in the template.
"""

from __future__ import annotations

import re
from collections import Counter
from math import ceil, floor

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Least Dice coefficient of a match.
THRESHOLD = 0.8
#: Short notices by which works are put under a license, as (SPDX id or kind, notice).
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("MIT", "Released under the MIT License."),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("CC0-1.0", "This work is dedicated to the public domain under CC0 1.0."),
    ("all-rights-reserved", "All rights reserved."),
]

#: Standard headers and the operative parts of license texts, as (SPDX id, text).
BODIES = [
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
        '(the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, '
        "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
        "subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or "
        "substantial portions of the Software.",
    ),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that "
        "the above copyright notice and this permission notice appear in all copies.",
    ),
    (
        "BSD-2-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions "
        "are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
        "documentation and/or other materials provided with the distribution.",
    ),
    (
        "Apache-2.0",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may '
        "obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
        'software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express '
        "or implied. See the License for the specific language governing permissions and limitations under the License.",
    ),
    (
        "GPL-3.0-or-later",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
        "the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the "
        "hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR "
        "PURPOSE. See the GNU General Public License for more details.",
    ),
    (
        "GPL-2.0-or-later",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
        "the Free Software Foundation; either version 2 of the License, or (at your option) any later version. This program is distributed in the "
        "hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR "
        "PURPOSE. See the GNU General Public License for more details.",
    ),
]


def template_words(text: str) -> list[str]:
    """The words of a template, as words() has them for columns."""
    return [w for w in re.split(r"[^a-z0-9]+", text.lower()) if w]


def template_bigrams(text: str) -> list[str]:
    words = template_words(text)
    return [f"{a} {b}" for a, b in zip(words, words[1:])]


def size_bounds(size: int, threshold: float) -> tuple[int, int]:
    """Least and most bigrams of a unit that can match a template of `size` bigrams."""
    low = ceil(threshold * size / (2 - threshold) - 1e-9)
    return max(1, low), floor((2 - threshold) * size / threshold + 1e-9)


def _missing(size: int, threshold: float) -> int:
    """Most bigrams of a template of `size` that a match lacks; largest for the longest unit that fits."""
    # common >= t / 2 * (n + m) with n >= common, so common >= t * m / (2 - t).
    return size - ceil(threshold * size / (2 - threshold) - 1e-9)


def probes(templates: list[tuple[str, str]], threshold: float) -> dict[int, list[str]]:
    """By template so many distinct bigrams that every match holds one; the rarest among templates first."""
    bigrams = [template_bigrams(t) for _, t in templates]
    common = Counter(b for x in bigrams for b in set(x))
    out = {}
    for k, x in enumerate(bigrams):
        count, chosen, held = Counter(x), [], 0
        for b in sorted(count, key=lambda b: (common[b], -len(b), b)):
            chosen.append(b)
            held += count[b]
            if held > _missing(len(x), threshold):
                break
        out[k] = chosen
    return out


def words(text: Column) -> Column:
    """Lower-case words of ASCII letters and digits."""
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda w: w != "")


def dice(b: Column, t: Column) -> Column:
    """Dice coefficient of two lists of bigrams, repeats counted."""
    times = lambda x, g: F.size(F.filter(x, lambda y: y == g))
    common = F.aggregate(F.array_distinct(t), F.lit(0), lambda n, g: n + F.least(times(b, g), times(t, g)))
    return 2.0 * common / (F.size(b) + F.size(t))


def anchors(templates: list[tuple[str, str]], threshold: float) -> list[tuple[int, int, str]]:
    """Template number, place and bigram of every place at which a template has one of its probes."""
    probe = probes(templates, threshold)
    return [(k, q, b) for k, (_, t) in enumerate(templates) for q, b in enumerate(template_bigrams(t)) if b in probe[k]]


def scan(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """Matches of units of docs with templates: doc_id, line_no, license, dice.

    docs: doc_id and text; more columns are ignored. line_no is that of the line, from 1, or 0 for the whole of
    a text of several lines. A unit gives the template with the highest coefficient, the first of equals by
    name; units below the threshold give none. Null, empty and blank texts and units of fewer than two words
    match nothing, templates of fewer than two words neither; repeated rows match each for itself, those
    with equal doc_ids included. 0 < threshold <= 1.
    """
    templates = [(n, t) for n, t in templates if template_bigrams(t)]
    spark = docs.sparkSession
    probe = probes(templates, threshold)
    bounds = [size_bounds(len(template_bigrams(t)), threshold) for _, t in templates]
    lows, highs = zip(*bounds, strict=True) if bounds else ((1,), (0,))
    # Every probe names its longer word; a unit with a probe holds that word.
    need = sorted({max(p.split(" "), key=lambda w: (len(w), w)) for x in probe.values() for p in x})
    lines = docs.select("doc_id", F.split("text", "\n").alias("lines"))
    whole = F.when(F.size("lines") > 1, F.array(F.struct(F.lit(0).alias("line_no"), F.array_join("lines", " ").alias("unit")))).otherwise(
        F.array().cast("array<struct<line_no: int, unit: string>>")
    )
    numbered = F.transform("lines", lambda x, i: F.struct((i + 1).cast("int").alias("line_no"), x.alias("unit")))
    # The size bounds hold for words before they are cut: a unit of n words has n - 1 characters between them at least.
    shortest = min(lows) * 2 + 1
    long_enough = F.filter(F.concat(whole, numbered), lambda u: F.length(u["unit"]) >= shortest)
    units = lines.select("doc_id", F.explode(long_enough).alias("u")).select("doc_id", "u.line_no", "u.unit")
    cut = units.select("doc_id", "line_no", F.split(F.lower("unit"), "[^a-z0-9]+").alias("w")).where(
        F.size("w").between(min(lows) + 1, max(highs) + 3) & F.arrays_overlap("w", F.array(*map(F.lit, need)))
    )
    cut = cut.select("doc_id", "line_no", F.filter("w", lambda w: w != "").alias("w"))
    bigrams = F.transform(F.sequence(F.lit(1), F.greatest(F.size("w") - 1, F.lit(1))), lambda i: F.concat_ws(" ", F.get("w", i - 1), F.get("w", i)))
    made = cut.where(F.size("w") > 1).select("doc_id", "line_no", F.monotonically_increasing_id().alias("unit_id"), bigrams.alias("b"))
    table = spark.createDataFrame(
        [(k, name, template_bigrams(t), *bounds[k], probe[k]) for k, (name, t) in enumerate(templates)],
        "k int, license string, t array<string>, low int, high int, probes array<string>",
    )
    # Each bigram of a unit that is a probe leads to its templates; the table is as small as the list above.
    by_probe = table.select(F.explode("probes").alias("probe"), "license", "t", "low", "high")
    met = made.select("doc_id", "line_no", "unit_id", "b", F.explode(F.array_distinct("b")).alias("probe")).join(F.broadcast(by_probe), "probe")
    met = met.where(F.size("b").between(F.col("low"), F.col("high"))).dropDuplicates(["unit_id", "license", "t"])
    met = met.select("doc_id", "line_no", "unit_id", "license", "b", "t")
    scored = met.select("doc_id", "line_no", "unit_id", "license", dice(F.col("b"), F.col("t")).alias("dice"))
    best = scored.where(F.col("dice") >= threshold).groupBy("unit_id").agg(
        F.min(F.struct((-F.col("dice")).alias("d"), "license", "doc_id", "line_no")).alias("m")
    )
    return best.select("m.doc_id", "m.line_no", "m.license", F.round(-F.col("m.d"), 6).alias("dice"))


def _hashes(spark: SparkSession, bigrams: set[str]) -> dict[str, int]:
    """The 64-bit number of each bigram of the templates, as Spark's hash of its two words gives it."""
    rows = spark.createDataFrame([(b, *b.split(" ")) for b in sorted(bigrams)], "b string, x string, y string")
    return {r["b"]: r["h"] for r in rows.select("b", F.xxhash64("x", "y").alias("h")).collect()}


def spans(docs: DataFrame, templates: list[tuple[str, str]] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """Places of templates within whole texts: doc_id, word_no, n_words (the template's), license, dice. templates: those of lines and the BODIES unless given.

    A window begins where a bigram of the text, laid on the same probe bigram of a template, puts the template's
    first word, and has as many words as the template, less what would stand outside the text. Of the windows of one
    template at or above the threshold the one with the highest coefficient is given, the first of equals, then the
    next that has no place of a given one, and so on: copies that follow each other are each given. word_no counts
    from 1 and is less for a template whose beginning is cut off by the start of the text. Null, empty and blank texts, texts of one word and templates of fewer than two
    words match nothing; an empty table gives an empty result; repeated rows match each for itself. More columns
    of docs are ignored. 0 < threshold <= 1. Bigrams are told apart by 64-bit hashes.
    """
    templates = [(n, t) for n, t in (TEMPLATES + BODIES if templates is None else templates) if template_bigrams(t)]
    spark, places = docs.sparkSession, anchors(templates, threshold)
    need = sorted({max(b.split(" "), key=lambda w: (len(w), w)) for *_, b in places})
    # A place of a template as one number: the template's in the upper bits, below it the start that it gives, less the anchor's own place.
    high, zero = 40, 1 << 20
    number_of = _hashes(spark, {b for _, t in templates for b in template_bigrams(t)})
    codes: dict[int, list[int]] = {}
    for k, q, b in places:
        codes.setdefault(number_of[b], []).append((k << high) + zero - q)
    if not codes:
        return docs.select("doc_id", F.lit(0).cast("long").alias("word_no"), F.lit(0).cast("long").alias("n_words"), F.lit("").alias("license"), F.lit(0.0).alias("dice")).where(F.lit(False))
    by_probe = F.create_map(*(x for b, c in codes.items() for x in (F.lit(b).cast("long"), F.array(*(F.lit(v).cast("long") for v in c)))))
    sizes = F.array(*(F.lit(len(template_bigrams(t))) for _, t in templates))
    bodies = F.array(*(F.array(*(F.lit(number_of[b]).cast("long") for b in template_bigrams(t))) for _, t in templates))

    raw = docs.select("doc_id", F.split(F.lower("text"), "[^a-z0-9]+").alias("w")).where(F.arrays_overlap("w", F.array(*map(F.lit, need))))
    # The explode of one list keeps what it holds from being made anew wherever it is used: words, then the number of each bigram.
    cut = raw.select("doc_id", F.monotonically_increasing_id().alias("row_id"), F.explode(F.array(F.filter("w", lambda w: w != ""))).alias("w")).where(F.size("w") > 1)
    numbers = F.transform(F.sequence(F.lit(0), F.size("w") - 2), lambda i: F.xxhash64(F.get("w", i), F.get("w", i + 1)))
    texts = cut.select("doc_id", "row_id", F.explode(F.array(numbers)).alias("g"))
    hits = F.filter(F.sequence(F.lit(0), F.size("g") - 1), lambda i: F.get("g", i).isin(list(codes)))
    laid = F.array_distinct(F.flatten(F.transform(hits, lambda i: F.transform(F.element_at(by_probe, F.get("g", i)), lambda c: c + i))))
    number = lambda c: F.shiftright(c, high).cast("int")
    start = lambda c: (c.bitwiseAND(F.lit((1 << high) - 1)) - zero).cast("int")

    first = lambda c: F.greatest(start(c), F.lit(0))
    last = lambda c: F.least(start(c) + F.get(sizes, number(c)), F.size("g")) - 1
    window = lambda c: F.slice("g", first(c) + 1, last(c) - first(c) + 1)

    # What a window and its template have in common is at most the bigrams of both, with the template's repeats.
    distinct = F.array(*(F.lit(len(t) - len(set(t))) for t in (template_bigrams(x) for _, x in templates)))
    most = lambda c: F.size(F.array_intersect(window(c), F.get(bodies, number(c)))) + F.get(distinct, number(c))
    least = lambda c: threshold * (last(c) - first(c) + 1 + F.get(sizes, number(c))) - 1e-9
    near = texts.select("doc_id", "row_id", "g", F.filter(laid, lambda c: 2.0 * most(c) >= least(c)).alias("codes"))
    found = near.where(F.size("codes") > 0).select("doc_id", "row_id", F.inline(F.transform("codes", lambda c: F.struct(number(c).alias("k"), start(c).alias("s"), window(c).alias("b")))))
    table = spark.createDataFrame([(k, n, [number_of[b] for b in template_bigrams(t)]) for k, (n, t) in enumerate(templates)], "k int, license string, t array<long>")
    scored = found.join(F.broadcast(table), "k").select("doc_id", "row_id", "k", "s", "license", F.size("t").alias("m"), dice(F.col("b"), F.col("t")).alias("dice"))
    # Windows that may overlap come together by runs, those of one text and template whose starts are no farther apart than the template is long.
    order = Window.partitionBy("row_id", "k").orderBy("s")
    begins = F.coalesce(F.col("s") - F.lag("s").over(order) > F.col("m"), F.lit(True)).cast("int")
    runs = scored.where(F.col("dice") >= threshold).withColumn("begins", begins).withColumn("run", F.sum("begins").over(order))
    item = F.struct((-F.col("dice")).alias("d"), "s")
    listed = runs.groupBy("row_id", "k", "run").agg(F.first("doc_id").alias("doc_id"), F.first("license").alias("license"), F.first("m").alias("m"), F.array_sort(F.collect_list(item)).alias("windows"))
    kept = F.aggregate(
        "windows", F.slice("windows", 1, 0), lambda given, x: F.when(F.exists(given, lambda y: F.abs(y["s"] - x["s"]) <= F.col("m")), given).otherwise(F.concat(given, F.array(x)))
    )
    best = listed.select("doc_id", "license", "m", F.explode(kept).alias("b"))
    place = (F.col("b.s") + 1).cast("long").alias("word_no"), (F.col("m") + 1).cast("long").alias("n_words")
    return best.select("doc_id", *place, "license", F.round(-F.col("b.d"), 6).alias("dice"))
