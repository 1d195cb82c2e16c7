"""License notices in texts, by DataFrame functions only.

Overlapping windows, twice as long as a class of templates and half overlapping, contain every notice of that class whole. A
window's MinHash minima, each a band of its own, retrieve templates; exact shingle containment verifies them.

A window that holds a notice with at least 75 percent of a template's shingles has a Jaccard similarity of 0.18 or more to
the template (windows have at most four times the words of a template of their class), so it shares none of 64 bands with
a chance under ``0.82 ** 64 = 3.1e-6``.

Only windows with an anchor word are hashed, and only texts in which one occurs are split into words. Anchors are words of the templates chosen so that, for every template, fewer
shingles lack one than a match may miss: a match always shows an anchor.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .registry import query, table

SHINGLE, BANDS, CONTAINED = 3, 64, 0.75
#: Words of all templates together; they are sent to the executors.
TEMPLATE_WORDS = 200_000
SMALLEST = 8
#: Letters from which a word is preferred as an anchor.
RARE = 6

# Wording of public license notices.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
     "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
     'software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.'),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
     "the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), '
     "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
     "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so."),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
     "provided that the above copyright notice and this permission notice appear in all copies."),
]
# Common words that make poor anchors.
COMMON = {"a", "an", "and", "any", "are", "as", "at", "be", "by", "for", "in", "is", "it", "may", "not", "of", "on", "or", "so", "that", "the", "this", "to", "under", "with", "you", "0", "2", "3", "4"}


def words_of(text: str) -> list[str]:
    return [w for w in re.split("[^a-z0-9]+", text.lower()) if w]


def anchors(templates: list[tuple[str, str]]) -> set[str]:
    """Few words such that no template can reach the containment without one of them."""
    out: set[str] = set()
    for _, text in templates:
        words = words_of(text)
        grams = {tuple(words[i : i + SHINGLE]) for i in range(max(1, len(words) - SHINGLE + 1))}
        while (bare := [g for g in grams if not out & set(g)]) and len(bare) >= CONTAINED * len(grams):
            rest = {w for g in bare for w in g}
            out.add(max(rest - COMMON or rest, key=lambda w: (len(w) >= RARE, sum(w in g for g in bare), len(w), w)))
    return out


def class_size(words: int) -> int:
    return max(SMALLEST, 1 << (words - 1).bit_length())


def text_words(text):
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda w: w != "")


def shingle_set(words):
    """Hashes of the distinct runs of three words; fewer words are one shingle."""
    runs = F.transform(F.sequence(F.lit(1), F.size(words) - SHINGLE + 1), lambda i: F.xxhash64(*[F.element_at(words, i + k) for k in range(SHINGLE)]))
    return F.when(F.size(words) >= SHINGLE, F.array_distinct(runs)).otherwise(F.array(F.xxhash64(words)))


def minima(shingles):
    return F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda k: F.array_min(F.transform(shingles, lambda s: F.xxhash64(k, s))))


def scan(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, template, license, containment, first_word``: templates found in each row's whole text.

    One row per row of ``docs`` and template, with the highest containment and the first window that reaches it. Null
    texts, texts without words and empty template lists give none; templates without words are never found. Repeated
    rows are found once each; other columns are not looked at.
    """
    spark = docs.sparkSession
    known = [(i, name, words_of(body)) for i, (name, body) in enumerate(templates) if words_of(body)]
    if sum(len(w) for _, _, w in known) > TEMPLATE_WORDS:
        raise ValueError(f"templates have more than {TEMPLATE_WORDS} words")
    schema = "template int, license string, words array<string>, size int"
    wanted = spark.createDataFrame([(i, name, w, class_size(len(w))) for i, name, w in known], schema)
    wanted = wanted.select("template", "license", "size", shingle_set(F.col("words")).alias("wanted"))
    # At most BANDS rows for each template word.
    bands = F.broadcast(wanted.select("template", "license", "size", "wanted", F.posexplode(minima(F.col("wanted"))).alias("band", "least")))
    chosen = sorted(anchors(templates))
    marks = F.array(*map(F.lit, chosen)).cast("array<string>")
    plain = F.lower(text)
    some = reduce(lambda a, b: a | b, [F.contains(plain, F.lit(w)) for w in chosen if len(w) >= RARE], F.lit(False))
    if short := [w for w in chosen if len(w) < RARE]:
        some = some | F.rlike(plain, F.lit(f"(?<![a-z0-9])(?:{'|'.join(short)})(?![a-z0-9])"))
    rows = docs.where(some).select(F.monotonically_increasing_id().alias("row"), F.col(doc_id).alias("doc_id"), text_words(F.col(text)).alias("words"))
    rows = rows.where(F.arrays_overlap("words", marks))
    sizes = sorted({class_size(len(w)) for _, _, w in known})
    begins = lambda n: F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.size("words") - 1), F.lit(n)), lambda i: F.struct(F.lit(n).alias("size"), i.cast("int").alias("first_word")))
    starts = F.flatten(F.array(*map(begins, sizes))) if sizes else F.array().cast("array<struct<size:int,first_word:int>>")
    cut = rows.select("row", "doc_id", "words", F.inline(starts)).select("row", "doc_id", "size", "first_word", F.slice("words", F.col("first_word") + 1, F.col("size") * 2).alias("words"))
    cut = cut.where(F.arrays_overlap("words", marks)).select("row", "doc_id", "size", "first_word", shingle_set(F.col("words")).alias("shingles"))
    seen = cut.select("*", F.posexplode(minima(F.col("shingles"))).alias("band", "least"))
    met = seen.join(bands, ["size", "band", "least"])
    share = F.size(F.array_intersect("shingles", "wanted")) / F.size("wanted")
    met = met.withColumn("containment", share).where(F.col("containment") >= CONTAINED)
    best = met.groupBy("row", "doc_id", "template", "license").agg(F.max(F.struct("containment", (-F.col("first_word")).alias("at"))).alias("best"))
    return best.select("doc_id", "template", "license", F.col("best.containment").alias("containment"), (-F.col("best.at")).alias("first_word"))


def sql(templates: list[tuple[str, str]] = TEMPLATES) -> str:
    """DuckDB text that measures every window against every template of its class."""
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    rows = ", ".join(f"({i}, {quoted(name)}, {quoted(' '.join(words_of(body)))}, {class_size(len(words_of(body)))})" for i, (name, body) in enumerate(templates))
    grams = lambda w: f"list_distinct(list_transform(range(1, greatest(2, len({w}) - 1)), lambda i: array_to_string({w}[i:i+2], ' ')))"
    return f"""
WITH t AS (
  SELECT template, license, size, {grams("ws")} AS wanted
  FROM (SELECT template, license, size, string_split(body, ' ') AS ws FROM (VALUES {rows}) v(template, license, body, size))
), d AS (
  SELECT doc_id, row_number() OVER () AS r, list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda w: w <> '') AS ws FROM documents WHERE text IS NOT NULL
), w AS (
  SELECT doc_id, r, size, i, ws[i+1:i+2*size] AS ws
  FROM (SELECT doc_id, r, ws, size, unnest(range(0, greatest(1, len(ws)), size)) AS i FROM d, (SELECT DISTINCT size FROM t) WHERE len(ws) > 0)
), g AS (
  SELECT doc_id, r, size, i, {grams("ws")} AS has FROM w
), c AS (
  SELECT doc_id, r, template, license, i, len(list_intersect(has, wanted)) / CAST(len(wanted) AS DOUBLE) AS containment FROM g JOIN t USING (size)
), k AS (
  SELECT *, row_number() OVER (PARTITION BY r, template ORDER BY containment DESC, i) AS n FROM c WHERE containment >= {CONTAINED}
)
SELECT doc_id, CAST(template AS INTEGER) AS template, license, containment, CAST(i AS INTEGER) AS first_word FROM k WHERE n = 1
"""


@query("op5_license_scan", sql())
def op5_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    """License notices of every document."""
    return scan(table(spark, folder, "documents"))
