"""License scans, in DataFrame operations only.

Texts are cut into overlapping windows of WINDOW words that start every STRIDE words, so that each shingle of five words lies
whole in at least one window. Each template is cut at every offset, so an intact passage meets a template window with the same
shingles whatever its place in the text. A window's signature has BANDS bands of one MinHash value each, in BANDS orders of mixed
hashes: windows whose shingle sets have Jaccard similarity J meet in some band with probability 1 - (1 - J)**BANDS. For the
template of one shingle J is 1/4 and that probability 0.9999; for two full windows that share but one of their four shingles J is
1/7 and it is 0.993, and a longer template that is contained to 0.75 has several such windows or equal ones. Candidates are then
verified by exact containment of the template's shingles in the whole text.

Templates of more than TEMPLATE_BYTES are scanned for in passes of at most so many, each of which broadcasts no more; a template that is
longer by itself is joined without a broadcast.

Defined cases: null or empty text and texts of fewer than five words contain nothing; rows with the same doc_id and the same text
are reported each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stage

SHINGLE, WINDOW, STRIDE, BANDS, CONTAINMENT = 5, 8, 4, 32, 0.75
#: Most bytes of templates that are broadcast in a pass.
TEMPLATE_BYTES = 1 << 20

# Opening notices of public licences, as their authors word them.
TEMPLATES = {
    "apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
    "mit-line": "Released under the MIT License.",
    "mit": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software',
    "gpl-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "gpl": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "lgpl": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "cc-by-nc-4.0-line": "Licensed under CC BY-NC 4.0.",
    "cc-by": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-sa": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "unlicense": "This is free and unencumbered software released into the public domain.",
}


def words_of(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def shingles(words: Column) -> Column:
    """Distinct shingles as texts, empty for fewer than five words. The words are bound as a lambda's variable: an expression in
    their place would be evaluated again for each shingle."""

    def cut(w: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.size(w) - (SHINGLE - 1), F.lit(1)))
        return F.when(F.size(w) < SHINGLE, F.array().cast("array<string>")).otherwise(F.array_distinct(F.transform(starts, lambda i: F.array_join(F.slice(w, i, SHINGLE), " "))))

    return F.element_at(F.transform(F.array(words), cut), 1)


#: One constant per band; shingle hashes are ordered by their hash together with it.
_ORDERS = [c - (1 << 64) if c >> 63 else c for c in ((0x9E3779B97F4A7C15 * (b + 1)) % (1 << 64) for b in range(BANDS))]


def _windows(rows: DataFrame, keep: list[str], stride: int) -> DataFrame:
    """The windows' band values: per band, the least shingle hash in the band's order. Values of different bands do not meet.

    The bands are rows of a constant array and not BANDS expressions, which keeps the generated method small enough to be compiled.
    """
    count = WINDOW - SHINGLE + 1
    starts = F.sequence(F.lit(0), F.greatest(F.size("words") - SHINGLE, F.lit(0)), F.lit(stride))
    cut = rows.where(F.size("words") >= SHINGLE).select(*keep, "words", F.explode(starts).alias("start"))
    # a shingle beyond the text is null, which least() passes over
    hashes = [F.when(F.size("words") >= F.col("start") + (j + SHINGLE), F.xxhash64(*[F.get("words", F.col("start") + (j + k)) for k in range(SHINGLE)])).alias(f"s{j}") for j in range(count)]
    each = cut.select(*keep, *hashes).select("*", F.explode(F.array(*[F.lit(c) for c in _ORDERS])).alias("order"))
    return each.select(*keep, F.least(*[F.when(F.col(f"s{j}").isNotNull(), F.xxhash64(f"s{j}", "order")) for j in range(count)]).alias("band"))


def template_table(spark: SparkSession, templates: dict[str, str]) -> DataFrame:
    rows = spark.createDataFrame(list(templates.items()), "license string, body string").select("license", words_of(F.col("body")).alias("words"))
    return rows.withColumn("template", shingles(F.col("words"))).where(F.size("template") > 0)


def passes(templates: dict[str, str], most: int) -> list[tuple[dict[str, str], bool]]:
    """Templates in passes of at most `most` bytes, and whether a pass keeps to that: one template may be longer."""
    out: list[dict[str, str]] = []
    size = 0
    for name, body in templates.items():
        n = len(body.encode())
        if not out or size + n > most:
            out.append({})
            size = 0
        out[-1][name] = body
        size += n
    return [(p, sum(len(b.encode()) for b in p.values()) <= most) for p in out]


def _scan(docs: DataFrame, templates: dict[str, str], few: bool, containment: float) -> DataFrame:
    known = template_table(docs.sparkSession, templates)
    small = F.broadcast if few else (lambda df: df)  # few: at most TEMPLATE_BYTES of templates, so their bands are bounded too
    bands = _windows(known.select("license", "words"), ["license"], 1).distinct()
    texts = docs.select("doc_id", words_of(F.col("text")).alias("words"))
    hits = _windows(texts, ["doc_id"], STRIDE).join(small(bands), "band").select("doc_id", "license").distinct()
    # staged, so that its size is known when the join back to the texts is planned
    candidates = stage(hits, "license-candidates").withColumnRenamed("doc_id", "id")
    found = docs.select("doc_id", "text").join(candidates, F.col("doc_id").eqNullSafe(F.col("id"))).select("doc_id", "license", shingles(words_of(F.col("text"))).alias("own"))
    found = found.join(small(known.select("license", "template")), "license")
    shared = F.size(F.array_intersect("own", "template"))
    out = found.select("doc_id", "license", F.size("template").cast("long").alias("n_template"), shared.cast("long").alias("n_shared"))
    return out.where(F.col("n_shared") >= containment * F.col("n_template")).withColumn("containment", F.col("n_shared") / F.col("n_template"))


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None, containment: float = CONTAINMENT, pass_bytes: int = TEMPLATE_BYTES) -> DataFrame:
    """doc_id, license, n_template, n_shared, containment: the templates of which each text has that share of shingles."""
    out = None
    for some, few in passes(TEMPLATES if templates is None else templates, pass_bytes) or [({}, True)]:
        found = _scan(docs, some, few, containment)
        out = found if out is None else out.unionByName(found)
    return out


_VALUES = ", ".join("('{}', '{}')".format(k, v.replace("'", "''")) for k, v in TEMPLATES.items())
_WORDS = "list_filter(regexp_split_to_array(lower(coalesce({}, '')), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '')"
_SHINGLES = "CASE WHEN len(ws) < 5 THEN [] ELSE list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(list_slice(ws, i, i + 4), ' '))) END"
ORACLE = f"""
WITH t AS (SELECT license, {_SHINGLES} AS s FROM (SELECT license, {_WORDS.format("body")} AS ws FROM (VALUES {_VALUES}) v(license, body))),
p AS (SELECT license, len(s) AS n, unnest(s) AS g FROM t),
d AS (SELECT row, doc_id, unnest({_SHINGLES}) AS g FROM (SELECT row_number() OVER () AS row, doc_id, {_WORDS.format("text")} AS ws FROM documents))
SELECT doc_id, license, CAST(n AS BIGINT) AS n_template, count(*) AS n_shared, count(*) / CAST(n AS DOUBLE) AS containment
FROM d JOIN p USING (g) GROUP BY row, doc_id, license, n HAVING count(*) >= {CONTAINMENT} * n
"""
