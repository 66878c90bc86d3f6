"""License scans: MinHash over overlapping windows retrieves templates, exact shingle containment verifies them.

DataFrame functions only; nothing is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: License notices and texts by identifier.
TEMPLATES = {
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-header": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at '
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "
        '"AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'
    ),
    "bsd-2-clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must "
        "retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions "
        "and the following disclaimer in the documentation and/or other materials provided with the distribution."
    ),
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-3.0-or-later": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 "
        "of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of "
        "MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."
    ),
    "isc": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice "
        "appear in all copies."
    ),
    "mit": "Released under the MIT License.",
    "mit-text": (
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without '
        "restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the "
        "Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
    ),
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
}
SHINGLE = 5
#: Windows of this many shingles start at every half window.
WINDOW = 16
#: A window's signature is the least hash of each of 2^BIN_BITS bins, each a band of its own. A
#: template's shingle collides unless a smaller one of its 15 neighbours is in its bin, in both of its
#: windows (one, at a text's ends): at least 1 - 15/16384 > 0.999 for a template of one shingle, more for others.
BIN_BITS = 14
#: Bits of the filter that holds the templates' keys.
FILTER_BITS = 16


def words(text: Column) -> Column:
    """Lower-case words [a-z0-9]+ of a text."""
    lower = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.array_remove(F.split(lower, "[^a-z0-9]+"), "")


def shingles(tokens: Column) -> Column:
    """The text of each run of SHINGLE words."""
    last = F.size(tokens) - SHINGLE + 1
    return F.when(last > 0, F.transform(F.sequence(F.lit(1), last), lambda i: F.array_join(F.slice(tokens, i, SHINGLE), " "))).otherwise(F.array().cast("array<string>"))


def signatures(hashes: Column) -> Column:
    """Band keys of all windows over an array of shingle hashes."""

    place = lambda x: F.shiftright(x, 64 - BIN_BITS)
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil((F.size(hashes) - WINDOW) / (WINDOW // 2)).cast("int")))
    # Sorted windows are bound as arguments: what a lambda computes, it computes for every element.
    ordered = F.transform(starts, lambda j: F.sort_array(F.slice(hashes, j * (WINDOW // 2) + 1, WINDOW)))
    return F.flatten(F.transform(ordered, lambda w: F.filter(w, lambda x, i: (i == 0) | (place(x) != place(F.get(w, i - 1))))))


def _library(spark: SparkSession, templates: dict[str, str]) -> list[tuple[str, list[str], list[int]]]:
    """(name, distinct shingles, band keys) of each template, made by the same functions as the documents'."""
    rows = spark.createDataFrame(list(templates.items()), "name string, text string")
    made = rows.select("name", F.array_distinct(shingles(words(F.col("text")))).alias("shingles")).withColumn("keys", F.array_distinct(signatures(F.transform("shingles", lambda s: F.xxhash64(s)))))
    return [(r["name"], r["shingles"], r["keys"]) for r in made.orderBy("name").collect()]


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None, *, least: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, license_id, matched, n_shingles, containment) for each template contained in a document.

    Containment: the share of the template's distinct 5-word shingles that the whole text
    has, `least` or more. Windows that share no band key with a template's windows don't
    retrieve it. The template library is fixed and part of the plan: some hundred notices
    at most. Null, empty and shorter texts contain nothing; repeated rows come back each;
    an empty table gives no rows; columns other than the two named are not read.
    """
    library = _library(docs.sparkSession, TEMPLATES if templates is None else templates)
    bits = [0] * (1 << FILTER_BITS - 6)
    for key in {k for _, _, keys in library for k in keys}:
        at = key & (1 << FILTER_BITS) - 1
        bits[at >> 6] |= 1 << (at & 63)
    table = F.lit([b - (1 << 64) if b >> 63 else b for b in bits]).cast("array<bigint>")
    mask = F.lit((1 << FILTER_BITS) - 1).cast("long")
    known = lambda x: F.call_function("getbit", F.get(table, F.shiftright(x.bitwiseAND(mask), 6).cast("int")), x.bitwiseAND(F.lit(63).cast("long")).cast("int")) == 1

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), words(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias("words"))
    rows = rows.withColumn("hashes", F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("words") - SHINGLE + 1)), lambda i: F.xxhash64(F.array_join(F.slice("words", i, SHINGLE), " "))))
    rows = rows.select("doc_id", "words", F.filter(signatures(F.col("hashes")), known).alias("keys"))
    # Texts without a key, which are nearly all, go no further: the shingles' texts are made for the others only.
    rows = rows.select("doc_id", "keys", F.when(F.size("keys") > 0, shingles(F.col("words"))).alias("shingles"))

    def found(name: str, own: list[str], keys: list[int]) -> Column:
        matched = F.size(F.array_intersect(F.lit(own), F.col("shingles")))
        hit = F.struct(F.lit(name).alias("license_id"), matched.cast("long").alias("matched"), F.lit(len(own)).cast("long").alias("n_shingles"), (matched / F.lit(len(own))).alias("containment"))
        return F.when((F.size("keys") > 0) & F.arrays_overlap("keys", F.lit(keys).cast("array<bigint>")), hit)

    hits = F.array(*(found(*t) for t in library if t[1]))
    hit = rows.select("doc_id", F.explode_outer(F.filter(hits, lambda h: h["containment"] >= least)).alias("hit"))
    return hit.where("hit is not null").select("doc_id", "hit.*")
