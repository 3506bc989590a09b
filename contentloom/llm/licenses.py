"""License scans: MinHash bands over overlapping windows, then exact containment.

Only DataFrame functions. A text's words are runs of letters, digits and the
signs . and - inside of them, lower-cased; templates are known texts, cut into
shingles of five words (all words of a shorter one). Templates come in classes:
the power of two c not below their number of shingles. Texts give windows of 2c
shingles at every c-th shingle, so one window holds the whole place where a
template stands. A window and a template share a bucket if one of BANDS
min-hashes is equal: with at least CONTAINMENT of the template in the window
their Jaccard similarity j is at least about 0.17, and the chance of no equal
min-hash is (1 - j)**BANDS, below 1 in 100 for the worst; for a window that holds
a whole template it is below 1 in 10**6 if that has c shingles and below 1 in
10**4 if it has hardly more than c / 2. What buckets retrieve is
verified by the distinct shingles (64-bit hashes) of the template in the window.

Texts are cut only if they can match at all: of each template the rarest words
that more than the excusable part of its shingles hold are looked for first.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpoint

SHINGLE = 5
CONTAINMENT = 0.75
BANDS = 32
#: Templates fit in a broadcast of a proven size: shingles of all of them.
MOST_SHINGLES = 200_000

#: Statements and notices by which works are licensed.
TEMPLATES = {
    "GPL-3.0 statement": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0 statement": "Licensed under CC BY-NC 4.0.",
    "MIT statement": "Released under the MIT License.",
    "Apache-2.0 statement": "Licensed under the Apache License, Version 2.0.",
    "MIT notice": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "Apache-2.0 notice": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "BSD notice": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "GPL-3.0 notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "MPL-2.0 notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "ISC notice": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
}
WORD = r"[a-z0-9](?:[a-z0-9.-]*[a-z0-9])?"
#: Words too common to look for, as long as there are others; they are looked for as parts of words.
PLAIN = frozenset("it its any not out per see for from have has a above all an and any appear are as at be but by can conditions copies copy file following for form forms free in is list may of on one or person persons that the this to use was with without you your".split())


def template_shingles(templates: dict[str, str]) -> list[tuple[str, str]]:
    rows = []
    for name, text in templates.items():
        words = re.findall(WORD, text.lower())
        if words:
            rows += [(name, " ".join(words[k : k + SHINGLE])) for k in range(max(1, len(words) - SHINGLE + 1))]
    return sorted(set(rows))


def telling_words(shingles: list[str]) -> set[str]:
    """Words of which a text must have one, if at most the excusable part of the shingles may be missing."""
    left, chosen = [set(s.split()) for s in shingles], set()
    spare = len(shingles) * (1 - CONTAINMENT)
    total = 0
    while total <= spare:
        words = sorted({w for s in left for w in s}, key=lambda w: (w in PLAIN or len(w) < 3, -sum(w in s for s in left), w))
        chosen.add(words[0])
        total += sum(words[0] in s for s in left)
        left = [s for s in left if words[0] not in s]
    return chosen


def minhash(hashes: Column, band: int) -> Column:
    return F.array_min(F.transform(hashes, lambda h: F.xxhash64(h, F.lit(band))))


def banded(frame: DataFrame, keys: list[str], hashes: str) -> DataFrame:
    """keys, band, low: the min-hashes of the hashes of each row."""
    pairs = F.array(*[F.struct(F.lit(k).alias("band"), minhash(F.col(hashes), k).alias("low")) for k in range(BANDS)])
    return frame.select(*keys, F.explode(pairs).alias("x")).select(*keys, "x.band", "x.low")


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None) -> DataFrame:
    """doc_id, license, containment, first_word, n_windows for every template that a text of docs (doc_id, text) holds.

    containment is the greatest part of the template's shingles in one window,
    first_word the place of the first shingle of the earliest such window that
    belongs to the template. Null and empty texts hold nothing; rows that
    repeat an id count as one document's. Texts of any length are read whole, as
    an array of 8 bytes a word. Other columns are not read; documents without a
    license give no row, nor does an empty table.
    """
    templates = TEMPLATES if templates is None else templates
    spark: SparkSession = docs.sparkSession
    known = template_shingles(templates)
    if not 0 < len(known) <= MOST_SHINGLES:
        raise ValueError(f"templates must have 1 to {MOST_SHINGLES} shingles; scan with parts of them")
    by_name: dict[str, list[str]] = {}
    for name, shingle in known:
        by_name.setdefault(name, []).append(shingle)
    classes = {name: 1 << (len(s) - 1).bit_length() for name, s in by_name.items()}
    rows = [(name, len(texts), classes[name], texts) for name, texts in by_name.items()]
    theirs = spark.createDataFrame(rows, "license string, n int, c int, texts array<string>")
    theirs = theirs.select("license", "n", "c", F.transform("texts", lambda t: F.xxhash64(t)).alias("theirs"))

    telling = sorted(set().union(*(telling_words(texts) for texts in by_name.values())))
    asked = reduce(Column.__or__, [F.contains(F.col("low"), F.lit(w)) for w in telling])
    texts = docs.select("doc_id", F.lower("text").alias("low"), F.monotonically_increasing_id().alias("row")).where(asked)
    texts = texts.select("doc_id", "row", F.regexp_extract_all("low", F.lit(f"({WORD})"), F.lit(1)).alias("words")).where(F.size("words") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("words") - (SHINGLE - 1)))
    hashes = F.transform(starts, lambda k: F.xxhash64(F.concat_ws(" ", F.slice("words", k, SHINGLE))))
    texts = checkpoint(texts.select("doc_id", "row", hashes.alias("hashes")))

    # a window shares a bucket only if it holds the shingle that is a template's min-hash there, so windows without any need no min-hashes
    exploded = theirs.select("c", F.explode("theirs").alias("h"), "license")
    least = exploded.groupBy("license", "c").agg(F.array_distinct(F.array(*[F.min_by("h", F.xxhash64(F.col("h"), F.lit(k))) for k in range(BANDS)])).alias("least"))
    seeds = least.select("c", F.explode("least").alias("h")).distinct()
    at = texts.select("row", F.posexplode("hashes").alias("pos", "h")).join(F.broadcast(seeds), "h")
    last = F.floor(F.col("pos") / F.col("c")).cast("int")
    asked = at.select("row", F.explode(F.array(F.struct("c", F.greatest(last - 1, F.lit(0)).alias("win")), F.struct("c", last.alias("win")))).alias("w"))
    asked = asked.groupBy("row").agg(F.collect_set("w").alias("wins"))  # one row for each text: its hashes pass the join once, and only their windows go on
    own = F.transform("wins", lambda w: F.struct(w["c"].alias("c"), w["win"].alias("win"), F.slice("hashes", w["win"] * w["c"] + 1, 2 * w["c"]).alias("own")))
    windows = asked.join(texts, "row").select("doc_id", "row", F.explode(own).alias("w")).select("doc_id", "row", "w.*").where(F.size("own") > 0)
    wanted = banded(theirs, ["license", "c"], "theirs")
    found = banded(windows, ["doc_id", "row", "c", "win", "own"], "own").join(F.broadcast(wanted), ["c", "band", "low"])
    found = found.select("doc_id", "row", "c", "win", "own", "license").distinct()

    common = F.array_intersect("own", "theirs")
    found = found.join(F.broadcast(theirs.drop("c")), "license").withColumn("common", common)
    found = found.where(F.size("common") >= CONTAINMENT * F.col("n"))
    first = F.col("win") * F.col("c") + F.array_min(F.transform("common", lambda h: F.array_position(F.col("own"), h))) - 1
    found = found.select("doc_id", "license", (F.size("common") / F.col("n")).alias("containment"), first.cast("long").alias("first_word"), "row", "win", "c")
    return found.groupBy("doc_id", "license").agg(F.max("containment").alias("containment"), F.min("first_word").alias("first_word"), F.count("*").alias("n_windows"))


def oracle_sql(templates: dict[str, str] = TEMPLATES) -> str:
    rows = template_shingles(templates)
    count = {name: sum(n == name for n, _ in rows) for name in templates}
    values = ", ".join(f"('{name}', '{shingle}', {count[name]}, {1 << (count[name] - 1).bit_length()})" for name, shingle in rows)
    return f"""
WITH t(license, shingle, n, c) AS (VALUES {values}),
w AS (SELECT doc_id, regexp_extract_all(lower(text), '{WORD}') AS ws FROM documents),
s AS (SELECT doc_id, i - 1 AS pos, array_to_string(ws[i : i + 4], ' ') AS shingle FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i FROM w WHERE len(ws) > 0)),
met AS (SELECT doc_id, license, n, pos, s.shingle, unnest(CASE WHEN pos // c > 0 THEN [pos // c - 1, pos // c] ELSE [0] END) AS win FROM s JOIN t ON s.shingle = t.shingle),
held AS (SELECT doc_id, license, win, count(DISTINCT shingle) / any_value(n) AS part, min(pos) AS pos FROM met GROUP BY doc_id, license, win)
SELECT doc_id, license, max(part)::DOUBLE AS containment, min(pos)::BIGINT AS first_word, count(*) AS n_windows FROM held WHERE part >= {CONTAINMENT} GROUP BY doc_id, license"""
