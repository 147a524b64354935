"""License scans by MinHash bands over overlapping text windows, verified by exact shingle containment.

Words are runs of a-z and 0-9 of the lower-cased text, shingles five words. Templates are cut into pieces of at most the longest scale; a piece belongs to the
smallest scale that holds its words. For each scale, windows of one and a half times its length start every half length, so each stretch of
a scale's length lies wholly in a window. Each window has HASHES minima of its shingle hashes, one band each (bands of one row): a window that holds 0.8 of a
piece has a similarity of at least 0.8 m / (w + 0.2 m) with it, for m shingles in the piece and w in the window, and collides in some band
with probability 1 - (1 - s)**HASHES, above 0.999 for all templates here (a test computes it). A pair that collides is verified by the exact
share of the piece's shingles that the window holds; a license matches where its pieces, by their shingles, reach CONTAINED.

Windows without any shingle of any template have similarity 0 with all of them; documents of which this holds are dropped before windows are
cut, by one look-up per shingle. DataFrame functions only; the templates are a fixed list, so their side of each join is small by construction.

Edge cases: null, empty and short texts match nothing; repeated rows that share a doc_id and text give one result; a null doc_id keeps its result; overlapping windows count a license once; empty tables give
empty results; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wirelattice.llm.words import let

#: Words of a shingle, least share of a template's shingles, scales in words, minima per window.
WORDS, CONTAINED, SCALES, HASHES = 5, 0.8, (8, 16, 32, 64), 64

#: Public license notices.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0",
    "Apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at "
    "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, "
    "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "BSD-2-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3",
    "GPL-3.0-or-later": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, "
    "either version 3 of the License, or (at your option) any later version.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "MIT": "Released under the MIT License",
    "MIT-permission": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, "
    "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "Unlicense": "This is free and unencumbered software released into the public domain",
}


def tokens(text: Column) -> Column:
    bare = F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+", " "))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, " "))


def shingles(words: Column) -> Column:
    """64-bit hashes of the shingles in order; none for fewer words than a shingle has."""
    at = lambda w: F.sequence(F.lit(1), F.size(w) - WORDS + 1)
    every = lambda w: F.transform(at(w), lambda i: F.xxhash64(F.array_join(F.slice(w, i, WORDS), " ")))
    return let(words, lambda w: F.when(F.size(w) < WORDS, F.array().cast("array<bigint>")).otherwise(every(w)))


def minima(window: Column) -> Column:
    """Per hash function the least hash of the window's shingles."""
    return F.transform(F.sequence(F.lit(1), F.lit(HASHES)), lambda k: F.array_min(F.transform(window, lambda h: F.xxhash64(h, k))))


def pieces(spark: SparkSession, templates: dict[str, str]) -> DataFrame:
    """Per piece of a template: license, piece, scale, items (its distinct shingles), parts (shingles of all its license's pieces)."""
    longest = SCALES[-1]
    rows = spark.createDataFrame(list(templates.items()), "license string, text string").select("license", tokens(F.col("text")).alias("w"))
    # the last piece ends with the template, so no piece is too short for a shingle
    starts = F.transform(F.sequence(F.lit(0), F.ceil(F.size("w") / longest).cast("int") - 1), lambda i: F.greatest(F.lit(1), F.least(i * longest + 1, F.size("w") - longest + 1)))
    cut = rows.select("license", "w", F.posexplode(F.array_distinct(starts)).alias("piece", "at")).withColumn("w", F.slice("w", F.col("at"), longest))
    scale = F.coalesce(*(F.when(F.size("w") <= s, F.lit(s)) for s in SCALES))
    own = cut.select("license", "piece", scale.alias("scale"), F.array_distinct(shingles(F.col("w"))).alias("items")).where(F.size("items") > 0)
    parts = own.groupBy("license").agg(F.sum(F.size("items")).alias("parts"))
    return own.join(parts, "license")


def scan(docs: DataFrame, templates: dict[str, str] | None = None) -> DataFrame:
    """Per document and license that it contains: doc_id, license, containment (share of the template's shingles)."""
    spark = docs.sparkSession
    known = pieces(spark, TEMPLATES if templates is None else templates).persist()
    everything = [r[0] for r in known.select(F.explode("items")).distinct().collect()]  # of the fixed list of templates
    any_of = F.array(*map(F.lit, everything)) if everything else F.array().cast("array<bigint>")
    # a generator instead of a filter: a filter would be pushed down and the shingles hashed twice
    held = F.filter(F.array(shingles(tokens(F.col("text")))), lambda h: F.arrays_overlap(h, any_of))
    hits = docs.select("doc_id", F.xxhash64("text").alias("copy"), F.explode(held).alias("h"))

    def cut(scale: int) -> Column:
        """The distinct shingles of the windows of a scale that hold any template's shingle, with their starts."""
        length, step = scale * 3 // 2 - WORDS + 1, scale // 2
        at = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("h")), F.lit(step))
        windows = F.transform(at, lambda i: F.struct(F.lit(scale).alias("scale"), i.alias("start"), F.array_distinct(F.slice("h", i, length)).alias("items")))
        return F.filter(windows, lambda x: F.arrays_overlap(x["items"], any_of))

    windows = hits.select("doc_id", "copy", F.explode(F.concat(*map(cut, SCALES))).alias("x")).select("doc_id", "copy", "x.scale", "x.start", "x.items")
    bands = windows.select("*", F.posexplode(minima(F.col("items"))).alias("band", "least"))
    template_bands = known.select("license", "piece", "scale", F.col("items").alias("wanted"), "parts", F.posexplode(minima(F.col("items"))).alias("band", "least"))
    met = bands.join(F.broadcast(template_bands), ["scale", "band", "least"])
    # all bands of a window lie in one row's explode, so this first step combines before the shuffle
    found = F.size(F.array_intersect("items", "wanted"))
    best = met.select("doc_id", "copy", "license", "piece", "parts", found.alias("found")).groupBy("doc_id", "copy", "license", "piece", "parts").agg(F.max("found").alias("found"))
    share = F.col("found") / F.col("parts")
    by_copy = best.groupBy("doc_id", "copy", "license", "parts").agg(F.sum("found").alias("found")).where(share >= CONTAINED)
    return by_copy.groupBy("doc_id", "license").agg(F.max(share).alias("containment"))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents against all templates."""
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op7_sql() -> str:
    """Templates whose shingles a text holds to 0.8 or more; equal to the scan where a notice stands in one place."""
    values = ", ".join("('{}', '{}')".format(k, v.replace("'", "''")) for k, v in TEMPLATES.items())
    cut = lambda c: f"string_split(trim(regexp_replace(lower({c}), '[^a-z0-9]+', ' ', 'g')), ' ')"
    grams = f"list_distinct(list_transform(range(1, greatest(len(w) - {WORDS - 2}, 1)), lambda i: array_to_string(w[i:i + {WORDS - 1}], ' ')))"
    return f"""
with k(license, text) as (values {values}), t as (select license, unnest({grams}) as g from (select license, {cut('text')} as w from k)), n as (select license, count(*) as parts from t group by 1),
d as (select doc_id, unnest({grams}) as g from (select doc_id, {cut("coalesce(text, '')")} as w from documents))
select doc_id, license, round(count(*) / any_value(parts), 6) as containment from d join t using (g) join n using (license) group by 1, 2 having count(*) >= {CONTAINED} * any_value(parts)
"""
