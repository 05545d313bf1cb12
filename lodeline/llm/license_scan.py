"""License texts in documents: MinHash bands over text windows, then exact containment."""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SHINGLE = 5
CONTAINMENT = 0.8
#: The least probability that a window with a template in it is retrieved.
RETRIEVED = 0.9999

#: Notices by which texts state their license.
TEMPLATES: tuple[tuple[str, str], ...] = (
    ("all-rights-reserved", "All rights reserved."),
    ("apache-2.0-line", "Licensed under the Apache License, Version 2.0."),
    ("mit-line", "Released under the MIT License."),
    ("gpl-3.0-line", "This work is licensed under the GNU General Public License, version 3."),
    ("cc-by-nc-4.0-line", "Licensed under CC BY-NC 4.0."),
    ("cc-by-4.0-line", "Licensed under CC BY 4.0."),
    ("cc-by-sa-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    (
        "apache-2.0",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the "
        "License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable "
        "law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES "
        "OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and "
        "limitations under the License.",
    ),
    (
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation "
        "files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, "
        "modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the "
        "Software is furnished to do so, subject to the following conditions:",
    ),
    (
        "bsd",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
        "conditions are met:",
    ),
    (
        "gpl-notice",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as "
        "published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
)


def words_of(text: str) -> list[str]:
    return re.findall(r"[^\W_]+", text.lower())


def bands_for(words: int, size: int, containment: float = CONTAINMENT, target: float = RETRIEVED) -> int:
    """Bands of one row each that retrieve a window of 2 * size words holding a template of ``words`` words.

    The template has m shingles, of which the window holds at least the share
    ``containment``; the union has at most all of the window's and the rest of
    the template's. A band agrees with that Jaccard similarity.
    """
    m = max(1, words - SHINGLE + 1)
    held = math.ceil(containment * m)
    union = 2 * size + (m - held)
    return math.ceil(math.log(1 - target) / math.log(1 - held / union)) if held < union else 1


def anchors(templates: list[list[str]], containment: float = CONTAINMENT) -> list[str]:
    """Words so that no template reaches the containment without a shingle that holds one of them."""
    rare: dict[str, int] = {}
    for t in templates:
        for w in set(t):
            rare[w] = rare.get(w, 0) + 1
    chosen: list[str] = []
    for t in templates:
        k = min(SHINGLE, len(t))
        shingles = {tuple(t[i : i + k]) for i in range(len(t) - k + 1)}
        needed = math.ceil(containment * len(shingles))

        def free(words: list[str]) -> int:
            return sum(not any(w in s for w in words) for s in shingles)

        while free(chosen) >= needed:
            fit = sorted(set(t), key=lambda w: (-len(w), w))
            chosen.append(min(fit, key=lambda w: (free([*chosen, w]) >= needed, len(w) < 5, free([*chosen, w]), -rare[w])))
    return sorted(set(chosen))


def _shingles(words: Column, k: Column) -> Column:
    starts = F.when(F.size(words) >= k, F.sequence(F.lit(1), F.size(words) - (k - 1))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.xxhash64(F.slice(words, i, k)))


def _signature(group: Column, shingles: Column, bands: Column) -> Column:
    """For each band the smallest hash under that band's permutation, paired with the group's and the band's number."""
    numbers = F.sequence(F.lit(0), bands - 1)
    return F.transform(numbers, lambda b: F.xxhash64(group, b, F.array_min(F.transform(shingles, lambda h: F.xxhash64(h, b)))))


def _blocks(at: Column, size: int, numbers: list[Column]) -> Column:
    """The windows of a size that hold one of the places, each with its group's numbers and where it begins."""
    near = F.flatten(F.transform(at, lambda i: F.array(F.floor(i / size), F.greatest(F.floor(i / size) - 1, F.lit(0)))))
    return F.transform(F.array_distinct(near), lambda w: F.struct(*numbers, (w * size).cast("int").alias("first")))


def scan(spark: SparkSession, docs: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES, containment: float = CONTAINMENT) -> DataFrame:
    """(doc_id, license_id, containment, first_word, windows) of each license found in ``docs`` (doc_id, text).

    Texts are words in lower case. Templates of similar length share a size,
    a power of two; windows of twice that size begin at every size words, so
    that each stretch of that size lies within one. The MinHash bands of
    windows and templates are joined, see bands_for, and of the pairs those
    stay whose window holds the share ``containment`` of the template's five-word
    shingles (of the whole template if it is shorter). ``first_word`` is where
    the first such window begins, ``windows`` how many there are.

    Windows without any anchor word can't hold that share of a template, see
    anchors, and are left out beforehand. All groups' windows come from one
    pass over the texts. Null and blank texts hold nothing; very long ones are
    read whole; repeated documents are one document, and those without an id
    are one too. Of windows that hold equally much the first counts. Other
    columns are not read. An empty table gives no rows.
    """
    split = [(name, words_of(text)) for name, text in templates]
    marks = anchors([t for _, t in split], containment)
    lower = F.lower(F.col("text").cast("string"))
    hint = F.lit(False)
    for w in marks:
        hint = hint | F.contains(lower, F.lit(w))
    groups: dict[tuple[int, int], list[tuple[str, list[str]]]] = {}
    for name, t in split:
        size = max(8, 1 << (len(t) - 1).bit_length())
        groups.setdefault((size, min(SHINGLE, len(t))), []).append((name, t))
    anchor_set = F.array(*map(F.lit, marks))
    texts = (
        docs.where(hint)
        .select(F.col("doc_id").cast("long").alias("doc_id"), F.array_remove(F.split(lower, r"[^\p{L}\p{N}]+"), "").alias("words"))
        .withColumn("at", F.filter(F.transform("words", lambda w, i: F.when(F.array_contains(anchor_set, w), i)), lambda i: i.isNotNull()))
    )
    wanted, looked_at = [], []
    for g, ((size, k), members) in enumerate(sorted(groups.items())):
        bands = max(bands_for(len(t), size, containment) for _, t in members)
        numbers = [F.lit(x).alias(n) for n, x in (("g", g), ("size", size), ("k", k), ("bands", bands))]
        wanted += [F.struct(*numbers, F.lit(n).alias("license_id"), F.array(*map(F.lit, t)).alias("words")) for n, t in members]
        looked_at.append(_blocks(F.col("at"), size, numbers))
    listed = spark.range(1).select(F.explode(F.array(*wanted)).alias("t")).select("t.*")
    listed = listed.select("license_id", "g", "bands", F.array_distinct(_shingles(F.col("words"), F.col("k"))).alias("wanted"))
    keys = listed.select("license_id", "wanted", F.explode(_signature(F.col("g"), F.col("wanted"), F.col("bands"))).alias("key"))
    windows = (
        texts.select("doc_id", "words", F.explode(F.concat(*looked_at)).alias("window"))
        .select("doc_id", "window.*", F.slice("words", F.col("window.first") + 1, 2 * F.col("window.size")).alias("words"))
        .select("doc_id", "g", "bands", F.col("first").alias("first_word"), F.array_distinct(_shingles(F.col("words"), F.col("k"))).alias("held"))
        .where(F.size("held") > 0)
    )
    found = (
        windows.withColumn("key", F.explode(_signature(F.col("g"), F.col("held"), F.col("bands"))))
        .join(F.broadcast(keys), "key")
        .select("doc_id", "first_word", "license_id", (F.size(F.array_intersect("held", "wanted")) / F.size("wanted")).alias("containment"))
        .where(F.col("containment") >= containment)
    )
    return found.groupBy("doc_id", "license_id").agg(
        F.max("containment").alias("containment"), F.min("first_word").alias("first_word"), F.countDistinct("first_word").alias("windows")
    )
