"""License texts by MinHash over overlapping word windows; DataFrame functions only.

Each template of L words is looked for in windows of a little over L words that
overlap so far that any L words lie whole in one of them. A window's and a
template's MinHash bands are joined; the number of bands follows from the
smallest Jaccard similarity that a window with enough of the template can have,
so that such a window is missed with a probability of at most MISS. What the
bands retrieve is verified by exact containment: the share of the template's
five-word shingles that the window has.

Only windows with a telling word are hashed. The telling words are chosen so
that a window that lacks them lacks too much of every template to match.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import license_table
from .base import ascii_lower, text_key, written

N = 5
CONTAINMENT = 0.8
MISS = 1e-4
BROADCAST_ROWS = 50_000  # template bands that are broadcast; more are joined by a shuffle

SHARED_FROM = 5  # stride from which a document's shingles are hashed for all windows together; both ways give the same keys
NEAR_LENGTHS = 1.5  # templates whose lengths differ by less are looked for in the same windows

#: License notices as their publishers word them. The default is these and the rows of `license_table`.
TEMPLATES = {
    "MIT-notice": "Released under the MIT License.",
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the
"Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense,
and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright
notice and this permission notice shall be included in all copies or substantial portions of the Software.""",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may
obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0""",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-or-later": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or (at your option) any later version.""",
    "BSD": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.""",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
}
SPLIT = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def plain_words(text: str) -> list[str]:
    return [w for w in re.split(SPLIT, re.sub("[A-Z]", lambda m: m[0].lower(), text)) if w]


def telling_words(texts: list[list[str]], containment: float) -> list[str]:
    """Words that every window with enough of a template must have one of.

    Of each template more than the share that a window may lack has a telling
    word. Taken greedily: long words, which are rarer, that many shingles have.
    """
    chosen: set[str] = set()
    for words in sorted(texts, key=len):
        k = min(N, len(words))
        all_ = [frozenset(words[i:i + k]) for i in range(len(words) - k + 1)]
        while sum(1 for s in all_ if s & chosen) <= (1 - containment) * len(all_) + 1e-9:
            open_ = [s for s in all_ if not s & chosen]
            worth: dict[str, int] = {}
            for s in open_:
                for w in s:
                    worth[w] = worth.get(w, 0) + 1
            chosen.add(max(worth, key=lambda w: (min(len(w), 7), worth[w], w)))
    return sorted(chosen)


def stride(length: int) -> int:
    return max(1, length // 4)


def least_similarity(shingles: list[int], window: int, containment: float) -> float:
    """Smallest Jaccard of one of the templates with a window of so many shingles that holds just enough of it."""
    need = [math.ceil(containment * own - 1e-9) for own in shingles]
    return min(n / (window + own - n) for n, own in zip(need, shingles, strict=True))


def by_near_length(items: list[tuple[str, list[str]]]) -> list[list[tuple[str, list[str]]]]:
    """Templates of about one length together; those below N words only with their equals, which have shingles as long."""
    out: list[list[tuple[str, list[str]]]] = []
    for item in sorted(items, key=lambda x: (len(x[1]), x)):
        first = len(out[-1][0][1]) if out else 0
        if out and (len(item[1]) == first or N <= first and len(item[1]) <= NEAR_LENGTHS * first):
            out[-1].append(item)
        else:
            out.append([item])
    return out


def shingle_hashes(words: Column, k: int) -> Column:
    """Hash of every k consecutive words."""
    at = F.sequence(F.lit(0), F.size(words) - k)
    one = F.transform(at, lambda i: F.xxhash64(F.lit(k), *(F.get(words, i + j) for j in range(k))))
    return F.when(F.size(words) >= k, one).otherwise(F.array().cast("array<bigint>"))


def once(value: Column, use) -> Column:
    """`use` of a value that is computed a single time."""
    return F.get(F.transform(F.array(value), use), 0)


def windows_with(tells: Column, grams: Column, size: int, step: int, k: int, least: int, bands: int) -> Column:
    """Windows, a step apart, that have one of the words numbered in `tells` and at least so many shingles: only they leave the document's row.

    Long windows share most of their shingles, so these are hashed once for each band and document.
    """
    def around(i: Column) -> Column:
        first = F.ceil(F.greatest(F.lit(0), i - (size - 1)) / step).cast("int") * step
        return F.sequence(first, F.floor(i / step).cast("int") * step, F.lit(step))

    def part(of: Column, s: Column) -> Column:
        return F.slice(of, s + 1, size - k + 1)

    def apart(starts: Column) -> Column:
        return F.transform(starts, lambda s: once(part(grams, s), lambda g: F.struct(s.alias("start"), g.alias("grams"), band_keys(g, bands).alias("keys"))))

    def together(starts: Column) -> Column:
        def smallest(band: Column) -> Column:
            return once(F.transform(grams, lambda g: F.xxhash64(band, g)), lambda hashes: F.transform(starts, lambda s: F.array_min(part(hashes, s))))
        keys = F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), smallest)
        return once(keys, lambda by_band: F.transform(starts, lambda s, i: F.struct(s.alias("start"), part(grams, s).alias("grams"), F.transform(by_band, lambda m: F.get(m, i)).alias("keys"))))

    starts = F.filter(F.array_distinct(F.flatten(F.transform(tells, around))), lambda s: s <= F.size(grams) - least)
    return once(starts, together if step >= SHARED_FROM else apart)


def band_keys(grams: Column, bands: int) -> Column:
    """Bands of one row each: the smallest hash under each seed."""
    return F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda b: F.array_min(F.transform(grams, lambda g: F.xxhash64(b, g))))


def bands_for(similarity: float, miss: float) -> int:
    """Bands of one row, so that a window of this similarity is missed with a probability of at most `miss`; one where only equality matches."""
    return 1 if similarity >= 1 else max(2, math.ceil(math.log(miss) / math.log(1 - similarity)))


def license_matches(docs: DataFrame, templates: dict[str, str] | DataFrame | None = None, *, id_col: str = "doc_id", text_col: str = "text",
                    containment: float = CONTAINMENT, miss: float = MISS) -> DataFrame:
    """doc_id, key and `matches` (template, containment, start, end as word numbers) for every row.

    A template is listed once, at the window that holds most of it, the first of
    equal ones; a window may hold more than one template. Null, empty and
    unmatched texts have an empty list, as all texts have if there are no
    templates. Templates without words match nothing. Repeated rows are each
    returned. Other columns are not read. A DataFrame of templates has the columns
    template and text, and may have a template in several wordings.
    """
    spark = docs.sparkSession
    if templates is None:
        pairs = [*TEMPLATES.items(), *license_table.rows()]
    else:
        pairs = list(templates.items()) if isinstance(templates, dict) else [(r.template, r.text) for r in templates.select("template", "text").collect()]
    known_words = sorted({(name, tuple(words)) for name, body in pairs if (words := plain_words(body or ""))})
    by_length = by_near_length([(name, list(words)) for name, words in known_words])
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), text_key(F.col(text_col)).alias("key"))
    empty = F.array().cast("array<struct<template:string,containment:double,start:int,end:int>>")
    if not by_length:
        return rows.withColumn("matches", empty)

    telling = telling_words([w for group in by_length for _, w in group], containment)
    text = F.coalesce(F.col(text_col), F.lit(""))
    hint = "(?<![a-zA-Z0-9])(?i:" + "|".join(sorted(map(re.escape, telling))) + ")(?![a-zA-Z0-9])"
    some = docs.where(text.rlike(hint)).select(F.col(id_col).cast("bigint").alias("doc_id"), text_key(F.col(text_col)).alias("key"),
                                               F.filter(F.split(ascii_lower(text), SPLIT), lambda w: w != "").alias("words"))
    at = F.filter(F.transform("words", lambda w, i: F.when(w.isin(telling), i)), lambda i: i.isNotNull())
    some = written(spark, some.select("doc_id", "key", "words", at.alias("tells"), shingle_hashes(F.col("words"), N).alias("grams")), "license-words")

    found = None
    for group in by_length:
        low, high = len(group[0][1]), len(group[-1][1])
        k, size, step = min(N, low), high + stride(low) - 1, stride(low)
        shingles = [len({tuple(w[i:i + k]) for i in range(len(w) - k + 1)}) for _, w in group]
        bands = bands_for(least_similarity(shingles, size - k + 1, containment), miss)
        # Fewer shingles than that cannot be enough of any template of the group.
        least = math.ceil(containment * min(shingles) - 1e-9)
        grams = F.col("grams") if k == N else shingle_hashes(F.col("words"), k)
        windows = some.where(F.size("words") - (k - 1) >= least).select("doc_id", "key", F.explode(windows_with(F.col("tells"), grams, size, step, k, least, bands)).alias("w"))
        windows = windows.select("doc_id", "key", "w.start", "w.grams", F.posexplode("w.keys").alias("band", "hash"))
        known = spark.range(1).select(F.explode(F.array(*(F.struct(F.lit(n).alias("template"), F.lit(" ".join(w)).alias("words")) for n, w in group))).alias("t"))
        known = known.select("t.template", shingle_hashes(F.split("t.words", " "), k).alias("wanted"))
        known = known.withColumn("wanted", F.array_distinct("wanted"))
        known = known.select("template", "wanted", F.posexplode(band_keys(F.col("wanted"), bands)).alias("band", "hash"))
        if len(group) * bands <= BROADCAST_ROWS:
            known = F.broadcast(known)
        share = F.size(F.array_intersect("wanted", "grams")) / F.size("wanted")
        hits = windows.join(known, ["band", "hash"]).withColumn("share", share).where(F.col("share") >= containment)
        hits = hits.select("doc_id", "key", "template", "share", "start", F.lit(size).alias("size"))
        found = hits if found is None else found.unionByName(hits)
    best = found.groupBy("doc_id", "key", "template").agg(F.max(F.struct("share", (-F.col("start")).alias("back"), "size")).alias("b"))
    lists = best.groupBy(F.col("doc_id").alias("in_doc"), F.col("key").alias("in_key")).agg(F.array_sort(F.collect_list(F.struct(
        "template", F.round("b.share", 6).alias("containment"), (-F.col("b.back")).alias("start"), (F.col("b.size") - F.col("b.back")).alias("end")))).alias("matches"))
    match = F.col("doc_id").eqNullSafe(F.col("in_doc")) & (F.col("key") == F.col("in_key"))
    return rows.join(written(spark, lists, "license-matches"), match, "left").select("doc_id", "key", F.coalesce("matches", empty).alias("matches"))
