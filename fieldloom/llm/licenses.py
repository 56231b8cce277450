"""License notices in texts: MinHash bands over windows, then shingle containment.

Overlapping windows, twice as long as the templates of their class, are
compared with the templates by MinHash. A notice fills only a part of its
window, so bands have one row, and their number is set by the least similarity
that a match can have. Templates that share a band are verified by the share
of their five-word shingles that the window holds. Everything is built of
column expressions; no Python runs on executors.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SHINGLE = 5
CONTAINED = 0.8
#: Probability that a window with a match shares no band with its template, at most.
MISS = 1e-5

# License notices, titles and passages as their licenses word them (fixed values).
TEMPLATES = {
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-notice": "you may not use this file except in compliance with the License. You may"
    " obtain a copy of the License at",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are"
    " permitted provided that the following conditions are met",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "cc-by-sa-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0"
    " International License.",
    "gpl-3": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-notice": "This program is free software: you can redistribute it and/or modify it under the"
    " terms of the GNU General Public License as published by the Free Software Foundation",
    "mit": "Released under the MIT License.",
    "mit-notice": "Permission is hereby granted, free of charge, to any person obtaining a copy of"
    " this software and associated documentation files",
    "0bsd": "Permission to use, copy, modify, and/or distribute this software for any purpose with or"
    " without fee is hereby granted.",
    "agpl-3": "This work is licensed under the GNU Affero General Public License, version 3.",
    "agpl-notice": "it under the terms of the GNU Affero General Public License as published by the Free"
    " Software Foundation",
    "agpl-title": "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007",
    "apache-2.0-short": "Licensed under the Apache License 2.0",
    "apache-2.0-title": "Apache License Version 2.0, January 2004",
    "apache-2.0-spdx": "SPDX-License-Identifier: Apache-2.0",
    "apache-2.0-warranty": "distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR"
    " CONDITIONS OF ANY KIND, either express or implied",
    "artistic-2.0": "the terms of the Artistic License 2.0",
    "bsd-short": "Licensed under the BSD License",
    "bsd-2-short": "Licensed under the BSD 2-Clause License",
    "bsd-3-short": "Licensed under the BSD 3-Clause License",
    "bsd-style": "governed by a BSD-style license that can be found in the LICENSE file",
    "bsd-warranty": "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR"
    " IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY"
    " AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED",
    "bsl-1.0": "Distributed under the Boost Software License, Version 1.0.",
    "bsl-1.0-notice": "Permission is hereby granted, free of charge, to any person or organization obtaining a copy"
    " of the software and accompanying documentation covered by this license",
    "cc0-1.0": "Creative Commons CC0 1.0 Universal",
    "cc0-notice": "has waived all copyright and related or neighboring rights to this work",
    "cc-by-4.0": "Licensed under CC BY 4.0.",
    "cc-by-4.0-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-3.0-notice": "This work is licensed under a Creative Commons Attribution 3.0 Unported License.",
    "cc-by-sa-4.0-short": "Licensed under CC BY-SA 4.0.",
    "cc-by-sa-3.0-notice": "This work is licensed under a Creative Commons Attribution-ShareAlike 3.0 Unported License.",
    "cc-by-nd-4.0": "Licensed under CC BY-ND 4.0.",
    "cc-by-nd-4.0-notice": "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International"
    " License.",
    "cc-by-nc-4.0-notice": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International"
    " License.",
    "cc-by-nc-sa-4.0": "Licensed under CC BY-NC-SA 4.0.",
    "cc-by-nc-sa-4.0-notice": "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0"
    " International License.",
    "cc-by-nc-nd-4.0": "Licensed under CC BY-NC-ND 4.0.",
    "cc-by-nc-nd-4.0-notice": "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0"
    " International License.",
    "epl-1.0": "made available under the terms of the Eclipse Public License v1.0",
    "epl-2.0": "made available under the terms of the Eclipse Public License 2.0",
    "epl-2.0-short": "Licensed under the Eclipse Public License 2.0",
    "gpl-2": "under the terms of the GNU General Public License version 2",
    "gpl-2-title": "GNU GENERAL PUBLIC LICENSE Version 2, June 1991",
    "gpl-3-short": "Licensed under the GNU General Public License v3.0",
    "gpl-3-title": "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
    "gpl-short": "Licensed under the GNU General Public License",
    "isc": "Licensed under the ISC License",
    "isc-released": "Released under the ISC License",
    "isc-notice": "Permission to use, copy, modify, and distribute this software for any purpose with or"
    " without fee is hereby granted, provided that the above copyright notice and this permission"
    " notice appear in all copies",
    "lgpl-short": "Licensed under the GNU Lesser General Public License",
    "lgpl-notice": "under the terms of the GNU Lesser General Public License as published by the Free Software"
    " Foundation",
    "lgpl-2.1-title": "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999",
    "lgpl-3-title": "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
    "mit-licensed": "Licensed under the MIT License",
    "mit-distributed": "Distributed under the MIT License",
    "mit-terms": "under the terms of the MIT License",
    "mit-included": "The above copyright notice and this permission notice shall be included in all copies or"
    " substantial portions of the Software",
    "mit-warranty": "THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING"
    " BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND"
    " NONINFRINGEMENT",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "mpl-2.0-short": "Licensed under the Mozilla Public License 2.0",
    "mpl-1.1": "The contents of this file are subject to the Mozilla Public License Version 1.1",
    "unlicense": "This is free and unencumbered software released into the public domain",
    "wtfpl": "DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE",
    "zlib": "Permission is granted to anyone to use this software for any purpose, including commercial"
    " applications, and to alter it and redistribute it freely",
}
_WORD = "[A-Za-z0-9]+"


def _words(text: str) -> list[str]:
    return re.findall(_WORD, text.lower())


def window_of(n_words: int) -> int:
    """Words of the windows for a template: a power of two, at least twice its words."""
    return max(4, 1 << (2 * n_words - 1).bit_length())


def bands_for(window: int, shingles: int) -> int:
    """One-row bands that a match of a template shares with probability 1 - MISS at least."""
    found = math.ceil(CONTAINED * shingles)
    least = found / (max(1, window - SHINGLE + 1) + shingles - found)
    return math.ceil(math.log(MISS) / math.log(1 - least)) if least < 1 else 1


def anchors(templates: dict[str, str]) -> list[str]:
    """Words of which every shingle of a template holds one."""
    found: set[str] = set()
    for text in templates.values():
        words = _words(text)
        for i in range(max(1, len(words) - SHINGLE + 1)):
            shingle = words[i : i + SHINGLE]
            if shingle and not found & set(shingle):
                found.add(max(shingle, key=len))
    return sorted(found)


def phrase_pattern(templates: dict[str, str]) -> str:
    """A pattern that every text with CONTAINED of a template's shingles matches: two words in a row.

    The pairs of words touch so many shingles of each template that the others
    alone are under CONTAINED.
    """
    pairs: set[tuple[str, ...]] = set()
    for text in templates.values():
        words = _words(text)
        shingles = {tuple(words[i : i + SHINGLE]) for i in range(max(1, len(words) - SHINGLE + 1))} - {()}
        own = {shingle: set(zip(shingle, shingle[1:])) or {shingle} for shingle in shingles}
        needed = math.floor(len(shingles) * (1 - CONTAINED) + 1e-6) + 1
        listed = sorted(set().union(*own.values()), key=lambda pair: (len("".join(pair)), pair))
        while listed and sum(bool(pairs & held) for held in own.values()) < needed:
            pairs.add(listed.pop())
    listed = "|".join("[^A-Za-z0-9]+".join(pair) for pair in sorted(pairs))
    return f"(?i)(?<![A-Za-z0-9])(?:{listed})(?![A-Za-z0-9])"


def _shingles(words: Column) -> Column:
    """Distinct hashes of the five-word shingles; shorter windows are one."""
    places = F.sequence(F.lit(1), F.greatest(F.size(words) - (SHINGLE - 1), F.lit(1)))
    hashed = F.transform(places, lambda i: F.xxhash64(F.array_join(F.slice(words, i, SHINGLE), " ")))
    return F.array_distinct(hashed)


def _bands(shingles: Column, count: Column) -> Column:
    """The smallest hash of the shingles under each of ``count`` hash functions."""
    return F.transform(
        F.sequence(F.lit(1), count),
        lambda k: F.array_min(F.transform(shingles, lambda s: F.xxhash64(s, k))),
    )


def _starts(window: int) -> Column:
    places = F.sequence(F.lit(0), (F.size("words") - 1).cast("int"), F.lit(window // 2))
    return F.transform(places, lambda a: F.struct(F.lit(window).alias("window"), a.alias("first_word")))


def _template_rows(spark, templates: dict[str, str], bands: dict[int, int]) -> DataFrame:
    """(license, window, wanted, band, value) of the templates; as many rows as bands."""
    texts = [
        F.struct(
            F.lit(name).alias("license"), F.lit(window_of(len(_words(text)))).alias("window"),
            F.split(F.lit(" ".join(_words(text))), " ").alias("words"),
        )
        for name, text in templates.items()
    ]
    rows = spark.range(1).select(F.explode(F.array(*texts)).alias("t")).select("t.*")
    rows = rows.withColumn("wanted", _shingles(F.col("words")))
    return rows.select(
        "license", "window", "wanted",
        F.posexplode(_bands(F.col("wanted"), _count(bands))).alias("band", "value"),
    )


def _count(bands: dict[int, int]) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for pair in bands.items() for x in pair)), F.col("window"))


def license_scan(docs: DataFrame, templates: dict[str, str] | None = None) -> DataFrame:
    """One row per doc_id of ``docs`` (doc_id, text) and template found in it.

    Columns doc_id, license, n_windows (windows that hold CONTAINED of the
    template's shingles or more), containment (the largest share), first_word
    (start of the first such window, counted in words from 0). Words are runs
    of ASCII letters and digits, in lower case. Null and empty texts give no
    row; rows of one doc_id, null too, are taken together; other columns are
    left aside. An empty table gives an empty table.
    """
    templates = TEMPLATES if templates is None else templates
    bands: dict[int, int] = {}
    for text in templates.values():
        n = len(_words(text))
        least, window = len({tuple(_words(text)[i : i + SHINGLE]) for i in range(max(1, n - SHINGLE + 1))}), window_of(n)
        bands[window] = max(bands.get(window, 0), bands_for(window, least))
    marks = anchors(templates)
    # Texts without any of the phrases cannot hold shingles enough, windows without any anchor none.
    words = F.transform(F.regexp_extract_all("text", F.lit(_WORD), F.lit(0)), F.lower)
    rows = (
        docs.select(F.col("doc_id").cast("long"), "text")
        .where(F.col("text").rlike(phrase_pattern(templates)))
        .select("doc_id", words.alias("words"))
    )
    starts = [_starts(window) for window in sorted(bands)]
    windows = (
        rows.where(F.size("words") > 0)
        .select("doc_id", "words", F.explode(F.concat(*starts)).alias("w"))
        .select(
            "doc_id", "w.window", "w.first_word",
            F.slice("words", F.col("w.first_word") + 1, F.col("w.window")).alias("words"),
        )
        .where(F.arrays_overlap("words", F.array(*map(F.lit, marks))))
        .select("doc_id", "window", "first_word", _shingles(F.col("words")).alias("own"))
    )
    banded = windows.select("*", F.posexplode(_bands(F.col("own"), _count(bands))).alias("band", "value"))
    # The templates are a list in the code, so their bands have a fixed size.
    wanted = F.broadcast(_template_rows(docs.sparkSession, templates, bands))
    candidates = (
        banded.join(wanted, ["window", "band", "value"])
        .select("doc_id", "license", "first_word", "own", "wanted")
        .distinct()
    )
    share = F.size(F.array_intersect("own", "wanted")) / F.size("wanted")
    return (
        candidates.withColumn("share", share)
        .where(F.col("share") >= CONTAINED)
        .groupBy("doc_id", "license")
        .agg(
            F.count_distinct("first_word").alias("n_windows"),
            F.max("share").alias("containment"),
            F.min("first_word").cast("long").alias("first_word"),
        )
    )


def _oracle() -> str:
    rows = ",\n".join(
        f"('{name}', '{text}', {window_of(len(_words(text)))})" for name, text in TEMPLATES.items()
    )
    words = "list_transform(regexp_extract_all({}, '[A-Za-z0-9]+'), lambda x: lower(x))"
    shingles = (
        "list_distinct(list_transform(range(1, greatest(len({0}) - 4, 1) + 1),"
        " lambda i: array_to_string(list_slice({0}, i, i + 4), ' ')))"
    )
    return f"""
with template(license, text, size) as (values {rows}),
     worded as (select license, size, {words.format("text")} as words from template),
     wanted as (select license, size, {shingles.format("words")} as wanted from worded),
     doc as (select doc_id, {words.format("coalesce(text, '')")} as words from documents),
     started as (
       select doc_id, words, size, unnest(range(0, len(words), size // 2)) as first_word
       from doc, (select distinct size from wanted)),
     cut as (
       select doc_id, size, first_word,
              list_slice(words, first_word + 1, first_word + size) as words
       from started),
     seen as (select doc_id, size, first_word, {shingles.format("words")} as own from cut),
     share as (
       select doc_id, license, first_word,
              len(list_intersect(own, wanted)) / len(wanted) as share
       from seen join wanted using (size))
select doc_id, license, count(distinct first_word) as n_windows, max(share) as containment,
       min(first_word) as first_word
from share where share >= {CONTAINED}
group by doc_id, license
"""


ORACLE = _oracle()
