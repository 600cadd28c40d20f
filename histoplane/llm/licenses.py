r"""License scans, on DataFrame operations only.

Words are runs of ASCII letters and digits, lower-cased; shingles are five words. For each template of n shingles
windows of n + s - 1 shingles start at every s-th shingle, s = max(1, n // 8), so a copy lies whole in some window.
A window that holds ``percent`` of a template's shingles holds at least one of any more than 100 - ``percent`` per
cent of them: windows are made only around such anchor shingles, and texts without the anchors' words have
none; that drops no match. Each window's MinHash bands (``BANDS`` of ``ROWS`` values) retrieve templates of its size: at the
Jaccard similarity of at least 0.55 that a match of 75 per cent implies, one of 24 bands of two collides with
probability 0.9998, at that of a whole copy (0.88 or more) with certainty for practical purposes. A retrieved
template is then matched by exact containment of its shingles in the window.

The result has a row for each document row and template found: the largest containment over its windows and the
first word (from 0) of the first such window. A null, empty or short text matches nothing; rows that repeat an id or
have none are documents of their own, with rows of their own; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import read_table

K = 5
BANDS, ROWS = 24, 2

# Public license notices, as their authors ask to put them into files.
TEMPLATES = {
    "MIT-line": "Released under the MIT License.",
    "Apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-4.0-line": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-4.0-short": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0-short": "Licensed under CC BY-SA 4.0.",
    "CC-BY-NC-4.0-short": "Licensed under CC BY-NC 4.0.",
    "CC-BY-NC-SA-4.0-short": "Licensed under CC BY-NC-SA 4.0.",
    "CC-BY-ND-4.0-short": "Licensed under CC BY-ND 4.0.",
    "CC-BY-NC-ND-4.0-short": "Licensed under CC BY-NC-ND 4.0.",
    "CC-BY-SA-4.0-line": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC-BY-NC-4.0-line": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "CC-BY-NC-SA-4.0-line": "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.",
    "CC-BY-ND-4.0-line": "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.",
    "CC-BY-NC-ND-4.0-line": "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License.",
    "CC0-1.0-short": "Licensed under CC0 1.0.",
    "CC0-1.0-line": "CC0 1.0 Universal (CC0 1.0) Public Domain Dedication",
    "CC0-1.0": "has waived all copyright and related or neighboring rights to",
    "LGPL-line": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "AGPL-line": "This work is licensed under the GNU Affero General Public License, version 3.",
    "BSD-line": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    "GPL-3.0-or-later": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    # the words by which these differ from the GPL's notice, or that follow a name: a whole notice would match its neighbours at 75 per cent
    "LGPL": "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
    "AGPL": "under the terms of the GNU Affero General Public License as published by the Free Software Foundation",
    "BSD-clauses-1-2": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "BSD-clause-3": "nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
}


def words_of(text: str) -> list[str]:
    return [w.lower() for w in re.findall("[A-Za-z0-9]+", text)]


def template_table(templates: dict[str, str], percent: int) -> list[dict]:
    """Shingles, window, stride and anchors of each template: at most a few hundred values in all, made on the driver."""
    out = []
    for name, text in templates.items():
        words = words_of(text)
        shingles = list(dict.fromkeys(" ".join(words[i : i + K]) for i in range(len(words) - K + 1)))
        if not shingles:
            raise ValueError(f"{name} has fewer than {K} words")
        n = len(shingles)
        anchors = shingles[: n - -(-(percent * n) // 100) + 1]
        out.append({"name": name, "shingles": shingles, "stride": max(1, n // 8), "window": n + max(1, n // 8) - 1, "anchors": anchors})
    return out


def _telling(shingle: str) -> str:
    """A pattern that every text with the shingle has and few others do: its longest word, or pair of words if that is short."""
    words = shingle.split()
    word = max(words, key=len)
    return word if len(word) >= 8 else "[^a-z0-9]+".join(max(zip(words, words[1:]), key=lambda p: len(p[0] + p[1])))


def _seeded(x: Column, j: Column) -> Column:
    return F.xxhash64(x, j)


def _bands(window: Column) -> Column:
    least = lambda j, r: F.array_min(F.transform(window, lambda x: _seeded(x, j * ROWS + r)))
    return F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda j: F.xxhash64(j, *[least(j, F.lit(r)) for r in range(ROWS)]))


def scan(docs: DataFrame, templates: dict[str, str] | None = None, percent: int = 75, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, license, containment, first_word``."""
    spark = docs.sparkSession
    table = template_table(templates or TEMPLATES, percent)
    rows = [(t["name"], t["shingles"], t["anchors"], t["stride"], t["window"]) for t in table]
    known = spark.createDataFrame(rows, "license string, grams array<string>, anchors array<string>, stride int, width int")
    known = known.select("license", F.transform("grams", lambda g: F.xxhash64(g)).alias("grams"), F.transform("anchors", lambda g: F.xxhash64(g)).alias("anchors"), "stride", "width")
    keys = sorted({_telling(a) for t in table for a in t["anchors"]})

    # a number for each row: rows that share an id, or have none, are documents of their own
    named = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).where(F.col("text").rlike("(?i)" + "|".join(keys)))
    words = F.transform(F.regexp_extract_all("text", F.lit("[A-Za-z0-9]+"), F.lit(0)), lambda w: F.lower(w))
    named = named.select(F.struct(F.monotonically_increasing_id().alias("row"), "doc_id").alias("doc"), words.alias("words"))
    grams = F.transform(F.sequence(F.lit(1), F.greatest(F.size("words") - (K - 1), F.lit(1))), lambda i: F.xxhash64(F.concat_ws(" ", F.slice("words", i, F.lit(K)))))
    named = named.select("doc", grams.alias("text_grams"))
    # coalesce: a condition that is null for nulls would be pushed below as a filter that makes the shingles again for each word
    # templates of one window width share their windows; a row for each width, whatever the corpus
    classes = known.groupBy("stride", "width").agg(F.flatten(F.collect_list("anchors")).alias("anchors"))
    pairs = named.join(F.broadcast(classes), F.coalesce(F.arrays_overlap("text_grams", "anchors"), F.lit(False)))
    places = F.filter(F.sequence(F.lit(0), F.size("text_grams") - 1), lambda i: F.array_contains(F.col("anchors"), F.element_at("text_grams", i + 1)))
    first = lambda i: F.greatest(F.lit(0), F.ceil((i - F.col("width") + 1) / F.col("stride")).cast("int"))
    last = lambda i: F.floor(i / F.col("stride")).cast("int")
    starts = F.array_distinct(F.flatten(F.transform(places, lambda i: F.sequence(first(i), last(i)))))
    windows = F.transform(starts, lambda s: F.struct((s * F.col("stride")).alias("first_word"), F.array_distinct(F.slice("text_grams", s * F.col("stride") + 1, F.col("width"))).alias("window")))
    windows = pairs.select("doc", "width", F.explode(windows).alias("w")).select("doc", "width", "w.first_word", "w.window")

    template_bands = known.select("license", "width", "grams", F.posexplode(_bands(F.col("grams"))).alias("band", "value"))
    banded = windows.select("doc", "width", "first_word", "window", F.posexplode(_bands(F.col("window"))).alias("band", "value"))
    found = banded.join(F.broadcast(template_bands), ["width", "band", "value"]).select("doc", "first_word", "license", "window", "grams")
    found = found.withColumn("containment", F.size(F.array_intersect("window", "grams")) / F.size("grams")).where(F.col("containment") * 100 >= percent)
    best = found.groupBy("doc", "license").agg(F.max(F.struct("containment", (-F.col("first_word")).alias("at"))).alias("best"))
    return best.select("doc.doc_id", "license", F.col("best.containment").alias("containment"), (-F.col("best.at")).cast("long").alias("first_word"))


def op5_license_scan(spark, sf_dir: str) -> DataFrame:
    return scan(read_table(spark, sf_dir, "documents"))


def _sql(percent: int = 75) -> str:
    """Every window of every template's stride, without bands."""
    quote = lambda x: "'" + x.replace("'", "''") + "'"
    rows = ", ".join(f"({quote(t['name'])}, {quote(g)}, {len(t['shingles'])}, {t['stride']}, {t['window']})" for t in template_table(TEMPLATES, percent) for g in t["shingles"])
    return f"""
WITH t(license, g, n, stride, width) AS (VALUES {rows}
), w AS (SELECT doc_id, list_transform(regexp_extract_all(text, '[A-Za-z0-9]+'), lambda x: lower(x)) AS words FROM documents
), s AS (SELECT doc_id, words, unnest(range(0, len(words) - 4)) AS i FROM w
), h AS (SELECT s.doc_id, s.i, t.* FROM s JOIN t ON t.g = array_to_string(words[i+1:i+5], ' ')
), k AS (SELECT doc_id, license, g, n, unnest(range(greatest(0, ceil((i - width + 1) / stride)::BIGINT), i // stride + 1)) * stride AS first_word FROM h
), c AS (SELECT doc_id, license, first_word, count(DISTINCT g) / any_value(n) AS containment FROM k GROUP BY 1, 2, 3
), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, license ORDER BY containment DESC, first_word) AS o FROM c WHERE containment * 100 >= {percent})
SELECT doc_id, license, containment, first_word::BIGINT AS first_word FROM r WHERE o = 1
"""


OP5_SQL = _sql()
