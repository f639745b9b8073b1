"""License scans: MinHash bands over overlapping windows retrieve templates, exact shingle containment verifies them.

Built-in functions only. Words are runs of letters and digits in lower case, shingles are five words. Templates are put into
classes of like length (within a quarter); for a class of at most L words, windows of L + stride - 1 words start every stride =
ceil(L / 4) words, so an occurrence lies whole in one window, whose Jaccard similarity with a template that it contains to
0.8 is then above 0.38. With one row a band, BANDS = 32 bands miss such a window with a probability below 1 in 4 million.
A retrieved window is verified on its shingles themselves: it must hold at least 80% of the template's.

Only texts with a cover word are windowed, and only windows with one are hashed. Cover words are chosen from the templates so that every one of their shingles
holds one; a window without any cover word therefore shares no shingle with a template, and nothing is lost.
The templates are a parameter, a short list; only they are broadcast, and their number is checked against MOST.

Edge cases: null and empty texts, and texts of fewer than five words, match nothing; a very long text is first cut into
stretches of whole windows, so no row holds all its windows at once;
a template that occurs more than once in a text is one finding with its best containment; repeated rows give the same
findings once, and rows without doc_id are findings of one null doc_id together; an empty table gives no rows; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import re
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.llm.shared import held, let, table
from corvane.llm.spots import COMMON

SHINGLE = 5
LEAST = 0.8
BANDS = 32
#: Windows of a stretch.
STRETCH = 32
#: Templates at most: what is broadcast has at most MOST * BANDS rows.
MOST = 500

#: Public notices, as their licenses word them.
TEMPLATES = {
    "apache_2_0": "Licensed under the Apache License, Version 2.0.",
    "apache_2_0_header": "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "mit": "Released under the MIT License.",
    "mit_line": "Licensed under the MIT License.",
    "mit_grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "isc_grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "gpl_3_0": "This work is licensed under the GNU General Public License, version 3.",
    "gpl_3_0_header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "lgpl_2_1": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "mpl_2_0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "mpl_1_1": "The contents of this file are subject to the Mozilla Public License Version 1.1 (the License); you may not use this file except in compliance with the License.",
    "gpl_2_0_header": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "lgpl_3_0": "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "agpl_3_0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "bsd_third_clause": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "as_is_holders": "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.",
    "mit_as_is": "THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.",
    "zlib": "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely.",
    "boost_1_0": "Distributed under the Boost Software License, Version 1.0.",
    "boost_1_0_grant": "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the Software) to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software.",
    "epl_2_0": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0.",
    "cddl_1_0": "The contents of this file are subject to the terms of the Common Development and Distribution License (the License). You may not use this file except in compliance with the License.",
    "cc0_1_0": "To the extent possible under law, the author has dedicated all copyright and related and neighboring rights to this work to the public domain worldwide.",
    "cc_by_nc_4_0": "Licensed under CC BY-NC 4.0.",
    "cc_by_4_0": "Licensed under CC BY 4.0.",
    "cc_by_sa_4_0": "Licensed under CC BY-SA 4.0.",
    "cc_by_long": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "unlicense": "This is free and unencumbered software released into the public domain.",
}
_SPLIT = r"[^\p{L}\p{N}]+"


def words_of(text: str) -> list[str]:
    """A template's words, as the columns' expressions find them."""
    return [w for w in re.split(r"[\W_]+", text.lower()) if w]


def classes(templates: dict[str, str]) -> dict[str, int]:
    """The class of each template: the longest length among those within a quarter of it."""
    out: dict[str, int] = {}
    length = 0
    for name in sorted(templates, key=lambda x: -len(words_of(templates[x]))):
        n = len(words_of(templates[name]))
        if n < SHINGLE:
            raise ValueError(f"template {name} has fewer than {SHINGLE} words")
        if not length or n < 0.75 * length:
            length = n
        out[name] = length
    return out


def stride(length: int) -> int:
    return -(-length // 4)


def cover(templates: dict[str, str]) -> list[str]:
    """Words such that every shingle of every template holds one: uncommon and long ones first, until all are held."""
    common = {w for words in COMMON.values() for w in words.split()}
    open_ = {tuple(w[i : i + SHINGLE]) for w in map(words_of, templates.values()) for i in range(len(w) - SHINGLE + 1)}
    out = []
    while open_:
        held_by = Counter(w for s in open_ for w in set(s))
        best = max(held_by, key=lambda w: (w not in common, min(len(w), 7), held_by[w], w))
        out.append(best)
        open_ = {s for s in open_ if best not in s}
    return sorted(out)


def words(text: Column) -> Column:
    """Runs of letters and digits in lower case."""
    return F.filter(F.split(F.lower(text), _SPLIT), lambda w: w != "")


def shingles(words: Column) -> Column:
    """The distinct shingles of a list of words; none if it is shorter than one."""
    at = F.sequence(F.lit(1), F.size(words) - SHINGLE + 1)
    every = F.array_distinct(F.transform(at, lambda i: F.array_join(F.slice(words, i, SHINGLE), " ")))
    return F.when(F.size(words) >= SHINGLE, every).otherwise(F.expr("array_repeat('', 0)"))


def bands(shingles: Column) -> Column:
    """The minimum of each hash function over the shingles, with the function's number mixed in."""
    hashes = F.transform(shingles, lambda s: F.xxhash64(s))
    return let(hashes, lambda h: F.array(*[F.xxhash64(F.array_min(F.transform(h, _seeded(b))), F.lit(b)) for b in range(BANDS)]))


def _seeded(b: int):
    return lambda x: F.xxhash64(x, F.lit(b + 1000))


def _templates(spark, templates: dict[str, str]) -> DataFrame:
    if len(templates) > MOST:
        raise ValueError(f"more than {MOST} templates")
    kinds = classes(templates)
    rows = spark.createDataFrame([(name, kinds[name], " ".join(words_of(text))) for name, text in templates.items()], "license string, class int, body string")
    return rows.select("license", "class", shingles(F.split("body", " ")).alias("wanted"))


def scanned(docs: DataFrame, templates: dict[str, str] = TEMPLATES) -> DataFrame:
    """doc_id, license, containment: the templates that each document holds."""
    spark = docs.sparkSession
    wanted = _templates(spark, templates)
    listed = held(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), "words", words(F.col("text"))).drop("text")
    telling = F.array(*[F.lit(w) for w in cover(templates)])
    likely = listed.where(F.arrays_overlap("words", telling))
    lengths = sorted(set(classes(templates).values()))

    def stretches(length: int) -> Column:
        """The words of STRETCH windows each; one stretch holds the words of the last windows, which may be fewer."""
        step = stride(length)
        last = F.greatest(F.size("words") - (length + step - 1) + step, F.lit(1))
        starts = F.sequence(F.lit(1), last, F.lit(step * STRETCH))
        size = step * (STRETCH - 1) + length + step - 1
        return F.transform(starts, lambda i: F.struct(F.lit(length).alias("class"), F.lit(step).alias("step"), F.least(F.lit(STRETCH), F.floor((last - i) / step).cast("int") + 1).alias("n"), F.slice(F.col("words"), i, size).alias("said")))

    parts = likely.select("doc_id", F.explode(F.concat(*[stretches(n) for n in lengths])).alias("s")).where(F.arrays_overlap("s.said", telling))
    starts = F.transform(F.sequence(F.lit(0), F.col("s.n") - 1), lambda i: F.slice(F.col("s.said"), i * F.col("s.step") + 1, F.col("s.class") + F.col("s.step") - 1))
    cut = parts.select("doc_id", F.col("s.class").alias("class"), F.explode(starts).alias("window"))
    cut = cut.where(F.arrays_overlap("window", telling))
    cut = held(cut.select("doc_id", "class", "window"), "shingles", shingles(F.col("window"))).drop("window").where(F.size("shingles") > 0)
    keyed = cut.select("*", F.explode(bands(F.col("shingles"))).alias("band"))
    index = wanted.select("license", "class", "wanted", F.explode(bands(F.col("wanted"))).alias("band"))
    found = keyed.join(F.broadcast(index), ["class", "band"])
    shared = F.size(F.array_intersect("shingles", "wanted")) / F.size("wanted")
    return found.select("doc_id", "license", shared.alias("containment")).where(F.col("containment") >= LEAST).groupBy("doc_id", "license").agg(F.max("containment").alias("containment"))


def op1_licenses(spark, sf_dir: str) -> DataFrame:
    return scanned(table(spark, sf_dir, "documents"))


def _sql() -> str:
    kinds = classes(TEMPLATES)
    rows = ", ".join(f"('{name}', {kinds[name]}, {stride(kinds[name])}, '{' '.join(words_of(text))}')" for name, text in TEMPLATES.items())
    return rf"""
WITH templates AS (SELECT *, string_split(body, ' ') AS w FROM (VALUES {rows}) t(license, class, step, body)),
wanted AS (SELECT DISTINCT license, class, step, array_to_string(w[i:i + {SHINGLE - 1}], ' ') AS s FROM (SELECT *, unnest(range(1, len(w) - {SHINGLE - 2})) AS i FROM templates)),
sizes AS (SELECT license, count(*) AS m FROM wanted GROUP BY license),
docs AS (SELECT row_number() OVER () AS n, doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '') AS w FROM documents),
cut AS (SELECT n, doc_id, len(w) AS size, i, array_to_string(w[i:i + {SHINGLE - 1}], ' ') AS s FROM (SELECT *, unnest(range(1, len(w) - {SHINGLE - 2})) AS i FROM docs)),
hits AS (SELECT n, doc_id, size, i, license, class, step, s FROM cut JOIN wanted USING (s)),
windows AS (
  SELECT n, doc_id, license, s, start FROM (
    SELECT *, 1 + step * unnest(range(CAST(greatest(size - class - step + 1 + step - 1, 0) // step + 1 AS BIGINT))) AS start FROM hits)
  WHERE i >= start AND i + {SHINGLE - 1} <= start + class + step - 2),
counted AS (SELECT doc_id, license, count(DISTINCT s) / any_value(m) AS containment FROM windows JOIN sizes USING (license) GROUP BY n, doc_id, license, start)
SELECT doc_id, license, max(containment) AS containment FROM counted WHERE containment >= {LEAST} GROUP BY doc_id, license
"""


OP1_SQL = _sql()
