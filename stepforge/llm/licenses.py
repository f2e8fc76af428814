"""License scans: a positional rare-token index over licence templates.

Base: places where a phrase's words stand one after another. Method: document frequencies
of all template words over all documents give their IDF; of every template its own
``RARE_WORDS`` rarest words are indexed with their positions, so that no licence of a file
takes the place of another. Every indexed word of a file is looked up, and each pair of a
place in the file and a posting votes for a relative position. A template whose words at
one relative position have ``AGREEMENT`` of the weight of its indexed words is a candidate;
it counts once the file has one of its mandatory key phrases. Templates are usual notices
and whole short licence texts; files that have only the opening of a text are found by
the opening, which is a template of its own. Everything is SQL expressions and
aggregations; only files with a template word keep their words past the first pass.

A word is a run of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]`` after lower-casing A-Z. The
score is the largest share of weight that agrees for a verified template, at least 0.5
where a base phrase stands, and 0 without any label.

Defined results: null and empty texts have no words, labels are the empty text; very long
texts are read whole; repeated rows have repeated results, ids need not be unique; of words
equally rare a template indexes the first in order; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stepforge.llm.common import table, written

WORD = "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
#: Base phrases and their labels.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: Public licence texts, their openings and usual notices, by label; beside
#: each the key phrases of which a file must have one.
TEMPLATES = {
    "mit": [
        ("released under the mit license", ["the mit license"]),
        ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction", ["permission is hereby granted free of charge to any person"]),
        (
            """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
            The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
            THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
            ["permission is hereby granted free of charge to any person"],
        ),
    ],
    "apache-2.0": [
        ("licensed under the apache license version 2 0", ["apache license version 2 0"]),
        ("licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license", ["apache license version 2 0"]),
        ("licensed under the apache license 2 0", ["apache license 2 0", "apache license version 2 0", "apache 2 0 license"]),
        (
            """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0
            Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
            ["apache license version 2 0", "apache org licenses license 2 0"],
        ),
    ],
    "gpl-3.0": [
        ("licensed under the gnu general public license version 3", ["gnu general public license version 3", "gnu gpl version 3"]),
        ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license", ["gnu general public license as published by the free software foundation either version 3"]),
    ],
    "gpl-2.0": [
        ("licensed under the gnu general public license version 2", ["gnu general public license version 2", "gnu gpl version 2"]),
        (
            """This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.
            This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.""",
            ["gnu general public license as published by the free software foundation either version 2", "gnu general public license version 2 as published by the free software foundation"],
        ),
    ],
    "lgpl": [
        ("licensed under the gnu lesser general public license", ["gnu lesser general public license"]),
        (
            """This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.
            This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.""",
            ["gnu lesser general public license"],
        ),
    ],
    "agpl-3.0": [
        ("licensed under the gnu affero general public license version 3", ["gnu affero general public license"]),
        (
            """This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.""",
            ["gnu affero general public license"],
        ),
    ],
    "cc-by-nc-4.0": [("licensed under cc by nc 4 0", ["cc by nc 4 0"]), ("This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License", ["creative commons attribution noncommercial 4 0 international"])],
    "cc-by-sa-4.0": [("licensed under cc by sa 4 0", ["cc by sa 4 0"]), ("This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License", ["creative commons attribution sharealike 4 0 international"])],
    "cc-by-4.0": [("licensed under cc by 4 0", ["cc by 4 0"]), ("This work is licensed under a Creative Commons Attribution 4.0 International License", ["creative commons attribution 4 0 international"])],
    "bsd": [
        ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ["redistribution and use in source and binary forms"]),
        (
            """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
            Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
            THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
            ["redistribution and use in source and binary forms"],
        ),
    ],
    "isc": [
        ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ["permission to use copy modify and or distribute this software for any purpose"]),
        (
            """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
            THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
            ["permission to use copy modify and or distribute this software for any purpose", "permission to use copy modify and distribute this software for any purpose"],
        ),
    ],
    "mpl-2.0": [
        ("this source code form is subject to the terms of the mozilla public license v 2 0", ["mozilla public license v 2 0", "mozilla public license version 2 0"]),
        ("""This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.""", ["mozilla public license v 2 0", "mozilla org mpl 2 0"]),
    ],
    "unlicense": [
        ("this is free and unencumbered software released into the public domain", ["free and unencumbered software released into the public domain"]),
        (
            """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.
            In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.""",
            ["free and unencumbered software released into the public domain"],
        ),
    ],
    "zlib": [
        (
            """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.
            Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. This notice may not be removed or altered from any source distribution.""",
            ["the origin of this software must not be misrepresented"],
        ),
    ],
    "bsl-1.0": [
        (
            """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so""",
            ["any person or organization obtaining a copy of the software and accompanying documentation covered by this license", "boost software license version 1 0"],
        ),
    ],
    "cc0-1.0": [("To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work", ["waived all copyright and related or neighboring rights", "cc0 1 0 universal"])],
}
#: Template words too common to be indexed.
COMMON = "0 1 2 3 4 a all an and any are as at be been being by do for from has have he if in into is it may no not of on one or other our out should so such that the their then there these this those to under use used was we were when where which who will with within without would you your".split()
#: Indexed words of a template: those of highest IDF.
RARE_WORDS = 12
#: Least share of the IDF weight of a template's indexed words that must agree on one
#: relative position.
AGREEMENT = 0.6


def words_of(text: str) -> list[str]:
    """Words of a template or phrase, which are ASCII."""
    return re.findall("[0-9a-z]+", text.lower())


def numbered(templates: dict = TEMPLATES) -> tuple[list[tuple[int, str, list[str], list[str]]], list[str]]:
    """Numbered templates (number, label, words, key phrases) and all words that may be
    indexed or begin a base phrase."""
    rows = [(label, words_of(text), [" ".join(words_of(k)) for k in keys]) for label, texts in templates.items() for text, keys in texts]
    rows = [(i, *r) for i, r in enumerate(rows)]
    phrases = {w for p in PHRASES for w in p.split()}
    return rows, sorted({w for _, _, words, _ in rows for w in words} - {*COMMON} | phrases - {*COMMON})


def postings(rows: list[tuple[int, str, list[str], list[str]]], idf: dict[str, float]) -> list[tuple[str, int, int, float]]:
    """(word, template, position, share of the template's weight) of the rarest words of
    each template, by the first place that a word has in it."""
    out = []
    for i, _, words, _ in rows:
        rare = sorted({*words} - {*COMMON}, key=lambda w: (-idf[w], w))[:RARE_WORDS]
        total = sum(idf[w] for w in rare)
        out += [(w, i, words.index(w), idf[w] / total) for w in rare]
    return out


def _array(values) -> str:
    return "array(" + ", ".join(f"'{v}'" for v in values) + ")"


def license_labels(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), templates: dict = TEMPLATES) -> DataFrame:
    """``keep`` and n_words, n_base, first_word, last_word, base_labels, labels, score."""
    rows_of, vocabulary = numbered(templates)
    own = [f"_own{i}" for i in range(len(keep))]
    t = df.select(*(F.col(k).alias(o) for k, o in zip(keep, own, strict=True)), F.coalesce(F.col(text), F.lit("")).alias("_t"))
    # Two letters outside ASCII would become ASCII in lower case; here they stay what they are: parts of words.
    t = t.withColumn("_low", F.expr("lower(replace(replace(_t, 'K', 'ı'), 'İ', 'ı'))"))
    t = t.withColumn("_w", F.regexp_extract_all("_low", F.lit(WORD), F.lit(0)))
    t = t.withColumn("_hits", F.expr(f"array_intersect({_array(vocabulary)}, _w)"))
    first = t.select(*own, F.size("_w").cast("long").alias("n_words"), "_hits", F.when(F.size("_hits") > 0, F.col("_w")).alias("_w"), F.monotonically_increasing_id().alias("_row"))
    rows, _ = written(first, "license-words")

    n_docs = rows.count()
    # One row for each indexed word at most.
    frequency = dict(rows.select(F.explode("_hits").alias("w")).groupBy("w").count().collect())
    idf = {w: math.log((1 + n_docs) / (1 + frequency.get(w, 0))) + 0.01 for w in vocabulary}

    few = rows.where(F.size("_hits") > 0)
    is_at = lambda words: "(" + " AND ".join(f"get(_w, i + {d}) = '{w}'" for d, w in enumerate(words)) + ")"
    phrases = " OR ".join(is_at(p.split()) for p in PHRASES)
    few = few.withColumn("_at", F.expr(f"filter(sequence(0, size(_w) - 1), i -> {phrases})"))
    starts = " ".join(f"WHEN {is_at(p.split())} THEN '{label}'" for p, label in PHRASES.items())
    few = few.withColumn("_base", F.expr(f"array_sort(array_distinct(transform(_at, i -> CASE {starts} END)))"))

    # A row for each template and indexed word: bounded by the templates, not by the data.
    found = postings(rows_of, idf)
    literal = "array(" + ", ".join(f"named_struct('w', '{w}', 't', {t}, 'p', {p}, 'x', {x!r}D)" for w, t, p, x in found) + ")"
    posting = df.sparkSession.range(1).select(F.inline(F.expr(literal)))
    places = few.select("_row", F.posexplode("_w").alias("i", "w")).where(F.col("w").isin(sorted({w for w, *_ in found})))
    votes = places.join(F.broadcast(posting), "w").groupBy("_row", "t", (F.col("i") - F.col("p")).alias("at")).agg(F.least(F.lit(1.0), F.round(F.sum("x"), 9)).alias("share"))
    best = votes.where(F.col("share") >= AGREEMENT).groupBy("_row", "t").agg(F.max("share").alias("share"))
    found = best.groupBy("_row").agg(F.collect_list(F.struct("t", "share")).alias("_found"))

    few = few.join(found, "_row", "left").withColumn("_text", F.concat(F.lit(" "), F.array_join("_w", " "), F.lit(" ")))
    keys = " ".join(f"WHEN x.t = {i} THEN {' OR '.join(f'contains(_text, {chr(39)} {k} {chr(39)})' for k in phrases_)}" for i, _, _, phrases_ in rows_of)
    few = few.withColumn("_sure", F.expr(f"filter(coalesce(_found, CAST(array() AS ARRAY<STRUCT<t: INT, share: DOUBLE>>)), x -> CASE {keys} ELSE false END)"))
    names = _array(label for _, label, _, _ in rows_of)
    few = few.select(
        "_row",
        F.size("_at").cast("long").alias("n_base"),
        F.array_min("_at").cast("long").alias("first_word"),
        F.array_max("_at").cast("long").alias("last_word"),
        F.array_join("_base", ",").alias("base_labels"),
        F.expr(f"array_join(array_sort(array_union(_base, transform(_sure, x -> element_at({names}, x.t + 1)))), ',')").alias("labels"),
        F.expr("greatest(coalesce(array_max(transform(_sure, x -> x.share)), 0.0D), CASE WHEN size(_base) > 0 THEN 0.5D ELSE 0.0D END)").alias("score"),
    )
    out = rows.select(*own, "n_words", "_row").join(few, "_row", "left")
    return out.select(
        *(F.col(o).alias(k) for k, o in zip(keep, own, strict=True)),
        "n_words",
        F.coalesce("n_base", F.lit(0).cast("long")).alias("n_base"),
        "first_word",
        "last_word",
        F.coalesce("base_labels", F.lit("")).alias("base_labels"),
        F.coalesce("labels", F.lit("")).alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
    )


def op10_licenses(spark, sf_dir: str) -> DataFrame:
    """Licence phrases, labels and scores of every whole document."""
    return license_labels(table(spark, sf_dir, "documents"))
