"""Licence scans: Dice coefficient over word bigrams against licence templates, in SQL functions only.

A text is normalised to lower-case words of letters and digits, so comment marks, line
breaks and paragraphs do not matter. Of each template, windows of as many words as it has
are compared, wherever one of its bigrams begins: the distinct bigrams of the window with
those of the template. Dice >= t is possible only if the two sizes lie within a factor
(2 - t) / t, and only if enough of the template's bigrams are there; so whole texts
without any of the templates' anchor words are left out (anchors are chosen so that a
window without one shares too few bigrams), then templates that are too large for a text
or share too few bigrams with the whole of it, then windows that hold too few of them.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.llm.common import fresh

THRESHOLD = 0.8

# Licence notices and short licence texts, as published.
TEMPLATES = {
    "all-rights-reserved": "All rights reserved.",
    "apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-notice": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
        'software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. '
        "See the License for the specific language governing permissions and limitations under the License."
    ),
    "cc-by-4.0-line": "Licensed under CC BY 4.0.",
    "cc-by-nc-4.0-line": "Licensed under CC BY-NC 4.0.",
    "cc-by-sa-4.0-line": "Licensed under CC BY-SA 4.0.",
    "cc-by-4.0-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc0-1.0-line": "This work is dedicated to the public domain under CC0 1.0.",
    "gpl-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-3.0-notice": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
        "the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope "
        "that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. "
        "See the GNU General Public License for more details."
    ),
    "isc": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above "
        'copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH '
        "REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, "
        "DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, "
        "NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
    ),
    "mit": (
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), '
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
        "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, '
        "FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER "
        "LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    ),
    "mit-line": "Released under the MIT License.",
    "agpl-3.0-notice": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by "
        "the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope "
        "that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. "
        "See the GNU Affero General Public License for more details."
    ),
    "bsd-2-clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
        "documentation and/or other materials provided with the distribution. "
        'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, '
        "THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR "
        "CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, "
        "PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF "
        "LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS "
        "SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
    ),
    "bsd-3-clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
        "documentation and/or other materials provided with the distribution. "
        "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this "
        "software without specific prior written permission. "
        'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, '
        "THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR "
        "CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, "
        "PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF "
        "LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS "
        "SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
    ),
    "bsl-1.0-notice": "Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at https://www.boost.org/LICENSE_1_0.txt)",
    "gpl-2.0-notice": (
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
        "the Free Software Foundation; either version 2 of the License, or (at your option) any later version. This program is distributed in the hope "
        "that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. "
        "See the GNU General Public License for more details."
    ),
    "lgpl-2.1-notice": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by "
        "the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version. This library is distributed in the hope "
        "that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. "
        "See the GNU Lesser General Public License for more details."
    ),
    "mpl-2.0-notice": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, "
        "You can obtain one at http://mozilla.org/MPL/2.0/."
    ),
    "unlicense": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute "
        "this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."
    ),
    "zlib": (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising "
        "from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to "
        "alter it and redistribute it freely, subject to the following restrictions:"
    ),
}
# Identifiers of the licence list that are looked for in SPDX lines.
SPDX = ("0BSD", "AGPL-3.0", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "BSL-1.0", "CC0-1.0", "GPL-2.0", "GPL-3.0", "ISC", "LGPL-2.1", "LGPL-3.0", "MIT", "MPL-2.0", "Unlicense", "Zlib")
TEMPLATES |= {f"spdx-{name.lower()}": f"SPDX-License-Identifier: {name}" for name in SPDX}

#: Words too common in any English text to be worth looking for.
COMMON = frozenset("nc sa a all and any as at be by for from in is it no not of on or other that the this to under use with you".split())


def bigrams(text: str) -> list[str]:
    """Distinct word bigrams of a template, in order."""
    words = re.findall(r"[^\W_]+", text.lower())
    return list(dict.fromkeys(f"{a} {b}" for a, b in zip(words, words[1:])))


def needed(size: int, threshold: float) -> int:
    """Bigrams that any unit must share with a template of ``size`` to reach the threshold."""
    return math.ceil(threshold * size / (2 - threshold) - 1e-9)


def anchors(template: list[str], threshold: float) -> list[str]:
    """Words such that a unit without any of them shares too few of the template's bigrams."""
    left, chosen = list(template), []
    while len(left) >= needed(len(template), threshold):
        count = Counter(w for pair in left for w in set(pair.split()))
        word = max(count, key=lambda w: (w not in COMMON and len(w) > 1, count[w] * min(len(w), 8), w))
        chosen.append(word)
        left = [pair for pair in left if word not in pair.split()]
    return chosen


def _text_array(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def words_of(text: str) -> list[str]:
    return re.findall(r"[^\W_]+", text.lower())


def find_licenses(rows: DataFrame, text: str = "text", templates: dict[str, str] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """``rows`` with ``license`` and ``license_dice`` (the best match, ties to the first name), ``n_licenses``
    and ``licenses``: every match as name:first word:Dice in ten-thousandths, comma-joined.

    A template's match is its best window, of equal ones the first; words count from 0. Of
    matches that overlap the one of the highest Dice counts, of equal ones the first name, so
    a notice is one licence. Columns
    of these names give way. Null, empty and unmatched texts have null, null, 0 and the
    empty string. Repeated rows are scanned each. Work stays inside each row: no shuffle,
    no join, no limit on a text's length.
    """
    templates = TEMPLATES if templates is None else templates
    new = ("license", "license_dice", "n_licenses", "licenses")
    if text in new:
        raise ValueError(f"the text column cannot be called {text}")
    rows = rows.drop(*new)
    payload = rows.columns
    low, maybe, pairs, near, found = (fresh(n, payload) for n in ("_low", "_maybe", "_pairs", "_near", "_found"))
    bodies = {name: (len(words_of(body)), bigrams(body)) for name, body in sorted(templates.items())}
    bodies = {name: b for name, b in bodies.items() if b[1]}
    anchored = F.lit(False)
    known = sorted({w for _, p in bodies.values() for w in anchors(p, threshold)})
    for word in known:
        if any(other != word and len(other) > 3 and other in word for other in known):
            continue
        has = F.contains(low, F.lit(word))
        if len(word) <= 3:  # within other words it would be found everywhere
            has = has & F.col(low).rlike(rf"{word}(?<![\p{{L}}\p{{N}}]{word})(?![\p{{L}}\p{{N}}])")
        anchored = anchored | has

    # each step is a column of its own, so that what several places use is computed once; null where nothing can match
    words = F.split(F.trim(F.regexp_replace(low, r"[^\p{L}\p{N}]+", " ")), " ")
    head, tail = F.slice(words, F.lit(1), F.greatest(F.size(words) - 1, F.lit(0))), F.slice(words, F.lit(2), F.greatest(F.size(words) - 1, F.lit(0)))
    table = F.array(
        *[
            F.struct(F.lit(name).alias("name"), _text_array(p).alias("pairs"), F.lit(len(p)).alias("size"), F.lit(n - 1).alias("span"), F.lit(needed(len(p), threshold)).alias("needed"))
            for name, (n, p) in bodies.items()
        ]
    )
    seen = rows.withColumn(low, F.lower(F.col(f"`{text}`"))).withColumn(maybe, anchored)
    seen = seen.withColumn(pairs, F.when(F.col(maybe), F.zip_with(head, tail, lambda a, b: F.concat_ws(" ", a, b))))
    every = F.array_distinct(pairs)
    fits = F.filter(table, lambda t: (F.size(pairs) >= t["needed"]) & (F.size(F.array_intersect(every, t["pairs"])) >= t["needed"]))
    placed = F.transform(fits, lambda t: F.struct(t.alias("t"), F.filter(F.transform(pairs, lambda b, i: F.when(F.array_contains(t["pairs"], b), i)), lambda i: i.isNotNull()).alias("hits")))
    seen = seen.withColumn(near, F.when(F.col(maybe), placed))

    def best(m: Column) -> Column:
        t, hits = m["t"], m["hits"]
        # a window holds enough of the template's bigrams only if the last of so many begins inside it
        starts = F.filter(hits, lambda p, k: F.coalesce(F.get(hits, k + t["needed"] - 1) < p + t["span"], F.lit(False)))
        factor = (2 - threshold) / threshold + 1e-9  # sizes just within the bound stay

        def dice(p: Column) -> Column:
            window = F.array_distinct(F.slice(pairs, p + 1, t["span"]))
            within = (F.size(window) * factor >= t["size"]) & (F.size(window) <= t["size"] * factor)
            return F.when(within, F.struct((F.lit(-2.0) * F.size(F.array_intersect(window, t["pairs"])) / (F.size(window) + t["size"])).alias("minus"), t["name"].alias("name"), p.alias("at"), t["span"].alias("span")))

        return F.array_min(F.filter(F.transform(starts, dice), lambda d: d["minus"] <= -threshold))

    # of matches that overlap the best counts: one after the other, best first, each that none before it overlaps
    meets = lambda a, b: (a["at"] <= b["at"] + b["span"]) & (b["at"] <= a["at"] + a["span"])
    sorted_ = F.array_sort(F.filter(F.transform(near, best), lambda d: d.isNotNull()))
    kept = F.aggregate(sorted_, F.slice(sorted_, 1, 0), lambda held, d: F.when(F.exists(held, lambda h: meets(h, d)), held).otherwise(F.concat(held, F.array(d))))
    done = seen.withColumn(found, kept)
    some = F.coalesce(F.size(found), F.lit(0)) > 0
    first = F.get(found, F.lit(0))
    shown = F.transform(F.array_sort(F.transform(found, lambda d: F.struct(d["name"], d["at"], d["minus"]))), lambda d: F.concat_ws(":", d["name"], d["at"], F.round(d["minus"] * -10_000).cast("int")))
    return done.select(
        *[F.col(f"`{c}`") for c in payload],
        F.when(some, first["name"]).alias("license"),
        F.when(some, -first["minus"]).alias("license_dice"),
        F.when(some, F.size(found)).otherwise(0).cast("long").alias("n_licenses"),
        F.when(some, F.array_join(shown, ",")).otherwise("").alias("licenses"),
    )


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licences of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return find_licenses(docs).drop("text")


def oracle() -> str:
    """The same scan in DuckDB: every window of every template, without pruning."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    values = ", ".join(f"({quote(name)}, {len(words_of(body)) - 1}, [{', '.join(map(quote, bigrams(body)))}])" for name, body in sorted(TEMPLATES.items()))
    return f"""
WITH template(name, span, pairs) AS (VALUES {values}),
numbered AS (SELECT row_number() OVER () AS r, doc_id, text FROM documents),
worded AS (SELECT r, doc_id, string_split(trim(regexp_replace(lower(text), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')), ' ') AS w FROM numbered WHERE text IS NOT NULL),
paired AS (SELECT r, doc_id, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) AS b FROM worded WHERE len(w) > 1),
placed AS (SELECT r, unnest(b) AS pair, unnest(range(len(b))) AS pos FROM paired),
hit AS (SELECT p.r, t.name, t.span, t.size, p.pos, p.pair FROM placed AS p JOIN (SELECT name, span, len(pairs) AS size, unnest(pairs) AS pair FROM template) AS t ON p.pair = t.pair),
win AS (
  SELECT a.r, a.name, a.span, a.size, a.pos, count(DISTINCT b.pair) AS shared
  FROM hit AS a JOIN hit AS b ON a.r = b.r AND a.name = b.name AND b.pos BETWEEN a.pos AND a.pos + a.span - 1
  GROUP BY ALL
),
scored AS (SELECT w.r, name, pos, 2.0::DOUBLE * shared / (len(list_distinct(p.b[pos + 1 : pos + span])) + size) AS dice FROM win AS w JOIN paired AS p ON w.r = p.r),
best AS (SELECT r, name, arg_min(pos, (-dice, pos)) AS pos, max(dice) AS dice FROM scored WHERE dice >= {THRESHOLD} GROUP BY r, name),
listed AS (SELECT r, list([{{'m': -dice, 'name': name, 'at': pos, 'till': pos + span}}] ORDER BY -dice, name, pos) AS ms FROM best JOIN template USING (name) GROUP BY r),
alone AS (SELECT r, unnest(list_reduce(ms, lambda held, d: CASE WHEN len(list_filter(held, lambda h: h.at <= d[1].till AND d[1].at <= h.till)) > 0 THEN held ELSE list_concat(held, d) END)) AS d FROM listed),
one AS (SELECT r, d.name AS name, d.at AS pos, -d.m AS dice FROM alone),
per_doc AS (
  SELECT doc_id, r, count(*) AS n, arg_min(name, (-dice, name)) AS license, max(dice) AS dice,
    string_agg(name || ':' || pos || ':' || round(dice * 10000)::INT, ',' ORDER BY name) AS names
  FROM one JOIN paired USING (r) GROUP BY doc_id, r
)
SELECT d.doc_id, license, h.dice AS license_dice, coalesce(n, 0)::BIGINT AS n_licenses, coalesce(names, '') AS licenses
FROM numbered AS d LEFT JOIN per_doc AS h ON d.r = h.r
"""
