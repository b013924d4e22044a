"""Licence scans: sparse TF-IDF cosine of headers and licence files to templates, then inheritance down directories.

DataFrame expressions only: texts are cut into units (the whole text, its
paragraphs, lines and sentences, and runs of lines in the templates' words), units whose
terms can reach the threshold are counted by term and joined to the templates' weights,
and the best cosine decides. Files without a licence of their own take that
of the nearest directory above them that has a licence file, by joins on paths.
"""

from __future__ import annotations

import json
import math
import re
from collections import Counter
from functools import lru_cache
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import materialize

_AS_IS = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
_BSD_2 = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_3 = _BSD_2 + " 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_MIT = 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.'
_MIT_AS_IS = 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'
_ISC = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."
_ISC_AS_IS = 'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'

#: Notices and short texts of public licences (fixed values).
SINGLE = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""),
    ("BSD-2-Clause", _BSD_2),
    ("BSD-2-Clause", f"{_BSD_2} {_AS_IS}"),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("BSD-3-Clause", _BSD_3),
    ("BSD-3-Clause", f"{_BSD_3} {_AS_IS}"),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at http://www.boost.org/LICENSE_1_0.txt)"),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work. CC0 1.0 Universal public domain dedication."),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"),
    ("ISC", _ISC),
    ("ISC", f"{_ISC} {_ISC_AS_IS}"),
    ("MIT", "Released under the MIT License."),
    ("MIT", _MIT),
    ("MIT", f"{_MIT} {_MIT_AS_IS}"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("Proprietary", "All rights reserved."),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."),
]
#: Licences whose notices differ in name and version alone, and the notices (fixed values).
GNU = [("GPL", "General", "2"), ("GPL", "General", "3"), ("LGPL", "Lesser General", "2.1"), ("LGPL", "Lesser General", "3"), ("LGPL", "Library General", "2"), ("AGPL", "Affero General", "3")]
GNU_NOTICES = [
    "This work is licensed under the GNU {name} Public License, version {version}.",
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {name} Public License as published by the Free Software Foundation, either version {version} of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {name} Public License for more details.",
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {name} Public License as published by the Free Software Foundation, either version {version} of the License, or (at your option) any later version.",
    "This program is free software; you can redistribute it and/or modify it under the terms of the GNU {name} Public License version {version} as published by the Free Software Foundation.",
]
COMMONS = [("BY", "Attribution"), ("BY-SA", "Attribution-ShareAlike"), ("BY-NC", "Attribution-NonCommercial"), ("BY-ND", "Attribution-NoDerivatives"), ("BY-NC-SA", "Attribution-NonCommercial-ShareAlike"), ("BY-NC-ND", "Attribution-NonCommercial-NoDerivatives")]
COMMONS_NOTICES = ["Licensed under CC {code} {version}.", "This work is licensed under a Creative Commons {name} {version} {port} License."]
#: Titles of licences, heads of their full texts, and the choice of two (fixed values).
TITLES = [
    ("Apache-2.0", "Apache License 2.0"), ("Apache-2.0", "Apache License, Version 2.0"),
    ("BSD-2-Clause", "BSD 2-Clause License"), ("BSD-2-Clause", 'BSD 2-Clause "Simplified" License'),
    ("BSD-3-Clause", "BSD 3-Clause License"), ("BSD-3-Clause", 'BSD 3-Clause "New" or "Revised" License'),
    ("BSL-1.0", "Boost Software License 1.0"), ("BSL-1.0", "Boost Software License - Version 1.0 - August 17th, 2003"),
    ("CC0-1.0", "CC0 1.0 Universal"), ("CC0-1.0", "Creative Commons CC0 1.0 Universal"),
    ("EPL-2.0", "Eclipse Public License 2.0"), ("EPL-2.0", "Eclipse Public License - v 2.0"),
    ("ISC", "ISC License"),
    ("MIT", "MIT License"), ("MIT", "The MIT License (MIT)"),
    ("MPL-2.0", "Mozilla Public License 2.0"), ("MPL-2.0", "Mozilla Public License Version 2.0"),
    ("Unlicense", "The Unlicense"),
    ("Zlib", "zlib License"),
]
HEADS = [
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION"),
    ("Apache-2.0 OR MIT", "Licensed under either of Apache License, Version 2.0 or MIT license at your option."),
    ("Apache-2.0 OR MIT", "Dual-licensed under the Apache License, Version 2.0 and the MIT license."),
]
FORMS = ["{title}", "Licensed under the {title}.", "Released under the {title}.", "This project is licensed under the {title} - see the LICENSE file for details."]
GNU_DATES = {("GPL", "2"): "June 1991", ("GPL", "3"): "29 June 2007", ("LGPL", "2.1"): "February 1999", ("LGPL", "3"): "29 June 2007", ("LGPL", "2"): "June 1991", ("AGPL", "3"): "19 November 2007"}
#: Identifiers in ``SPDX-License-Identifier:`` lines beside those of the GNU and Creative Commons licences (fixed values).
SPDX = ["Apache-2.0", "Apache-2.0 OR MIT", "BSD-2-Clause", "BSD-3-Clause", "BSL-1.0", "CC0-1.0", "EPL-2.0", "ISC", "MIT", "MPL-2.0", "Unlicense", "Zlib"]


def _gnu(code: str, version: str) -> str:
    return f"{code}-{version if '.' in version else version + '.0'}"


def _names() -> list[tuple[str, str]]:
    out = [(n, form.format(title=t)) for n, t in TITLES for form in FORMS] + HEADS
    out += [(n, f"SPDX-License-Identifier: {n}") for n in SPDX]
    for code, name, version in GNU:
        licence = _gnu(code, version)
        title = f"GNU {name} Public License"
        out += [(licence, f"{title} Version {version}, {GNU_DATES[code, version]}"), (licence, f"{title} v{licence.split('-')[1]}"), (licence, f"GNU {code} v{version}"), (licence, f"GNU {code} version {version}")]
        out += [(licence, f"SPDX-License-Identifier: {licence}{end}") for end in ("", "+", "-only", "-or-later")[:: 1 if code != "LGPL" or name == "Lesser General" else 4]]
    out += [(f"CC-{code}-{version}", f"SPDX-License-Identifier: CC-{code}-{version}") for code, _ in COMMONS for version in ("3.0", "4.0")]
    return sorted(set(out))


TEMPLATES: list[tuple[str, str]] = sorted([
    *SINGLE,
    *((_gnu(code, version), t.format(name=name, version=version)) for code, name, version in GNU for t in GNU_NOTICES),
    *((f"CC-{code}-{version}", t.format(code=code, name=name, version=version, port=port)) for code, name in COMMONS for version, port in (("3.0", "Unported"), ("4.0", "International")) for t in COMMONS_NOTICES),
])
#: Names of licences: a unit needs every word of one, since a few words that are alike say nothing.
NAMES: list[tuple[str, str]] = _names()
#: A licence that any other one comes before: its words stand in most copyright lines.
LAST = "Proprietary"
#: Words that tell near licences apart: a unit and its template have the same ones (fixed values).
QUALIFIERS = ["affero", "lesser", "nc", "nd", "noncommercial", "noderivatives", "sa", "sharealike"]
#: What counts as a term, and the names of licence files (fixed values).
TERM = r"[a-z0-9]+(?:\.[0-9]+)*"
FILE_NAME = r"(?i)^(un)?(licen[cs]e|copying|notice)(\.[a-z]+)?$"
THRESHOLD = 0.8
#: A line belongs to a run if at least this share of its terms are templates' terms; ends a run otherwise.
DENSE, BREAK = 0.6, "\u0001"
#: Blank lines, between paragraphs.
BLANK = r"\n[ \t\r]*\n"
#: The end of a sentence, and what follows it.
SENTENCE = r"([.!?])[ \t\r\n]+"


def load_templates(folder: str) -> list[tuple[str, str]]:
    """Further templates from a folder of licence texts on the driver: each file's name is the licence."""
    return sorted((f.stem if f.suffix in (".txt", ".md") else f.name, f.read_text(errors="replace")) for f in Path(folder).iterdir() if f.is_file())


@lru_cache(maxsize=4)
def template_weights(templates: tuple[tuple[str, str], ...] = tuple(TEMPLATES), names: tuple[tuple[str, str], ...] = tuple(NAMES)) -> tuple[dict[str, float], list[tuple[int, str, str, float, int, int]], dict[int, int], float]:
    """What scoring needs of the templates and, numbered after them, the names.

    Each term's idf over the templates, that of terms only names have included;
    rows of (template, licence, term, weight, needed, barred), weights of unit
    length; how many terms each template needs; and the idf of terms that no
    template has. A unit needs its template's qualifiers and version number,
    or all terms of a name, and is barred by another qualifier, however long
    the template.
    """
    n = len(templates)
    counts = [Counter(re.findall(TERM, text.lower())) for _, text in (*templates, *names)]
    df = Counter(t for c in counts[:n] for t in c)
    idf = {t: math.log((1 + n) / (1 + df[t])) + 1 for t in sorted(set().union(*counts))}
    rows, needs = [], {}
    for i, ((name, text), c) in enumerate(zip((*templates, *names), counts, strict=True)):
        norm = math.sqrt(sum((k * idf[t]) ** 2 for t, k in c.items()))
        version = re.search(r"(?i)\b(?:version|v\.|license|universal|cc [a-z-]+|\w*attribution[\w-]*) ?([0-9]+(?:\.[0-9]+)?)\b", text)
        must = set(c) if i >= n else {t for t in c if t in QUALIFIERS} | ({version[1]} & set(c) if version else set())
        rows += [(i, name, t, k * idf[t] / norm, int(t in must), 0) for t, k in sorted(c.items())]
        rows += [(i, name, t, 0.0, 0, 1) for t in QUALIFIERS if t not in c]
        needs[i] = len(must)
    return idf, rows, needs, math.log(1 + n) + 1


def terms_of(part: Column) -> Column:
    return F.regexp_extract_all(F.lower(part), F.lit(TERM), F.lit(0))


def can_reach(part: Column, idf: dict[str, float], rows: list, needs: dict[int, int], threshold: float) -> Column:
    """Whether the terms of ``part`` suffice for a cosine of ``threshold`` to a template, whatever else it has.

    By Cauchy and Schwarz a cosine is at most the root of the summed squares of
    the shared terms' weights. The sum of each term's greatest square over all templates
    is looked at first, as no template's sum is above it. Templates that need
    all of their terms are reached by those alone.
    """
    terms, whole = {}, set()
    for i, _, t, _, _, barred in rows:
        if not barred:
            terms.setdefault(i, set()).add(t)
    whole = {i for i, ts in terms.items() if needs[i] == len(ts)}
    spread = sorted(terms.keys() - whole)
    place = {i: k for k, i in enumerate(spread)}
    squares: dict[str, list[float]] = {}
    for i, _, t, w, _, barred in rows:
        if not barred and i in place:
            squares.setdefault(t, [0.0] * len(spread))[place[i]] = w * w
    sets = {frozenset(terms[i]) for i in whole}
    least = sorted(sorted(x) for x in sets if not any(y < x for y in sets))  # a set that holds another is reached only with it
    constant = lambda value, kind: F.from_json(F.lit(json.dumps(value)), kind)  # noqa: E731  (one constant, whatever its size)
    floor = (threshold - 1e-6) ** 2 - 1e-9
    cover, left = [], least  # few words of which each name has one
    while left:
        word = max(sorted(set().union(*left)), key=lambda t: sum(t in x for x in left))
        cover.append(word)
        left = [x for x in left if word not in x]

    def reached(shared: Column) -> Column:
        most = F.aggregate(shared, F.lit(0.0), lambda a, t: a + F.coalesce(F.element_at(constant({t: max(v) for t, v in squares.items()}, "map<string, double>"), t), F.lit(0.0)))
        sums = F.aggregate(F.filter(shared, lambda t: t.isin(list(squares))), F.array_repeat(F.lit(0.0), len(spread)), lambda a, t: F.zip_with(a, F.element_at(constant(squares, "map<string, array<double>>"), t), lambda x, y: x + y))
        alike = F.when(most >= floor, F.array_max(sums) >= floor)
        named = F.exists(constant(least, "array<array<string>>"), lambda x: F.size(F.array_except(x, shared)) == 0)
        return F.coalesce(alike, F.lit(False)) | F.coalesce(F.when(F.arrays_overlap(shared, constant(cover, "array<string>")), named), F.lit(False))

    # the shared terms are bound to a variable, so that they are found once, not for each name
    shared = F.array_intersect(terms_of(part), constant(sorted(idf), "array<string>"))
    return F.coalesce(F.element_at(F.transform(F.array(shared), reached), 1), F.lit(False))


def units_of(text: Column, vocabulary: list[str]) -> Column:
    """The whole text, its paragraphs, lines and sentences, and its runs of lines that are mostly in the templates' words.

    A run goes on over lines without terms, so a notice of several lines or
    paragraphs is one, whatever stands before and after it.
    """
    lines = F.split(text, "\n")
    own = lambda line: F.size(F.filter(terms_of(line), lambda t: t.isin(vocabulary))) >= DENSE * F.size(terms_of(line))
    runs = F.split(F.array_join(F.transform(lines, lambda x: F.when(own(x), x).otherwise(F.lit(BREAK))), "\n"), BREAK)
    return F.array_distinct(F.concat(F.array(text), F.split(text, BLANK), lines, F.split(F.regexp_replace(text, SENTENCE, f"$1{BREAK}"), BREAK), runs))


def score_texts(files: DataFrame, threshold: float, templates: tuple[tuple[str, str], ...] = tuple(TEMPLATES), names: tuple[tuple[str, str], ...] = tuple(NAMES)) -> DataFrame:
    """Best licence of each (id, text) that has one: id, own_license, own_score, whole (the whole text is a licence).

    Texts, and then units, that can't reach ``threshold`` are left out before
    they move. A unit's terms meet the templates' weights by term, so only terms that both
    have are multiplied.
    """
    spark = files.sparkSession
    idf, rows, needs, other = template_weights(templates, names)
    entry = {t: [] for t in sorted({r[2] for r in rows})}
    for i, name, t, w, needed, barred in rows:
        entry[t].append((i, name, w, needed, barred, needs[i]))
    kind = "term string, idf double, entries array<struct<template: int, license: string, weight: double, needed: int, barred: int, needs: int>>"
    vocabulary = F.broadcast(spark.createDataFrame([(t, idf.get(t, other), e) for t, e in entry.items()], kind))  # the templates' terms
    likely = files.where(F.col("text").isNotNull() & can_reach(F.col("text"), idf, rows, needs, threshold))
    units = likely.select("id", F.xxhash64("text").alias("body"), F.posexplode(units_of(F.col("text"), list(idf))).alias("unit", "part"))
    # dealt by unit before they become terms, so that counts and sums need no other shuffle
    keys = ["id", "body", "unit"]
    units = units.where(can_reach(F.col("part"), idf, rows, needs, threshold)).dropDuplicates(keys).repartition(*keys)
    tf = units.select(*keys, F.explode(terms_of(F.col("part"))).alias("term")).groupBy(*keys, "term").agg(F.count(F.lit(1)).alias("tf"))
    tf = tf.join(vocabulary, "term", "left").withColumn("v", F.col("tf") * F.coalesce("idf", F.lit(other)))
    known = F.collect_list(F.when(F.col("entries").isNotNull(), F.struct("v", "entries")))  # no more than the templates' terms
    sums = tf.groupBy(*keys).agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("norm"), known.alias("known"))
    met = sums.select(*keys, "norm", F.explode("known").alias("k")).select(*keys, "norm", "k.v", F.explode("k.entries").alias("e"))
    per = met.groupBy(*keys, "norm", "e.template", "e.license", "e.needs").agg(F.sum(F.col("v") * F.col("e.weight")).alias("dot"), F.sum("e.needed").alias("has"), F.max("e.barred").alias("barred"))
    scored = per.where((F.col("has") == F.col("needs")) & (F.col("barred") == 0)).withColumn("score", F.round(F.col("dot") / F.col("norm"), 6)).where(F.col("score") >= threshold)
    best = F.min_by(F.struct("license", "score"), F.struct(F.col("license") == LAST, -F.col("score"), F.col("license")))
    per_id = scored.groupBy("id").agg(best.alias("best"), F.bool_or(F.col("unit") == 0).alias("whole"))
    return per_id.select("id", F.col("best.license").alias("own_license"), F.col("best.score").alias("own_score"), "whole")


def scan(df: DataFrame, id_col: Column, repo: Column, path: Column, text: Column, threshold: float = THRESHOLD, templates: list[tuple[str, str]] = TEMPLATES, names: list[tuple[str, str]] = NAMES) -> DataFrame:
    """One row for each row of ``df``: id, path, own_license, own_score, license, inherited_from.

    ``own_license`` is the licence of the template with the greatest cosine to
    a unit of the whole text, if that reaches ``threshold`` (ties: first by
    name; "All rights reserved" only if there is no other). ``names`` are titles
    and identifiers, every word of which must be in the unit. A template's version and qualifiers (Lesser, NonCommercial, ...) must be in the
    unit, and no other qualifier may be. A file whose whole text is a licence, or whose name is that of one,
    gives its licence to its directory; of several in a directory, the one
    with the greatest score does (then first by path; "All rights reserved" last). A file without its own
    takes that of the nearest directory at or above its own in its repository,
    named in ``inherited_from`` ('' is the root). Null texts have no licence; a
    null repository or path is a repository or root file of its own kind: it
    gives and takes nothing. Rows with one id are one file; an empty table
    gives no rows; other columns play no part, whatever their names. Texts
    are read whole, however long.
    """
    files = df.select(id_col.alias("id"), repo.alias("repo"), path.alias("path"), text.alias("text"))
    own = materialize(score_texts(files, threshold, tuple(templates), tuple(names))).withColumnRenamed("id", "own_id")  # scored once; three joins read it
    paths = files.select("id", "repo", "path")
    known = paths.join(own, F.col("id").eqNullSafe(F.col("own_id")), "left").drop("own_id")
    parts = F.split("path", "/")
    known = known.withColumn("dir", F.array_join(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), "/"))
    gives = F.coalesce(F.col("whole"), F.lit(False)) | F.element_at(parts, -1).rlike(FILE_NAME)
    given = known.where(F.col("own_license").isNotNull() & F.col("repo").isNotNull() & F.col("path").isNotNull() & gives)
    given = given.groupBy("repo", "dir").agg(F.min_by("own_license", F.struct(F.col("own_license") == LAST, -F.col("own_score"), F.col("path"), F.col("own_license"))).alias("dir_license"))
    lacks = known.where(F.col("own_license").isNull() & F.col("repo").isNotNull() & F.col("path").isNotNull()).select("repo", "dir").distinct()
    steps = F.split("dir", "/")
    above = F.when(F.col("dir") == "", F.array(F.struct(F.lit(0).alias("depth"), F.lit("").alias("up")))).otherwise(
        F.transform(F.sequence(F.lit(0), F.size(steps)), lambda i: F.struct(i.alias("depth"), F.array_join(F.slice(steps, F.lit(1), i), "/").alias("up")))
    )
    reach = lacks.select("repo", "dir", F.explode(above).alias("a")).select("repo", "dir", "a.depth", "a.up")
    nearest = reach.join(given.withColumnRenamed("dir", "up"), ["repo", "up"]).groupBy("repo", "dir").agg(F.max_by(F.struct("up", "dir_license"), "depth").alias("near"))
    out = known.join(nearest, ["repo", "dir"], "left")
    takes = F.col("own_license").isNull()
    return out.select("id", "path", "own_license", "own_score", F.coalesce("own_license", F.col("near.dir_license")).alias("license"), F.when(takes, F.col("near.up")).alias("inherited_from"))


def documents_layout() -> dict[str, Column]:
    """``documents`` as files: a repository for each source, directories of a thousand and of twenty ids, of which the first is the licence file."""
    doc = F.col("doc_id")
    name = F.when(doc % 20 == 0, F.lit("LICENSE")).otherwise(F.concat(doc.cast("string"), F.lit(".txt")))
    path = F.concat(F.lit("part"), F.expr("doc_id div 1000").cast("string"), F.lit("/set"), F.expr("doc_id div 20").cast("string"), F.lit("/"), name)
    return {"id_col": doc, "repo": F.col("source"), "path": path, "text": F.col("text")}
