from pyspark.sql import functions as F

from corvane.llm.license_scan import TEMPLATES, scan


def run(spark, rows):
    df = spark.createDataFrame(rows, "id long, repo string, path string, text string")
    return {r.id: r for r in scan(df, F.col("id"), F.col("repo"), F.col("path"), F.col("text")).collect()}


def test_headers_files_and_inheritance(spark):
    mit = next(t for n, t in TEMPLATES if n == "MIT" and len(t) > 100)
    got = run(spark, [
        (1, "r", "LICENSE", mit),
        (2, "r", "src/a.py", "print(1)\n"),
        (3, "r", "src/b.py", "# Licensed under the Apache License, Version 2.0.\nprint(2)"),
        (4, "r", "vendor/x/COPYING", "This work is licensed under the GNU General Public License, version 3."),
        (5, "r", "vendor/x/deep/er/c.c", "int x;"),
        (6, "r", "vendor/y/d.c", None),
        (7, "q", "a.py", ""),
        (8, None, "a.py", "code"),
        (9, "r", None, "code"),
        (10, "r", "vendor/xy/e.c", "int y;"),
    ])
    assert {k: (r.own_license, r.license, r.inherited_from) for k, r in got.items()} == {
        1: ("MIT", "MIT", None), 2: (None, "MIT", ""), 3: ("Apache-2.0", "Apache-2.0", None), 4: ("GPL-3.0", "GPL-3.0", None),
        5: (None, "GPL-3.0", "vendor/x"), 6: (None, "MIT", ""), 7: (None, None, None), 8: (None, None, None), 9: (None, None, None), 10: (None, "MIT", ""),
    }


def test_every_template_finds_itself(spark):
    got = run(spark, [(i, f"r{i}", "f", f"Some words first.\n{t}\nMore of them.") for i, (_, t) in enumerate(TEMPLATES)])
    assert [got[i].own_license for i in range(len(TEMPLATES))] == [n for n, _ in TEMPLATES]


def test_repeated_rows_and_empty_table(spark):
    got = scan(spark.createDataFrame([(1, "r", "a", "Released under the MIT License.", 0)] * 2, "id long, repo string, path string, text string, license int"), F.col("id"), F.col("repo"), F.col("path"), F.col("text")).collect()
    assert [r.license for r in got] == ["MIT", "MIT"]
    assert run(spark, []) == {}


def test_lines_without_a_trigger_word_are_scored(spark):
    lines = {"CC BY-SA 4.0": "CC-BY-SA-4.0", "CC BY-NC 4.0": "CC-BY-NC-4.0", "CC BY 4.0": "CC-BY-4.0", "Released under the MIT": "MIT", "Under CC BY-SA 4.0": "CC-BY-SA-4.0", "This work is under a Creative Commons Attribution 4.0 International": "CC-BY-4.0"}
    got = run(spark, [(i, f"r{i}", "LICENSE", f"{t}\nOther words.") for i, t in enumerate(lines)] + [(100 + i, f"r{i}", "src/a.py", "code") for i in range(len(lines))])
    assert [got[i].own_license for i in range(len(lines))] == [got[100 + i].license for i in range(len(lines))] == [*lines.values()]


NOTICES = {  # public notices, as projects print them
    "GPL-2.0": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.\n\nThis program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the GNU General Public License for more details.",
    "AGPL-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.\n\nThis program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the GNU Affero General Public License for more details.",
    "LGPL-3.0": "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.",
    "LGPL-2.1": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "BSD-2-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n\n1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n\n2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "CC-BY-NC-SA-4.0": "This work is licensed under the Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.",
    "CC-BY-SA-3.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 3.0 Unported License.",
}


def test_near_licences_are_told_apart(spark):
    got = run(spark, [(i, f"r{i}", "LICENSE", t) for i, t in enumerate(NOTICES.values())])
    assert [got[i].own_license for i in range(len(NOTICES))] == [*NOTICES]


def test_a_version_or_qualifier_that_no_template_has_is_no_match(spark):
    got = run(spark, [(1, "a", "f", "This work is licensed under the GNU General Public License, version 7."), (2, "b", "f", "Licensed under CC BY-NC-SA 2.5."), (3, "c", "f", "Lesser: Released under the MIT License.")])
    assert [got[i].own_license for i in (1, 2)] == [None, None] and got[3].own_license is None


def test_headers_of_several_lines_before_code(spark):
    import textwrap

    full = ["MIT", "GPL-3.0", "ISC", "BSD-3-Clause", "BSD-2-Clause", "Apache-2.0", "Zlib", "MPL-2.0"]
    code = "\n".join(f"    total{i} = compute(total{i}, index) + {i}" for i in range(30))
    rows = []
    for i, name in enumerate(full):
        notice = max((t for n, t in TEMPLATES if n == name), key=len)
        header = "\n".join(f"# {x}" for x in textwrap.wrap(notice, 78))
        rows.append((i, f"r{i}", "src/a.py", f"#!/usr/bin/env python\n{header}\n{code}"))
    got = run(spark, rows)
    assert [got[i].own_license for i in range(len(full))] == full


def test_what_is_left_out_beforehand_would_not_match(spark):
    """Brute force in Python over the units of random mixtures of notices and prose."""
    import math
    import random
    import re
    from collections import Counter

    from corvane.llm.license_scan import QUALIFIERS, TERM, template_weights

    idf, rows, needs, other = template_weights()
    vectors = {}
    for i, name, t, w, needed, barred in rows:
        x = vectors.setdefault(i, (name, {}, set(), set()))
        if barred:
            x[3].add(t)
        else:
            x[1][t] = w
            if needed:
                x[2].add(t)
    rng = random.Random(4)
    texts = []
    for _ in range(60):
        words = rng.choice(TEMPLATES)[1].split()
        mixed = [w for w in words if rng.random() < rng.choice([0.8, 0.9, 1.0])] + [f"zq{rng.randrange(99)}" for _ in range(rng.randrange(1 + len(words) // 4))]
        texts.append(" ".join(mixed))

    def scored(unit):
        c = Counter(re.findall(TERM, unit.lower()))
        norm = math.sqrt(sum((k * idf.get(t, other)) ** 2 for t, k in c.items()))
        return [(name == "Proprietary", -round(sum(k * idf.get(t, other) * v.get(t, 0) for t, k in c.items()) / norm, 6), name) for name, v, must, bars in vectors.values() if must <= set(c) and not bars & set(c)] if c else []

    def brute(text):  # one line: the whole of it, and its sentences
        units = {text, *re.split(r"(?<=[.!?])[ \t\r\n]+", text)}
        return min((x for u in units for x in scored(u) if -x[1] >= 0.8), default=(0, 0, None))[2]

    got = run(spark, [(i, f"r{i}", "f", t) for i, t in enumerate(texts)])
    want = [brute(t) for t in texts]
    assert [got[i].own_license for i in range(len(texts))] == want and 10 < sum(w is not None for w in want) < 60
    assert set(QUALIFIERS) >= {"lesser", "affero"}


NAMED = {  # names, identifiers and heads, as projects print them
    "SPDX-License-Identifier: MIT": "MIT", "# SPDX-License-Identifier: Apache-2.0": "Apache-2.0", "/* SPDX-License-Identifier: GPL-2.0-or-later */": "GPL-2.0",
    "SPDX-License-Identifier: LGPL-2.1-only": "LGPL-2.1", "SPDX-License-Identifier: AGPL-3.0": "AGPL-3.0", "SPDX-License-Identifier: CC-BY-NC-4.0": "CC-BY-NC-4.0", "SPDX-License-Identifier: Apache-2.0 OR MIT": "Apache-2.0 OR MIT",
    "MIT License": "MIT", "The MIT License (MIT)": "MIT", "Licensed under the MIT license.": "MIT", "BSD 3-Clause License": "BSD-3-Clause", "GNU GPL v3": "GPL-3.0",
    "                                 Apache License\n                           Version 2.0, January 2004\n                        http://www.apache.org/licenses/\n\n   TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION": "Apache-2.0",
    "                   GNU LESSER GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007\n\n Copyright (C) 2007 Free Software Foundation, Inc.": "LGPL-3.0",
    "This file is part of Foo.\n\nFoo is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.\n\nFoo is distributed in the hope that it will be useful.": "GPL-3.0",
    "Copyright (c) 2020 The Foo Authors. All rights reserved. Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.": "BSD-3-Clause",
    "Licensed under either of Apache License, Version 2.0 or MIT license at your option.": "Apache-2.0 OR MIT",
    "Mit der Lizenz": None, "mit": None, "the license": None, "apache": None, "SPDX-License-Identifier: Foo-1.0": None, "Copyright 2020 Foo. All rights reserved.": "Proprietary",
}


def test_names_identifiers_and_heads(spark):
    got = run(spark, [(i, f"r{i}", "LICENSE", t) for i, t in enumerate(NAMED)])
    assert {t: got[i].own_license for i, t in enumerate(NAMED)} == NAMED


def test_every_name_finds_its_licence(spark):
    from corvane.llm.license_scan import NAMES

    got = run(spark, [(i, f"r{i}", "f", f"x = 1\n# {t}\ny = 2") for i, (_, t) in enumerate(NAMES)])
    assert [got[i].own_license for i in range(len(NAMES))] == [n for n, _ in NAMES]


def test_long_templates_keep_their_version_and_qualifiers(spark):
    words = " ".join(f"word{i}" for i in range(700))
    long = [(f"L-{v}", f"Some License Version {v} {words}") for v in ("1", "2")] + [("L-NC-1", f"Some NonCommercial License Version 1 {words}")]
    df = spark.createDataFrame([(i, "r", f"f{i}", t) for i, (_, t) in enumerate([*long, ("", f"Some License Version 3 {words}")])], "id long, repo string, path string, text string")
    got = {r.id: r.own_license for r in scan(df, F.col("id"), F.col("repo"), F.col("path"), F.col("text"), templates=long).collect()}
    assert got == {0: "L-1", 1: "L-2", 2: "L-NC-1", 3: None}
