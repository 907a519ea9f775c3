import re

import duckdb
import pandas as pd

from sparkann.llm import license_scan as L

MIT = """# Copyright (c) 2020 Someone
# Permission is hereby granted, free of charge, to any person obtaining a copy
# of this software and associated documentation files (the "Software"), to deal
# in the Software without restriction, including without limitation the rights
# to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
# copies of the Software, and to permit persons to whom the Software is
# furnished to do so, subject to the following conditions:
#
# The above copyright notice and this permission notice shall be included in all
# copies or substantial portions of the Software.
#
# THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
# IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
# FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.
"""
APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License."""
GPL = "This program is free software: you can redistribute it and/or modify it\nunder the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
CASES = [
    (1, MIT, "MIT", "permissive"),
    (2, APACHE, "Apache-2.0", "permissive"),
    (3, GPL, "GPL-3.0-or-later", "copyleft"),
    (4, "// SPDX-License-Identifier: MIT\nimport os", "MIT", "permissive"),
    (5, "Text here.\nReleased under the MIT License.\nAll rights reserved.\nMore.", "MIT,All-Rights-Reserved", "restricted"),
    (6, "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.", "", "unclear"),
    (7, "the license of a driver", "", "none"),
    (8, None, "", "none"),
    (9, "", "", "none"),
    (None, "Licensed under CC BY-NC 4.0.", "CC-BY-NC-4.0", "restricted"),
    (10, "word " * 50_000 + ".\nReleased under the MIT License.", "MIT", "permissive"),
    (10, "Released under the MIT License. Released under the MIT License.", "MIT", "permissive"),
]


def frame(spark):
    return spark.createDataFrame([(i, t, "x", 7) for i, t, _, _ in CASES], "doc_id long, text string, licenses string, ids int")


def test_rules(spark):
    got = sorted(((r.doc_id, r.licenses, r.category) for r in L.scan(frame(spark)).collect()), key=repr)
    assert got == sorted(((i, a, b) for i, _, a, b in CASES), key=repr)
    assert L.scan(frame(spark).limit(0)).count() == 0


def test_sql_says_the_same(spark):
    documents = pd.DataFrame([(i, t) for i, t, _, _ in CASES if i is not None], columns=["doc_id", "text"])  # noqa: F841
    want = duckdb.sql(L.scan_sql()).fetchall()
    got = [tuple(r) for r in L.scan(frame(spark).where("doc_id is not null")).collect()]
    assert sorted(got) == sorted(want)


def test_every_known_sentence_has_a_hint_and_is_normal():
    for _, s in L.SENTENCES:
        assert re.search(L.HINTS, s) or s.startswith(("bsd", "spdx")), s
        assert re.fullmatch("[a-z0-9]+( [a-z0-9]+)*", s)
    names = {n for n, _ in L.SENTENCES} | {"Copyright"}
    assert all(set(seq) <= names for _, seq, _ in L.RULES)


def test_main_path_has_no_python(spark):
    plan = L.scan(frame(spark))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|Exchange", plan)


WRAPPED = ["All rights\nreserved.", "ALL RIGHTS RESERVED", "All rights  reserved.", "# All rights\n# reserved.", "// This is free and unencumbered software released into the public\n// domain.", "This program is free\nsoftware.", "This program is free  software."]


def test_wrapped_and_spaced_sentences_pass_the_hint_test(spark):
    documents = pd.DataFrame(list(enumerate(WRAPPED)), columns=["doc_id", "text"])  # noqa: F841
    want = sorted(duckdb.sql(L.scan_sql()).fetchall())
    got = sorted(tuple(r) for r in L.scan(spark.createDataFrame(list(enumerate(WRAPPED)), "doc_id long, text string")).collect())
    assert got == want and all(r[1] for r in want)


def test_every_sentence_however_it_is_broken_or_spaced(spark):
    """scan(), with its hint, says of each what the SQL says, which has none."""
    breaks = [" ", "  ", "\n", " \n", "\n ", "\n// ", "\n# ", "\n * ", "\t", ", ", " - ", "*"]
    rows = [(k * 1000 + j * 10 + c, f"Some words before.\n{case(w.join([head, ' '.join(tail)]) if c == 0 else w.join([head, *tail]))}.\nAnd after.")
            for k, (_, s) in enumerate(L.SENTENCES) for j, w in enumerate(breaks) for c, case in enumerate((str, str.upper, str.title)) for head, *tail in [s.split(" ")]]
    documents = pd.DataFrame(rows, columns=["doc_id", "text"])  # noqa: F841
    want = sorted(duckdb.sql(L.scan_sql()).fetchall())
    assert sorted(tuple(r) for r in L.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()) == want
    plain = {r[0] for r in want if r[1]}
    assert {k * 1000 + j * 10 for k in range(len(L.SENTENCES)) for j in range(4)} <= plain
