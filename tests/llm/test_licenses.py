"""Licenses of files against a plain computation."""

import math
import re
from collections import Counter

import pytest

from notewright.llm import licenses
from notewright.llm.license_forms import forms
from notewright.llm.licenses import TEMPLATES, scan_licenses

SCHEMA = "file_id long, path string, text string, license string, score int"
MARK = re.compile("(?i)licen[sc]e|copyright|spdx|redistribution|cc by")
NAME = re.compile("(?i)(^|/)(licen[sc]e|copying|notice)[^/]*$")


def terms(text):
    return [w for w in re.split("[^a-z0-9]+", text.lower()) if w]


def plain(rows, threshold=0.6):
    def head(path, text):
        text = text or ""
        if NAME.search(path or "") and not MARK.search(text):
            return text.strip(" ")
        return "\n".join(x for x in text.split("\n") if MARK.search(x)).strip(" ")

    heads = [head(p, t) for _, p, t, *_ in rows]
    distinct = sorted({h for h in heads if h})
    df = Counter(w for h in distinct + list(TEMPLATES.values()) for w in set(terms(h)))
    total = len(distinct) + len(TEMPLATES)

    def vector(text):
        v = {w: n * (math.log((1 + total) / (1 + df[w])) + 1) for w, n in Counter(terms(text)).items()}
        norm = math.sqrt(sum(x * x for x in v.values()))
        return {w: x / norm for w, x in v.items()}

    known = {k: vector(t) for k, t in TEMPLATES.items()}
    match = {}
    for h in distinct:
        v = vector(h)
        scores = [(-round(sum(v.get(w, 0) * x for w, x in k.items()), 9), name) for name, k in known.items()]
        if -min(scores)[0] >= threshold:
            match[h] = min(scores)
    folder = lambda p: re.sub("/?[^/]*$", "", p or "")
    decided = {}
    for (_, p, *_), h in zip(rows, heads):
        if NAME.search(p or "") and h in match:
            decided[folder(p)] = min(decided.get(folder(p), (9, "")), match[h])
    out = []
    for (i, p, *_), h in zip(rows, heads):
        own = match.get(h)
        parts, found = [x for x in folder(p).split("/") if x], (None, None)
        for up in range(len(parts) + 1):
            above = "/".join(parts[: len(parts) - up])
            if above in decided:
                found = (decided[above][1], above)
                break
        out.append((i, p, own and own[1], own and -own[0], own[1] if own else found[0], None if own else found[1]))
    return sorted(out, key=repr)


@pytest.mark.parametrize("limit", [licenses.BROADCAST_BYTES, 0])
def test_matches_plain_python(spark, monkeypatch, limit):
    monkeypatch.setattr(licenses, "BROADCAST_BYTES", limit)
    notices = list(TEMPLATES.values())
    rows = [
        (1, "a/LICENSE", notices[6], "x", 1), (2, "a/b/x.py", "code\nmore", "x", 1), (3, "a/b/c/y.py", "z\n" + notices[5] + "\nz", "x", 1),
        (4, "a/b/c/COPYING.txt", "Text about nothing known here", "x", 1), (5, "a/b/c/d/NOTICE", notices[0] + " " + notices[0], "x", 1),
        (6, "a/b/c/d/e/f.c", None, "x", 1), (7, "top.c", "", "x", 1), (8, None, "Copyright somebody", "x", 1), (9, None, None, "x", 1),
        (10, "a/licence-two", notices[5], "x", 1), (11, "q/r.py", "Licensed under CC BY-SA 4.0 maybe", "x", 1), (None, "a/b/x.py", "long " * 50000, "x", 1),
        (12, "w/LICENSE", "Permission is hereby granted\n" * 4, "x", 1), (13, "w/k.c", "licence\n\nLICENSE", "x", 1), (5, "a/b/c/d/NOTICE", notices[0] + " " + notices[0], "x", 1),
    ]
    found = scan_licenses(spark.createDataFrame(rows, SCHEMA)).collect()
    got = sorted(((*r[:3], None if r[3] is None else round(r[3], 9), *r[4:]) for r in found), key=repr)
    assert got == plain(rows)
    assert sum(1 for r in got if r[5] is not None) >= 3 and sum(1 for r in got if r[2]) >= 5


def test_root_license_and_empty_table(spark):
    rows = [(1, "LICENSE", TEMPLATES["MIT"], "x", 1), (2, "deep/er/file", "words", "x", 1)]
    out = {r.file_id: (r.license, r.licensed_by) for r in scan_licenses(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert out == {1: ("MIT", None), 2: ("MIT", "")}
    assert scan_licenses(spark.createDataFrame([], SCHEMA)).collect() == []


def test_plan_is_native(spark):
    df = spark.createDataFrame([(1, "LICENSE", "MIT License", "x", 1)], SCHEMA)
    plan = scan_licenses(df)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|Cartesian|NestedLoop", plan)


def forms_by_length():
    """The longest form of each license last, so that a dict keeps it."""
    return sorted(forms(), key=lambda form: len(form[1]))


MIT_FILE = """MIT License

Copyright (c) 2031 Some Person

""" + dict(forms_by_length())["MIT"]
APACHE_HEADER = """/*
 * Copyright 2031 Some Person
 *
 * Licensed under the Apache License, Version 2.0 (the "License");
 * you may not use this file except in compliance with the License.
 * You may obtain a copy of the License at
 *
 *     http://www.apache.org/licenses/LICENSE-2.0
 *
 * Unless required by applicable law or agreed to in writing, software
 * distributed under the License is distributed on an "AS IS" BASIS,
 * WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
 * See the License for the specific language governing permissions and
 * limitations under the License.
 */
package a.b;
"""
GPL_HEADER = """# thing.py - does things
# Copyright (C) 2031  Some Person
#
# This program is free software: you can redistribute it and/or modify
# it under the terms of the GNU General Public License as published by
# the Free Software Foundation, either version {v} of the License, or
# (at your option) any later version.
#
# This program is distributed in the hope that it will be useful,
# but WITHOUT ANY WARRANTY; without even the implied warranty of
# MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
# GNU General Public License for more details.

import os
"""


def test_real_license_files_and_headers(spark):
    whole = dict(forms_by_length())
    prose = "The thing and the other thing are of the same kind as it is in the house of the man and to the end. " * 40
    cases = [
        ("m/LICENSE", MIT_FILE, "MIT"), ("m/x.py", "code", "MIT"), ("s/a.c", APACHE_HEADER, "Apache-2.0"),
        ("s/b.py", GPL_HEADER.format(v=3), "GPL-3.0"), ("s/c.py", GPL_HEADER.format(v=2), "GPL-2.0"),
        ("s/d.js", "// SPDX-License-Identifier: MIT\n// Copyright 2031 Some Person\nlet x;", "MIT"),
        ("s/e.js", "/* SPDX-License-Identifier: GPL-2.0-or-later WITH Classpath-exception-2.0 */\nlet x;", "GPL-2.0"),
        ("s/f.js", "// SPDX-License-Identifier: (MIT OR Apache-2.0)\n", "Apache-2.0"),
        ("s/g.py", "\n".join("# " + x for x in MIT_FILE.split("\n")) + "\nimport os\n", "MIT"),
        ("s/h.txt", "Released under the MIT License.\n" + prose + "\nThis is about a license.", "MIT"),
        ("p/NOTICE", prose, None), ("p/y.py", "code", None), ("p/q/COPYING", "A license of our own: do as the owner says.", None),
        *((f"w{k}/COPYING", "Copyright (c) 2031 Some Person\n\n" + text, name) for k, (name, text) in enumerate(sorted(whole.items())) if "-BY-" not in name),
    ]
    rows = [(i, path, text, "x", 1) for i, (path, text, _) in enumerate(cases)]
    found = {r.file_id: r.license for r in scan_licenses(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert [(c[0], found[i]) for i, c in enumerate(cases)] == [(c[0], c[2]) for c in cases]
