from __future__ import annotations

import re
from collections import Counter
from math import log, sqrt

import pytest

from millrace.llm import license_scan as L

MIT = L.TEMPLATES["MIT"][0]
GPL = L.TEMPLATES["GPL-3.0"][0]
FILES = [
    (1, "a/LICENSE", "MIT notice\n" + L.TEMPLATES["MIT"][1]), (2, "a/b/c/code.py", "x = 1"), (3, "a/b/LICENSE.txt", GPL), (4, "a/b/d.py", None),
    (5, "a/b/c/e.py", "# " + MIT + "\nmore"), (6, "top.py", "the of and under this"), (7, "z/y.py", "Licensed under the Apache License, Version 2.0, of course"),
    (8, "z/x.py", "nothing"), (9, None, MIT), (10, None, "plain"), (None, "a/n.py", ""), (11, "a/b.py", "y"), (11, "a/b.py", "y"), (12, "ab/q.py", "q"),
    (13, "p/COPYING", "no licence text here"), (14, "p/q.py", "free of charge, to any person"),
]


@pytest.fixture(scope="module")
def files(spark):
    return spark.createDataFrame([(*f, 1, "x") for f in FILES], "doc_id long, path string, text string, row int, license string").repartition(3)


def terms(text):
    return [t for t in re.split(r"[^\w-]+|_", (text or "").lower()) if t]


def brute(rows, threshold=0.6, any_states=False, wrap=4):
    n = len(rows)
    seen = Counter(t for _, _, text in rows for t in set(terms(text)))
    weight = lambda t: log((n + 1) / (seen[t] + 1)) + 1
    notices = [(name, s) for name, several in L.TEMPLATES.items() for s in several]
    bodies = list(L.licence_texts().items())

    def cosine(a, b):
        a, b = ({t: k * weight(t) for t, k in Counter(terms(x)).items()} for x in (a, b))
        dot = sum(v * b.get(t, 0) for t, v in a.items())
        return dot / sqrt(sum(v * v for v in a.values()) * sum(v * v for v in b.values())) if dot else 0

    own, states = [], {}
    for i, path, text in rows:
        named = bool(path and re.search(L.NAMED, path))
        lines = (text or "").split("\n")
        units = ["\n".join(lines[k : k + w]) for w in range(1, wrap + 1) for k in range(len(lines) - w + 1)]
        pairs = [(u, name, s) for u in units for name, s in notices] + [(text, name, s) for name, s in notices + bodies if named]
        best = min(((-round(cosine(u, s), 6), name) for u, name, s in pairs), default=(0, None))
        own.append((best[1], -best[0]) if -best[0] >= threshold else (None, None))
        if own[-1][0] and path is not None and (named or any_states):
            folder = path.rpartition("/")[0]
            states[folder] = min(states.get(folder, (0, "~")), (-own[-1][1], own[-1][0]))
    for (i, path, _), (name, similarity) in zip(rows, own, strict=True):
        origin, source = ("own", None) if name else (None, None)
        if not name and path is not None:
            folder = path.rpartition("/")[0]
            while folder not in states and folder:
                folder = folder.rpartition("/")[0]
            if folder in states:
                name, origin, source = states[folder][1], "inherited", folder
        yield i, path, name, similarity, origin, source


@pytest.mark.parametrize("stating", ["name", "any"])
def test_against_brute_force(files, multiset, stating):
    got = L.scan(files, stating=stating)
    assert got.columns == ["doc_id", "path", "license", "similarity", "origin", "inherited_from"]
    want = list(brute(FILES, any_states=stating == "any"))
    assert {w[4] for w in want} == {"own", "inherited", None}
    assert multiset(got.collect()) == multiset(want)


def test_empty_and_native(files):
    from millrace.plans.inspect import operators

    assert L.scan(files.limit(0)).collect() == []
    assert not [o for o in operators(L.scan(files)) if "Python" in o or "Arrow" in o or "Pandas" in o]


def test_needed_terms_lose_nothing():
    class Unit(dict):
        __getitem__ = dict.get

    units = [Unit(license="A", notice=0, unit=u, term=t) for t, u in (("x", 0.8), ("y", 0.5), ("z", 0.3317))]
    assert L.needed_terms(units, 0.7) == ["x"]
    assert L.needed_terms(units, 0.5) == ["x", "y"]


def test_common_words_outside_the_notices_weigh_little(spark, tmp_path):
    """The registered query counts the documents of every word, so common words don't hide a notice."""
    from millrace.llm.queries import op6_license_scan

    n, outside = 3000, "see that page file was here"
    notice = "See that page: the file was licensed under the Apache License, Version 2.0, here unusually."
    texts = [f"{outside} word{k % 50}" if k % 3 == 0 else f"word{k % 50} number{k}" for k in range(n - 1)] + [f"a line\n{notice}"]
    rows = [(k, t, "en", "web") for k, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    own = [r for r in op6_license_scan(spark, str(tmp_path)).collect() if r["origin"] == "own"]

    seen = Counter(t for text in texts for t in set(terms(text)))
    weigh = lambda text: {t: k * (log((n + 1) / (seen[t] + 1)) + 1) for t, k in Counter(terms(text)).items()}
    a = weigh(notice)
    cosine = lambda b: sum(v * b.get(t, 0) for t, v in a.items()) / sqrt(sum(v * v for v in a.values()) * sum(v * v for v in b.values()))
    want = max(cosine(weigh(t)) for t in L.TEMPLATES["Apache-2.0"])
    assert [(r["doc_id"], r["license"]) for r in own] == [(n - 1, "Apache-2.0")]
    assert own[0]["similarity"] == pytest.approx(want, abs=2e-6)


def one(spark, *rows, **how):
    files = spark.createDataFrame(list(enumerate([*rows, *[(f"src/f{k}.py", f"def f{k}(x): return x + {k}") for k in range(40)]])), "doc_id long, file struct<path:string,text:string>")
    got = {r["doc_id"]: r for r in L.scan(files.select("doc_id", "file.*"), **how).collect()}
    return [(got[k]["license"], got[k]["origin"]) for k in range(len(rows))]


def test_whole_licence_files(spark):
    """Each with its own copyright line, without blank lines at the end, and some wrapped anew."""
    import textwrap

    texts = L.licence_texts()
    assert len(texts) >= 13 and min(map(len, texts.values())) > 700
    rows = []
    for k, (name, body) in enumerate(texts.items()):
        body = body.replace("<year>", "2020").replace("<owner>", "Some Body").replace("<copyright holders>", "Some Body Else")
        if k % 2:
            body = "\n".join(textwrap.wrap(body, 60))
        rows.append((f"lib{k}/{['LICENSE', 'LICENSE.txt', 'COPYING', 'license.md'][k % 4]}", body))
    assert one(spark, *rows) == [(name, "own") for name in texts]


WRAPPED = """#!/usr/bin/env python
# Copyright 2020 Some Body
#
# This program is free software: you can redistribute it and/or modify
# it under the terms of the GNU General Public License as published by
# the Free Software Foundation, either version 3 of the License, or
# (at your option) any later version.
import os
"""
APACHE = """/*
 * Copyright 2020 Some Body
 *
 * Licensed under the Apache License, Version 2.0 (the "License");
 * you may not use this file except in compliance with the License.
 * You may obtain a copy of the License at
 *
 *     http://www.apache.org/licenses/LICENSE-2.0
 */
int main() { return 0; }
"""


def test_wrapped_and_commented_headers(spark):
    rows = [
        ("a/x.py", WRAPPED), ("b/x.c", APACHE), ("c/x.js", "// SPDX-License-Identifier: MIT\nlet x = 1;"),
        ("d/x.go", "// Use of this source code is governed by a BSD-style\n// license that can be found in the LICENSE file.\npackage d"),
        ("e/x.c", WRAPPED.replace("version 3", "version 2").replace("software:", "software;")), ("f/x.py", WRAPPED.replace("GNU General", "GNU Affero General")),
        ("g/x.md", "This work is licensed under a Creative Commons\nAttribution-ShareAlike 4.0 International License."),
        ("h/x.md", "This work is licensed under the GNU General Public License,\nversion 2."), ("i/x.md", "Nothing of the kind; see the manual."),
    ]
    want = ["GPL-3.0", "Apache-2.0", "MIT", "BSD-3-Clause", "GPL-2.0", "AGPL-3.0", "CC-BY-SA-4.0", "GPL-2.0", None]
    assert one(spark, *rows) == [(name, name and "own") for name in want]


def test_runs_of_lines(spark):
    made = {"X-1": ("alpha beta gamma delta epsilon zeta eta theta",)}
    text = "# alpha beta\n# gamma delta\n#\n# epsilon zeta eta theta\nmore"
    assert one(spark, ("a/x", text), templates=made, texts={}) == [("X-1", "own")]
    text = "# alpha beta\n# gamma delta\n# epsilon zeta\n# eta theta\nmore"
    assert [one(spark, ("a/x", text), templates=made, texts={}, wrap=w, threshold=0.9)[0][0] for w in (1, 2, 3, 4)] == [None, None, None, "X-1"]


def test_ties_go_to_the_first_name(spark):
    same = {"Z-1": ("this very notice",), "B-1": ("this very notice",), "M-1": ("this very notice",)}
    assert one(spark, ("a/x", "this very notice"), templates=same, texts={}) == [("B-1", "own")]
    # of two licence files of equal similarity in one directory, too
    rows = [("p/LICENSE", "Released under the MIT License."), ("p/COPYING", "Licensed under the Apache License, Version 2.0."), ("p/q/x", "text")]
    assert one(spark, *rows)[2] == ("Apache-2.0", "inherited")


def test_very_long_text(spark):
    body = "\n".join(f"line {k} of many" for k in range(20_000))
    rows = [("a/x", body + "\n" + MIT + "\n" + body), ("b/x", "word " * 200_000), ("c/x", body)]
    assert one(spark, *rows) == [("MIT", "own"), (None, None), (None, None)]
