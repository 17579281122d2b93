"""Licence scans: sparse TF-IDF cosine to templates, and inheritance from the nearest ancestor directory."""

from __future__ import annotations

from collections import Counter
from importlib.resources import files as packaged
from math import log, sqrt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import narrow_reads, saved
from millrace.llm.quality_rules import let

#: Notices by SPDX identifier, as headers state them.
TEMPLATES = {
    "AGPL-3.0": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the "
        "Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "This work is licensed under the GNU Affero General Public License, version 3.",
    ),
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\")",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. "
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "SPDX-License-Identifier: Apache-2.0",
    ),
    "BSD-2-Clause": ("Use of this source code is governed by a BSD 2-Clause license.", "Licensed under the BSD 2-Clause License.", "SPDX-License-Identifier: BSD-2-Clause"),
    "BSD-3-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "Licensed under the BSD 3-Clause License.",
        "SPDX-License-Identifier: BSD-3-Clause",
    ),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    "CC0-1.0": ("To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.", "SPDX-License-Identifier: CC0-1.0"),
    "GPL-2.0": (
        "This work is licensed under the GNU General Public License, version 2.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the "
        "Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
        "SPDX-License-Identifier: GPL-2.0",
    ),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License version 3",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the "
        "Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "SPDX-License-Identifier: GPL-3.0",
    ),
    "ISC": ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",),
    "LGPL-2.1": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the "
        "Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
        "Licensed under the GNU Lesser General Public License, version 2.1.",
    ),
    "LGPL-3.0": ("Licensed under the GNU Lesser General Public License, version 3.",),
    "MIT": (
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software",
        "SPDX-License-Identifier: MIT",
    ),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, "
        "You can obtain one at https://mozilla.org/MPL/2.0/.",
    ),
    "Unlicense": ("This is free and unencumbered software released into the public domain.",),
    "Zlib": ("This software is provided 'as-is', without any express or implied warranty.",),
}


def licence_texts() -> dict[str, str]:
    """The whole texts of licences by SPDX identifier, for files that hold nothing else."""
    return {f.name.removesuffix(".txt"): f.read_text() for f in sorted(packaged("millrace.llm").joinpath("licenses").iterdir(), key=lambda f: f.name) if f.name.endswith(".txt")}


BREAKS = r"[^\p{L}\p{N}-]+"
#: A file of such a name states the licence of its directory.
NAMED = r"(?i)(^|/)(licen[cs]e|copying|unlicense|notice)([.-][^/]*)?$"


KIND = "array<struct<line:int,span:int,terms:array<string>>>"


def terms(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), BREAKS), "")


def directory(path: Column) -> Column:
    """The part before the last slash; the top directory is the empty string."""
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def headers(text: Column, named: Column, marks: Column, wrap: int) -> Column:
    """Array of (line, span, terms): the runs of 1 to ``wrap`` lines with a mark; of named files also (-1, 0, all terms)."""
    lines = F.transform(F.split(text, "\n"), terms)

    def runs(x, hit):
        starting = lambda span: F.transform(x, lambda _, k: F.struct(k.alias("line"), F.lit(span).alias("span")))
        inside = lambda p: (p["line"] + p["span"] <= F.size(x)) & F.array_contains(F.slice(hit, p["line"] + 1, p["span"]), True)
        chosen = F.filter(F.concat(*map(starting, range(1, wrap + 1))), inside)
        found = F.transform(chosen, lambda p: F.struct(p["line"].alias("line"), p["span"].alias("span"), F.flatten(F.slice(x, p["line"] + 1, p["span"])).alias("terms")))
        return F.when(F.array_contains(hit, True), found).otherwise(F.array().cast(KIND))

    whole = F.when(named, F.array(F.struct(F.lit(-1).alias("line"), F.lit(0).alias("span"), terms(text).alias("terms"))).cast(KIND)).otherwise(F.array().cast(KIND))
    marked = lambda x: F.transform(x, lambda line: F.arrays_overlap(line, marks))
    return F.concat(let(lines, lambda x: let(marked(x), lambda hit: runs(x, hit))).cast(KIND), whole)


def scan(
    files: DataFrame, threshold: float = 0.6, templates: dict[str, tuple[str, ...]] = TEMPLATES, stating: str = "name", wrap: int = 4,
    texts: dict[str, str] | None = None, id_column: str = "doc_id", path_column: str = "path", text_column: str = "text",
) -> DataFrame:
    """Rows (id, path, license, similarity, origin, inherited_from), one for each input row, whole texts.

    Headers are runs of 1 to ``wrap`` neighbouring lines, so that a notice may be wrapped, in comments
    or not; every run of every text is compared with the notices in ``templates``.  Files with a
    licence's name are also compared as a whole, with notices and with the licences' ``texts`` (by
    default those that come with the package).  Licence files are those with such a name, or, if
    ``stating`` is "any", all with their own licence.  The best template at ``threshold`` or more is
    the file's own licence; a file without one inherits from the nearest ancestor directory with a
    licence file, its own first.  Ties go to the licence first by name.  Null texts are empty, a
    null path has no directory and inherits nothing, null ids stay null, repeated rows stay apart,
    an empty table gives no rows, other columns are ignored.

    Inverse document frequencies are those of all texts, every term counted.  What is collected or
    broadcast is bounded by the templates; other terms and directories are joined, however many.
    """
    spark = files.sparkSession
    text = F.coalesce(F.col(text_column), F.lit(""))
    with narrow_reads(spark):
        counts = saved(files.select(F.explode(F.array_distinct(terms(text))).alias("term")).groupBy("term").count(), "license-terms")
    n = files.count()
    held = [(name, k, False, notice) for name, several in sorted(templates.items()) for k, notice in enumerate(several)]
    held += [(name, -1, True, body) for name, body in sorted((licence_texts() if texts is None else texts).items())]
    told = spark.createDataFrame(held, "license string, notice int, whole boolean, text string").select("license", "notice", "whole", terms(F.col("text")).alias("terms"))
    known = [(r["license"], r["notice"], r["whole"], Counter(r["terms"])) for r in told.collect()]
    vocabulary = spark.createDataFrame([(t,) for t in sorted({t for *_, c in known for t in c})], "term string")
    found = {r["term"]: r["count"] for r in counts.join(F.broadcast(vocabulary), "term").collect()}
    idf = lambda term: log((n + 1) / (found.get(term, 0) + 1)) + 1
    own = []
    for name, k, whole, tf in known:
        weights = {t: c * idf(t) for t, c in tf.items()}
        norm = sqrt(sum(w * w for w in weights.values()))
        own += [(name, k, whole, t, idf(t), w / norm) for t, w in weights.items()]
    needed = needed_terms([{"license": o[0], "notice": o[1], "term": o[3], "unit": o[5]} for o in own if not o[2]], threshold)
    marks = F.array(*map(F.lit, needed)).cast("array<string>")
    units_known = spark.createDataFrame(own, "license string, notice int, whole boolean, term string, weight double, unit double")

    path = F.col(path_column)
    named = F.coalesce(path.rlike(NAMED), F.lit(False))
    rows = files.select(F.monotonically_increasing_id().alias("row"), F.col(id_column).alias("id"), path.alias("path"), named.alias("named"), headers(text, named, marks, wrap).alias("units"))
    with narrow_reads(spark):
        rows = saved(rows, "license-units")

    units = rows.select("row", F.explode("units").alias("u")).select("row", "u.line", "u.span", F.explode("u.terms").alias("term"))
    tf = units.groupBy("row", "line", "span", "term").agg(F.count("*").alias("tf"))
    weights = F.broadcast(units_known.select("term", "weight").distinct())
    tf = tf.join(weights, "term", "left")
    inside = tf.where("weight is not null").withColumn("w", F.col("tf") * F.col("weight"))
    others = tf.where("weight is null").join(counts, "term").withColumn("w", F.col("tf") * (F.log((F.lit(n) + 1) / (F.col("count") + 1)) + 1))
    each = inside.select("row", "line", "span", "w").unionByName(others.select("row", "line", "span", "w"))
    sized = each.groupBy("row", "line", "span").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    dots = inside.join(F.broadcast(units_known.drop("weight")), "term").where(~F.col("whole") | (F.col("line") < 0))
    dots = dots.groupBy("row", "line", "span", "license", "notice").agg(F.sum(F.col("w") * F.col("unit")).alias("dot"))
    scored = dots.join(sized, ["row", "line", "span"]).withColumn("similarity", F.round(F.col("dot") / F.col("norm"), 6)).where(F.col("similarity") >= threshold)
    best = scored.groupBy("row").agg(F.min(F.struct((-F.col("similarity")).alias("minus"), "license")).alias("best"))
    best = saved(best.select("row", F.col("best.license").alias("license"), (-F.col("best.minus")).alias("similarity")), "licenses")

    stated = rows.drop("units").join(best, "row", "left")
    speaks = F.col("named") | F.lit(stating == "any")
    of = stated.where(F.col("license").isNotNull() & F.col("path").isNotNull() & speaks).groupBy(directory(F.col("path")).alias("ancestor"))
    of = of.agg(F.min(F.struct((-F.col("similarity")).alias("minus"), "license"))["license"].alias("inherited"))
    folders = rows.where("path is not null").select(directory(F.col("path")).alias("folder")).distinct()
    parts = F.split("folder", "/")
    ancestors = F.concat(F.array(F.lit("")), F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), "/")))
    reached = folders.select("folder", F.explode(F.array_distinct(ancestors)).alias("ancestor")).join(of, "ancestor")
    nearest = reached.groupBy("folder").agg(F.max(F.struct(F.length("ancestor").alias("depth"), "ancestor", "inherited")).alias("near"))
    out = stated.withColumn("folder", directory(F.col("path"))).join(nearest, "folder", "left")
    mine = F.col("license").isNotNull()
    return out.select(
        F.col("id").alias(id_column), "path", F.coalesce("license", "near.inherited").alias("license"), "similarity",
        F.when(mine, "own").when(F.col("near").isNotNull(), "inherited").alias("origin"),
        F.when(~mine, F.col("near.ancestor")).alias("inherited_from"),
    )


def needed_terms(units: list, threshold: float) -> list[str]:
    """Terms of which every text within ``threshold`` of a notice holds one.

    For each notice its heaviest terms are taken until the rest, even all together, weigh less
    than the threshold: a unit vector over the rest alone has a smaller cosine.
    """
    by: dict[tuple, list] = {}
    for r in units:
        by.setdefault((r["license"], r["notice"]), []).append((r["unit"], r["term"]))
    needed: set[str] = set()
    for held in by.values():
        held.sort(reverse=True)
        rest = sum(u * u for u, _ in held)
        for u, term in held:
            if rest < threshold * threshold:
                break
            needed.add(term)
            rest -= u * u
    return sorted(needed)
