"""Licence scans: Dice coefficient over word bigrams. DataFrame operations only."""

from __future__ import annotations

import re
from functools import reduce
from math import ceil, floor
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Wordings of public licence notices.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at",
    "BSD-3-Clause-notice": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "GPL-2.0-or-later": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-or-later": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "MIT": "Released under the MIT License.",
    "MIT-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
}


def template_bigrams(text: str) -> list[str]:
    """Distinct word bigrams of a normalised template, in order; a single word stands for itself."""
    words = re.findall("[a-z0-9]+", text.lower())
    return list(dict.fromkeys(f"{a} {b}" for a, b in zip(words, words[1:], strict=False))) or words[:1]


def needed(grams: list[str], least: float) -> list[str]:
    """Words of which a unit must hold one to reach ``least``: they touch more of the template's bigrams than it may lack.

    2 c / (a + b) >= least with c <= a gives c >= b * least / (2 - least).
    """
    left, out = set(grams), []
    for w in sorted({w for g in grams for w in g.split(" ")}, key=lambda w: (-len(w), w)):
        if len(grams) - len(left) > len(grams) * (1 - least / (2 - least)) + 1e-9:
            break
        out.append(w)
        left = {g for g in left if w not in g.split(" ")}
    return out


def normalised(text: Column) -> Column:
    """Lower case; every run without [a-z0-9] or line feed becomes one blank."""
    return F.regexp_replace(F.lower(text), "[^a-z0-9\n]+", " ")


def units(norm: Column) -> Column:
    """The lines of a text and its paragraphs of several lines (blank lines part them)."""
    lines = F.split(norm, "\n")
    paragraphs = F.filter(F.split(norm, "\n ?\n[ \n]*"), lambda p: p.contains("\n"))
    return F.concat(lines, F.transform(paragraphs, lambda p: F.replace(p, F.lit("\n"), F.lit(" "))))


def best_window(grams: list[str], pairs: Column, least: float) -> Column:
    """The best coefficient of the runs of a unit's bigrams that are at most b * (2 - least) / least long; null if none can reach ``least``.

    Only runs that start and end with a bigram of the template count: without others at its ends a run scores more.
    """
    b, most = len(grams), floor(len(grams) * (2 - least) / least + 1e-9)
    few = ceil(len(grams) * least / (2 - least) - 1e-9)

    def dice(part: Column) -> Column:
        return 2.0 * F.size(F.array_intersect(F.array(*map(F.lit, grams)), part)) / (F.size(F.array_distinct(part)) + b)

    def best(at: Column) -> Column:
        first = F.when(F.size(at) >= few, F.sequence(F.lit(0), F.size(at) - few)).otherwise(F.array().cast("array<int>"))
        last = lambda i: F.filter(F.sequence(i + few - 1, F.least(F.size(at), i + most) - 1), lambda j: F.get(at, j) - F.get(at, i) < most)
        return F.array_max(F.flatten(F.transform(first, lambda i: F.transform(last(i), lambda j: dice(F.slice(pairs, F.get(at, i), F.get(at, j) - F.get(at, i) + 1))))))

    at = F.filter(F.sequence(F.lit(1), F.size(pairs)), lambda i: F.get(pairs, i - 1).isin(grams))
    return F.get(F.transform(F.array(at), best), F.lit(0))  # bound once


def scan(docs: DataFrame, templates: dict[str, str] | None = None, least: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, licence, dice, n_units): for each document and template, the best coefficient of the units that reach ``least``.

    A unit is a line, or a paragraph of several lines, of the whole normalised text. If no
    unit of a document reaches ``least``, as the notice is part of longer ones, the runs of
    words within its units stand for them (``best_window``).
    Dice = 2 * common / (a + b) over distinct word bigrams. It can only reach ``least``
    if a lies between b * least / (2 - least) and b * (2 - least) / least, so a unit
    with too few words for any template is left before its bigrams are made, and only
    templates within the bounds are compared. Before that, texts and units without any
    of the words that a match cannot lack (``needed``) are left.

    Null and empty texts give no rows; nor does an empty table. Rows of a repeated or
    null id are taken together under that id. Other columns are ignored.
    """
    grams = {k: template_bigrams(v) for k, v in (TEMPLATES if templates is None else templates).items()}
    known = sorted({g for gs in grams.values() for g in gs})
    low = min(len(g) for g in grams.values()) * least / (2 - least)
    marks = sorted({w for g in grams.values() for w in needed(g, least)})
    marked = lambda t: reduce(or_, [t.contains(w) for w in marks])
    docs = docs.where(marked(F.lower(F.col(text_col))))
    split = docs.select(F.col(id_col), F.explode(units(normalised(F.col(text_col)))).alias("unit")).where(marked(F.col("unit")))
    words = F.filter(F.split("unit", " "), lambda w: w != "")
    rows = split.withColumn("words", words).where(F.size("words") >= max(1, low)).drop("unit")
    pairs = F.when(F.size("words") == 1, F.col("words")).otherwise(F.zip_with(F.slice("words", 1, F.size("words") - 1), F.slice("words", 2, F.size("words") - 1), lambda a, b: F.concat(a, F.lit(" "), b)))
    rows = rows.withColumn("pairs", pairs).withColumn("held", F.array_distinct(F.filter("pairs", lambda p: p.isin(known)))).where(F.size("held") >= low)
    rows = rows.withColumn("size", F.size(F.array_distinct("pairs")))
    size = F.col("size")

    def found(k: str, g: list[str]) -> Column:
        common = F.size(F.array_intersect(F.array(*map(F.lit, g)), F.col("held")))
        dice = 2.0 * common / (size + len(g))
        window = F.when((dice < least) & (common >= len(g) * least / (2 - least) - 1e-9), best_window(g, F.col("pairs"), least))
        return F.struct(F.lit(k).alias("licence"), F.when(dice >= least, dice).alias("dice"), F.when(window >= least, window).alias("window"))

    each = F.filter(F.array(*[found(k, g) for k, g in grams.items()]), lambda s: s["dice"].isNotNull() | s["window"].isNotNull())
    hits = rows.select(id_col, F.explode(each).alias("hit"))
    n = F.count("hit.dice")
    out = hits.groupBy(id_col, F.col("hit.licence").alias("licence"))
    return out.agg(F.coalesce(F.max("hit.dice"), F.max("hit.window")).alias("dice"), F.when(n > 0, n).otherwise(F.count("hit.window")).alias("n_units"))
