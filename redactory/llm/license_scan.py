"""License scans: MinHash bands over overlapping text windows retrieve templates, exact containment verifies.

Templates are cut into windows of at most ``LONGEST`` shingles; a shorter one is a window of its own.  A window
of n shingles is looked for in document windows of the next power of two, which start every half window, so the best
of them overlaps a full match by at least J = 1/2.  Each of ``BANDS`` hashes is a band: a match with similarity J is
retrieved with probability 1 - (1 - J)^BANDS, over 0.99999 at 0.4.

Two windows share a band's minimum exactly if the template's smallest shingle under that hash is in the document's
window and smallest there too.  So documents' shingles are first joined with the templates' band minima, a
small table, and window minima are worked out only where one of those occurs.  That gives the same pairs
as hashing every window.

Containment alone would not tell versions apart: where two neighbouring words of a template both name the licence or
its version, a shingle with the two has to be found as well.  All of it is DataFrame and SQL expressions.
"""

from __future__ import annotations

import math
import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..plans.sizing import small_side

SHINGLE = 5
LONGEST = 32
BANDS = 24
CONTAINMENT = 0.8

# Short notices as they are used in files and on pages, by licence identifier.
TEMPLATES: tuple[tuple[str, str], ...] = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
            "documentation files (the \"Software\"), to deal in the Software without restriction, including without "
            "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of "
            "the Software, and to permit persons to whom the Software is furnished to do so"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is "
                   "distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or "
                   "implied."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
            "Public License as published by the Free Software Foundation"),
    ("LGPL", "licensed under the GNU Lesser General Public License"),
    ("AGPL-3.0", "licensed under the GNU Affero General Public License, version 3."),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
            "that the following conditions are met"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
            "hereby granted"),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related rights to this work."),
)

# Other versions and members of the same families.  The DuckDB statement holds TEMPLATES and the bound alone.
VERSIONS: tuple[tuple[str, str], ...] = (
    *((name, "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
             f"{word} General Public License as published by the Free Software Foundation")
      for name, word in (("LGPL", "Lesser"), ("AGPL", "Affero"))),
    ("GPL-1.0", "This work is licensed under the GNU General Public License, version 1."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("LGPL-2.0", "licensed under the GNU Library General Public License, version 2."),
    ("LGPL-2.0", "GNU LIBRARY GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("LGPL-2.1", "licensed under the GNU Lesser General Public License, version 2.1."),
    ("LGPL-2.1", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999"),
    ("LGPL-3.0", "licensed under the GNU Lesser General Public License, version 3."),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("AGPL-1.0", "licensed under the GNU Affero General Public License, version 1."),
    ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"),
    ("Apache-1.0", "Licensed under the Apache License, Version 1.0."),
    ("Apache-1.1", "Licensed under the Apache License, Version 1.1."),
    ("MPL-1.1", "The contents of this file are subject to the Mozilla Public License Version 1.1"),
    ("BSD-3-Clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or "
                     "promote products derived from this software without specific prior written permission"),
    *((f"CC-{kind}-{version}", f"Licensed under CC {kind} {version}.") for kind in
      ("BY", "BY-SA", "BY-NC", "BY-ND", "BY-NC-SA", "BY-NC-ND") for version in ("2.0", "2.5", "3.0", "4.0")
      if version != "4.0" or kind not in ("BY", "BY-SA", "BY-NC")),
    *((f"CC-{kind}-4.0", f"This work is licensed under a Creative Commons {name} 4.0 International License.") for kind, name in (
        ("BY-SA", "Attribution-ShareAlike"), ("BY-NC", "Attribution-NonCommercial"), ("BY-ND", "Attribution-NoDerivatives"),
        ("BY-NC-SA", "Attribution-NonCommercial-ShareAlike"), ("BY-NC-ND", "Attribution-NonCommercial-NoDerivatives"))),
)

# Words that name a licence or its version, besides numbers.
NAMING = frozenset("gnu general public license lesser library affero apache mozilla mit bsd isc creative commons attribution "
                   "sharealike noncommercial noderivatives cc by sa nc nd version v".split())


def naming_pairs(text: str) -> list[int]:
    """Positions of a template's words that name the licence or its version together with the next word."""
    names = [w in NAMING or w.isdigit() for w in words_of(text)]
    return [i for i, both in enumerate(zip(names, names[1:])) if all(both)]


def words_of(text: str) -> list[str]:
    return re.findall("[a-z0-9]+", text.lower())


def word_hashes(text: str) -> Column:
    """Hashes of a text column's words; null text has none."""
    h = f"transform(regexp_extract_all(lower(coalesce({text}, '')), '[a-z0-9]+', 0), w -> xxhash64(w))"
    return F.expr(h)


def _shingled(df: DataFrame, keep: list[str], text: str) -> DataFrame:
    others = ", ".join(f"get(_h, i + {k})" for k in range(1, SHINGLE))
    return df.select(*keep, word_hashes(text).alias("_h")).select(*keep, F.expr(
        f"transform(slice(_h, 1, greatest(size(_h) - {SHINGLE - 1}, 0)), (x, i) -> xxhash64(x, {others}))").alias("_s"))


def template_bands(spark: SparkSession, templates: Sequence[tuple[str, str]], bands: int) -> DataFrame:
    """Rows ``(shingle, band, size, template, license, whole, named)``: the smallest shingle of each template window and
    band.  ``named`` has the shingles around each of ``naming_pairs``.

    As many rows as template windows times bands, whatever the documents.  Templates of fewer than five words
    raise: they have no shingle.
    """
    for _, text in templates:
        if len(words_of(text)) < SHINGLE:
            raise ValueError(f"a template needs {SHINGLE} words: {text!r}")
    table = spark.createDataFrame([(i, name, text, naming_pairs(text)) for i, (name, text) in enumerate(templates)],
                                  "template int, license string, text string, pairs array<int>")
    whole = _shingled(table, ["template", "license", "pairs"], "text").select("*", F.size("_s").alias("n"), F.expr(
        f"transform(pairs, p -> slice(_s, greatest(p - {SHINGLE - 2}, 0) + 1, "
        f"least(p + 1, size(_s)) - greatest(p - {SHINGLE - 2}, 0)))").alias("named"))
    half = LONGEST // 2
    windows = whole.select("*", F.explode(F.expr(
        f"IF(n <= {LONGEST}, array(0), sequence(0, n - {half} - 1, {half}))")).alias("at")).select(
        "template", "license", F.array_distinct("_s").alias("whole"), "named", F.expr(f"slice(_s, at + 1, {LONGEST})").alias("w"))
    scale = "CASE " + " ".join(f"WHEN size(w) <= {1 << k} THEN {1 << k}" for k in range(int(math.log2(LONGEST)) + 1)) + " END"
    return windows.select("*", F.expr(scale).alias("size"), F.explode(F.sequence(F.lit(0), F.lit(bands - 1))).alias("band")).select(
        F.expr("array_min(transform(w, x -> named_struct('h', xxhash64(x, band), 'x', x))).x").alias("shingle"),
        "band", "size", "template", "license", "whole", "named")


def license_matches(docs: DataFrame, templates: Sequence[tuple[str, str]] = (*TEMPLATES, *VERSIONS), bands: int = BANDS,
                    containment: float = CONTAINMENT) -> DataFrame:
    """``docs(doc_id, text)`` to one row per match: ``(doc_id, template, license, shingle_at, containment)``.

    ``shingle_at`` is where the matching window starts, in shingles; a passage found through several windows of one
    template gives the rows of the best windows that differ.  ``containment`` is the share of the template's distinct
    shingles found around the window, at least the bound; all its ``naming_pairs`` are there, too.  Words are ASCII
    letters and digits in lower case; null, empty and shorter texts match nothing.  Other columns are ignored.
    """
    table = template_bands(docs.sparkSession, templates, bands)
    found = _shingled(docs.select("doc_id", "text"), ["doc_id"], "text").select(
        "doc_id", "_s", F.posexplode_outer("_s").alias("at", "shingle"))
    hits = found.join(small_side(table), "shingle")
    # The windows of the template's scale that hold the shingle: those that start at the last half step and before.  Each
    # goes on with the shingles around it alone, whose number the template bounds, and never with the whole text.
    step = "greatest(1, size div 2)"
    last, before = f"IF(size = 1, at, (at div {step}) * {step})", f"IF(size = 1, -1, (at div {step} - 1) * {step})"
    window = ("named_struct('start', {0}, 'lead', least({0}, size(whole)), 'around', slice(_s, greatest(0, {0} - size(whole)) + 1, "
              "least(greatest({0}, 0), size(whole)) + size + size(whole)))")
    hits = hits.select("doc_id", "shingle", "band", "size", "template", "license", "whole", "named", F.explode(F.expr(
        f"array({window.format(last)}, {window.format(before)})")).alias("w")).where("w.start >= 0").select(
        "*", "w.start", "w.lead", "w.around").drop("w")
    same = F.expr("array_min(transform(slice(around, lead + 1, size), x -> xxhash64(x, band))) = xxhash64(shingle, band)")
    retrieved = hits.where(same).dropDuplicates(["doc_id", "template", "start", "size"])
    share = F.expr("size(array_intersect(whole, around)) / size(whole)")
    named = F.expr("forall(named, pair -> arrays_overlap(pair, around))")
    return retrieved.where(named).select("doc_id", "template", "license", F.col("start").alias("shingle_at"),
                                         share.alias("containment")).where(F.col("containment") >= containment)


def scan_licenses(docs: DataFrame, templates: Sequence[tuple[str, str]] = (*TEMPLATES, *VERSIONS), bands: int = BANDS,
                  containment: float = CONTAINMENT) -> DataFrame:
    """One row per document id: ``(doc_id, licenses array<string>, n_templates, containment)``.

    ``licenses`` is sorted and empty where nothing matches, ``containment`` the best one, then null.  Rows that
    share a doc_id (null ids too) are one document.  An empty table gives no rows.
    """
    matches = license_matches(docs, templates, bands, containment).select("doc_id", "template", "license", "containment")
    base = docs.select("doc_id").withColumns({
        "template": F.lit(None).cast("int"), "license": F.lit(None).cast("string"), "containment": F.lit(None).cast("double")})
    return base.unionByName(matches).groupBy("doc_id").agg(
        F.sort_array(F.collect_set("license")).alias("licenses"),
        F.size(F.collect_set("template")).alias("n_templates"), F.max("containment").alias("containment"))
