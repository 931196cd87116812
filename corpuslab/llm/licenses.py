"""Licence scan in Spark's own functions.

A unit is a line of a document, a paragraph of several lines, or the whole document, that holds an anchor word; every template holds
one. For each place of a template's first anchor term in a document, the run of terms that the template would cover there is a unit too, however
lines wrap and whatever stands around it; runs that can't reach the threshold are left out before weighing. Units and templates are vectors of TF-IDF weights over lower-case terms. The inverse document frequencies of the templates' terms are counted
over all documents; a term outside the templates weighs as one that no document has. A document's own licence is the
template with the greatest cosine to one of its units, if that is at least THRESHOLD. A document whose whole text
is that close to a template, or whose name is one of NAMES, is a licence file and covers its directory: a document without an own
licence takes that of the nearest ancestor directory with a licence file, found by joining ancestor paths.

Only the templates' weights are broadcast, a table that the code bounds. A directory's licence is one row, reduced before
the join, so a directory with very many files is joined, not gathered.

Edge cases: a null or empty text has no own licence and can inherit; a null path has no ancestors; ties go to the template's name, then to
the smallest doc_id; very long texts are scanned whole; repeated rows are scanned alike; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslab.plans.scratch import cut

THRESHOLD = 0.75
#: A line or text that is a licence statement holds one of these; so does each template.
ANCHORS = r"(?i)licen[sc]|copyright|spdx|permission is hereby|redistribution|unlicense|public domain"
#: Templates of more terms are compared with lines, paragraphs and whole texts only.
LONGEST = 60
#: Parts in which the files of a directory are joined to its licence.
SALTS = 16
NAMES = r"(?i)^(licen[sc]e|copying|notice|unlicense)([._-].*)?$"
#: Terms by which a run of a document is laid on a template.
ANCHOR_TERM = r"^(licen[sc].*|copyright|spdx.*|permission|redistribution|unlicense|public)$"
TERM = r"[\p{L}\p{N}][\p{L}\p{N}.+-]*"

# Texts of short licences, short notices of common licences, as they stand in file headers, and the openings of their texts.
_AS_IS = 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS {}BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'
TEMPLATES = (
    ("MIT", 'MIT License Copyright (c) Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. ' + _AS_IS.format("OR COPYRIGHT HOLDERS ")),
    ("BSD-3-Clause", 'Copyright (c) All rights reserved. Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. " + _AS_IS.format("")),
    ("Apache-2.0", "Apache License Version 2.0, January 2004"),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007 Copyright (C) 2007 Free Software Foundation, Inc."),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991 Copyright (C) 1989, 1991 Free Software Foundation, Inc."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT license."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-only"),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC0-1.0", "This work is dedicated to the public domain under CC0 1.0 Universal."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
)


def terms(text: Column) -> Column:
    """Lower-case terms, without full stops at their ends."""
    return F.transform(F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0)), bare)


def bare(term: Column) -> Column:
    return F.regexp_replace(term, r"[.+-]+$", "")


def laid(templates) -> dict[str, list[tuple[int, int]]]:
    """For each first anchor term of a template: the terms before it, and the template's length. Texts of more than LONGEST terms are whole files."""
    out: dict[str, set] = {}
    for _, body in templates:
        found = [re.sub(r"[.+-]+$", "", t) for t in re.findall(r"[^\W_](?:[^\W_]|[.+-])*", body.lower())]
        at = next((i for i, t in enumerate(found) if re.match(ANCHOR_TERM, t)), None)
        if at is not None and len(found) <= LONGEST:
            out.setdefault(found[at], set()).add((at, len(found)))
    return {t: sorted(x) for t, x in sorted(out.items())}


def runs(found: Column, templates, words: Column, threshold: float) -> Column:
    """The runs of the terms `found` on which a template can lie. A term outside the templates weighs as much as any, so a run of d of the
    templates' terms and m others has a cosine of at most sqrt(q / (q + m)), with q the greatest sum of squares of the former's counts."""
    at = laid(templates)
    hits = F.filter(F.transform(found, lambda t, i: F.struct(t.alias("t"), i.alias("i"))), lambda h: h["t"].isin(*at))
    lay = F.create_map(*[c for t, x in at.items() for c in (F.lit(t), F.array(*[F.struct(F.lit(p).alias("p"), F.lit(n).alias("n")) for p, n in x]))])
    start = lambda h, q: F.greatest(h["i"] - q["p"], F.lit(0))
    cover = F.flatten(F.transform(hits, lambda h: F.transform(F.element_at(lay, h["t"]), lambda q: F.slice(found, start(h, q) + 1, q["n"] - F.greatest(q["p"] - h["i"], F.lit(0))))))

    def can(run):
        d = F.size(F.array_intersect(run, words))
        m = F.size(F.array_distinct(run)) - d
        most = F.size(run) - m - d + 1
        return (most * most + d - 1) * (1 - threshold**2) >= threshold**2 * m - 1e-9

    return F.filter(F.array_distinct(cover), can)


def scan(docs: DataFrame, path: Column, threshold: float = THRESHOLD, templates=TEMPLATES) -> DataFrame:
    """doc_id, path, license, score, origin ('own', 'inherited', null), from_dir: for each row of docs (doc_id, text)."""
    spark = docs.sparkSession
    known = spark.createDataFrame([(i, name, text) for i, (name, text) in enumerate(templates)], "template int, license string, body string")
    weights = known.select("template", "license", F.explode(terms(F.col("body"))).alias("term")).groupBy("template", "license", "term").agg(F.count(F.lit(1)).alias("tf"))
    vocabulary = weights.select("term").distinct()
    words = [r[0] for r in vocabulary.orderBy("term").collect()]

    # One pass over the texts: which of the templates' terms a document holds, and its units.
    body = F.coalesce(F.col("text"), F.lit(""))
    anchored = F.rlike("body", F.lit(ANCHORS))
    vocabulary_words = F.array(*[F.lit(w) for w in words])
    lines = F.split("body", "\n")
    blocks = F.filter(F.split("body", r"\n[^\p{L}\p{N}\n]*\n"), lambda x: F.instr(x, "\n") > 0)
    holds = lambda units: F.filter(units, lambda x: F.rlike(x, F.lit(ANCHORS)))
    units = F.concat(F.transform(F.concat(holds(lines), holds(blocks)), terms), runs(F.col("found"), templates, vocabulary_words, threshold))
    named = F.coalesce(F.rlike(F.element_at(F.split(F.col("path"), "/"), -1), F.lit(NAMES)), F.lit(False))
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), path.cast("string").alias("path"), body.alias("body"))
    # Few texts hold an anchor: only their terms are kept in order.
    held = F.array_intersect(F.transform(F.array_distinct(F.regexp_extract_all(F.lower("body"), F.lit(TERM), F.lit(0))), bare), vocabulary_words)
    base = base.withColumn("found", F.when(anchored, terms(F.col("body")))).select(
        "doc_id", "path", named.alias("named"), held.alias("held"), F.when(anchored, units).otherwise(F.array().cast("array<array<string>>")).alias("units"), F.when(anchored, F.col("found")).alias("whole")
    )
    base = cut(base.withColumn("row", F.monotonically_increasing_id()), "licence_units")
    n = base.count()
    df = base.select(F.explode("held").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    # A row for each term of the templates.
    idf = cut(vocabulary.join(df, "term", "left").select("term", (F.log((F.lit(n) + 1.0) / (F.coalesce("df", F.lit(0)) + 1.0)) + 1.0).alias("idf")), "licence_idf")
    unseen = F.log(F.lit(n + 1.0)) + 1.0
    table = weights.join(F.broadcast(idf), "term").withColumn("w", F.col("tf") * F.col("idf"))
    norms = table.groupBy("template").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("t_norm"))
    table = cut(table.join(F.broadcast(norms), "template").select("template", "license", "term", (F.col("w") / F.col("t_norm")).alias("share")), "licence_weights")

    lines = base.where(F.size("units") > 0).select("row", F.posexplode("units").alias("unit", "body"))
    wholes = base.where(F.col("whole").isNotNull()).select("row", F.lit(-1).alias("unit"), F.col("whole").alias("body"))
    tf = lines.unionByName(wholes).select("row", "unit", F.explode("body").alias("term")).groupBy("row", "unit", "term").agg(F.count(F.lit(1)).alias("tf"))
    tf = tf.join(F.broadcast(idf), "term", "left").withColumn("w", F.col("tf") * F.coalesce("idf", unseen))
    norm = tf.groupBy("row", "unit").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    dots = tf.join(F.broadcast(table), "term").groupBy("row", "unit", "license", "template").agg(F.sum(F.col("w") * F.col("share")).alias("dot"))
    close = dots.join(norm, ["row", "unit"]).withColumn("score", F.round(F.col("dot") / F.col("norm"), 9)).where(F.col("score") >= threshold)
    own = close.groupBy("row").agg(F.min(F.struct(-F.col("score"), "license")).alias("best"), F.max(F.col("unit") == -1).alias("file"))
    own = own.select("row", F.col("best.license").alias("own_license"), (-F.col("best.col1")).alias("own_score"), "file")

    marked = cut(base.select("row", "doc_id", "path", "named").join(own, "row", "left"), "licence_own")
    parts = F.split("path", "/")
    folder = F.array_join(F.slice(parts, 1, F.size(parts) - 1), "/")
    files = marked.where(F.col("own_license").isNotNull() & F.col("path").isNotNull() & (F.col("file") | F.col("named")))
    folders = files.groupBy(folder.alias("folder")).agg(F.min(F.struct((-F.col("own_score")).alias("s"), F.col("own_license").alias("l"), F.col("doc_id").alias("d"))).alias("x"))
    folders = cut(folders.select("folder", F.col("x.l").alias("f_license"), (-F.col("x.s")).alias("f_score"), F.col("x.d").alias("f_doc")), "licence_folders")
    # Directories are few beside files: each directory without a licence of its own looks up its ancestors once.
    need = marked.where(F.col("own_license").isNull() & F.col("path").isNotNull()).select(folder.alias("dir")).distinct()
    depth = F.size(F.split("dir", "/"))
    above = need.select("dir", F.explode(F.sequence(F.lit(0), depth)).alias("k")).withColumn("folder", F.array_join(F.slice(F.split("dir", "/"), F.lit(1), F.col("k")), "/"))
    nearest = above.join(folders, "folder").groupBy("dir").agg(F.max(F.struct("k", "folder", "f_license", "f_score", "f_doc")).alias("x"))
    nearest = nearest.select("dir", F.col("x.f_license").alias("in_license"), F.col("x.f_score").alias("in_score"), F.col("x.folder").alias("from_dir"))
    # A directory with very many files meets its one row in SALTS parts.
    nearest = nearest.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salt = F.pmod(F.xxhash64("row"), F.lit(SALTS)).cast("int")
    out = marked.withColumns({"dir": folder, "salt": salt}).join(nearest, ["dir", "salt"], "left")
    is_own = F.col("own_license").isNotNull()
    return out.select(
        "doc_id", "path", F.coalesce("own_license", "in_license").alias("license"), F.when(is_own, F.col("own_score")).otherwise(F.col("in_score")).alias("score"),
        F.when(is_own, "own").when(F.col("in_license").isNotNull(), "inherited").alias("origin"), F.when(~is_own, F.col("from_dir")).alias("from_dir"),
    )
