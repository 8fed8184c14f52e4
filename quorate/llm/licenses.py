"""Licences of files: sparse TF-IDF cosine to licence templates, then inheritance from the nearest ancestor directory.

All built-in DataFrame functions; no Python runs on the executors.

1. Every text is cut into statements (sentences and lines); templates likewise.  Terms are runs of a-z and 0-9.  The inverse
   document frequency of every template term is counted over all files; other terms weigh as terms no file has.
2. Marks: of each template the rarest terms, as many as it takes until the others alone stay below the threshold.  A statement
   without a mark can never match and is left out without loss.
3. Term counts of the other statements meet the templates' weights in an inverted index (a broadcast table whose size is
   that of the templates), which gives the cosine of each statement with each template.
4. A file's own licence is its best statement's (at least ``threshold``; ties: smaller licence name).  A licence file is one named so
   or mostly made of licence statements; it speaks for its directory (best score, then smallest path).
5. Files without a licence inherit that of the nearest directory above them: each distinct directory is joined with its
   ancestors, and files take over what their directory found.

Defined cases: NULL and empty texts have no statement; a NULL path has no directory and inherits nothing; repeated rows are
judged alike; an empty table gives an empty result; extra columns do not matter.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quorate.llm.common import BROADCAST_ROWS, stored

# Public licence notices.
TEMPLATES = {
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.",
                   "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
                   "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
                   "SPDX-License-Identifier: Apache-2.0", "Released under the Apache License 2.0."],
    "MIT": ["Released under the MIT License.", "Licensed under the MIT License.", "This project is licensed under the terms of the MIT license.", "SPDX-License-Identifier: MIT",
            "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction."],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3.", "Licensed under the GNU General Public License, version 3.", "SPDX-License-Identifier: GPL-3.0-only",
                "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "GPL-2.0": ["This work is licensed under the GNU General Public License, version 2.", "Licensed under the GNU General Public License, version 2.", "SPDX-License-Identifier: GPL-2.0-only",
                "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."],
    "LGPL-3.0": ["Licensed under the GNU Lesser General Public License, version 3.", "SPDX-License-Identifier: LGPL-3.0-only"],
    "BSD-3-Clause": ["Licensed under the BSD 3-Clause License.", "SPDX-License-Identifier: BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
                     "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Licensed under the Mozilla Public License, version 2.0.", "SPDX-License-Identifier: MPL-2.0"],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC0-1.0": ["Released under CC0 1.0.", "This work is dedicated to the public domain under CC0 1.0 Universal."],
}
THRESHOLD = 0.75
FILE_SHARE = 0.2  # of a licence file's terms, this share stands in licence statements
STATEMENT = r"\n|(?<=[.!?;])\s+"
TERM = r"[^a-z0-9]+"
FILE_NAME = r"(?i)(^|/)(licen[cs]e|copying|notice)[^/]*$"


def terms(text: str) -> list[str]:
    return [t for t in re.split(TERM, text.lower()) if t]


def template_vectors(idf: dict[str, float]) -> list[tuple[str, int, dict[str, float]]]:
    """(licence, statement number, unit vector) of every template."""
    out = []
    for name, statements in TEMPLATES.items():
        for k, s in enumerate(statements):
            raw = {t: n * idf[t] for t, n in Counter(terms(s)).items()}
            size = math.sqrt(sum(v * v for v in raw.values()))
            out.append((name, k, {t: v / size for t, v in raw.items()}))
    return out


def marks_of(vectors: list[tuple[str, int, dict[str, float]]], df: dict[str, int], threshold: float) -> list[str]:
    """Terms of which a matching statement has at least one."""
    found: set[str] = set()
    for _, _, v in vectors:
        rest = 1.0
        for t in sorted(v, key=lambda t: (df[t], t)):
            if rest < (threshold - 1e-6) ** 2:
                break
            found.add(t)
            rest -= v[t] ** 2
    return sorted(found)


def frequencies(files: DataFrame, text: str) -> tuple[int, dict[str, int]]:
    """Number of files, and of those with each template term."""
    words = sorted({t for s in TEMPLATES.values() for x in s for t in terms(x)})
    known = F.array(*[F.lit(w) for w in words])
    rows = (files.select(F.explode(F.array_append(F.array_intersect(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), TERM), known), F.lit(""))).alias("t"))
            .groupBy("t").count().collect())  # one row per template term, and one for all files
    got = {r[0]: r[1] for r in rows}
    return got.get("", 0), {w: got.get(w, 0) for w in words}


def statements(files: DataFrame, threshold: float = THRESHOLD, key: str = "path", text: str = "text") -> DataFrame:
    """(key, place, n_terms, licence, score): statements that match a template, with their best licence."""
    spark = files.sparkSession
    n, df = frequencies(files, text)
    idf = {t: math.log((n + 1) / (c + 1)) + 1 for t, c in df.items()}
    unknown = math.log(n + 1) + 1
    vectors = template_vectors(idf)
    marks = marks_of(vectors, df, threshold)
    mark = rf"(?<![a-z0-9])(?:{'|'.join(marks)})(?![a-z0-9])"
    parts = (files.select(key, F.lower(F.col(text)).alias("l")).filter(F.col("l").rlike(mark))
             .select(key, F.posexplode(F.split("l", STATEMENT)).alias("place", "s")).filter(F.col("s").rlike(mark))
             .select(key, "place", F.filter(F.split("s", TERM), lambda t: t != "").alias("ts")))
    # a literal relation, so that no Python runs outside the driver; terms and names hold no quotation marks
    values = ", ".join(f"('{t}', '{name}', {k}, {w * idf[t]!r}D, {idf[t]!r}D)" for name, k, v in vectors for t, w in v.items())
    index = spark.sql(f"select * from values {values} as v(t, licence, k, w, idf)")
    weights = index.groupBy("t").agg(F.max("idf").alias("idf"), F.collect_list(F.struct("licence", "k", "w")).alias("hits"))
    # a statement's row is named by its file, place and terms, so repeated files stay apart only where they differ
    counts = (parts.select(key, "place", F.xxhash64("ts").alias("h"), F.size("ts").alias("n_terms"), F.explode("ts").alias("t"))
              .groupBy(key, "place", "h", "n_terms", "t").agg(F.count(F.lit(1)).alias("c"))
              .join(F.broadcast(weights), "t", "left"))
    scored = (counts.withColumn("tf", F.col("c") * F.coalesce("idf", F.lit(unknown)))
              .withColumn("norm", F.sum(F.col("tf") * F.col("tf")).over(Window.partitionBy(key, "place", "h")))
              .select(key, "place", "h", "n_terms", "norm", F.col("c"), F.explode("hits").alias("x"))
              .groupBy(key, "place", "h", "n_terms", "norm", "x.licence", "x.k").agg(F.sum(F.col("c") * F.col("x.w")).alias("dot"))
              .withColumn("score", F.round(F.col("dot") / F.sqrt("norm"), 9)).filter(F.col("score") >= threshold))
    top = scored.groupBy(key, "place", "h", "n_terms").agg(F.max("score").alias("score"))
    return (scored.join(top, [key, "place", "h", "n_terms", "score"])
            .groupBy(key, "place", "h", "n_terms", "score").agg(F.min("licence").alias("licence")).drop("h"))


def scan(files: DataFrame, threshold: float = THRESHOLD, path: str = "path", text: str = "text") -> DataFrame:
    """(path, own_licence, score, licence, inherited_from) of every file."""
    files = files.select(path, text)
    found = stored(statements(files.filter(F.col(path).isNotNull()), threshold, path, text))
    top = found.groupBy(path).agg(F.max("score").alias("score"), F.sum("n_terms").alias("__l_terms"))
    own = stored(found.join(top, [path, "score"]).groupBy(path, "score", "__l_terms").agg(F.min("licence").alias("own_licence")))
    # only files with a licence of their own can speak for their directory, so only their terms are counted
    size = F.size(F.filter(F.split(F.lower(F.col(text)), TERM), lambda t: t != ""))
    rows = own.count()
    some = files.join(F.broadcast(own) if rows <= BROADCAST_ROWS else own, path)
    speaks = some.filter(F.col(path).rlike(FILE_NAME) | (F.col("__l_terms") >= size * FILE_SHARE)).select(path, "score", "own_licence").distinct()
    spoken = speaks.withColumn("dir", directory(F.col(path)))
    first = spoken.groupBy("dir").agg(F.max("score").alias("score")).join(spoken, ["dir", "score"]).groupBy("dir", "score").agg(F.min(path).alias(path))
    named = stored(first.join(spoken, ["dir", "score", path]).select("dir", "own_licence").groupBy("dir").agg(F.min("own_licence").alias("dir_licence")))
    dirs = files.filter(F.col(path).isNotNull()).select(directory(F.col(path)).alias("dir")).distinct()
    above = (dirs.select("dir", F.explode(F.sequence(F.lit(0), F.size(F.split("dir", "/")))).alias("depth"))
             .select("dir", "depth", F.array_join(F.slice(F.split("dir", "/"), F.lit(1), F.col("depth")), "/").alias("up")))
    hits = above.join(named.select(F.col("dir").alias("up"), "dir_licence"), "up")
    near = hits.groupBy("dir").agg(F.max("depth").alias("depth")).join(hits, ["dir", "depth"]).select("dir", F.col("up").alias("__l_up"), "dir_licence").distinct()
    near = stored(near)
    known = near.count()
    whole = files.select(path).withColumn("dir", directory(F.col(path)))
    whole = whole.join(F.broadcast(near) if known <= BROADCAST_ROWS else near, "dir", "left")
    mine = own.select(path, "own_licence", "score")
    whole = whole.join(F.broadcast(mine) if rows <= BROADCAST_ROWS else mine, path, "left")
    lone = F.col("own_licence").isNull()
    return whole.select(path, "own_licence", "score", F.coalesce("own_licence", "dir_licence").alias("licence"), F.when(lone, F.col("__l_up")).alias("inherited_from"))


def directory(path):
    """What stands before the last slash; the empty directory where there is none."""
    return F.regexp_replace(path, r"/?[^/]*$", "")
