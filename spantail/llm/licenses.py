"""Licences of files: TF-IDF cosine of headers and licence files to templates, then inheritance by paths.

A statement is a line or sentence with a word of licensing. Its sparse TF-IDF vector is held against
those of the templates (idf over the templates; a word that none has weighs as much as one that only
one has). A file's own licence is that of its best statement of at least `least`; a file named as a
licence file is compared as a whole too, and if one is found, it stands for its directory.

Files without an own licence take that of the nearest ancestor directory: distinct directories are
exploded to their ancestors, joined on paths with the directories that have a licence, and the
deepest is taken; files are then joined with their directory, those of very large directories by
broadcast. Two licence files in one directory: the higher score, then the name of the licence, decides.
What was found of each row is written once, with the columns that are kept.

DataFrame functions only. Null and empty texts have no statements; null paths are in no directory and
inherit nothing. Ties between templates go to the name. Very long texts, and statements, take time in
proportion to their words, but for sorting them. Repeated rows each get their row; an empty table gives
no rows.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spantail.llm.common import joined_hot, others, written
from spantail.llm.native import once

#: Statements by which licences are commonly declared.
TEMPLATES = {
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.", "Apache License Version 2.0, January 2004", "SPDX-License-Identifier: Apache-2.0"],
    "BSD-2-Clause": ["Released under the 2-Clause BSD License.", "SPDX-License-Identifier: BSD-2-Clause", "Use of this source code is governed by a 2-clause BSD license"],
    "BSD-3-Clause": ["Released under the 3-Clause BSD License.", "SPDX-License-Identifier: BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License.", "SPDX-License-Identifier: CC-BY-4.0"],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "SPDX-License-Identifier: CC-BY-NC-4.0"],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "SPDX-License-Identifier: CC-BY-SA-4.0"],
    "GPL-2.0": ["This work is licensed under the GNU General Public License, version 2.", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991", "SPDX-License-Identifier: GPL-2.0-only"],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3.", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007", "SPDX-License-Identifier: GPL-3.0-only"],
    "LGPL-3.0": ["This work is licensed under the GNU Lesser General Public License, version 3.", "SPDX-License-Identifier: LGPL-3.0-only"],
    "MIT": ["Released under the MIT License.", "Licensed under the MIT License.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software", "SPDX-License-Identifier: MIT"],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "SPDX-License-Identifier: MPL-2.0"],
    "Proprietary": ["Copyright. All rights reserved.", "This file is proprietary and confidential. Unauthorized copying of this file is prohibited."],
}
CUE = r"(?i)licen[cs]|copyright|spdx|all rights reserved|permission is hereby granted|proprietary"
LICENCE_FILE = r"(?i)(^|/)(licen[cs]e|copying|unlicense|notice)([.-][^/]*)?$"
#: A version's point stays in its word.
_WORD = r"[^a-z0-9.]+|[.](?![0-9])"


def _words(text: str) -> list[str]:
    return [w for w in re.split(_WORD, text.lower()) if w]


class Templates:
    """Unit TF-IDF vectors of template statements."""

    def __init__(self, templates: dict[str, list[str]]):
        self.rows = sorted((name, s) for name, statements in templates.items() for s in statements)
        counts = [Counter(_words(s)) for _, s in self.rows]
        has = Counter(w for c in counts for w in c)
        self.idf = {w: math.log((1 + len(counts)) / (1 + n)) + 1 for w, n in sorted(has.items())}
        self.unknown = math.log((1 + len(counts)) / 2) + 1
        self.vectors = []
        for c in counts:
            size = math.sqrt(sum((n * self.idf[w]) ** 2 for w, n in c.items()))
            self.vectors.append({w: n * self.idf[w] / size for w, n in sorted(c.items())})


def _map(values: dict[str, float]) -> Column:
    return F.map_from_arrays(F.array(*map(F.lit, values)), F.array(*map(F.lit, values.values())))


def _runs(words: Column) -> Column:
    """array<struct<w, c>> of distinct words and their counts. For words of a bounded vocabulary: the list that grows has at most as many."""
    none = F.array().cast("array<struct<w:string,c:int>>")
    put = lambda s: F.when(s["c"] > 0, F.concat(s["out"], F.array(F.struct(s["w"].alias("w"), s["c"].alias("c"))))).otherwise(s["out"])
    step = lambda s, w: F.when(s["w"].eqNullSafe(w), F.struct(w.alias("w"), (s["c"] + 1).alias("c"), s["out"].alias("out"))).otherwise(F.struct(w.alias("w"), F.lit(1).alias("c"), put(s).alias("out")))
    return F.aggregate(F.sort_array(words), F.struct(F.lit(None).cast("string").alias("w"), F.lit(0).alias("c"), none.alias("out")), step, put)


def _squares(words: Column) -> Column:
    """The sum of the squares of the words' counts."""
    step = lambda s, w: F.when(s["w"].eqNullSafe(w), F.struct(w.alias("w"), (s["c"] + 1).alias("c"), (s["sum"] + 2 * s["c"] + 1).alias("sum"))).otherwise(F.struct(w.alias("w"), F.lit(1).cast("double").alias("c"), (s["sum"] + 1).alias("sum")))
    return F.aggregate(F.sort_array(words), F.struct(F.lit(None).cast("string").alias("w"), F.lit(0.0).alias("c"), F.lit(0.0).alias("sum")), step, lambda s: s["sum"])


def best_template(text: Column, templates: Templates) -> Column:
    """struct<score, license> of the template nearest to a text; score is rounded to 6 places.

    The words are sorted once: those of the templates are counted one by one, of all others only the
    squares of their counts matter, as they weigh the same.
    """
    idf, vectors = _map(templates.idf), F.array(*map(_map, templates.vectors))
    names, known = F.array(*[F.lit(n) for n, _ in templates.rows]), F.array(*map(F.lit, templates.idf))

    def scored(words: Column) -> Column:
        counted = F.transform(_runs(F.filter(words, lambda w: F.array_contains(known, w))), lambda x: F.struct(x["w"].alias("w"), (x["c"] * F.element_at(idf, x["w"])).alias("v")))
        rest = _squares(F.filter(words, lambda w: ~F.array_contains(known, w))) * templates.unknown**2

        def best(c: Column) -> Column:
            norm = F.sqrt(F.aggregate(c["known"], c["rest"], lambda t, x: t + x["v"] * x["v"]))
            dots = F.transform(vectors, lambda m: F.aggregate(c["known"], F.lit(0.0), lambda t, x: t + x["v"] * F.coalesce(F.try_element_at(m, x["w"]), F.lit(0.0))))
            top = F.array_max(F.zip_with(dots, F.sequence(F.lit(1), F.lit(len(templates.rows))), lambda d, i: F.struct(F.round(d / norm, 6).alias("score"), (-i).alias("i"))))
            return F.struct(top["score"].alias("score"), F.element_at(names, -top["i"]).alias("license"))

        return F.when(F.size(words) > 0, once(F.struct(counted.alias("known"), rest.alias("rest")), best))

    return once(F.filter(F.split(F.lower(text), _WORD), lambda w: w != ""), scored)


def own_licenses(df: DataFrame, text_col: str, path: Column, least: float, templates: Templates) -> DataFrame:
    """df with __path, __named (a licence file), __own (struct<score, license> or null) and n_statements."""
    text = F.col(text_col)
    statements = F.filter(F.split(text, r"\n|(?<=[.!?])\s+"), lambda s: s.rlike(CUE))
    named = F.coalesce(path.rlike(LICENCE_FILE), F.lit(False))
    found = df.withColumn("__path", path).withColumn("__named", named).withColumn("__said", F.when(text.rlike(CUE), statements).otherwise(F.array().cast("array<string>")))
    compared = F.when(F.col("__named"), F.concat("__said", F.array(F.coalesce(text, F.lit(""))))).otherwise(F.col("__said"))
    scores = F.filter(F.transform(compared, lambda s: best_template(s, templates)), lambda b: b["score"] >= least)
    top = F.array_sort(F.transform(scores, lambda b: F.struct((-b["score"]).alias("s"), b["license"].alias("license"))))
    return found.withColumn("__top", F.try_element_at(top, F.lit(1))).withColumn("n_statements", F.size("__said").cast("long")).withColumn("__own", F.when(F.col("__top").isNotNull(), F.struct((-F.col("__top.s")).alias("score"), F.col("__top.license").alias("license")))).drop("__top", "__said")


def _directory(path: Column) -> Column:
    return F.when(path.contains("/"), F.regexp_replace(path, "/[^/]*$", "")).when(path.isNotNull(), F.lit(""))


def _ancestors(directory: Column) -> Column:
    """A directory and all above it, with their depths; the root is the empty string."""
    parts = F.filter(F.split(directory, "/"), lambda p: p != "")
    return F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.struct(n.alias("depth"), F.concat_ws("/", F.slice(parts, 1, n)).alias("ancestor")))


def license_scan(df: DataFrame, text_col: str = "text", path: Column | str = "path", least: float = 0.6, keep: list[str] | None = None, templates: dict[str, list[str]] | None = None) -> DataFrame:
    """The columns `keep` of df (all, if None), license, score, via (own, inherited or null) and n_statements; columns of these names are replaced."""
    made = ("license", "score", "via", "n_statements")
    kept = others(df.columns if keep is None else keep, *made)
    path = F.col(path) if isinstance(path, str) else path
    made_from = Templates(templates or TEMPLATES)
    clean = F.concat_ws("/", F.filter(F.split(_directory(F.col("__path")), "/"), lambda p: p != ""))

    found = own_licenses(df, text_col, path, least, made_from).select(*kept, "__path", "__named", "__own", "n_statements")
    found, _ = written(found.withColumn("__dir", F.when(F.col("__path").isNotNull(), clean)), "licenses")
    here = found.where(F.col("__dir").isNotNull())
    standing = here.where(F.col("__named") & F.col("__own").isNotNull())
    standing = standing.groupBy(F.col("__dir").alias("ancestor")).agg(F.min(F.struct((-F.col("__own.score")).alias("s"), F.col("__own.license").alias("license"))).alias("own"))
    below = here.groupBy("__dir").agg(F.count("*").alias("n")).select("__dir", "n", F.inline(_ancestors(F.col("__dir"))))
    near, _ = written(below.join(standing, "ancestor").groupBy("__dir", "n").agg(F.max_by("own", "depth").alias("__near")), "near")
    rows = joined_hot(found, near, "__dir", "left")
    own, near = F.col("__own"), F.col("__near")
    return rows.select(
        *kept,
        F.coalesce(own["license"], near["license"]).alias("license"),
        F.coalesce(own["score"], -near["s"]).alias("score"),
        F.when(own.isNotNull(), F.lit("own")).when(near.isNotNull(), F.lit("inherited")).alias("via"),
        "n_statements",
    )
