"""License scans (operator 4), in DataFrame functions only.

Every line of a file is a possible notice; a licence file's whole text is one more. So are runs of 2 to HEADER_LINES lines,
which are held against the licences' headers, whose words break over lines as they like. Units are compared with the
templates by cosine of TF-IDF vectors. Only the templates' terms have an inverse document frequency, counted over all
files; other terms weigh 1. A unit can reach the least score only if it holds one of a template's heaviest terms (those
without which the rest of the template is too short a vector), and a run of lines only if it holds as many of a header's
terms as its heaviest ones need, so only such units are split into terms.

A licence file's whole text is compared with the licences' full texts as well, with document frequencies of these texts;
a tag SPDX-License-Identifier with a known identifier, or an expression of such, names its licence outright. Tags go before
full texts and these before notices, as a full text may quote one ("All rights reserved.").

A file without a notice of its own has the licence of the nearest directory above it that has a licence file: distinct
directories are expanded into their ancestors and joined by path.
"""

from __future__ import annotations

import json
import math
import re
from functools import cache
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.llm.tables import written

#: Notices by SPDX identifier.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0."),
    ("GPL-2.0-only", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."),
    ("LGPL-3.0-only", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("LicenseRef-Proprietary", "All rights reserved."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy"),
    ("MPL-2.0", "Licensed under the Mozilla Public License, Version 2.0."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public"),
]
#: Headers of several lines by SPDX identifier.
HEADERS = [
    ("AGPL-3.0-or-later", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("BSD-3-Clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("LicenseRef-BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("GPL-2.0-or-later", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("GPL-3.0-or-later", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("LGPL-2.1-or-later", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at"),
]
HEADER_LINES = 5
#: Full texts by SPDX identifier: one file each.
TEXTS = Path(__file__).parent / "license_texts"
#: Identifiers that SPDX has replaced.
FORMER = {"gpl-2.0": "GPL-2.0-only", "gpl-3.0": "GPL-3.0-only", "lgpl-3.0": "LGPL-3.0-only"}
#: Identifiers that tags may have besides those of the templates.
TAGGED = ("0BSD", "AGPL-3.0-only", "Artistic-2.0", "BSD-2-Clause", "BSL-1.0", "CC0-1.0", "EPL-2.0", "ISC", "LGPL-2.1-only", "MIT-0", "Unlicense", "Zlib")
TAG = r"spdx-license-identifier:[ \t]*([a-z0-9.+() -]*[a-z0-9.+)])[ \t]*(?:\*/|-->)?[ \t\r]*(?:\n|$)"
#: File names, in lower case, of files whose whole text is a licence.
LICENSE_FILES = r"^((un)?licen[cs]e|copying|notice)([-_.].*)?$|^[^/]*[-_.](un)?licen[cs]e(\.[a-z]+)?$"
#: A text that names itself so at its beginning isn't the one that it is nearest to.
TITLES = {"GPL-3.0-only": ("affero general public license", "AGPL-3.0-only")}
TITLE_CHARS = 400
TERM = "[a-z0-9]+"


def terms_of(text: str) -> dict[str, int]:
    found = re.findall(TERM, text.lower())
    return {t: found.count(t) for t in dict.fromkeys(found)}


def heaviest(weights: dict[str, float], least: float) -> list[str]:
    """The fewest terms, heaviest first, without which the unit vector's rest is shorter than least."""
    out, rest = [], 1.0
    for t, w in sorted(weights.items(), key=lambda x: (-x[1], x[0])):
        if rest < least * least:
            break
        out.append(t)
        rest -= w * w
    return out


@cache
def full_texts() -> tuple[list[str], str]:
    """The identifiers, and as JSON each term's inverse document frequency and its weights in the texts' unit vectors."""
    count = {p.stem: terms_of(p.read_text()) for p in sorted(TEXTS.glob("*.txt"))}
    vocabulary = sorted({t for own in count.values() for t in own})
    idf = {t: math.log((1 + len(count)) / (1 + sum(t in own for own in count.values()))) + 1 for t in vocabulary}
    length = {name: math.sqrt(sum((n * idf[t]) ** 2 for t, n in own.items())) for name, own in count.items()}
    return list(count), json.dumps([{"term": t, "idf": idf[t], "ws": [own.get(t, 0) * idf[t] / length[name] for name, own in count.items()]} for t in vocabulary])


def of_texts(source: DataFrame, least: float, allowed: list[str]) -> DataFrame:
    """id, path, whole, best: licence files (rows with whole) whose text is the full text of an allowed licence."""
    names, weights = full_texts()
    if not set(names) & set(allowed):
        return source.limit(0).select("id", "path", "whole", ranked(1, F.lit(0.0), 0, F.lit("")).alias("best"))
    table = source.sparkSession.range(1).select(F.inline(F.from_json(F.lit(weights), "array<struct<term string, idf double, ws array<double>>>")))
    titles = [F.lower(F.substring("text", 1, TITLE_CHARS)).contains(words).alias(f"t{k}") for k, (words, _) in enumerate(TITLES.values())]
    titled = [f"t{k}" for k in range(len(titles))]
    units = source.where("whole").select("id", "path", "whole", F.xxhash64("text").alias("u"), *titles, F.explode(F.regexp_extract_all(F.lower("text"), F.lit(TERM), F.lit(0))).alias("term"))
    single = units.groupBy("id", "path", "whole", "u", *titled, "term").agg(F.count(F.lit(1)).alias("tf"))
    scored = single.join(F.broadcast(table), "term", "left").withColumn("w", F.col("tf") * F.coalesce("idf", F.lit(1.0)))
    dots = [F.sum(F.col("w") * F.coalesce(F.col("ws")[i], F.lit(0.0))).alias(f"d{i}") for i in range(len(names))]
    # Repeated rows multiply every term alike, so their cosines stay.
    cosines = scored.groupBy("id", "path", "whole", "u", *titled).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("length"), *dots)
    named = lambda name: F.when(F.col(f"t{list(TITLES).index(name)}"), TITLES[name][1]).otherwise(name) if name in TITLES else F.lit(name)
    rows = F.array(*[ranked(1, F.round(F.col(f"d{i}") / F.col("length"), 9), i, named(name)) for i, name in enumerate(names) if name in allowed])
    return cosines.select("id", "path", "whole", F.array_max(rows).alias("best")).where(F.col("best.score") >= least)


def of_tags(source: DataFrame, names: list[str]) -> DataFrame:
    """id, path, whole, best: files with an SPDX tag of one of the names, or of an expression of these (in SPDX's spelling,
    without brackets). Of several tags the first name in the alphabet counts."""
    known = {name.lower(): name for name in (*names, *TAGGED)} | {k: v for k, v in FORMER.items() if v in names} | {x: x.upper() for x in ("or", "and")}
    tags = F.regexp_extract_all(F.lower("text"), F.lit(TAG), F.lit(1))
    found = source.where(F.lower("text").contains("spdx-license-identifier:")).select("id", "path", "whole", F.explode(tags).alias("tag"))
    spelled = F.create_map(*[F.lit(x) for k, v in sorted(known.items()) for x in (k, v)])
    words = F.transform(F.split(F.trim(F.regexp_replace("tag", "[() ]+", " ")), " "), lambda w: spelled[w])
    named = found.select("id", "path", "whole", words.alias("words")).where(~F.exists("words", lambda w: w.isNull())).select("id", "path", "whole", F.array_join("words", " ").alias("name"))
    first = named.groupBy("id", "path", "whole").agg(F.min("name").alias("name"))
    return first.select("id", "path", "whole", ranked(2, F.lit(1.0), 0, F.col("name")).alias("best"))


def ranked(rank: int, score: Column, order: int | Column, name: Column) -> Column:
    """Of two the larger counts: by rank, score, then the smaller order."""
    return F.struct(F.lit(rank).alias("rank"), score.alias("score"), (-(F.lit(order) if isinstance(order, int) else order)).cast("int").alias("order"), name.alias("name"))


def runs_of(lines: Column, n: int) -> Column:
    """Each n lines in a row, joined; none of fewer lines."""
    run = lambda i: F.array_join(F.slice(lines, i, F.lit(n)), "\n")
    return F.when(F.size(lines) >= n, F.transform(F.sequence(F.lit(1), F.size(lines) - n + 1), run)).otherwise(F.array().cast("array<string>"))


def directory(path: Column) -> Column:
    """Up to the last slash, without it; empty at the root, null for a null path."""
    return F.when(path.isNull(), F.lit(None).cast("string")).when(F.instr(path, "/") > 0, F.regexp_replace(path, "/[^/]*$", "")).otherwise(F.lit(""))


def scan(df: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, path_col: str = "path", id_col: str = "doc_id", text_col: str = "text", least: float = 0.8) -> DataFrame:
    """One row per row: id_col, path, own_license, own_score, license, inherited_from.

    own_license is the template of largest cosine (of equal ones the first in the lists) over the file's units if that is
    at least `least`, else null with a null score; a licence file's full text and SPDX tags (score 1) go before notices. license is own_license, or that of the nearest directory above (its
    own included) with a licence file that has one; of several licence files in a directory the smallest path counts,
    and inherited_from is its path. A null text has no units, a null path no directory. Rows of one id are one file
    each; those whose id and path are equal share their results. Other columns are left out. An empty table gives no
    rows.
    """
    source = df.select(F.col(id_col).alias("id"), F.col(path_col).cast("string").alias("path"), F.col(text_col).cast("string").alias("text"))
    headers = HEADERS if templates is TEMPLATES else []
    names = [name for name, _ in [*templates, *headers]]
    allowed = sorted({*names, *(full_texts()[0] if templates is TEMPLATES else [])})
    count = [terms_of(text) for _, text in [*templates, *headers]]
    vocabulary = sorted({t for own in count for t in own})
    words = F.array_intersect(F.regexp_extract_all(F.lower("text"), F.lit(TERM), F.lit(0)), F.array(*[F.lit(t) for t in vocabulary]))
    # One row for each term of the templates, and one for the number of files.
    tally = source.select(F.explode(F.concat(F.array(F.lit("")), F.coalesce(words, F.array().cast("array<string>")))).alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("n")).collect()
    seen = {r["t"]: r["n"] for r in tally}
    idf = {t: math.log((1 + seen.get("", 0)) / (1 + seen.get(t, 0))) + 1 for t in vocabulary}
    vectors = []
    for own in count:
        length = math.sqrt(sum((n * idf[t]) ** 2 for t, n in own.items()))
        vectors.append({t: n * idf[t] / length for t, n in own.items()})
    pattern = lambda own: rf"(^|[^a-z0-9])({'|'.join(sorted({t for v in own for t in heaviest(v, least)})) or '(?!)'})($|[^a-z0-9])"
    any_heavy, header_heavy = pattern(vectors), pattern(vectors[len(templates) :])

    base = F.lower(F.element_at(F.split("path", "/"), -1))
    # A file that holds no heavy term has no unit that could match.
    files = source.withColumn("whole", F.coalesce(base.rlike(LICENSE_FILES), F.lit(False)))
    held = files.where(F.lower("text").rlike(any_heavy))
    lines = F.transform(F.split("text", "\n"), F.lower)
    pieces = F.filter(lines, lambda x: x.rlike(any_heavy))
    explode = lambda units: held.select("id", "path", "whole", F.explode(F.array_distinct(units)).alias("unit"))
    terms = F.regexp_extract_all("unit", F.lit(TERM), F.lit(0))
    units = explode(F.when(F.col("whole"), F.concat(F.array(F.lower("text")), pieces)).otherwise(pieces)).withColumn("first", F.lit(0)).withColumn("terms", terms)
    if headers:
        runs = [runs_of(F.col("ls"), n) for n in range(2, HEADER_LINES + 1)]
        run = held.where(F.lower("text").rlike(header_heavy)).select("id", "path", "whole", lines.alias("ls")).where("size(ls) > 1").select("id", "path", "whole", F.explode(F.array_distinct(F.filter(F.flatten(F.array(*runs)), lambda x: x.rlike(header_heavy)))).alias("unit")).withColumn("terms", terms)
        # The fewest of a header's terms, heaviest first, that are as long as a similar unit's share of it must be.
        enough = F.lit(False)
        for v in vectors[len(templates) :]:
            need, total = 0, 0.0
            for w in sorted(v.values(), reverse=True):
                if total >= least * least:
                    break
                need, total = need + 1, total + w * w
            enough = enough | (F.size(F.array_intersect("terms", F.array(*[F.lit(t) for t in sorted(v)]))) >= need)
        units = units.unionByName(run.where(enough).withColumn("first", F.lit(len(templates))))
    units = units.select("id", "path", "whole", "first", F.xxhash64("unit", "first").alias("u"), "terms")
    single = units.select("id", "path", "whole", "first", "u", F.explode("terms").alias("term")).groupBy("id", "path", "whole", "first", "u", "term").agg(F.count(F.lit(1)).alias("tf"))
    weights = json.dumps([{"term": t, "idf": idf[t], "ws": [v.get(t, 0.0) for v in vectors]} for t in vocabulary])
    table = source.sparkSession.range(1).select(F.inline(F.from_json(F.lit(weights), "array<struct<term string, idf double, ws array<double>>>")))
    scored = single.join(F.broadcast(table), "term", "left").withColumn("w", F.col("tf") * F.coalesce("idf", F.lit(1.0)))  # a row for each term of the templates
    dots = [F.sum(F.col("w") * F.coalesce(F.col("ws")[i], F.lit(0.0))).alias(f"d{i}") for i in range(len(vectors))]
    cosines = scored.groupBy("id", "path", "whole", "first", "u").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("length"), *dots)
    # Runs of lines count for headers only.
    rows = F.array(*[F.when(F.col("first") <= i, ranked(0, F.round(F.col(f"d{i}") / F.col("length"), 9), i, F.lit(name))) for i, name in enumerate(names)])
    notices = cosines.select("id", "path", "whole", F.array_max(rows).alias("best")).where(F.col("best.score") >= least)
    matches = notices.unionByName(of_texts(files, least, allowed)).unionByName(of_tags(files, allowed))
    best = matches.groupBy("id", "path", "whole").agg(F.max("best").alias("best"))
    own = written(best.select("id", "path", "whole", F.col("best.name").alias("own_license"), F.col("best.score").alias("own_score")))

    given = own.where("whole and path is not null").groupBy(directory(F.col("path")).alias("above")).agg(F.min_by(F.struct("own_license", "path"), "path").alias("from"))
    directories = source.where("path is not null").select(directory(F.col("path")).alias("dir")).distinct()
    parts = F.split("dir", "/")
    above = F.when(F.col("dir") == "", F.array(F.lit(""))).otherwise(F.concat(F.array(F.lit("")), F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))))
    reached = directories.select("dir", F.explode(above).alias("above")).join(given, "above").groupBy("dir").agg(F.max_by("from", F.char_length("above")).alias("from"))
    every = source.select("id", "path", directory(F.col("path")).alias("dir"))
    found = every.join(own.select(F.col("id").alias("i"), F.col("path").alias("p"), "own_license", "own_score").hint("merge"), F.col("id").eqNullSafe(F.col("i")) & F.col("path").eqNullSafe(F.col("p")), "left").drop("i", "p")
    joined = found.join(written(reached).hint("merge"), "dir", "left")  # both grow with the input: never broadcast
    return joined.select(F.col("id").alias(id_col), "path", "own_license", "own_score", F.coalesce("own_license", "from.own_license").alias("license"), F.when(F.col("own_license").isNull(), F.col("from.path")).alias("inherited_from"))
