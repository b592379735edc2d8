"""License scans by sparse TF-IDF cosine and directory inheritance (operator 2; DataFrame operations only).

Headers are found in any file: windows of words as long as a template, laid wherever a telling word of it stands, so
line ends, markup and surrounding prose don't matter. Licence files, those named LICENSE or COPYING, are compared as a
whole as well. The cosine of the sparse TF-IDF vectors of a window and its template decides; term weights are integers
(thousandths), so every sum is exact and a score is one root and one division. A file's own licence is that of its
best part, if its score is high enough and two words are shared that are not of any prose (COMMON).

Telling words are such that a window which reaches the score has one; a window that shares fewer terms than the score
needs is passed over before it is scored. Windows live and die within the row of their text: nothing is exploded or
shuffled but the parts that reach the score.

A file is a licence file if its name says so or if its licence windows cover at least half of its words. It speaks for
its directory and all below that have no nearer one. Inheritance is resolved once per directory, by a join of all
ancestors of each directory with the directories of licence files; the deepest match wins; then files join by
directory. Both tables are written first, so Spark broadcasts them only under its size threshold and otherwise splits
hot directories.

Defined results: null texts and paths have no licence of their own; a null path inherits nothing. Ties of score go to
the licence that comes first by name, several licence files in one directory to the smallest path. Rows that repeat a
path are one file, with the best part of any. Empty tables give empty results, empty texts no licence. Long texts are
whole. Columns of the input with the names of the results give way.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored, table

#: Public licence headers and first lines of licence texts.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License."),
    ("Apache-2.0", "Apache License Version 2.0, January 2004"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
]
#: SPDX identifiers, told by the line "SPDX-License-Identifier: X"; X-only and X-or-later count as X.
SPDX = [
    "0BSD", "AGPL-3.0", "Apache-2.0", "Artistic-2.0", "BSD-2-Clause", "BSD-3-Clause", "BSL-1.0", "CC-BY-4.0", "CC-BY-NC-4.0", "CC-BY-NC-SA-4.0", "CC-BY-SA-4.0", "CC0-1.0", "EPL-2.0", "EUPL-1.2",
    "GPL-2.0", "GPL-3.0", "ISC", "LGPL-2.1", "LGPL-3.0", "MIT", "MPL-2.0", "Unlicense", "WTFPL", "Zlib",
]
#: More headers, titles and first sentences of common licences.
MORE = [
    ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License"),
    ("Artistic-2.0", "The Artistic License 2.0 Copyright (c) 2000-2006, The Perl Foundation."),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0."),
    ("BSL-1.0", "Boost Software License - Version 1.0 - August 17th, 2003"),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-SA-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License."),
    ("CC0-1.0", "Creative Commons Legal Code CC0 1.0 Universal"),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0"),
    ("EPL-2.0", "Eclipse Public License - v 2.0"),
    ("EUPL-1.2", "Licensed under the European Union Public Licence v. 1.2"),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License"),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("LGPL-2.1", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999"),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License"),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("LGPL-3.0", "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License"),
    ("MIT", "The MIT License (MIT)"),
    ("MIT", "MIT License Copyright (c)"),
    ("MIT", "Licensed under the MIT License."),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("WTFPL", "DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE Version 2, December 2004"),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software."),
]
EVERY = TEMPLATES + MORE + [(x, f"SPDX-License-Identifier: {x}") for x in SPDX]
TERM = "[A-Za-z0-9]+"
#: Names of licence files.
NAMED = "^(LICEN[CS]E|COPYING)"
#: Words of any prose; a part must share two others with a template.
COMMON = set("a an and any are as at be by can do for from if in into is it may no not of on one or that the this to was what will with without you".split())
LEAST_SCORE = 0.6
RESULTS = ["own_license", "own_score", "license", "inherited_from"]


def vectors(templates: list[tuple[str, str]] = EVERY) -> tuple[list[tuple[int, str, str, int, int]], int]:
    """(template, licence, term, weight, squared norm) of the templates' terms, and the idf of a term of none."""
    bags = [Counter(w.lower() for w in re.findall(TERM, text)) for _, text in templates]
    df = Counter(w for bag in bags for w in bag)
    idf = lambda n: round(1000 * (1 + math.log((1 + len(bags)) / (1 + n))))
    rows = []
    for i, bag in enumerate(bags):
        weight = {w: n * idf(df[w]) for w, n in sorted(bag.items())}
        norm = sum(x * x for x in weight.values())
        rows += [(i, templates[i][0], w, x, norm) for w, x in weight.items()]
    return rows, idf(0)


def _idf(templates: list[tuple[str, str]]) -> list[tuple[str, int]]:
    rows, _ = vectors(templates)
    count = {(i, w.lower()): 0 for i, (_, text) in enumerate(templates) for w in re.findall(TERM, text)}
    for i, (_, text) in enumerate(templates):
        for w in re.findall(TERM, text):
            count[i, w.lower()] += 1
    return sorted({(w, x // count[i, w]) for i, _, w, x, _ in rows})


def needs(templates: list[tuple[str, str]], least: float) -> list[tuple[list[str], int, list[str]]]:
    """Of each template its terms, how many of them a part must share to reach the score, and telling terms, of which one is shared then, unless only COMMON words are.

    A part's cosine is at most the share of the template's norm that lies in the shared terms.
    """
    weights: dict[int, dict[str, int]] = {}
    for i, _, term, weight, _ in vectors(templates)[0]:
        weights.setdefault(i, {})[term] = weight * weight
    idf, out = dict(_idf(templates)), []
    for bag in weights.values():
        total = sum(bag.values())
        count = next(n for n in range(1, len(bag) + 1) if sum(sorted(bag.values(), reverse=True)[:n]) >= 0.999 * least * least * total)
        telling, rest = [], total
        for term in sorted(set(bag) - COMMON, key=lambda w: (-idf[w], w)):
            if rest < 0.999 * least * least * total:
                break
            telling.append(term)
            rest -= bag[term]
        out.append((sorted(bag), count, telling))
    return out


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_of(text: str):
    return F.regexp_extract_all(F.translate(text, UPPER, LOWER), F.lit("[a-z0-9]+"), F.lit(0))


def let(value, then):
    """`then` of a value that is computed once."""
    return F.transform(F.array(value), then)[0]


def listed(values):
    return F.array(*(F.lit(x) for x in values))


def spots_of(templates: list[tuple[str, str]], least: float) -> list[tuple[str, int, int, int]]:
    """(telling word, template, its place there, words of the template)."""
    out = []
    for t, ((_, text), (_, _, telling)) in enumerate(zip(templates, needs(templates, least), strict=True)):
        bag = [w.lower() for w in re.findall(TERM, text)]
        out += [(w, t, i, len(bag)) for i, w in enumerate(bag) if w in telling]
    return out


def headers(files: DataFrame, templates: list[tuple[str, str]], least: float) -> DataFrame:
    """(path, score, license, covered, size) of (path, text): the best window; covered and all words of the text."""
    rows, other = vectors(templates)
    spots, found = spots_of(templates, least), needs(templates, least)
    laid = F.create_map(*(x for term in sorted({w for w, *_ in spots}) for x in (F.lit(term), F.array(*(F.struct(F.lit(t).alias("t"), F.lit(i).alias("i"), F.lit(n).alias("n")) for w, t, i, n in spots if w == term)))))
    idf = F.create_map(*(F.lit(x) for pair in _idf(templates) for x in pair))
    of = [{w: x for i, _, w, x, _ in rows if i == t} for t in range(len(templates))]
    norms = {i: norm for i, _, _, _, norm in rows}
    about = F.array(*(F.struct(F.lit(name).alias("license"), listed(terms).alias("terms"), F.lit(count).alias("count"), F.create_map(*(F.lit(x) for w in sorted(bag) for x in (w, bag[w]))).alias("weights"), F.lit(norms[t]).cast("long").alias("norm")) for t, ((name, _), (terms, count, _), bag) in enumerate(zip(templates, found, of, strict=True))))
    zero = F.lit(0).cast("long")
    telling = sorted({w for w, *_ in spots})

    def place(p, s):
        start = F.greatest(p["at"] - s["i"], F.lit(0))
        return F.struct(s["t"].alias("t"), start.alias("start"), (p["at"] - s["i"] + s["n"] - start).alias("n"))

    def sums(w, t):
        def add(acc, term):
            return let(F.struct((F.size(F.filter(w, lambda x: x == term)) * F.coalesce(F.try_element_at(idf, term), F.lit(other))).cast("long").alias("w"), F.try_element_at(t["weights"], term).cast("long").alias("x")), lambda v: F.struct((acc["line"] + v["w"] * v["w"]).alias("line"), (acc["dot"] + v["w"] * F.coalesce(v["x"], zero)).alias("dot"), (acc["own"] + F.when(v["x"].isNotNull() & ~term.isin(sorted(COMMON)), 1).otherwise(0)).alias("own")))

        return F.aggregate(F.array_distinct(w), F.struct(zero.alias("line"), zero.alias("dot"), F.lit(0).alias("own")), add)

    def judged(ws, c):
        return let(F.struct(F.slice(ws, c["start"] + 1, c["n"]).alias("w"), about[c["t"]].alias("t")), lambda x: F.when(F.size(F.array_intersect(x["w"], x["t"]["terms"])) >= x["t"]["count"], let(sums(x["w"], x["t"]), lambda v: F.struct(F.when(v["own"] >= 2, v["dot"] / F.sqrt(v["line"].cast("double") * x["t"]["norm"].cast("double"))).alias("score"), x["t"]["license"].alias("license"), c["start"].alias("start"), F.size(x["w"]).alias("n")))))

    def windows(ws):
        hits = F.filter(F.transform(ws, lambda w, at: F.when(w.isin(telling), F.struct(w.alias("w"), at.alias("at")))), lambda h: h.isNotNull())
        # A window that two telling words lay stands twice; that changes neither the best score nor the words covered.
        places = F.flatten(F.transform(hits, lambda p: F.transform(F.try_element_at(laid, p["w"]), lambda s: place(p, s))))
        return F.struct(F.filter(F.transform(places, lambda c: judged(ws, c)), lambda g: g["score"] >= least).alias("good"), F.size(ws).alias("size"))

    known = files.where(F.col("path").isNotNull() & F.col("text").isNotNull())
    scored = known.select("path", let(words_of("text"), windows).alias("x")).where(F.size("x.good") > 0)
    best = F.array_min(F.transform("x.good", lambda g: F.struct((-g["score"]).alias("minus"), g["license"].alias("license"))))
    covered = F.size(F.array_distinct(F.flatten(F.transform("x.good", lambda g: F.sequence(g["start"], g["start"] + g["n"] - 1)))))
    return scored.select("path", (-best["minus"]).alias("score"), best["license"].alias("license"), covered.alias("covered"), F.col("x.size").alias("size"))


def whole_files(files: DataFrame, templates: list[tuple[str, str]], least: float) -> DataFrame:
    """(path, score, license, covered, size): named licence files as a whole, by joins of their terms."""
    spark = files.sparkSession
    rows, other = vectors(templates)
    terms = F.broadcast(spark.createDataFrame(rows, "template int, license string, term string, weight long, norm long"))  # the templates, a fixed list
    idf = F.broadcast(spark.createDataFrame(_idf(templates), "term string, idf long"))
    named = files.where(F.regexp_extract("path", "[^/]*$", 0).rlike(NAMED) & F.col("text").isNotNull())
    words = named.select("path", F.xxhash64("text").alias("part"), F.explode(words_of("text")).alias("term"))
    counts = words.groupBy("path", "part", "term").agg(F.count("*").alias("tf")).join(idf, "term", "left").withColumn("w", F.col("tf") * F.coalesce("idf", F.lit(other)))
    norms = counts.groupBy("path", "part").agg(F.sum(F.col("w") * F.col("w")).alias("line"), F.sum("tf").cast("int").alias("size"))
    dots = counts.join(terms, "term").groupBy("path", "part", "template", "license", "norm").agg(F.sum(F.col("w") * F.col("weight")).alias("dot"), F.count_if(~F.col("term").isin(sorted(COMMON))).alias("own")).where("own >= 2")
    scored = dots.join(norms, ["path", "part"]).withColumn("score", F.col("dot") / F.sqrt(F.col("line").cast("double") * F.col("norm").cast("double")))
    return scored.where(F.col("score") >= least).select("path", "score", "license", F.col("size").alias("covered"), "size")


def own_licenses(files: DataFrame, *, path: str = "path", text: str = "text", templates: list[tuple[str, str]] = EVERY, least: float = LEAST_SCORE) -> DataFrame:
    """(path, own_license, own_score, is_file) of the files whose best part reaches the score."""
    read = files.select(F.col(path).alias("path"), F.col(text).alias("text"))
    parts = headers(read, templates, least).unionByName(whole_files(read, templates, least))
    found = parts.groupBy("path").agg(F.min(F.struct((-F.col("score")).alias("minus"), F.col("license").alias("license"))).alias("best"), F.max(2 * F.col("covered") >= F.col("size")).alias("half"))
    named = F.regexp_extract("path", "[^/]*$", 0).rlike(NAMED)
    return found.select("path", F.col("best.license").alias("own_license"), (-F.col("best.minus")).alias("own_score"), (named | F.col("half")).alias("is_file"))


def directory(path: str):
    """All before the last slash; the empty text for the root."""
    return F.regexp_replace(path, "/?[^/]*$", "")


def scan(files: DataFrame, *, path: str = "path", text: str = "text", keep: list[str] | None = None, templates: list[tuple[str, str]] = EVERY, least: float = LEAST_SCORE) -> DataFrame:
    """The columns `keep` of files (default: all) with RESULTS: the licence of each file, its own or an inherited one."""
    keep = [c for c in (keep or files.columns) if c not in RESULTS]
    own = stored(own_licenses(files, path=path, text=text, templates=templates, least=least), "license-own")
    marked = own.where("is_file").select(directory("path").alias("at"), "path", "own_license")
    speaks = stored(marked.groupBy("at").agg(F.min(F.struct("path", "own_license"))["own_license"].alias("license")), "license-directories")
    places = files.where(F.col(path).isNotNull()).select(directory(path).alias("dir")).distinct()
    parts = F.split("dir", "/")
    above = F.when(F.col("dir") == "", F.array(F.lit(""))).otherwise(F.concat(F.array(F.lit("")), F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))))
    climbed = places.select("dir", F.explode(above).alias("at")).join(speaks, "at")
    resolved = stored(climbed.groupBy("dir").agg(F.max(F.struct(F.length("at").alias("depth"), "at", "license")).alias("x")).select("dir", F.col("x.at").alias("inherited_from"), F.col("x.license").alias("inherited")), "license-resolved")
    f = files.select(*(F.col(c).alias(f"k_{c}") for c in keep), F.col(path).alias("f_path"), directory(path).alias("f_dir"))
    joined = f.join(own.drop("is_file"), F.col("f_path") == F.col("path"), "left").join(resolved, F.col("f_dir") == F.col("dir"), "left")
    mine = F.col("own_license").isNotNull()
    return joined.select(*(F.col(f"k_{c}").alias(c) for c in keep), "own_license", "own_score", F.coalesce("own_license", "inherited").alias("license"), F.when(~mine, F.col("inherited_from")).alias("inherited_from"))


#: The documents as files: a source is a repository, with directories of two levels by id.
PATH = "concat(source, '/', cast(doc_id div 100 % 10 as string), '/', cast(doc_id div 20 % 5 as string), '/', cast(doc_id as string), '.txt')"


def op2_licenses(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.expr(PATH).alias("path"))
    return scan(docs, keep=["doc_id", "path"])


def _values() -> dict[str, str]:
    rows, other = vectors()
    quote = lambda x: f"'{x}'" if isinstance(x, str) else str(x)
    said = lambda rows: ", ".join("(" + ", ".join(map(quote, r)) + ")" for r in rows)
    return {"terms": said(rows), "idf": said(_idf(EVERY)), "spots": said(spots_of(EVERY, LEAST_SCORE)), "common": ", ".join(quote(w) for w in sorted(COMMON)), "other": str(other), "least": str(LEAST_SCORE), "upper": UPPER, "lower": LOWER}


OP2_SQL = r"""
WITH terms(template, license, term, weight, norm) AS (VALUES {terms}), idf(term, idf) AS (VALUES {idf}), spots(term, template, place, n) AS (VALUES {spots}), files AS (
  SELECT text, concat_ws('/', source, CAST(doc_id // 100 % 10 AS VARCHAR), CAST(doc_id // 20 % 5 AS VARCHAR), CAST(doc_id AS VARCHAR) || '.txt') AS path, doc_id FROM documents
), tokens AS (
  SELECT path, regexp_extract_all(translate(text, '{upper}', '{lower}'), '[a-z0-9]+') AS words FROM files WHERE text IS NOT NULL
), spread AS (
  SELECT path, unnest(words) AS term, generate_subscripts(words, 1) - 1 AS pos FROM tokens
), placed AS (
  SELECT DISTINCT path, template, greatest(pos - place, 0) AS start, pos - place + n AS stop FROM spread JOIN spots USING (term)
), windows AS (
  SELECT path, template, start, len(words) AS size, list_slice(words, start + 1, stop) AS w FROM placed JOIN tokens USING (path)
), counts AS (
  SELECT path, template, start, size, len(w) AS n, term, count(*) AS tf FROM (SELECT *, unnest(w) AS term FROM windows) GROUP BY ALL
), weighed AS (
  SELECT c.*, tf * coalesce(idf, {other}) AS w, weight FROM counts c LEFT JOIN idf i ON c.term = i.term LEFT JOIN terms t ON c.template = t.template AND c.term = t.term
), summed AS (
  SELECT path, template, start, size, n, sum(w * w) AS line, sum(w * coalesce(weight, 0)) AS dot, count(*) FILTER (weight IS NOT NULL AND term NOT IN ({common})) AS own
  FROM weighed GROUP BY ALL
), good AS (
  SELECT path, start, size, n, license, CAST(dot AS DOUBLE) / sqrt(CAST(line AS DOUBLE) * CAST(norm AS DOUBLE)) AS score
  FROM summed JOIN (SELECT DISTINCT template, license, norm FROM terms) USING (template) WHERE own >= 2
), best AS (SELECT * FROM good WHERE score >= {least}
), covered AS (
  SELECT path, count(DISTINCT pos) AS covered FROM (SELECT path, unnest(range(start, start + n)) AS pos FROM best) GROUP BY path
), own AS (
  SELECT path, arg_min(license, (-score, license)) AS own_license, max(score) AS own_score, 2 * any_value(covered) >= any_value(size) AS is_file
  FROM best JOIN covered USING (path) GROUP BY path
), speaks AS (
  SELECT regexp_replace(path, '/?[^/]*$', '') AS "at", arg_min(own_license, path) AS license FROM own WHERE is_file GROUP BY 1
), located AS (
  SELECT doc_id, path, regexp_replace(path, '/?[^/]*$', '') AS dir FROM files
), resolved AS (
  SELECT dir, arg_max("at", length("at")) AS inherited_from, arg_max(license, length("at")) AS inherited
  FROM (SELECT DISTINCT dir FROM located) d JOIN speaks s ON s."at" = '' OR d.dir = s."at" OR starts_with(d.dir, s."at" || '/') GROUP BY dir
)
SELECT p.doc_id, p.path, o.own_license, o.own_score, coalesce(o.own_license, r.inherited) AS license,
       CASE WHEN o.own_license IS NULL THEN r.inherited_from END AS inherited_from
FROM located p LEFT JOIN own o ON p.path = o.path LEFT JOIN resolved r ON p.dir = r.dir
"""
for _name, _value in _values().items():
    OP2_SQL = OP2_SQL.replace("{" + _name + "}", _value)
