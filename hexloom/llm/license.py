"""License scans by sparse TF-IDF cosine and directory inheritance, in DataFrame operations only (operator 8).

Runs of terms become sparse TF-IDF vectors, held against the vectors of known statements, headers, licence texts and titles;
the best cosine names the licence. A run is a whole line, or as many terms as the statement has, laid at the word both share
('license', 'permission', ...): so a statement is found inside a longer line and across line ends. A run states a licence only
if it has the terms that tell it from others, as 'mit' or 'lesser': lines are joined to statements by one of these terms, every
line that has it, so nothing is passed over by a keyword of another kind. SPDX identifiers are read as they stand.
A path without a licence of its own takes that of the nearest directory above that has one: directories, not files, are joined
to their ancestors.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# fixed values: short statements and file headers of common licences
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
]
_GPL = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {} as published by the Free Software Foundation, either version {} of the License, or (at your option) any later version."
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_CC = "This work is licensed under a Creative Commons {} 4.0 International License."
#: Further statements, titles and whole texts: (licence, terms it needs, terms that none of the next FORWARD terms may be, text).
MORE = [
    ("AGPL-3.0", "affero 3", "", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("AGPL-3.0", "affero 3", "", _GPL.format("Affero General Public License", "3")),
    ("AGPL-3.0", "affero 3", "", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"),
    ("Apache-2.0", "apache 2", "", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION"),
    ("BSD-2-Clause", "bsd 2 clause", "", "Licensed under the BSD 2-Clause License."),
    ("BSD-2-Clause", "redistribution binary reproduce", "neither advertising", _BSD),
    ("BSD-3-Clause", "bsd 3 clause", "", "Licensed under the BSD 3-Clause License."),
    ("BSD-3-Clause", "redistribution binary reproduce neither", "", _BSD + " 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("BSL-1.0", "boost 1", "", "Distributed under the Boost Software License, Version 1.0."),
    ("CC-BY-NC-ND-4.0", "attribution noncommercial noderivatives 4", "", _CC.format("Attribution-NonCommercial-NoDerivatives")),
    ("CC-BY-NC-SA-4.0", "attribution noncommercial sharealike 4", "", _CC.format("Attribution-NonCommercial-ShareAlike")),
    ("CC-BY-ND-4.0", "attribution noderivatives 4", "", _CC.format("Attribution-NoDerivatives")),
    ("CC-BY-SA-4.0", "attribution sharealike 4", "", _CC.format("Attribution-ShareAlike")),
    ("GPL-2.0", "gnu general 2", "", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", "gnu general 2", "", _GPL.format("General Public License", "2")),
    ("GPL-2.0", "gnu general 2", "", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("GPL-3.0", "gnu general 3", "", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("ISC", "isc", "", "Released under the ISC License."),
    ("ISC", "permission fee", "", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("LGPL-2.1", "lesser 2 1", "", "This work is licensed under the GNU Lesser General Public License, version 2.1."),
    ("LGPL-2.1", "lesser 2 1", "", _GPL.format("Lesser General Public License", "2.1")),
    ("LGPL-2.1", "lesser 2 1", "", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999"),
    ("LGPL-3.0", "lesser 3", "", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("LGPL-3.0", "lesser 3", "", _GPL.format("Lesser General Public License", "3")),
    ("LGPL-3.0", "lesser 3", "", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("MIT", "mit", "", "Licensed under the MIT License."),
    ("MIT", "permission charge sublicense", "", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("MPL-2.0", "mozilla 2", "", "Mozilla Public License Version 2.0"),
    ("Unlicense", "unencumbered domain", "", "This is free and unencumbered software released into the public domain."),
    ("0BSD", "permission fee", "copyright", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES"),
    ("BSD-4-Clause", "redistribution binary advertising acknowledgement", "", _BSD + " 3. All advertising materials mentioning features or use of this software must display the following acknowledgement: This product includes software developed by the organization."),
    ("BSL-1.0", "permission charge boost", "", "Boost Software License - Version 1.0 - August 17th, 2003 Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software"),
    ("CC0-1.0", "cc0 1", "", "This work is licensed under CC0 1.0 Universal."),
    ("CC0-1.0", "waived copyright domain", "", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work, by a public domain dedication and license."),
    ("EPL-2.0", "eclipse 2", "", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0"),
    ("EUPL-1.2", "eupl 1 2", "", "Licensed under the EUPL, Version 1.2 or as soon they will be approved by the European Commission subsequent versions of the EUPL (the License)"),
    ("PostgreSQL", "permission fee agreement", "", "Permission to use, copy, modify, and distribute this software and its documentation for any purpose, without fee, and without a written agreement is hereby granted, provided that the above copyright notice and this paragraph and the following two paragraphs appear in all copies."),
    ("Zlib", "permission origin misrepresented", "", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software."),
]
#: The terms that TEMPLATES need; a sentence that two licences share names one only where none of its clauses follow.
NEEDS = ["apache 2", "apache 2", "redistribution binary", "attribution 4", "cc nc 4", "attribution noncommercial 4", "gnu general 3", "gnu general 3", "mit", "permission charge", "mozilla 2"]
AVOIDS = {2: "reproduce"}
ANCHOR = "^(licen[cs]e.*|permission|redistribution|unencumbered)$"
BACK, FORWARD = 48, 192
SPDX = r"(?i)spdx-license-identifier:[ \t]*([^\r\n]*)"
#: The parts of an SPDX expression that name nothing, and what stands behind a name.
JOINTS = ["and", "or", "none", "noassertion"]
SUFFIX = r"(?i)(-only|-or-later|\+)$"
EXCEPTION, NAME = r"(?i)\bwith\s+\S+", "^[A-Za-z][A-Za-z0-9.+-]*$"


def template_terms(templates: list[tuple[str, str]] = TEMPLATES) -> tuple[list[tuple[int, str, str, float, float]], float]:
    """(template, licence, term, idf, unit weight), and the idf of terms that no template has."""
    terms = [Counter(re.findall("[a-z0-9]+", text.lower())) for _, text in templates]
    n = len(terms)
    df = Counter(t for c in terms for t in c)
    idf = {t: math.log((1 + n) / (1 + d)) + 1 for t, d in df.items()}
    out = []
    for k, c in enumerate(terms):
        norm = math.sqrt(sum((v * idf[t]) ** 2 for t, v in c.items()))
        out += [(k, templates[k][0], t, idf[t], c[t] * idf[t] / norm) for t in sorted(c)]
    return out, math.log(1 + n) + 1


def statements() -> tuple[list[tuple], dict[str, float], float]:
    """(template, licence, key, needs, avoids, weights, length, anchors with their places) of all known statements, idf, idf of others.

    key: of the needs the one that fewest statements have (then the longest, the first by name).
    """
    every = [(lic, NEEDS[k], AVOIDS.get(k, ""), text) for k, (lic, text) in enumerate(TEMPLATES)] + MORE
    rows, unseen = template_terms([(lic, text) for lic, _, _, text in every])
    idf = {t: w for _, _, t, w, _ in rows}
    weights: list[dict[str, float]] = [{} for _ in every]
    for k, _, t, _, w in rows:
        weights[k][t] = w
    out = []
    for k, (lic, needs, avoids, text) in enumerate(every):
        terms = re.findall("[a-z0-9]+", text.lower())
        key = min(needs.split(), key=lambda t: (-idf[t], -len(t), t))
        out.append((k, lic, key, needs.split(), avoids.split(), weights[k], len(terms), [(t, i) for i, t in enumerate(terms) if re.match(ANCHOR, t)]))
    return out, idf, unseen


def _terms(text: str) -> F.Column:
    return F.expr(f"regexp_extract_all(lower({text}), '[a-z0-9]+', 0)")


def text_key(text: str = "text") -> F.Column:
    """Tells texts of one path apart."""
    return F.md5(F.coalesce(F.col(text), F.lit("")))


def scan(files: DataFrame, least: float = 0.5) -> DataFrame:
    """(path, text_key, own_license, own_score) of the files whose text states a licence: the best cosine of its runs of terms, rounded to
    six decimals, or 1 for an SPDX identifier (without '-only' and '-or-later'); ties go to the licence that comes first by name.

    A file is a path and a text: rows of one path with different texts are files of their own, repeated rows are one. Null and
    empty texts state nothing. A text of any length is scanned whole.
    """
    spark: SparkSession = files.sparkSession
    known, idf, unseen = statements()
    table = spark.createDataFrame(known, "template int, license string, key string, needs array<string>, avoids array<string>, weights map<string,double>, length int, anchors array<struct<term:string,place:int>>")
    idf = F.create_map(*[F.lit(x) for t in idf.items() for x in t])
    own = files.select(F.struct("path", text_key().alias("text_key")).alias("file"), F.col("text").alias("text"))

    # the surroundings of every word that a statement can be laid at
    words = own.where(F.lower("text").rlike(ANCHOR[1:-1])).select("file", _terms("text").alias("terms"))
    around = lambda t, i: F.when(t.rlike(ANCHOR), F.struct(t.alias("term"), F.least(i, F.lit(BACK)).alias("at"), F.greatest(i - BACK, F.lit(0)).alias("start")))
    spots = F.filter(F.transform("terms", around), lambda s: s.isNotNull())
    near = words.select("file", F.explode(F.transform(spots, lambda s: F.struct(s["term"].alias("term"), s["at"].alias("at"), F.slice("terms", s["start"] + 1, BACK + FORWARD).alias("near")))).alias("s")).select("file", "s.*")
    laid = table.select("license", "needs", "avoids", "weights", "length", F.inline("anchors"))
    run = F.slice("near", F.greatest(F.col("at") - F.col("place"), F.lit(0)) + 1, F.col("length"))
    ahead = F.slice("near", F.col("at") + 1, F.lit(FORWARD))
    inside = near.join(F.broadcast(laid), "term").where(~F.arrays_overlap(ahead, "avoids")).select("file", "license", "needs", "weights", run.alias("run"))

    keys = F.array(*[F.lit(k) for k in sorted({k[2] for k in known})])
    lines = own.select("file", F.explode(F.split("text", "\n")).alias("said")).select("file", _terms("said").alias("run"))
    lines = lines.withColumn("keys", F.array_intersect("run", keys)).where(F.size("keys") > 0).select("file", "run", F.explode("keys").alias("key"))
    whole = lines.join(F.broadcast(table.where(F.size("avoids") == 0)), "key").select("file", "license", "needs", "weights", "run")

    runs = inside.unionAll(whole).where(F.size(F.array_except("needs", "run")) == 0)
    tf = F.transform(F.array_distinct("run"), lambda t: F.struct(F.coalesce(F.element_at("weights", t), F.lit(0.0)).alias("w"), (F.size(F.filter("run", lambda x: x == t)) * F.coalesce(F.element_at(idf, t), F.lit(unseen))).alias("v")))
    total = lambda f: F.aggregate("tf", F.lit(0.0), lambda acc, x: acc + f(x))
    score = F.round(total(lambda x: x["v"] * x["w"]) / F.sqrt(total(lambda x: x["v"] * x["v"])), 6)
    scored = runs.withColumn("tf", tf).select("file", "license", score.alias("c")).where(F.col("c") >= least)

    # SPDX expressions: every identifier but those of exceptions
    names = {lic.lower(): lic for _, lic, *_ in known}
    names = F.create_map(*[F.lit(x) for n in names.items() for x in n])
    stated = own.select("file", F.explode(F.regexp_extract_all("text", F.lit(SPDX), F.lit(1))).alias("said"))
    parts = F.split(F.regexp_replace("said", EXCEPTION, ""), r"[ \t()]+")
    stated = stated.select("file", F.explode(parts).alias("id")).where(F.col("id").rlike(NAME) & ~F.lower("id").isin(JOINTS))
    bare = F.regexp_replace("id", SUFFIX, "")
    spdx = stated.select("file", F.coalesce(F.element_at(names, F.lower(bare)), bare).alias("license"), F.lit(1.0).alias("c"))

    best = scored.unionAll(spdx).groupBy("file").agg(F.min(F.struct((-F.col("c")).alias("c"), "license")).alias("b"))
    return best.select("file.path", "file.text_key", F.col("b.license").alias("own_license"), (-F.col("b.c")).alias("own_score"))


def _directory(path: str = "path") -> F.Column:
    return F.regexp_replace(path, "/?[^/]*$", "")


def inherit(files: DataFrame, own: DataFrame) -> DataFrame:
    """``files`` (path, text_key, ...) with own_license, own_score, license and from_path (the directory it comes from, or the path).

    A directory's licence is that of its best statement (ties: the smallest path, then the licence's name). The top directory, named by the empty
    string, counts. Files are joined to directories once; a directory of a third of all files is split by Spark's skew join.
    """
    at = own.withColumn("dir", _directory())
    stated = at.groupBy("dir").agg(F.min(F.struct((-F.col("own_score")).alias("s"), "path", "own_license")).alias("b")).select("dir", F.col("b.own_license").alias("license"))
    f = files.withColumn("dir", _directory())
    dirs = f.select("dir").distinct()
    steps = F.split("dir", "/")
    ups = F.transform(F.sequence(F.lit(0), F.when(F.col("dir") == "", 0).otherwise(F.size(steps))), lambda k: F.array_join(F.slice(steps, 1, k), "/"))
    above = dirs.select("dir", F.posexplode(F.array_distinct(ups)).alias("depth", "up"))
    near = above.join(stated.withColumnRenamed("dir", "up"), "up").groupBy("dir").agg(F.max(F.struct("depth", "up", "license")).alias("n"))
    near = near.select("dir", F.col("n.up").alias("up"), F.col("n.license").alias("near_license"))
    out = f.join(own, ["path", "text_key"], "left").join(near, "dir", "left")
    return out.withColumn("license", F.coalesce("own_license", "near_license")).withColumn("from_path", F.when(F.col("own_license").isNotNull(), F.col("path")).otherwise(F.col("up"))).drop("dir", "up", "near_license", "text_key")


def scan_documents(docs: DataFrame) -> DataFrame:
    """(doc_id, path, own_license, own_score, license, from_path) of every row.

    The table has no paths, so one is made: source / thousands of ids / fifties of ids / id. Null sources and ids are
    named 'none'. Texts that come to one path (null or repeated ids) are files of their own. Null and empty texts state nothing but
    inherit. Repeated rows share their path and result. Very long texts are scanned whole. An empty table gives an empty
    table; other columns are not read.
    """
    doc = F.col("doc_id")
    path = F.concat_ws("/", F.coalesce("source", F.lit("none")), F.coalesce(F.floor(doc / 1000).cast("string"), F.lit("none")), F.coalesce(F.floor(doc / 50).cast("string"), F.lit("none")), F.coalesce(doc.cast("string"), F.lit("none")))
    own = docs.select("doc_id", path.alias("path"), "text")
    return inherit(own.select("doc_id", "path", text_key().alias("text_key")), scan(own)).select("doc_id", "path", "own_license", "own_score", "license", "from_path")


def _sql() -> str:
    """The same scan by brute force: every run of terms, one row a term."""
    known, idf, unseen = statements()
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    listed = lambda xs: "[" + ", ".join(map(quoted, xs)) + "]::VARCHAR[]"
    templates = ", ".join(f"({k}, {quoted(lic)}, {listed(needs)}, {listed(avoids)}, {n})" for k, lic, _, needs, avoids, _, n, _ in known)
    weights = ", ".join(f"({k}, {quoted(t)}, {w!r}::DOUBLE)" for k, *_, of, _, _ in known for t, w in of.items())
    anchors = ", ".join(f"({k}, {quoted(t)}, {i})" for k, *_, places in known for t, i in places)
    idfs = ", ".join(f"({quoted(t)}, {w!r}::DOUBLE)" for t, w in idf.items())
    names = ", ".join(f"({quoted(n.lower())}, {quoted(n)})" for n in sorted({k[1] for k in known}))
    return f"""
WITH template(template, license, needs, avoids, length) AS (VALUES {templates}), weight(template, term, w) AS (VALUES {weights}),
anchor(template, term, place) AS (VALUES {anchors}), idf(term, idf) AS (VALUES {idfs}), named(low, name) AS (VALUES {names}),
files AS (SELECT doc_id, text, md5(coalesce(text, '')) AS text_key, concat_ws('/', coalesce(source, 'none'), coalesce((doc_id // 1000)::VARCHAR, 'none'), coalesce((doc_id // 50)::VARCHAR, 'none'), coalesce(doc_id::VARCHAR, 'none')) AS path FROM documents),
file AS (SELECT DISTINCT path, text_key, text FROM files),
words AS (SELECT path, text_key, regexp_extract_all(lower(text), '[a-z0-9]+') AS terms FROM file),
spots AS (SELECT path, text_key, terms, unnest(terms) AS term, generate_subscripts(terms, 1) AS i FROM words),
laid AS (
  SELECT path, text_key, template, license, needs, list_slice(terms, greatest(i - place, greatest(i - {BACK}, 1)), greatest(i - place, greatest(i - {BACK}, 1)) + length - 1) AS run
  FROM spots JOIN anchor USING (term) JOIN template USING (template)
  WHERE NOT list_has_any(list_slice(terms, i, i + {FORWARD} - 1), avoids)),
lines AS (SELECT path, text_key, regexp_extract_all(lower(said), '[a-z0-9]+') AS run FROM (SELECT path, text_key, unnest(string_split(text, chr(10))) AS said FROM file)),
held AS (SELECT path, text_key, template, license, needs, run FROM lines JOIN template ON len(avoids) = 0 AND list_has_all(run, needs) UNION ALL SELECT * FROM laid WHERE list_has_all(run, needs)),
runs AS (SELECT row_number() OVER () AS k, * FROM held),
tf AS (SELECT k, any_value(path) AS path, any_value(text_key) AS text_key, any_value(template) AS template, any_value(license) AS license, term, count(*) AS n FROM (SELECT *, unnest(run) AS term FROM runs) GROUP BY k, term),
cosine AS (
  SELECT path, text_key, license, round(sum(n * coalesce(idf, {unseen!r}) * coalesce(w, 0)) / sqrt(sum(n * coalesce(idf, {unseen!r}) * n * coalesce(idf, {unseen!r}))), 6) AS c
  FROM tf LEFT JOIN idf USING (term) LEFT JOIN weight USING (template, term) GROUP BY k, path, text_key, license),
said AS (SELECT path, text_key, unnest(regexp_extract_all(text, '(?i)spdx-license-identifier:[ \\t]*([^\\r\\n]*)', 1)) AS said FROM file),
ids AS (SELECT path, text_key, unnest(regexp_split_to_array(regexp_replace(said, '(?i)\\bwith\\s+\\S+', '', 'g'), '[ \\t()]+')) AS id FROM said),
spdx AS (
  SELECT path, text_key, coalesce(name, bare) AS license, 1.0::DOUBLE AS c
  FROM (SELECT path, text_key, regexp_replace(id, '(?i)(-only|-or-later|\\+)$', '') AS bare FROM ids WHERE regexp_matches(id, '{NAME}') AND lower(id) NOT IN ('and', 'or', 'none', 'noassertion'))
  LEFT JOIN named ON low = lower(bare)),
own AS (SELECT path, text_key, license AS own_license, c AS own_score FROM (FROM cosine WHERE c >= 0.5 UNION ALL FROM spdx) QUALIFY row_number() OVER (PARTITION BY path, text_key ORDER BY c DESC, license) = 1),
stated AS (SELECT regexp_replace(path, '/?[^/]*$', '') AS up, own_license AS license FROM own QUALIFY row_number() OVER (PARTITION BY regexp_replace(path, '/?[^/]*$', '') ORDER BY own_score DESC, path, own_license) = 1),
f AS (SELECT doc_id, path, text_key, regexp_replace(path, '/?[^/]*$', '') AS dir FROM files),
near AS (SELECT dir, up, license FROM (SELECT DISTINCT dir FROM f) JOIN stated ON up = '' OR dir = up OR starts_with(dir, up || '/') QUALIFY row_number() OVER (PARTITION BY dir ORDER BY length(up) DESC) = 1)
SELECT doc_id, f.path, own_license, own_score, coalesce(own_license, near.license) AS license, CASE WHEN own_license IS NOT NULL THEN f.path ELSE near.up END AS from_path
FROM f LEFT JOIN own ON f.path = own.path AND f.text_key = own.text_key LEFT JOIN near ON f.dir = near.dir
"""


SQL = _sql()
