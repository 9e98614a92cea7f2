"""Licence scans (operator 6), DataFrame functions only.

Passages are the lines and blocks of a file that speak of a licence (KEYWORDS), and all
lines and blocks of a licence file. Blocks are neighbouring lines without a blank line between them, the comment
lines that a file begins with, and a licence file as a whole; comment marks are no part of them. So a notice
that is broken into lines, or a title and its version, are compared in one piece. With ``blocks=False``, lines alone are compared. A passage's terms, weighted by TF-IDF, are compared
with each template's by cosine; document frequencies count all passages.
The best template of a file's best passage is its own licence if the cosine is at
least ``least``. A file without one inherits that of the nearest directory
above it, its own first, that has a licence file with one.

Only passages are exploded to terms; templates are a fixed short list. Inheritance is solved once
for each directory: its ancestors are joined with the directories that have a
licence, and the deepest wins. Files of one directory, however many,
look up one row.

Null texts have no passages; a null path is in no directory and inherits
nothing. Equal scores go to the first licence by name; of several licence files in a
directory, the best score counts, then the first path. Files that repeat are each reported. Very long files are
read whole. Columns of files may have any names and come back, but for those that the scan makes. An empty table gives none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cuelake.llm.common import materialize, sheltered

LEAST = 0.5
KEYWORDS = r"(?i)licen[sc]e|copyright|spdx-|public domain|all rights reserved|permission is hereby granted|redistribution and use"
LICENSE_FILE = r"(?i)^(un)?licen[sc]e|^copying|^notice"
TERM = r"[a-z0-9]+(?:[.-][0-9]+)*"
#: Files or directories with a licence that are sent to all tasks; more are joined by shuffle.
LISTED = 500_000

#: Public licence names and their usual notices.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "To the extent possible under law, all copyright and related rights are waived; this work is dedicated to the public domain under CC0 1.0."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License, version 2."),
    ("GPL-2.0", "SPDX-License-Identifier: GPL-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License, version 3."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0"),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("proprietary", "Copyright. All rights reserved."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
]

#: Titles as licence files have them, a line or two; compared besides TEMPLATES where blocks are.
TITLES = [
    ("Apache-2.0", "Apache License Version 2.0, January 2004"),
    ("GPL-2.0", "GNU General Public License Version 2, June 1991"),
    ("GPL-3.0", "GNU General Public License Version 3, 29 June 2007"),
    ("LGPL-3.0", "GNU Lesser General Public License Version 3, 29 June 2007"),
    ("MIT", "MIT License"),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
]
NOTICES = TEMPLATES + TITLES

#: A comment's marks before a line and after it.
MARK = r"^\s*(?://+!?|/?\*+!?|#+!?|;+|%+|--+|<!--+|\"\"\"|'''|(?i:rem|dnl)\s)"
BARE = MARK + r"?[\s*/#=-]*|[\s*/#=-]*(?:--+>)?\s*$"


def _terms(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(f"({TERM})"), F.lit(1))


def template_terms(spark: SparkSession, templates: list[tuple[str, str]] = NOTICES) -> DataFrame:
    """license, template (its number), term, tf."""
    rows = spark.createDataFrame([(k, name, text) for k, (name, text) in enumerate(templates)], "template int, license string, text string")
    return rows.select("template", "license", F.explode(_terms(F.col("text"))).alias("term")).groupBy("template", "license", "term").agg(F.count("*").alias("tf"))


def passages_of(text: Column, is_license: Column) -> Column:
    """A text's lines and blocks, without comment marks, that speak of a licence, or all of a licence file's."""
    raw = F.split(text, "\n")
    bare = lambda rows: F.transform(rows, lambda x: F.regexp_replace(x, BARE, ""))
    plain = bare(raw)
    code = F.array_position(F.transform(raw, lambda x: x.rlike(MARK) | x.rlike(r"^\s*$")), False)  # of the first line that is no comment; 0: none
    header = F.array_join(bare(F.when(code > 0, F.slice(raw, F.lit(1), (code - 1).cast("int"))).otherwise(raw)), "\n")
    whole = F.array_join(plain, "\n")
    every = F.concat(plain, F.split(whole, r"\n{2,}"), F.array(header), F.when(is_license, F.array(whole)).otherwise(F.array().cast("array<string>")))
    return F.when(is_license | text.rlike(KEYWORDS), F.filter(every, lambda x: is_license | x.rlike(KEYWORDS)))


def own_licenses(files: DataFrame, templates: list[tuple[str, str]] = NOTICES, least: float = LEAST, blocks: bool = True) -> DataFrame:
    """key, license, score of the files that have a licence of their own; files: key, name, text."""
    spark = files.sparkSession
    is_license = F.coalesce(F.col("name").rlike(LICENSE_FILE), F.lit(False))
    lines = passages_of(F.col("text"), is_license) if blocks else F.filter(F.split("text", "\n"), lambda x: x.rlike(KEYWORDS) | is_license)
    passages = files.select("key", F.explode(F.array_distinct(lines)).alias("passage"))
    passages = passages.distinct().withColumn("terms", _terms(F.col("passage"))).where(F.size("terms") > 0)
    passages = materialize(passages.withColumn("id", F.monotonically_increasing_id()).select("id", "key", "terms"), "license-passages")
    tf = passages.select("id", F.explode("terms").alias("term")).groupBy("id", "term").agg(F.count("*").alias("tf"))
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    known = template_terms(spark, templates)
    n = passages.count()
    idf = F.log(F.lit(float(n + 1)) / (F.coalesce("df", F.lit(0)) + 1)) + 1
    weighted = known.join(df, "term", "left").select("template", "license", "term", (F.col("tf") * idf).alias("wt"))
    norms = weighted.groupBy("template").agg(F.sqrt(F.sum(F.col("wt") * F.col("wt"))).alias("nt"))
    # templates are a fixed list of some hundred terms
    weighted = F.broadcast(weighted.join(norms, "template"))
    mine = tf.join(df, "term").select("id", "term", (F.col("tf") * idf).alias("wp"))
    lengths = mine.groupBy("id").agg(F.sqrt(F.sum(F.col("wp") * F.col("wp"))).alias("np"))
    dots = mine.join(weighted, "term").groupBy("id", "template", "license", "nt").agg(F.sum(F.col("wp") * F.col("wt")).alias("dot"))
    scored = dots.join(lengths, "id").select("id", "license", F.round(F.col("dot") / F.col("nt") / F.col("np"), 6).alias("score")).where(F.col("score") >= least)
    best = scored.join(passages.select("id", "key"), "id").groupBy("key").agg(F.min(F.struct((-F.col("score")).alias("minus"), "license")).alias("b"))
    return best.select("key", F.col("b.license").alias("license"), (-F.col("b.minus")).alias("score"))


def _listed(rows: DataFrame, name: str) -> DataFrame:
    """rows, written; to be broadcast while there are at most LISTED."""
    written = materialize(rows, name)
    return F.broadcast(written) if written.count() <= LISTED else written


def ancestors(directory: Column) -> Column:
    """The directory and all above it, the root ("") among them."""
    parts = F.filter(F.split(directory, "/"), lambda x: x != "")
    return F.transform(F.sequence(F.lit(0), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))


def inherit(files: DataFrame) -> DataFrame:
    """dir, license, from of all directories with a licence at or above them; files: dir, path, license, score, shared (it speaks for its directory)."""
    spoken = files.where("license is not null and shared and dir is not null")
    owners = spoken.groupBy("dir").agg(F.min(F.struct((-F.col("score")).alias("s"), "path", "license")).alias("b")).select(F.col("dir").alias("from"), F.col("b.license").alias("license"))
    side = _listed(owners, "license-directories")
    dirs = files.where("dir is not null").select("dir").distinct().select("dir", F.explode(ancestors(F.col("dir"))).alias("up"))
    found = dirs.join(side, F.col("up") == F.col("from")).groupBy("dir").agg(F.max(F.struct(F.length("up").alias("depth"), "from", "license")).alias("b"))
    return found.select("dir", F.col("b.license").alias("license"), F.col("b.from").alias("from"))


def scan(files: DataFrame, templates: list[tuple[str, str]] = NOTICES, least: float = LEAST, every_file_speaks: bool = False, blocks: bool = True) -> DataFrame:
    """files (path, text and others) with license, score (of its own), origin
    (own, inherited or null) and inherited_from (a directory); text is left out.

    Licence files speak for their directory by their name (LICENSE_FILE), or,
    with ``every_file_speaks``, each file that has a licence."""
    name = F.regexp_extract("path", r"([^/]*)$", 1)
    directory = F.when(F.col("path").isNotNull(), F.array_join(F.filter(F.split(F.regexp_replace("path", r"[^/]*$", ""), "/"), lambda x: x != ""), "/"))
    key = F.struct("path", F.xxhash64("text").alias("h"))
    whole, files = files, sheltered(files, "path", "text")
    rows = files.withColumns({"key": F.to_json(key), "name": name, "dir": directory})
    own = own_licenses(rows.select("key", "name", "text"), templates, least, blocks).withColumnsRenamed({"key": "_key", "license": "_license", "score": "_score"})
    own = _listed(own, "license-own")
    rest = [c for c in files.columns if c != "text"]
    rows = rows.select(*[f"`{c.replace('`', '``')}`" for c in rest], "key", "name", "dir").join(own, F.col("key") == F.col("_key"), "left")
    rows = materialize(rows, "license-files")
    shared = F.lit(True) if every_file_speaks else F.coalesce(F.col("name").rlike(LICENSE_FILE), F.lit(False))
    above = inherit(rows.select("dir", "path", F.col("_license").alias("license"), F.col("_score").alias("score"), shared.alias("shared"))).withColumnsRenamed({"dir": "_dir", "license": "_above", "from": "_from"})
    above = _listed(above, "license-above")
    rows = rows.join(above, F.col("dir") == F.col("_dir"), "left")
    has = F.col("_license").isNotNull()
    rows = rows.select(
        *[f"`{c.replace('`', '``')}`" for c in rest], F.coalesce("_license", "_above").alias("license"), F.col("_score").alias("score"),
        F.when(has, "own").when(F.col("_above").isNotNull(), "inherited").alias("origin"), F.when(~has, F.col("_from")).alias("inherited_from"),
    )
    made = ("license", "score", "origin", "inherited_from")  # columns of these names give way
    plain = [c for c in whole.columns if c != "text"]
    return rows.toDF(*plain, *made) if not set(plain) & set(made) else rows.drop(*[f"in_{c}" for c in made]).toDF(*[c for c in plain if c not in made], *made)
