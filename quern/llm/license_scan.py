"""Licence scans with DataFrame functions only (operator 10).

A passage is any run of words of a document, over line ends or within a line, that begins and ends with a word bigram of
a licence template and has at most (2 - t) / t times as many bigrams. It is compared with the template by the Dice
coefficient over word bigrams; t is the least coefficient that counts. A document can hold such a passage only if it
holds at least t / (2 - t) of the template's distinct bigrams, so other templates are never compared.

Only a document's bigrams that are in some template leave its row, so what is sorted and compared afterwards grows with
the licence text in the corpus and, for every bigram, with what lies within a template's length of it.
"""

from __future__ import annotations

import math

import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Public licence notices and the opening paragraphs of public licences.
TEMPLATES = [
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0'),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:'),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
]

BREAKS = r"[^\p{L}\p{N}]+"


def words_of(text: str) -> list[str]:
    """Words of a template, normalised as documents are."""
    return regex.sub(BREAKS, " ", text.lower()).strip().split(" ")


def bigrams(words: list[str]) -> list[str]:
    """Distinct word bigrams."""
    return list(dict.fromkeys(f"{a} {b}" for a, b in zip(words, words[1:], strict=False)))


def bounds(templates: list[tuple[str, str]], least: float) -> list[tuple[str, list[str], int, int]]:
    """(licence, distinct bigrams, fewest of them that a passage shares, most bigrams that a passage has) of each template."""
    out = []
    for name, text in templates:
        words = words_of(text)
        if grams := bigrams(words):
            out.append((name, grams, math.ceil(len(grams) * least / (2 - least) - 1e-9), math.floor((len(words) - 1) * (2 - least) / least + 1e-9)))
    if not out:
        raise ValueError("no template has two words")
    return out


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = 0.8, templates: list[tuple[str, str]] = TEMPLATES) -> DataFrame:
    """(doc_id, license, dice, word, n_words): the best passage of each licence that a document reaches `least` with.

    Dice is 2 * shared / (passage + template): distinct bigrams, but for those of a passage that the template lacks, which
    count every time. word counts a document's words from 1; ties go to the earlier and then the shorter passage. Null
    and empty texts, and words without a neighbour, match nothing. Rows that repeat an id, or have a null one, are taken
    together, each with passages of its own. An empty table gives no rows. Other columns are not read.
    """
    known = bounds(templates, least)
    every = sorted({g for _, grams, _, _ in known for g in grams})
    heads = sorted({g.split(" ")[0] for g in every})
    longest = max(most for *_, most in known)
    listed = F.array(*[F.struct(F.lit(k).alias("no"), F.lit(name).alias("license"), F.array(*map(F.lit, grams)).alias("grams"), F.lit(fewest).alias("fewest"), F.lit(most).alias("most")) for k, (name, grams, fewest, most) in enumerate(known)])

    text = F.col(f"`{text_col}`").cast("string")
    words = F.split(F.trim(F.regexp_replace(F.lower(text), BREAKS, " ")), " ")
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.xxhash64(text).alias("h"), words.alias("words"))
    # places of words that begin a bigram of a template, then of those bigrams
    begin = F.filter(F.when(F.size("words") > 1, F.sequence(F.lit(1), F.size("words") - 1)), lambda i: F.get("words", i - 1).isin(heads))
    pairs = F.transform(begin, lambda i: F.struct(i.alias("pos"), F.concat(F.get("words", i - 1), F.lit(" "), F.get("words", i)).alias("gram")))
    found = rows.select("doc_id", "h", F.filter(pairs, lambda x: x["gram"].isin(every)).alias("hits"))
    found = found.withColumn("kinds", F.array_distinct(F.col("hits.gram")))
    fitting = F.when(F.size("kinds") >= min(fewest for _, _, fewest, _ in known), F.filter(listed, lambda t: F.size(F.array_intersect(F.col("kinds"), t["grams"])) >= t["fewest"]))
    # outer, as Spark would else evaluate all of the above in a filter and then once more
    likely = found.select("doc_id", "h", "hits", F.explode_outer(fitting).alias("t")).where("t is not null")
    # rows that are equal in id and text have the same passages, so one of them is enough
    hits = likely.select("doc_id", "h", "t.no", "t.license", F.size("t.grams").alias("n"), "t.fewest", "t.most", F.explode(F.filter("hits", lambda x: F.array_contains("t.grams", x["gram"]))).alias("hit")).distinct()
    hits = hits.select("doc_id", "h", "no", "license", "n", "fewest", "most", "hit.pos", "hit.gram")
    place = Window.partitionBy("doc_id", "h", "no")
    hits = hits.withColumn("before", F.coalesce(F.lag("pos").over(Window.partitionBy("doc_id", "h", "no", "gram").orderBy("pos")), F.lit(0)))
    near = hits.withColumn("near", F.collect_list(F.struct("pos", "before")).over(place.orderBy("pos").rangeBetween(0, longest - 1)))
    near = near.withColumn("near", F.filter("near", lambda x: (x["pos"] < F.col("pos") + F.col("most")))).where(F.size("near") >= F.col("fewest"))

    def step(acc, x):
        """The passage up to x: its bigrams of the template, the distinct ones, and the best passage so far."""
        hit, kinds = acc["hit"] + 1, acc["kinds"] + (x["before"] < F.col("pos")).cast("int")
        dice = F.lit(2.0) * kinds / (x["pos"] - F.col("pos") + 1 - hit + kinds + F.col("n"))
        better = dice > acc["dice"]
        return F.struct(hit.alias("hit"), kinds.alias("kinds"), F.when(better, dice).otherwise(acc["dice"]).alias("dice"), F.when(better, x["pos"]).otherwise(acc["end"]).alias("end"))

    start = F.struct(F.lit(0).alias("hit"), F.lit(0).alias("kinds"), F.lit(0.0).alias("dice"), F.lit(0).alias("end"))
    scored = near.select("doc_id", "license", "pos", F.aggregate("near", start, step).alias("best")).where(F.col("best.dice") >= least)
    order = F.struct(F.col("best.dice").alias("dice"), (-F.col("pos")).alias("word"), (F.col("pos") - F.col("best.end") - 2).alias("n_words"))
    best = scored.groupBy("doc_id", "license").agg(F.max(order).alias("best"))
    return best.select("doc_id", "license", F.col("best.dice").alias("dice"), (-F.col("best.word")).alias("word"), (-F.col("best.n_words")).alias("n_words"))


def scan_sql(least: float = 0.8, templates: list[tuple[str, str]] = TEMPLATES) -> str:
    """The same in DuckDB's SQL, every passage against every template."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    values = ", ".join(f"({k}, {quote(name)}, {len(grams)}, {most}, {quote(g)})" for k, (name, grams, _, most) in enumerate(bounds(templates, least)) for g in grams)
    return f"""
        WITH t(no, license, n, most, gram) AS (VALUES {values}),
        d AS (SELECT row_number() OVER () AS r, doc_id, string_split(trim(regexp_replace(lower(text), '{BREAKS}', ' ', 'g')), ' ') AS w FROM documents WHERE text IS NOT NULL),
        b AS (SELECT r, doc_id, w, unnest(range(1, len(w))) AS pos FROM d),
        g AS (SELECT r, doc_id, CAST(pos AS INTEGER) AS pos, w[pos] || ' ' || w[pos + 1] AS gram FROM b),
        h AS (SELECT r, doc_id, no, license, n, most, pos, coalesce(lag(pos) OVER (PARTITION BY r, no, gram ORDER BY pos), 0) AS before FROM g JOIN t USING (gram)),
        p AS (SELECT s.doc_id, s.license, s.n, s.pos AS word, e.pos AS last,
                     count(*) OVER x AS hit, sum(CASE WHEN e.before < s.pos THEN 1 ELSE 0 END) OVER x AS kinds
              FROM h s JOIN h e ON s.r = e.r AND s.no = e.no AND e.pos BETWEEN s.pos AND s.pos + s.most - 1
              WINDOW x AS (PARTITION BY s.r, s.no, s.pos ORDER BY e.pos)),
        c AS (SELECT doc_id, license, word, last - word + 2 AS n_words, CAST(2 * kinds AS DOUBLE) / CAST(last - word + 1 - hit + kinds + n AS DOUBLE) AS dice FROM p),
        o AS (SELECT *, row_number() OVER (PARTITION BY doc_id, license ORDER BY dice DESC, word, n_words) AS k FROM c WHERE dice >= {least})
        SELECT doc_id, license, dice, word, CAST(n_words AS INTEGER) AS n_words FROM o WHERE k = 1"""
