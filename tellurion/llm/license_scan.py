"""License scans: known phrases, and an exact set-similarity join with templates.

A text block is a window of words that slides over the whole text, ``SPAN`` times as
wide as the template that it is held against has words; lines play no part, so a
notice may be wrapped, and a long line is no block by itself. A block matches a
template when it holds at least ``THRESHOLD`` of the template's distinct words.
Windows that begin at a template word answer for all: any other holds no more than
the one that begins at its first such word.

The join is exact. The templates' words are ordered by the number of documents
that hold them, rarest first, counted over the whole corpus. Blocks meet templates
on the words of the templates' prefixes; a pair goes on when the block has words
enough, and when enough are left after the first common one. What passes is
verified on the full sets. A text is read once; only documents that hold enough of
a template's words as a whole are cut into blocks.

Only DataFrame operations are used.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tellurion.llm.common import BROADCAST_ROWS, land, run_dir, table, text_of

# Phrases and their labels.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
# Notices that name a license or grant it, by label.
TEMPLATES = {
    "agpl-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation",
    "apache-notice": "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License",
    "bsd-notice": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "cc-by-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "cc0-notice": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work",
    "epl-notice": "This program and the accompanying materials are made available under the terms of the Eclipse Public License",
    "gpl-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "gpl-work": "This work is licensed under the GNU General Public License",
    "isc-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
    "lgpl-notice": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction",
    "mit-notice": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software",
    "mit-release": "Released under the MIT License",
    "mpl-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    "unlicense": "This is free and unencumbered software released into the public domain",
    "warranty-disclaimer": "The software is provided as is, without warranty of any kind, express or implied, including but not limited to the warranties of merchantability, fitness for a particular purpose and noninfringement",
    "zlib-notice": "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software",
}
THRESHOLD = 0.8
#: How many times a template's words a block is wide.
SPAN = 2
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What stands between words, once A-Z are lower-cased.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: str) -> list[str]:
    import re

    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.lower())


def template_words(text: str) -> list[str]:
    return sorted(set(words_of(text)))


def canonical(text: Column) -> Column:
    """The words, lower-cased in A-Z, with one space between."""
    low = F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    return F.trim(F.regexp_replace(low, BETWEEN, " "))


def words(canon: Column) -> Column:
    return F.when(canon == "", F.array().cast("array<string>")).otherwise(F.split(canon, " "))


def strings(values: list[str]) -> Column:
    return F.array(*map(F.lit, values)).cast("array<string>")


def count_of(canon: Column, phrase: str) -> Column:
    return (F.length(canon) - F.length(F.replace(canon, F.lit(phrase), F.lit("")))) / F.lit(len(phrase))


def spaces_half(x: Column) -> Column:
    """Words of a piece of doubled text, where every word has a space on either side."""
    return ((F.length(x) - F.length(F.replace(x, F.lit(" "), F.lit("")))) / 2).cast("long")


def needed(n: int, threshold: float) -> int:
    return max(1, math.ceil(threshold * n - 1e-9))


def read(df: DataFrame, id_col: str, text_col: str, sets: dict[str, list[str]], threshold: float) -> DataFrame:
    """What one reading of each text gives: counts, the phrases' places, its template words, and the text if it may hold a notice."""
    rows = df.select(F.monotonically_increasing_id().alias("rid"), F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    rows = rows.withColumn("canon", canonical(F.col("text")))
    some = F.contains("canon", F.lit("license")) | F.contains("canon", F.lit("cc by"))
    rows = rows.withColumn("n_words", F.when(F.col("canon") == "", 0).otherwise(F.length("canon") - F.length(F.replace("canon", F.lit(" "), F.lit(""))) + 1).cast("long"))
    rows = rows.withColumn("twice", F.when(some, F.concat(F.lit(" "), F.replace("canon", F.lit(" "), F.lit("  ")), F.lit(" "))))
    doubled = {p: " " + p.replace(" ", "  ") + " " for p in PHRASES}
    for i, p in enumerate(doubled.values()):
        rows = rows.withColumn(f"n{i}", F.coalesce(count_of(F.col("twice"), p).cast("long"), F.lit(0)))
    firsts = [F.when(F.col(f"n{i}") > 0, spaces_half(F.substring_index("twice", p, 1))) for i, p in enumerate(doubled.values())]
    lasts = [F.when(F.col(f"n{i}") > 0, F.col("n_words") - spaces_half(F.substring_index("twice", p, -1)) - len(p.split())) for i, p in enumerate(doubled.values())]
    base = F.array_compact(F.array(*[F.when(F.col(f"n{i}") > 0, F.lit(x)) for i, x in enumerate(PHRASES.values())]))
    rows = rows.withColumn("own", F.array_intersect(strings(sorted({w for ws in sets.values() for w in ws})), words(F.col("canon"))))
    hopeful = F.lit(False)
    for ws in sets.values():
        need = needed(len(ws), threshold)
        hopeful = hopeful | F.when(F.size("own") >= need, F.size(F.array_intersect(strings(ws), F.col("own"))) >= need).otherwise(False)
    places = sum((F.col(f"n{i}") for i in range(len(PHRASES))), F.lit(0)).cast("long")
    return rows.select("rid", "doc_id", "n_words", places.alias("n_base"), F.least(*firsts).alias("first_word"), F.greatest(*lasts).alias("last_word"), base.alias("base"), "own", F.when(hopeful, F.col("text")).alias("text"))


def blocks(rows: DataFrame, order: list[str], widths: list[int]) -> DataFrame:
    """rid, block (the word that it begins with), width, own: the template words of each block of the texts, rarest first."""
    every = rows.filter("text is not null").select("rid", F.posexplode(words(canonical(F.col("text")))).alias("block", "word"))
    # Only template words are carried into the windows.
    tokens = every.filter(F.col("word").isin(order)).withColumn("block", F.col("block").cast("long"))
    sets = {f"w{w}": F.collect_set("word").over(Window.partitionBy("rid").orderBy("block").rangeBetween(0, w - 1)) for w in widths}
    own = F.array(*[F.struct(F.lit(w).alias("width"), F.col(f"w{w}").alias("ws")) for w in widths])
    found = tokens.select("rid", "block", *(c.alias(k) for k, c in sets.items())).select("rid", "block", F.explode(own).alias("b")).select("rid", "block", "b.width", "b.ws")
    return found.select("rid", "block", "width", F.array_intersect(strings(order), F.col("ws")).alias("own"))


def template_rows(spark, sets: dict[str, list[str]], order: list[str], threshold: float, widths: dict[str, int]) -> DataFrame:
    """A row for each word of each template's prefix: word, label, ws (all its words, rarest first), prefix, need, width, at (place in ws)."""
    rank = {w: i for i, w in enumerate(order)}

    def with_place(own: Column):
        return lambda w, i: F.struct(w.alias("word"), i.alias("at"), own.alias("t"))

    out = []
    for label, ws in sets.items():
        ws = sorted(ws, key=rank.__getitem__)
        need = needed(len(ws), threshold)
        prefix = ws[: len(ws) - need + 1]
        own = F.struct(F.lit(label).alias("label"), strings(ws).alias("ws"), strings(prefix).alias("prefix"), F.lit(need).alias("need"), F.lit(widths[label]).alias("width"))
        out.append(F.transform(strings(prefix), with_place(own)))
    return spark.range(1).select(F.explode(F.concat(*out)).alias("r")).select("r.word", "r.at", "r.t.*")


def join_templates(found: DataFrame, templates: DataFrame) -> DataFrame:
    """rid, block, label, score of the blocks that reach a template's threshold."""
    tokens = found.select("rid", "block", "width", "own", F.posexplode("own").alias("place", "word"))
    # Templates are a parameter: a few rows for each.
    pairs = tokens.join(F.broadcast(templates), ["word", "width"]).filter(F.size("own") >= F.col("need"))
    # A pair counts at its first common word, after which enough of both must be left.
    pairs = pairs.filter(F.element_at(F.array_intersect("prefix", "own"), 1) == F.col("word"))
    pairs = pairs.filter(F.least(F.size("ws") - F.col("at"), F.size("own") - F.col("place")) >= F.col("need"))
    pairs = pairs.withColumn("common", F.size(F.array_intersect("ws", "own"))).filter("common >= need")
    return pairs.select("rid", "block", "label", (F.col("common") / F.size("ws")).alias("score"))


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, str] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """One row per input row: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    ``score`` is the greatest containment of a template in a block that reaches
    the threshold, else 0. Null text is the empty text: no words, no labels,
    null places. A null id stays null; repeated rows each give a row; an empty
    table gives an empty result; other columns play no part.
    """
    path = run_dir(df.sparkSession, "license-scan")
    sets = {k: template_words(v) for k, v in templates.items()}
    vocabulary = sorted({w for ws in sets.values() for w in ws})
    rows = land(read(df, id_col, text_col, sets, threshold), f"{path}/rows")
    # The documents that hold each template word: as many rows as such words.
    held = {r["word"]: r["n"] for r in rows.select(F.explode("own").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n")).collect()}
    order = sorted(vocabulary, key=lambda w: (held.get(w, 0), w))
    widths = {k: SPAN * len(words_of(v)) for k, v in templates.items()}
    found = join_templates(blocks(rows, order, sorted(set(widths.values()))), template_rows(df.sparkSession, sets, order, threshold, widths))
    found = land(found.groupBy("rid").agg(F.collect_set("label").alias("more"), F.max("score").alias("score")), f"{path}/found")
    out = rows.drop("text", "own").join(F.broadcast(found) if found.count() <= BROADCAST_ROWS else found, "rid", "left")
    more = F.coalesce("more", F.array().cast("array<string>"))
    return out.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word",
        F.array_join(F.array_sort(F.array_distinct("base")), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(F.concat("base", more))), ",").alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
    )


def op9_license_scan(spark, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


def _sql() -> str:
    """Brute force: every window against every template of its width, every place against every phrase."""
    sets = ", ".join(f"('{k}', [{', '.join(repr(w) for w in template_words(v))}], {needed(len(template_words(v)), THRESHOLD)}, {SPAN * len(words_of(v))})" for k, v in TEMPLATES.items())
    phrases = ", ".join(f"([{', '.join(repr(w) for w in p.split())}], '{k}')" for p, k in PHRASES.items())
    word = "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
    low = f"translate({{}}, '{UPPER}', '{LOWER}')"
    return f"""
WITH templates(label, ws, need, width) AS (VALUES {sets}),
phrases(ws, label) AS (VALUES {phrases}),
d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all({low.format("coalesce(text, '')")}, '{word}') AS w FROM documents),
places AS (
  SELECT doc_id, p.label, i FROM (SELECT doc_id, w, unnest(range(len(w))) AS i FROM d WHERE len(w) > 0) x, phrases p
  WHERE w[i + 1] = p.ws[1] AND w[i + 1 : i + len(p.ws)] = p.ws),
base AS (SELECT doc_id, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word, list(DISTINCT label) AS ls FROM places GROUP BY doc_id),
windows AS (SELECT doc_id, label, ws, need, width, w, unnest(range(1, len(w) + 1)) AS i FROM d, templates WHERE len(list_intersect(list_distinct(w), ws)) >= need),
scores AS (SELECT doc_id, label, need, len(list_intersect(list_distinct(w[i : i + width - 1]), ws)) AS common, len(ws) AS n FROM windows WHERE list_contains(ws, w[i])),
found AS (SELECT doc_id, list(DISTINCT label) AS ls, max(common::DOUBLE / n) AS score FROM scores WHERE common >= need GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
  coalesce(array_to_string(list_sort(base.ls), ','), '') AS base_labels,
  coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(base.ls, []), coalesce(found.ls, [])))), ','), '') AS labels,
  coalesce(score, 0.0::DOUBLE) AS score
FROM d LEFT JOIN base USING (doc_id) LEFT JOIN found USING (doc_id)"""


SQL = _sql()
