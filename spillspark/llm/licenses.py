"""License scans: phrase counts, and an exact set-similarity join with notices.

DataFrame functions only. Words are runs of ASCII letters and digits and of
non-ASCII characters after A-Z are lower-cased. A block is a line, or with
``wrapped`` also any run of as many words as the template has, over line ends.
A block matches a template if it holds at least ``THRESHOLD`` of the template's
distinct tokens.

The join is exact. Template tokens are ordered by the number of documents that
hold them, rarest first, counted over all documents. A template of size t that
needs c shared tokens must share one of its first t - c + 1 in that order
(prefix filter), a block needs c template tokens itself (length filter), and a
shared token only counts if enough tokens follow it on both sides (positional
filter); what is left is verified. Only documents that hold a prefix token of
some template are cut into blocks, so common words never meet the index. Runs
are counted for the templates that a text has a prefix token and enough tokens of, and only
in texts of several lines: within one, the line holds all that its runs hold.

What is broadcast is the template index: its size is fixed by the templates,
which ``MAX_TEMPLATES`` bounds, and doesn't grow with the documents.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spillspark.llm.common import written

THRESHOLD = 0.8
MAX_TEMPLATES = 1000

#: The phrases whose places are counted, and their labels.
PHRASES = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)

#: Notices as published with the licenses, and forms in which works name them.
TEMPLATES = (
    ("this work is licensed under the gnu general public license version 3", "gpl"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", "gpl"),
    ("you should have received a copy of the gnu general public license along with this program", "gpl"),
    ("this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license", "lgpl"),
    ("you should have received a copy of the gnu lesser general public license along with this library", "lgpl"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license", "agpl"),
    ("licensed under the apache license version 2 0", "apache"),
    ("licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at", "apache"),
    ("unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied", "apache"),
    ("licensed under cc by 4 0", "cc-by"),
    ("licensed under cc by sa 4 0", "cc-by-sa"),
    ("licensed under cc by nc 4 0", "cc-by-nc"),
    ("licensed under cc by nd 4 0", "cc-by-nd"),
    ("this work is licensed under a creative commons attribution 4 0 international license", "cc-by"),
    ("this work is licensed under a creative commons attribution sharealike 4 0 international license", "cc-by-sa"),
    ("this work is licensed under a creative commons attribution noncommercial 4 0 international license", "cc-by-nc"),
    ("to the extent possible under law the author has waived all copyright and related or neighboring rights to this work", "cc0"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
    ("released under the mit license", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software", "mit"),
    ("the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", "mit"),
    ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies", "isc"),
    ("redistribution and use in source and binary forms with or without modification are permitted", "bsd"),
    ("redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer", "bsd"),
    ("redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution", "bsd"),
    ("permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license", "boost"),
    ("altered source versions must be plainly marked as such and must not be misrepresented as being the original software", "zlib"),
    ("this source code form is subject to the terms of the mozilla public license v 2 0", "mpl"),
    ("this program and the accompanying materials are made available under the terms of the eclipse public license v 2 0", "epl"),
)

SEPARATORS = "[\\x00-/:-`{-\\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lowered(text: Column) -> Column:
    """``text`` with A-Z lower-cased, as far as ASCII words can tell.

    The built-in lower() also changes non-ASCII letters, which no ASCII word
    holds; only the Kelvin sign and the dotted capital I turn into ASCII
    letters, and texts with those take the exact, slower way.
    """
    odd = text.contains("K") | text.contains("İ")
    return F.when(odd, F.translate(text, UPPER, LOWER)).otherwise(F.lower(text))


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, SEPARATORS), "")


def _strings(values) -> Column:
    return F.array(*[F.lit(v) for v in values]) if values else F.array().cast("array<string>")


def places(words: Column, phrases=PHRASES) -> Column:
    """array<struct<at, label>> of the places of the phrases, phrase by phrase."""
    return F.concat(*[_places_of(words, phrase.split(), label) for phrase, label in phrases])


def _places_of(words: Column, parts: list[str], label: str) -> Column:
    def here(i):
        same = F.lit(True)
        for k, part in enumerate(parts):
            same = same & F.coalesce(F.get(words, i + k) == part, F.lit(False))
        return same

    hits = F.filter(F.sequence(F.lit(0), F.size(words) - 1), here)
    return F.transform(hits, lambda i: F.struct(i.alias("at"), F.lit(label).alias("label")))


def frequencies(docs: DataFrame, templates) -> dict[str, int]:
    """Documents that hold each template token: one row per token, over all texts."""
    vocabulary = sorted({w for t, _ in templates for w in t.split()})
    held = docs.select(F.explode(F.array_intersect(words_of(lowered(F.col("text"))), _strings(vocabulary))).alias("token"))
    counts = {r.token: r.n for r in held.groupBy("token").agg(F.count(F.lit(1)).alias("n")).collect()}
    return {w: counts.get(w, 0) for w in vocabulary}


def index(templates, counts: dict[str, int], threshold: float) -> list[tuple]:
    """(token, template number, label, place, needed, size, tokens by frequency, words) of the prefixes."""
    rows = []
    for number, (text, label) in enumerate(templates):
        tokens = sorted(set(text.split()), key=lambda w: (counts.get(w, 0), w))
        need = math.ceil(threshold * len(tokens) - 1e-9)
        for place, token in enumerate(tokens[: len(tokens) - need + 1]):
            rows.append((token, number, label, place, need, len(tokens), tokens, len(text.split())))
    return rows


def _in_runs(table: DataFrame, rows: list[tuple]) -> DataFrame:
    """Template matches of runs as long as the template, over line ends.

    A text is only asked about templates of which it holds a prefix token and
    enough tokens in all. Its marks of one become rows in order, and each counts the
    distinct tokens of the run that begins there: a run may begin at one of the
    template's words, for moved on to the next of them it holds no fewer. Positions are
    divided by the template's length, so one window of less than 1 serves
    all; a row looks at as many words as the template has, whatever the text's length.
    """
    whole = {}
    for token, number, label, _, need, size, template, length in rows:
        whole.setdefault(number, (label, need, size, length, template, []))[5].append(token)
    known = F.array(*[
        F.struct(F.lit(n).alias("number"), F.lit(label).alias("label"), F.lit(need).alias("need"), F.lit(size).alias("size"), F.lit(length).alias("length"), _strings(template).alias("template"), _strings(prefix).alias("prefix"))
        for n, (label, need, size, length, template, prefix) in whole.items()
    ])
    held = table.where("size(marks) > 0").select("uid", "marks", F.array_distinct("marks.token").alias("tokens"))
    asked = F.filter(known, lambda t: F.arrays_overlap(t["prefix"], F.col("tokens")) & (F.size(F.array_intersect(t["template"], F.col("tokens"))) >= t["need"]))
    pairs = held.select("uid", "marks", F.explode(asked).alias("t"))
    mine = F.filter("marks", lambda m: F.array_contains(F.col("t.template"), m["token"]))
    marks = pairs.select("uid", "t.number", "t.label", "t.need", "t.size", "t.length", F.explode(mine).alias("m")).select("*", "m.token", (F.col("m.at") / F.col("length")).alias("at")).drop("m")
    longest = max(length for _, _, _, length, _, _ in whole.values())
    run = f"OVER (PARTITION BY uid, number ORDER BY at RANGE BETWEEN CURRENT ROW AND {1 - 1 / (2 * longest)}D FOLLOWING)"
    return marks.withColumn("shared", F.expr(f"size(collect_set(token) {run})")).where("shared >= need")


def scan(docs: DataFrame, templates=TEMPLATES, phrases=PHRASES, threshold: float = THRESHOLD, wrapped: bool = False) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): phrase places and labels.

    With ``wrapped``, notices that are broken over lines are found too.

    Columns: doc_id, n_words, n_base (all phrase places), first_word and
    last_word (smallest and largest start, else null), base_labels, labels
    (with the join's), score: 1 with a phrase, else the largest containment
    found, else 0. A null text is empty, and empty texts have no words; texts
    may be of any length, and take time in proportion to it. Rows that repeat an id, or have none, are judged one
    by one; other columns, whatever their names, are ignored; an empty table
    gives an empty result.
    """
    if not 0 < len(templates) <= MAX_TEMPLATES:
        raise ValueError(f"1 to {MAX_TEMPLATES} templates")
    if any(re.search("[^a-z0-9 ]", t) for t, _ in (*templates, *phrases)):
        raise ValueError("templates and phrases hold ASCII words, lower-case, one blank between")
    spark = docs.sparkSession
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    counts = frequencies(docs, templates)
    rows = index(templates, counts, threshold)
    vocabulary = sorted(counts, key=lambda w: (counts[w], w))
    prefix = _strings(sorted({r[0] for r in rows}))
    ordered = _strings(vocabulary)  # array_intersect keeps this order: rarest first

    starts = _strings(sorted({p.split()[0] for p, _ in phrases}))
    cut = docs.withColumn("low", lowered(F.col("text"))).withColumn("words", words_of(F.col("low")))
    found = cut.select(
        "doc_id",
        F.size("words").cast("bigint").alias("n_words"),
        F.when(F.arrays_overlap("words", starts), places(F.col("words"), phrases)).alias("at"),
        F.when(
            F.arrays_overlap("words", prefix),
            F.filter(
                F.transform(F.split("low", "\n"), lambda line: F.array_intersect(ordered, words_of(line))),
                lambda block: F.arrays_overlap(block, prefix),
            ),
        ).alias("blocks"),
        # Where the templates' words stand: all that counting in runs needs.
        F.when(
            F.lit(wrapped) & F.col("low").contains("\n") & F.arrays_overlap("words", prefix),
            F.filter(F.transform("words", lambda w, i: F.struct(i.alias("at"), w.alias("token"))), lambda m: F.array_contains(ordered, m["token"])),
        ).alias("marks"),
    )
    table = written(found.withColumn("uid", F.monotonically_increasing_id()), "licenses")

    held = table.where("size(blocks) > 0").select("uid", F.posexplode("blocks").alias("block", "tokens"))
    tokens = held.select("uid", "block", "tokens", F.posexplode("tokens").alias("i", "token"))
    names = ("token", "number", "label", "j", "need", "size", "template", "length")
    known = spark.range(1).select(F.inline(F.array(*[F.struct(*[(_strings(v) if n == "template" else F.lit(v)).alias(n) for n, v in zip(names, r, strict=True)]) for r in rows])))
    length = F.size("tokens") >= F.col("need")
    position = F.least(F.size("tokens") - F.col("i"), F.col("size") - F.col("j")) >= F.col("need")
    candidates = tokens.join(F.broadcast(known), "token").where(length & position)
    shared = candidates.withColumn("shared", F.size(F.array_intersect("tokens", "template"))).where("shared >= need")
    shared = shared.select("uid", "label", "shared", "size")
    if wrapped:
        shared = shared.unionByName(_in_runs(table, rows).select("uid", "label", "shared", "size"))
    labels = shared.groupBy("uid").agg(F.collect_set("label").alias("more"), F.max(F.col("shared") / F.col("size")).alias("most"))

    base = F.array_sort(F.array_distinct(F.transform(F.coalesce("at", F.expr("array()").cast("array<struct<at:int,label:string>>")), lambda p: p["label"])))
    n_base = F.when(F.col("at").isNull(), 0).otherwise(F.size("at"))
    both = table.join(labels, "uid", "left").withColumns({"base": base, "n_base": n_base.cast("bigint")})
    return both.select(
        "doc_id",
        "n_words",
        "n_base",
        F.array_min(F.transform("at", lambda p: p["at"])).cast("bigint").alias("first_word"),
        F.array_max(F.transform("at", lambda p: p["at"])).cast("bigint").alias("last_word"),
        F.array_join("base", ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("base", F.coalesce("more", F.array().cast("array<string>")))), ",").alias("labels"),
        F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("most", F.lit(0.0))).alias("score"),
    )
