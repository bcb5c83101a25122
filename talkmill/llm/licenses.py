"""License scan: an exact containment join between license templates and blocks of every text.

Blocks are windows of ``2 * L`` words that start every ``L`` words, L being the longest template's
length, so any run of up to L words lies whole in one of them. A block is the set of its words that
occur in any template, a template the set of its words; both are ordered by the corpus-wide document
frequency of the words, rarest first. A pair must pass, for a needed overlap o = ceil(threshold * |T|):

* length filter: the block's set has o words at least;
* prefix filter: one of the first |T|-o+1 words of T is among the first |B|-o+1 words of B;
* positional filter: from the first shared word on, both have enough words left to reach o.

Survivors are confirmed by the full intersection, so the filters lose nothing. The templates are
constants of the query (``MAX_TEMPLATES`` at most), so they go into the plan as literals: nothing is
shuffled but one count per template word and task. No Python runs on the executors.

Defined cases: null and word-less texts have no words, places or labels; every document row gets one
result row, repeated rows equal ones; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, lower_ascii, whole_text

#: The phrases that count as such, and their labels.
PHRASES = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)

#: Notices as their licenses word them (label, text).
TEMPLATES = (
    ("apache", "Licensed under the Apache License, Version 2.0"),
    ("apache", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("cc0", "The person who associated a work with this deed has dedicated the work to the public domain by waiving all of his or her rights to the work worldwide under copyright law"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
)

THRESHOLD = 0.85
MAX_TEMPLATES = 256
_GAPS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def words_of(text: str) -> list[str]:
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.translate(str.maketrans(UPPER, LOWER)))


def spaced(c: Column) -> Column:
    """The words in their own case, with one blank before, between and after them."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(c, _GAPS, " ")), F.lit(" "))


def _blanks(c: Column) -> Column:
    return F.length(c) - F.length(F.replace(c, F.lit(" "), F.lit("")))


def _any(words: list[str]) -> str:
    return f"(?i) (?:{'|'.join(words)}) "


def word_frequencies(docs: DataFrame, vocabulary: list[str], text: str = "text") -> dict[str, int]:
    """In how many texts each word of the (bounded) vocabulary occurs."""
    rows = (
        docs.select(F.split(F.trim(lower_ascii(spaced(whole_text(text)))), " ").alias("w"))
        .select(F.explode(F.array_intersect(F.array(*map(F.lit, vocabulary)), "w")).alias("w"))
        .groupBy("w")
        .count()
        .collect()
    )
    return dict.fromkeys(vocabulary, 0) | {r["w"]: r["count"] for r in rows}


def template_matches(words: Column, ordered: list[str], templates: list[tuple[str, list[str]]], threshold: float, step: int) -> Column:
    """array<struct<label, containment>> of all (block, template) pairs over the threshold."""
    rank = {w: i for i, w in enumerate(ordered)}
    sets = [(label, sorted(set(ws), key=rank.__getitem__)) for label, ws in templates]
    need = [-int(-threshold * len(ws) // 1) for _, ws in sets]
    known = F.array(*map(F.lit, ordered))
    blocks = F.transform(
        F.sequence(F.lit(0), F.greatest(F.size(words) - 1, F.lit(0)), F.lit(step)),
        lambda i: F.array_intersect(known, F.slice(words, i + 1, F.lit(2 * step))),
    )

    def pair(b: Column, k: int) -> Column:
        label, ws = sets[k]
        o, t = need[k], F.array(*map(F.lit, ws))
        prefix = F.slice(b, F.lit(1), F.greatest(F.size(b) - (o - 1), F.lit(0)))
        first = F.array_intersect(F.array(*map(F.lit, ws[: len(ws) - o + 1])), prefix)
        left = F.least(F.lit(len(ws)) - F.array_position(t, F.get(first, F.lit(0))), F.size(b) - F.array_position(b, F.get(first, F.lit(0))))
        shared = F.size(F.array_intersect(t, b))
        passes = (F.size(b) >= o) & (F.size(first) > 0) & (left + 1 >= o) & (shared >= o)
        return F.when(passes, F.struct(F.lit(label).alias("label"), (shared / F.lit(float(len(ws)))).alias("containment")))

    kept = F.filter(blocks, lambda b: F.size(b) >= min(need))
    return F.filter(F.flatten(F.transform(kept, lambda b: F.array(*(pair(b, k) for k in range(len(sets)))))), lambda m: m.isNotNull())


def scan(
    docs: DataFrame,
    phrases: tuple[tuple[str, str], ...] = PHRASES,
    templates: tuple[tuple[str, str], ...] = TEMPLATES,
    threshold: float = THRESHOLD,
    text: str = "text",
) -> DataFrame:
    """doc_id, words, places of the phrases, labels and the best containment, one row per document row."""
    if not 0 < len(templates) <= MAX_TEMPLATES:
        raise ValueError(f"between 1 and {MAX_TEMPLATES} templates are expected")
    sets = [(label, words_of(t)) for label, t in templates]
    vocabulary = sorted({w for _, ws in sets for w in ws})
    seen = word_frequencies(docs, vocabulary, text)
    ordered = sorted(vocabulary, key=lambda w: (seen[w], w))
    rank = {w: i for i, w in enumerate(ordered)}
    step = max(len(ws) for _, ws in sets)
    prefixes = set()
    for _, ws in sets:
        t = sorted(set(ws), key=rank.__getitem__)
        prefixes |= set(t[: len(t) + int(-threshold * len(t) // 1) + 1])

    base = docs.select(F.col("doc_id"), spaced(whole_text(text)).alias("_s"))
    base = base.select("doc_id", "_s", F.when(F.col("_s") == "  ", F.lit(0)).otherwise(_blanks(F.col("_s")) - 1).cast("long").alias("n_words"))
    # one look at every text; the others only at the few that hold a phrase or a prefix word
    phrase_words = [p for p, _ in phrases]
    base = base.withColumn("_c", F.col("_s").rlike(_any([*phrase_words, *sorted(prefixes)])))
    told = F.col("_c") & F.col("_s").rlike(_any(phrase_words))
    likely = F.col("_c") & F.col("_s").rlike(_any(sorted(prefixes)))
    # a split before each place: word i stands after i + 1 blanks, the first of them its own
    parts = [F.when(told, F.split(F.concat(F.lit("#"), F.col("_s")), f"(?i)(?= {p} )", -1)) for p, _ in phrases]
    # a column of its own, used twice: inside the lambda of the blocks the text would be split for each block
    base = base.withColumn("_w", F.when(likely, F.split(F.trim(lower_ascii(F.col("_s"))), " ")))
    found = base.select(
        "doc_id", "n_words", *(p.alias(f"_p{k}") for k, p in enumerate(parts)),
        F.when(F.col("_w").isNotNull(), template_matches(F.col("_w"), ordered, sets, threshold, step)).alias("_m"),
    )
    pieces = [F.col(f"_p{k}") for k in range(len(phrases))]
    places = [F.when(p.isNotNull(), F.size(p) - 1).otherwise(0) for p in pieces]
    nothing = F.lit(None).cast("long")
    firsts = [F.when(n > 0, _blanks(F.get(p, F.lit(0))).cast("long")).otherwise(nothing) for p, n in zip(pieces, places)]
    lasts = [F.when(n > 0, (F.col("n_words") + 1 - _blanks(F.element_at(p, -1))).cast("long")).otherwise(nothing) for p, n in zip(pieces, places)]
    own = [F.when(n > 0, F.lit(label)) for (_, label), n in zip(phrases, places)]
    base_labels = F.array_sort(F.array_distinct(F.array_compact(F.array(*own))))
    more = F.coalesce(F.transform("_m", lambda m: m["label"]), F.array().cast("array<string>"))
    n_base = sum(places[1:], places[0])
    best = F.coalesce(F.array_max(F.transform("_m", lambda m: m["containment"])), F.lit(0.0))
    total = lambda xs, f: f(*xs) if len(xs) > 1 else xs[0]
    return found.select(
        "doc_id", "n_words", n_base.cast("long").alias("n_base"),
        total(firsts, F.least).alias("first_word"), total(lasts, F.greatest).alias("last_word"),
        F.array_join(base_labels, ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(base_labels, more)), ",").alias("labels"),
        F.when(n_base > 0, F.lit(1.0)).otherwise(best).alias("score"),
        best.alias("containment"),
    )


def oracle() -> str:
    """DuckDB SQL for the same rows: every block against every template, without filters."""
    sets = [(label, sorted(set(words_of(t)))) for label, t in TEMPLATES]
    step = max(len(words_of(t)) for _, t in TEMPLATES)
    rows = ", ".join(f"('{label}', {ws}, {-int(-THRESHOLD * len(ws) // 1)})" for label, ws in sets)
    phrases = ", ".join(f"({p.split()}, '{label}')" for p, label in PHRASES)
    return f"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
p(words, label) AS (VALUES {phrases}),
places AS (SELECT k, label, unnest(list_filter(range(len(w)), lambda i: w[i + 1:i + len(words)] = words)) AS pos FROM d, p
    WHERE list_contains(w, words[1])),
base AS (SELECT k, count(*) AS n, min(pos) AS a, max(pos) AS b, list(DISTINCT label) AS labels FROM places GROUP BY k),
t(label, words, need) AS (VALUES {rows}),
blocks AS (SELECT k, unnest(list_transform(range(0, len(w), {step}), lambda i: list_distinct(w[i + 1:i + {2 * step}]))) AS b FROM d),
hits AS (SELECT k, label, len(list_intersect(b, words)) / len(words)::DOUBLE AS c FROM blocks, t WHERE len(list_intersect(b, words)) >= need),
more AS (SELECT k, max(c) AS c, list(DISTINCT label) AS labels FROM hits GROUP BY k)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_base, a::BIGINT AS first_word, b::BIGINT AS last_word,
    coalesce(array_to_string(list_sort(base.labels), ','), '') AS base_labels,
    coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(base.labels, []), coalesce(more.labels, [])))), ','), '') AS labels,
    CASE WHEN n > 0 THEN 1.0 ELSE coalesce(c, 0) END::DOUBLE AS score, coalesce(c, 0)::DOUBLE AS containment
FROM d LEFT JOIN base USING (k) LEFT JOIN more USING (k)"""
