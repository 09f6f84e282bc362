"""License scans by a positional rare-token index (operator 10); DataFrame functions only.

Every template is a short licence notice with a label and a key phrase. The index holds,
per template, its words of the highest inverse document frequency over all documents and
the positions where they stand. Every place of an indexed word in a file votes, for each
template that holds it, for the offset between its position in the file and in the
template. The best offset's weight, as a share of the template's, must reach
``least_share``, and the key phrase must stand in the file.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters that end a word, and the base phrases with their labels.
NO_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BASE = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))

#: Public licence notices: label, key phrase that must stand in the file, words.
TEMPLATES = (
    ("agpl-notice", "affero general public license", "licensed under the gnu affero general public license"),
    ("apache-notice", "apache license", "licensed under the apache license version 2 0"),
    ("boost-notice", "boost software license", "distributed under the boost software license version 1 0"),
    ("bsd-text", "redistribution and use in source and binary forms", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("cc-by-nc-notice", "cc by nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa-notice", "cc by sa", "licensed under cc by sa 4 0"),
    ("cc-notice", "creative commons attribution", "licensed under a creative commons attribution 4 0 international license"),
    ("cc0-notice", "public domain dedication", "cc0 1 0 universal public domain dedication"),
    ("epl-notice", "eclipse public license", "made available under the terms of the eclipse public license"),
    ("gpl-notice", "gnu general public license", "licensed under the gnu general public license version 3"),
    ("isc-text", "permission to use copy modify and or distribute this software", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("lgpl-notice", "lesser general public license", "under the terms of the gnu lesser general public license"),
    ("mit-notice", "mit license", "released under the mit license"),
    ("mit-text", "permission is hereby granted free of charge", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mpl-notice", "mozilla public license", "subject to the terms of the mozilla public license v 2 0"),
    ("reserved-notice", "all rights reserved", "all rights reserved"),
    ("unlicense-text", "unencumbered software released into the public domain", "this is free and unencumbered software released into the public domain"),
    ("warranty-text", "without warranty of any kind", "the software is provided as is without warranty of any kind express or implied"),
)


def _words(text: str) -> Column:
    """The text's words, lower-cased, with one space around each; a space alone if there are none.

    lower() also changes letters beyond ASCII, but no word's bounds. It would turn one of
    them, the sign for kelvin, into an ASCII letter, so that is put out of its reach.
    """
    lowered = F.lower(F.replace(F.coalesce(F.col(text).cast("string"), F.lit("")), F.lit("\u212a"), F.lit("\ue000")))
    return F.regexp_replace(F.concat(F.lit(" "), lowered, F.lit(" ")), NO_WORD, " ")


def _places(phrase: str) -> Column:
    """Start words of ``phrase`` in a file, looked for only where its text holds it."""
    test = " AND ".join(f"get(_w, i + {k}) = '{p}'" for k, p in enumerate(phrase.split()))
    places = F.expr(f"filter(sequence(0, size(_w) - 1), i -> {test})")
    return F.when(F.contains("_spaced", F.lit(f" {phrase} ")), places).otherwise(F.expr("cast(array() AS ARRAY<INT>)"))


def scan_licenses(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    templates: tuple[tuple[str, str, str], ...] = TEMPLATES,
    lookups: int = 12,
    least_share: float = 0.6,
) -> DataFrame:
    """Licence labels of every whole text, one row per row.

    Returns id_column, n_words, n_base, first_word, last_word (long), base_labels, labels
    (string, distinct, sorted, joined by commas), score (double, 0 to 1: the largest
    share of a template found in place). The index holds each template's
    ``lookups`` rarest words, however many documents hold them, so that no label depends on
    its share of the corpus; a file votes with all of its indexed words.

    A null text is empty: no words, null places, empty labels, score 0. Repeated rows and
    null ids are reported like any row; other columns are ignored; an empty table gives
    no rows.
    """
    rows = docs.select(F.col(id_column).alias("_id"), _words(text_column).alias("_spaced"))
    vocabulary = sorted({w for _, _, text in templates for w in text.split()})
    listed = F.array(*(F.lit(w) for w in vocabulary))
    # Document frequency of the template words, over all documents: as many rows as words.
    held = rows.select(F.explode(F.array_intersect(F.split("_spaced", " "), listed)).alias("word")).groupBy("word").agg(F.count("*").alias("df"))
    df = {r["word"]: r["df"] for r in held.collect()}
    total = docs.count()
    idf = {w: _weight(total, df.get(w, 0)) for w in vocabulary}

    at: dict[str, list[str]] = {}  # per word the templates, positions and weights it votes with
    for t, (_, _, text) in enumerate(templates):
        words = text.split()
        rare = sorted(set(words), key=lambda w: (-idf[w], w))[:lookups]
        postings = [(w, p) for p, w in enumerate(words) if w in rare]
        whole = sum(idf[w] for w, _ in postings)
        for w, p in postings:
            at.setdefault(w, []).append(f"named_struct('t', {t}, 'p', {p}, 'f', {idf[w]!r}D, 'whole', {whole!r}D)")

    out = rows.withColumn("_n", F.expr("greatest(length(_spaced) - length(replace(_spaced, ' ', '')) - 1, 0)"))
    out = out.withColumn("_w", F.expr("split(trim(_spaced), ' ')"))
    out = out.withColumns({f"_b{k}": _places(p) for k, (p, _) in enumerate(BASE)})
    every = F.concat(*(F.col(f"_b{k}") for k in range(len(BASE))))
    if at:
        index = f"array({', '.join('array(' + ', '.join(entries) + ')' for entries in at.values())})"
        # IN is a hash look-up, so only indexed words are searched for in the list.
        known = ", ".join(repr(w) for w in at)
        spot = f"named_struct('k', cast(array_position(array({known}), w) AS INT), 'i', i)"
        spots = f"filter(transform(_w, (w, i) -> CASE WHEN w IN ({known}) THEN {spot} END), x -> x IS NOT NULL)"
        votes = f"flatten(transform({spots}, s -> transform(get({index}, s.k - 1), a -> named_struct('t', a.t, 'o', s.i - a.p, 'f', a.f, 'whole', a.whole))))"
        # In order of template and offset, so that one pass adds up every offset's weight.
        start = "named_struct('t', -1, 'o', 0, 'f', 0D, 'best', 0D, 'hits', cast(array() AS ARRAY<INT>))"
        f = "CASE WHEN acc.t = v.t AND acc.o = v.o THEN acc.f ELSE 0D END + v.f"
        hits = f"CASE WHEN ({f}) / v.whole >= {least_share}D THEN array_union(acc.hits, array(v.t)) ELSE acc.hits END"
        step = f"named_struct('t', v.t, 'o', v.o, 'f', {f}, 'best', greatest(acc.best, least(({f}) / v.whole, 1D)), 'hits', {hits})"
        out = out.withColumn("_found", F.expr(f"aggregate(sort_array({votes}), {start}, (acc, v) -> {step})"))
    else:
        out = out.withColumn("_found", F.expr("cast(NULL AS STRUCT<best: DOUBLE, hits: ARRAY<INT>>)"))
    names = ", ".join(f"named_struct('label', '{label}', 'key', ' {key} ')" for label, key, _ in templates)
    base = F.array_compact(F.array(*(F.when(F.size(f"_b{k}") > 0, F.lit(label)) for k, (_, label) in enumerate(BASE))))
    confirmed = f"transform(filter(transform(_found.hits, t -> get(array({names}), t)), x -> contains(_spaced, x.key)), x -> x.label)"
    more = F.expr(f"coalesce({confirmed}, cast(array() AS ARRAY<STRING>))") if at else F.expr("cast(array() AS ARRAY<STRING>)")
    return out.select(
        F.col("_id").alias(id_column),
        F.col("_n").cast("long").alias("n_words"),
        F.size(every).cast("long").alias("n_base"),
        F.array_min(every).cast("long").alias("first_word"),
        F.array_max(every).cast("long").alias("last_word"),
        F.array_join(F.array_sort(base), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(F.concat(base, more))), ",").alias("labels"),
        F.coalesce("_found.best", F.lit(0.0)).alias("score"),
    )


def _weight(documents: int, df: int) -> float:
    return math.log((documents + 1) / (df + 1)) + 1
