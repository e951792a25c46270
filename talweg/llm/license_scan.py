"""License scan: an exact set-similarity join of text blocks with notice templates.

A block is a run of at most ``2 * L`` words of a text, across line ends, every ``L`` words, where ``L``
is the longest template's length; so any passage of a template's length lies whole in
a block.  A template is found in a block if the block holds at least ``THRESHOLD`` of
the template's distinct words, all of those that tell licenses apart (``TELLING``), and
none that speaks for a relative of its license (``AGAINST``).  Template words are put in the order of their
frequency in the corpus, rarest first.  A block can only reach the threshold if it
holds one of a template's first ``m - need + 1`` words (prefix filter), has at
least ``need`` template words (length filter), and enough words are left after the
first match on either side (positional filter).  What passes is verified by the
exact intersection.

Only built-in functions are used.  The templates are a parameter of bounded size;
their index is the only thing broadcast.

Defined cases: a null or empty text has no words, no labels and score 0; rows
repeated whole get equal results; columns with clashing names are not read.
"""

from __future__ import annotations

import math
import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower

# single characters, not ranges: Java then tests a character by one look-up
_SEPARATORS = "".join(f"\\x{b:02X}" for b in range(128) if not chr(b).isalnum())
#: Words of a text whose A-Z are lower-cased.
WORD = f"[^{_SEPARATORS}{''.join(chr(b) for b in range(65, 91))}]+"
#: The same words before A-Z are lower-cased.
ANY_CASE_WORD = f"[^{_SEPARATORS}]+"
_BETWEEN = f"[{_SEPARATORS}]+"
_LEFT, _RIGHT = f"(?<![^{_SEPARATORS}])", f"(?![^{_SEPARATORS}])"
THRESHOLD = 0.8

#: Phrases whose words must stand consecutively, with their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

#: Wording of common notices, with their labels.
TEMPLATES: tuple[tuple[str, str], ...] = (
    ("gpl", "This work is licensed under the GNU General Public License v3."),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License"),
    ("lgpl", "Licensed under the GNU Lesser General Public License"),
    ("agpl", "Licensed under the GNU Affero General Public License"),
    ("apache", "Licensed under the Apache License, Version 2.0."),
    ("apache", "You may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("mit", "Released under the MIT License."),
    ("bsd", "Released under the BSD License."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0."),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License"),
)


#: Words of a template without which it is not found.
TELLING = frozenset("affero apache attribution bsd general gnu lesser mit mozilla nc sa".split())

#: Words that speak against a label, as they name a relative of its license.
AGAINST = {
    "gpl": ("lesser", "affero"),
    "lgpl": ("affero",),
    "agpl": ("lesser",),
    "cc-by": ("nc", "nd", "sa", "noncommercial", "noderivatives", "sharealike"),
}


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(ascii_lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def _any_case(text: str) -> str:
    """A pattern for a lower-case text in which A-Z may stand for a-z."""
    return "".join(f"[{c}{c.upper()}]" if "a" <= c <= "z" else re.escape(c) for c in text)


def _trie_pattern(tokens: Sequence[str]) -> str:
    """One pattern for all tokens that shares their beginnings, so a place is tried once a letter."""
    ends, below = False, {}
    for t in tokens:
        if t:
            below.setdefault(t[0], []).append(t[1:])
        else:
            ends = True
    if not below:
        return ""
    parts = "|".join(_any_case(c) + _trie_pattern(rest) for c, rest in sorted(below.items()))
    return f"(?:{parts})?" if ends else f"(?:{parts})"


def whole_words(tokens: Sequence[str]) -> str:
    """A pattern that finds the tokens as whole words, in any case."""
    return _LEFT + _trie_pattern(sorted(set(tokens))) + _RIGHT


def phrase_pattern(phrases: Sequence[str]) -> str:
    """A pattern that finds a phrase's words standing consecutively, in any case."""
    return _LEFT + "(?:" + "|".join(_BETWEEN.join(map(_any_case, p.split(" "))) for p in phrases) + ")" + _RIGHT


def _template_words(text: str) -> list[str]:
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    return list(dict.fromkeys(re.findall(WORD, low)))


def _strings(values: Sequence[str]) -> Column:
    return F.array(*(F.lit(v) for v in values)).cast("array<string>")


def places(words: str, phrases: Mapping[str, str] = PHRASES) -> Column:
    """array<struct<at, label>>: where the phrases' words stand consecutively in the column ``words``."""
    def of_phrase(parts: list[str], label: str) -> Column:
        fits = lambda i: _all([F.get(F.col(words), i + k) == F.lit(p) for k, p in enumerate(parts)])
        starts = F.filter(F.sequence(F.lit(0), F.size(words) - 1), fits)
        spots = F.transform(starts, lambda i: F.struct(i.cast("long").alias("at"), F.lit(label).alias("label")))
        return F.coalesce(F.when(F.array_contains(words, parts[0]), spots), F.array().cast("array<struct<at: bigint, label: string>>"))

    return F.flatten(F.array(*(of_phrase(p.split(" "), label) for p, label in phrases.items())))


def _all(tests: list[Column]) -> Column:
    out = tests[0]
    for t in tests[1:]:
        out = out & t
    return F.coalesce(out, F.lit(False))


def index_of(docs: DataFrame, templates: Sequence[tuple[str, str]], threshold: float) -> tuple[list[tuple], list[str]]:
    """([(token, template no, position, m, need)] of all prefixes, the words in global order).

    Frequencies are numbers of texts; only template words are cut out of them.  One
    row a template word comes back.
    """
    sets = [_template_words(t) for _, t in templates]
    vocabulary = sorted({w for s in sets for w in s} | {w for label, _ in templates for w in AGAINST.get(label, ())})
    words = F.regexp_extract_all("text", F.lit(whole_words(vocabulary)), F.lit(0))
    seen = docs.select(F.explode(F.array_distinct(F.transform(words, ascii_lower))).alias("w")).groupBy("w").count()
    count = dict(seen.collect())  # at most one row a template word
    order = sorted(vocabulary, key=lambda w: (count.get(w, 0), w))
    rank = {w: i for i, w in enumerate(order)}
    rows = []
    for t, s in enumerate(sets):
        s = sorted(s, key=rank.__getitem__)
        need = math.ceil(threshold * len(s) - 1e-9)
        rows += [(w, t, k, len(s), need) for k, w in enumerate(s[: len(s) - need + 1])]
    return rows, order


def blocks(docs: DataFrame, keys: Sequence[str], longest: int) -> DataFrame:
    """(keys, __block): word arrays of texts, as overlapping runs of words."""
    texts = docs.select(*keys, words_of(F.col("text")).alias("__w")).filter(F.size("__w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("__w") - F.lit(longest)), F.lit(longest))
    # runs are cut before they are spread, so a long text is not copied for each of them
    return texts.select(*keys, F.explode(F.transform(starts, lambda s: F.slice("__w", s, 2 * longest))).alias("__block"))


def find_templates(docs: DataFrame, keys: Sequence[str], templates: Sequence[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """(keys, found array<string>, score): templates found in (keys, text) rows; rows without any are absent."""
    rows, order = index_of(docs, templates, threshold)
    sets = [_template_words(t) for _, t in templates]
    longest = max(len(re.findall(WORD, t)) for _, t in templates)
    # rows of the index: at most the templates' words
    prefix = F.broadcast(docs.sparkSession.createDataFrame(rows, "__tok string, __t int, __i int, __m int, __need int"))
    first = sorted({r[0] for r in rows})
    hits = docs.filter(F.rlike("text", F.lit(whole_words(first))))
    # template words of the block in global order: array_intersect keeps the first array's order
    b = blocks(hits, keys, longest).select(*keys, F.array_intersect(_strings(order), "__block").alias("__b"))
    b = b.filter(F.size("__b") >= min(r[4] for r in rows)).distinct()
    pair = b.select("*", F.posexplode(F.array_intersect("__b", _strings(first))).alias("__n", "__tok")).join(prefix, "__tok")
    at = F.array_position("__b", F.col("__tok")) - 1
    pair = pair.filter((F.size("__b") >= F.col("__need")) & (F.least(F.col("__m") - F.col("__i"), F.size("__b") - at) + F.least(F.col("__i"), at) >= F.col("__need")))
    pair = pair.select(*keys, "__b", "__t", "__m", "__need").distinct()
    table = F.array(*(_strings(s) for s in sets))
    labels = _strings([label for label, _ in templates])
    own = lambda lists: F.element_at(F.array(*map(_strings, lists)), F.col("__t") + 1)
    both = F.size(F.array_intersect("__b", F.element_at(table, F.col("__t") + 1)))
    telling = F.size(F.array_except(own([[w for w in s if w in TELLING] for s in sets]), "__b")) == 0
    against = F.arrays_overlap("__b", own([AGAINST.get(label, ()) for label, _ in templates]))
    found = pair.withColumn("__both", both).filter((F.col("__both") >= F.col("__need")) & telling & ~against)
    return found.groupBy(*keys).agg(F.collect_set(F.element_at(labels, F.col("__t") + 1)).alias("found"), F.max(F.col("__both") / F.col("__m")).alias("score"))


def scan(docs: DataFrame, templates: Sequence[tuple[str, str]] = TEMPLATES, phrases: Mapping[str, str] = PHRASES, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score of (doc_id, text) rows."""
    docs = docs.select("doc_id", "text", F.xxhash64("text").alias("__h"))
    # words are only cut out of texts with a phrase
    holds = F.rlike("text", F.lit(phrase_pattern(list(phrases))))
    words = F.when(holds, words_of(F.col("text"))).otherwise(F.array().cast("array<string>"))
    spots = docs.withColumn("__words", words).withColumn("__places", places("__words", phrases))
    count = F.coalesce(F.regexp_count("text", F.lit(ANY_CASE_WORD)), F.lit(0)).cast("long")
    base = spots.select(
        "doc_id", "__h", count.alias("n_words"), F.size("__places").cast("long").alias("n_base"),
        F.array_min("__places.at").alias("first_word"), F.array_max("__places.at").alias("last_word"), F.array_sort(F.array_distinct("__places.label")).alias("__base"),
    )
    keys = ["doc_id", "__h"]
    found = find_templates(docs, keys, templates, threshold).select(F.col("doc_id").alias("__id"), F.col("__h").alias("__g"), "found", "score")
    both = base.join(found, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__h") == F.col("__g")), "left")
    none = F.array().cast("array<string>")
    labels = F.array_sort(F.array_union("__base", F.coalesce("found", none)))
    return both.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("__base", ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"),
        F.greatest(F.coalesce("score", F.lit(0.0)), F.when(F.col("n_base") > 0, 1.0).otherwise(0.0)).alias("score"),
    )
