"""Licence scans with a positional rare-token index, in built-in expressions only.

Every phrase and licence notice is a template of words. The document frequency of all template words is counted over the
whole corpus, and each template is indexed under its rarest words with their positions. A file looks up those words; a
word at position i of the file and j of a template puts the template's start at i - j, and the starts are intersected over
the index words by that relative position. A start is confirmed by the share of the template's words (weighed by their
rarity) that stand at their places and by the template's mandatory key phrases. Base phrases are templates whose words
must all stand.

No start is missed: the words that starts are taken from weigh more than a confirmed notice may lack, so that one of them
stands; and an intersection is dropped only where the index words that stand are too few for the share by their weight.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD, BETWEEN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Share of a notice's weight that must stand at its places, and that its index words have at least.
COVERAGE, INDEXED = 0.8, 0.5


@dataclass(frozen=True)
class Template:
    label: str
    text: str
    keys: tuple[str, ...] = ()
    base: bool = False

    @property
    def words(self) -> list[str]:
        return self.text.split()


# The base phrases with their labels.
BASE = (
    Template("mit", "mit license", base=True),
    Template("apache", "apache license", base=True),
    Template("gpl", "general public license", base=True),
)
# Sentences of public licence notices, in lower case without punctuation, with phrases that must stand.
NOTICES = (
    Template("mit-notice", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", ("free of charge", "associated documentation files")),
    Template("mit-notice", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", ("permission notice", "substantial portions")),
    Template("mit-notice", "released under the mit license", ("mit license",)),
    Template("mit-notice", "spdx license identifier mit", ("license identifier mit",)),
    Template("apache-notice", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license", ("apache license version 2 0", "in compliance with the license")),
    Template("apache-notice", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis", ("applicable law", "distributed under the license")),
    Template("apache-notice", "licensed under the apache license", ("apache license",)),
    Template("apache-notice", "spdx license identifier apache 2 0", ("license identifier apache",)),
    Template("gpl-notice", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", ("gnu general public license", "free software foundation")),
    Template("gpl-notice", "under the gnu general public license", ("gnu general public license",)),
    Template("gpl-notice", "spdx license identifier gpl", ("license identifier gpl",)),
    Template("lgpl-notice", "under the terms of the gnu lesser general public license", ("gnu lesser general public license",)),
    Template("agpl-notice", "under the terms of the gnu affero general public license", ("gnu affero general public license",)),
    Template("bsd-notice", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ("source and binary forms", "with or without modification")),
    Template("bsd-notice", "spdx license identifier bsd", ("license identifier bsd",)),
    Template("mpl-notice", "this source code form is subject to the terms of the mozilla public license v 2 0", ("mozilla public license",)),
    Template("epl-notice", "made available under the terms of the eclipse public license", ("eclipse public license",)),
    Template("isc-notice", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ("with or without fee",)),
    Template("zlib-notice", "this software is provided as is without any express or implied warranty in no event will the authors be held liable", ("held liable",)),
    Template("unlicense-notice", "this is free and unencumbered software released into the public domain", ("unencumbered software",)),
    Template("cc-notice", "this work is licensed under a creative commons attribution", ("creative commons",)),
    Template("cc0-notice", "to the extent possible under law the author has waived all copyright and related or neighboring rights", ("neighboring rights",)),
    Template("boost-notice", "distributed under the boost software license version 1 0", ("boost software license",)),
    Template("reserved-notice", "all rights reserved", ("all rights reserved",)),
)


def words_of(text: Column) -> Column:
    """Runs of WORD in the whole text with A-Z lowered; none for null. Splitting is far cheaper than extracting them."""
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), BETWEEN), "")


def _literal(values: Sequence) -> Column:
    return F.array(*[F.lit(v) for v in values])


def _at(start: Column, n: int) -> Column:
    """n words of the file from 0-based place start."""
    return F.slice(F.col("l_words"), start + 1, F.lit(n))


def _starts(t: Template, j: int) -> Column:
    """Places where t would start, judged by the file's postings of its j-th word."""
    word, rest = t.words[j], len(t.words) - j
    own = F.filter("l_post", lambda x: (x["w"] == word) & (x["i"] >= j) & (x["i"] + rest <= F.size("l_words")))
    return F.transform(own, lambda x: x["i"] - j)


def _met(t: Template, places: Sequence[int], weight: dict[str, float], least: float) -> Callable[[Column], Column]:
    """Whether the index words at places that stand, seen from a start, weigh at least so much: their postings intersect."""

    def check(start: Column) -> Column:
        there = (F.when(F.get("l_words", start + j) == t.words[j], weight[t.words[j]]).otherwise(0.0) for j in places)
        return reduce(lambda a, b: a + b, there) >= least

    return check


def _stands(phrase: Sequence[str]) -> Callable[[Column], Column]:
    """Whether the whole phrase stands at a place."""
    return lambda start: _at(start, len(phrase)) == _literal(phrase)


def _keyed(t: Template) -> Callable[[Column], Column]:
    """Whether t's mandatory phrases stand within its words at a place."""

    def check(start: Column) -> Column:
        part = F.concat(F.lit(" "), F.array_join(_at(start, len(t.words)), " "), F.lit(" "))
        return reduce(lambda a, key: a & part.contains(f" {key} "), t.keys, F.lit(True))

    return check


def _share(t: Template, weight: dict[str, float]) -> Callable[[Column], Column]:
    """Share of t's weight that stands at its places, to six decimals."""
    whole = sum(weight[w] for w in t.words)
    own = F.array(*[F.struct(F.lit(w).alias("w"), F.lit(weight[w] / whole).alias("x")) for w in t.words])

    def share(start: Column) -> Column:
        there = F.zip_with(_at(start, len(t.words)), own, lambda a, b: F.when(a == b["w"], b["x"]).otherwise(0.0))
        return F.round(F.aggregate(there, F.lit(0.0), lambda total, x: total + x), 6)

    return share


def rarity(df: DataFrame, vocabulary: Sequence[str], text_col: str) -> dict[str, float]:
    """ln(1 + (1 + N) / (1 + df)) of each word of the vocabulary over all rows; the result has one number a word."""
    present = df.select(F.array_intersect(words_of(F.col(text_col)), _literal(vocabulary)).alias("w"))
    n = F.count(F.lit(1))
    row = present.agg(n.alias("n"), *[F.count_if(F.array_contains("w", v)).alias(f"c{i}") for i, v in enumerate(vocabulary)]).first()
    return {v: math.log(1 + (1 + row["n"]) / (1 + row[f"c{i}"])) for i, v in enumerate(vocabulary)}


def scan_licences(
    df: DataFrame,
    base: Sequence[Template] = BASE,
    notices: Sequence[Template] = NOTICES,
    coverage: float = COVERAGE,
    indexed_share: float = INDEXED,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """id, n_words, n_base, first_word, last_word, base_labels, labels and score of every row.

    n_base counts all places of base phrases, first_word and last_word are the smallest and largest of their starts.
    labels are the base labels and those of confirmed notices, distinct, sorted, comma-joined. score, if a notice is
    confirmed: the largest share of a notice's weight that stands (at least coverage); 0.5 with base phrases alone; else 0.
    A notice counts where all its places lie within the text.

    Null and empty texts have no words. Repeated rows stay rows; an empty table gives an empty result; other columns do
    not matter, whatever their names.
    """
    templates = [*base, *notices]
    vocabulary = sorted({w for t in templates for w in t.words})
    weight = rarity(df, vocabulary, text_col)
    indexed = []  # of each template: places of its index words, of those that starts are taken from, and the least weight
    for t in templates:
        places = sorted(range(len(t.words)), key=lambda j, t=t: (-weight[t.words[j]], t.words[j], j))
        if t.base:
            indexed.append((t, places, places[:1], 0.0))
            continue
        whole, lack = sum(weight[w] for w in t.words), 1 - coverage + 1e-6
        upto = lambda share: next((n for n in range(1, len(places) + 1) if sum(weight[t.words[j]] for j in places[:n]) > share * whole), len(places))  # noqa: B023, E731
        index = places[: max(upto(lack), upto(indexed_share))]
        indexed.append((t, index, places[: upto(lack)], sum(weight[t.words[j]] for j in index) - lack * whole))
    rare = sorted({t.words[j] for t, _, js, _ in indexed for j in js})

    words = words_of(F.col(text_col))
    rows = df.select(F.col(id_col).alias("l_id"), words.alias("l_words"))
    # the file's postings: places of indexed words only
    postings = F.when(
        F.arrays_overlap("l_words", _literal(rare)),
        F.filter(F.transform("l_words", lambda w, i: F.struct(w.alias("w"), i.alias("i"))), lambda x: x["w"].isin(rare)),
    )
    rows = rows.select("l_id", "l_words", postings.alias("l_post"))

    columns = {}
    for k, (t, index, js, least) in enumerate(indexed):
        starts = F.array_distinct(F.concat(*[_starts(t, j) for j in js]))
        if t.base:
            columns[f"b{k}"] = F.coalesce(F.filter(starts, _stands(t.words)), F.array().cast("array<int>"))
        else:
            met = F.filter(starts, _met(t, index, weight, least - 1e-9))
            checked = F.transform(F.filter(met, _keyed(t)), _share(t, weight))
            columns[f"n{k}"] = F.coalesce(F.array_max(F.filter(checked, lambda x: x >= coverage)), F.lit(0.0))
    found = rows.select("l_id", F.size("l_words").cast("long").alias("n_words"), *[c.alias(n) for n, c in columns.items()])
    places = F.concat(*[F.col(f"b{k}") for k, t in enumerate(templates) if t.base])
    labels = lambda some: F.array_join(F.array_sort(F.array_distinct(F.filter(F.array(*some), lambda x: x.isNotNull()))), ",")
    of_base = [F.when(F.size(f"b{k}") > 0, F.lit(t.label)) for k, t in enumerate(templates) if t.base]
    of_notices = [F.when(F.col(f"n{k}") > 0, F.lit(t.label)) for k, t in enumerate(templates) if not t.base]
    best = F.greatest(*[F.col(f"n{k}") for k, t in enumerate(templates) if not t.base])
    return found.select(
        F.col("l_id").alias(id_col),
        "n_words",
        F.size(places).cast("long").alias("n_base"),
        F.array_min(places).cast("long").alias("first_word"),
        F.array_max(places).cast("long").alias("last_word"),
        labels(of_base).alias("base_labels"),
        labels([*of_base, *of_notices]).alias("labels"),
        F.least(F.lit(1.0), F.greatest(best, F.when(F.size(places) > 0, F.lit(0.5)).otherwise(F.lit(0.0)))).alias("score"),
    )
