"""Unicode normalisation and glued-name segmentation as Arrow kernels, with the dictionaries as plain arguments."""

from __future__ import annotations

import unicodedata
from collections.abc import Mapping

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql.functions import pandas_udf

from tessera.session import ship

# Letters that have no decomposition, and characters of no width.
LIGATURES = {"œ": "oe", "æ": "ae", "ø": "o", "đ": "d", "ł": "l", "ı": "i"}
NO_WIDTH = "​‌‍⁠﻿­"
SINGLE_LETTER_COST, LONGEST_WORD, MOST_PARTS = 12.0, 20, 4


def normalize(text: str | None) -> str:
    """NFKC, case folding, Latin diacritics folded, '&' between or beside words as 'and', punctuation and symbols as spaces, spaces collapsed."""
    s = unicodedata.normalize("NFKC", text or "").casefold()
    s = s.translate({ord(c): None for c in NO_WIDTH})
    if not s.isascii():
        s = "".join(LIGATURES.get(c, c) for c in s)
        s = unicodedata.normalize("NFC", "".join(c for c in unicodedata.normalize("NFD", s) if not 0x300 <= ord(c) <= 0x36F))
    words = s.split()
    s = " ".join("and" if w == "&" and len(words) > 1 else w for w in words)  # a text of "&" alone has no words
    return " ".join("".join(" " if unicodedata.category(c)[0] in "PS" else c for c in s).split())


def normalize_column(spark: SparkSession, text: Column) -> Column:
    ship(spark)

    @pandas_udf("string")
    def kernel(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: normalize(t if isinstance(t, str) else None))

    return kernel(text)


def segment(word: str, costs: Mapping[str, float]) -> list[str]:
    """The cheapest split of a glued word into vocabulary words and lone letters; [word] if the word is short, known or not
    of ASCII letters, or if that split has fewer than 2 or over MOST_PARTS parts or over one lone letter."""
    if len(word) < 7 or word in costs or not (word.isascii() and word.isalpha()):
        return [word]
    best: list[tuple[float, int]] = [(0.0, 0)]
    for end in range(1, len(word) + 1):
        ways = [(best[end - 1][0] + costs.get(word[end - 1], SINGLE_LETTER_COST), end - 1)]
        ways += [(best[at][0] + costs[word[at:end]], at) for at in range(max(0, end - LONGEST_WORD), end - 1) if word[at:end] in costs]
        best.append(min(ways))
    parts, end = [], len(word)
    while end:
        parts.insert(0, word[best[end][1] : end])
        end = best[end][1]
    fits = 2 <= len(parts) <= MOST_PARTS and sum(len(p) == 1 for p in parts) <= 1
    return parts if fits else [word]
