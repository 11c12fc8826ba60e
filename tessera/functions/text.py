"""Token and key expressions over noisy names and addresses; all built-in, so they stay in whole-stage codegen."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NON_WORD = r"[^\p{L}\p{N}]+"
# Legal-form words and the family of each.
LEGAL_FORMS = {
    "inc": "inc", "incorporated": "inc", "corp": "corp", "corporation": "corp", "co": "co", "company": "co", "llc": "llc", "llp": "llp",
    "pllc": "pllc", "ltd": "ltd", "limited": "ltd", "pvt": "pvt", "private": "pvt",
    "sarl": "sarl", "sas": "sas", "sasu": "sasu", "sa": "sa", "eurl": "eurl", "sci": "sci",
}
#: Consonant classes of the phonetic code; vowels, h and y are dropped.
PHONETIC_FROM, PHONETIC_TO = "bfpvwcgjkqsxzdtlmnraeiouyh", "1111122222222334556"


def tokens(text: Column, first: int | None = None) -> Column:
    """Lower-case words, or the first so many of them; none for null."""
    if first is None:
        return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), NON_WORD), lambda t: t != "")
    # the pattern stops after the words asked for: one piece more for an empty start, one for the rest
    pieces = F.slice(F.split(F.lower(F.coalesce(text, F.lit(""))), NON_WORD, first + 2), 1, first + 1)
    return F.slice(F.filter(pieces, lambda t: t != ""), 1, first)


def strip_legal_forms(words: Column) -> tuple[Column, Column]:
    """(kept, found) words, order and repeats preserved."""
    forms = list(LEGAL_FORMS)
    return F.filter(words, lambda t: ~t.isin(forms)), F.filter(words, lambda t: t.isin(forms))


def phonetic_code(word: Column) -> Column:
    """Classes of the consonants with adjacent repeats collapsed; empty for words beyond a-z."""
    coded = F.regexp_replace(F.translate(F.replace(word, F.lit("tion"), F.lit("sn")), PHONETIC_FROM, PHONETIC_TO), r"(.)\1+", "$1")
    return F.when(word.rlike("^[a-z]+$"), coded).otherwise(F.lit(""))


def char_ngrams(text: Column, low: int = 3, high: int = 5) -> Column:
    """Distinct n-grams of the text between single spaces; none for an empty text."""
    padded = F.concat(F.lit(" "), text, F.lit(" "))

    def of(n: int) -> Column:
        places = F.when(F.length(padded) >= n, F.sequence(F.lit(1), F.length(padded) - n + 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(places, lambda i: F.substring(padded, i, n))

    return F.when(text != "", F.array_distinct(F.concat(*[of(n) for n in range(low, high + 1)]))).otherwise(F.array().cast("array<string>"))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets: 1 if both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def containment(a: Column, b: Column) -> Column:
    """Share of a's distinct values in b; 0 for an empty a."""
    n = F.size(F.array_distinct(a))
    return F.when(n == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / n)
