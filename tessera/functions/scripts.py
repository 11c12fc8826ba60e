"""Script runs and a rough Latin skeleton of nine Indic scripts.

The nine blocks share one layout, so a letter is what the Devanagari letter at its offset is called in the character
database; its Latin spelling is derived from that name.
"""

from __future__ import annotations

import unicodedata
from collections import Counter
from collections.abc import Mapping
from functools import cache

import regex

# The scripts with the first code point of their blocks.
BLOCKS = {
    "Devanagari": 0x900, "Bengali": 0x980, "Gurmukhi": 0xA00, "Gujarati": 0xA80, "Oriya": 0xB00,
    "Tamil": 0xB80, "Telugu": 0xC00, "Kannada": 0xC80, "Malayalam": 0xD00,
}
# Consonants and vowels that are not spelt as they are named.
RESPELT = {
    "TT": "t", "TTH": "th", "DD": "d", "DDH": "dh", "NN": "n", "NNN": "n", "RR": "r", "LL": "l", "LLL": "zh", "SS": "sh",
    "VOCALIC R": "ri", "CANDRABINDU": "n", "ANUSVARA": "n", "VISARGA": "h", "NUKTA": "", "VIRAMA": "", "OM": "om",
}
VOWELS = ["A", "AA", "I", "II", "U", "UU", "E", "AI", "O", "AU"]
# Letters of single scripts that differ from the shared layout.
OWN = {
    "Gurmukhi": {"ੰ": "n", "ੱ": ""},
    "Tamil": {"ஏ": "ee", "ஓ": "oo", "ே": "ee", "ோ": "oo", "ஃ": ""},
    "Malayalam": {"ൺ": "n", "ൻ": "n", "ർ": "r", "ൽ": "l", "ൾ": "l", "ൿ": "k"},
}
DOUBLE_RRA = ("റ്റ", "ട്ട")  # Malayalam: pronounced as the second
LAST_LETTER, OM, FIRST_DIGIT = 0x4D, 0x50, 0x66

_RUN = regex.compile("|".join(rf"(\p{{Script={s}}}+)" for s in ["Latin", *BLOCKS]) + r"|[0-9]+|\S+")
_SCRIPTS = [None, "Latin", *BLOCKS]


def _spelling(offset: int) -> str | None:
    """Latin letters of the Devanagari sign at offset; None if it has none."""
    if FIRST_DIGIT <= offset < FIRST_DIGIT + 10:
        return str(offset - FIRST_DIGIT)
    if offset > LAST_LETTER and offset != OM:
        return None
    called = unicodedata.name(chr(BLOCKS["Devanagari"] + offset), "").removeprefix("DEVANAGARI ")
    for head in ("LETTER ", "VOWEL SIGN ", "SIGN ", "CANDRA ", "SHORT "):
        called = called.removeprefix(head)
    if called in RESPELT:
        return RESPELT[called]
    if called in VOWELS:
        return called.lower()
    stem = called[:-1]
    consonant = called.endswith("A") and stem.isalpha() and " LETTER " in unicodedata.name(chr(BLOCKS["Devanagari"] + offset))
    return RESPELT.get(stem, stem.lower()) if consonant else None


@cache
def letters(script: str) -> dict[int, str]:
    """The translation table of a script, for str.translate."""
    spelt = {offset: _spelling(offset) for offset in range(0x70)}
    table = {BLOCKS[script] + offset: s for offset, s in spelt.items() if s is not None}
    return table | {ord(c): s for c, s in OWN.get(script, {}).items()}


def runs(text: str) -> list[tuple[str, str]]:
    """(script, run) in order: Latin, an Indic script, Digit or Other; white space separates and is dropped."""
    out = []
    for m in _RUN.finditer(text):
        word = m[0]
        out.append(("Digit" if word.isdigit() else _SCRIPTS[m.lastindex] if m.lastindex else "Other", word))
    return out


def dominant(text: str) -> str:
    """The script of most characters, digits aside; the first of equals; 'None' if there is none."""
    counts: Counter[str] = Counter()
    for script, run in runs(text):
        if script != "Digit":
            counts[script] += len(run)
    return counts.most_common(1)[0][0] if counts else "None"


def skeleton(text: str) -> str:
    """Runs joined by single spaces, Indic ones in Latin letters; letters without a spelling stay."""
    out = []
    for script, run in runs(text):
        if script in BLOCKS:
            if script == "Malayalam":
                run = run.replace(*DOUBLE_RRA)
            run = run.translate(letters(script))
        if run:
            out.append(run)
    return " ".join(out)


def skeleton_of_words(words: list[str], learnt: Mapping[str, str] | None = None) -> str:
    """skeleton() of the words, those in a learnt dictionary replaced by its entry."""
    if not learnt:
        return skeleton(" ".join(words))
    return " ".join(learnt.get(w) or skeleton(w) for w in words)


def non_latin_share(text: str) -> float:
    """Share of the characters beyond white space that are neither Latin nor digits; 1 for a text without any."""
    counts: Counter[str] = Counter()
    for script, run in runs(text):
        counts[script] += len(run)
    total = counts.total() or 1
    return (total - counts["Latin"] - counts["Digit"]) / total
