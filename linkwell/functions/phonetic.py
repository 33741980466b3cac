"""Sound-alike forms: phonetic reduction, its n-gram similarity, and a soundex in which every vowel, H, W and Y parts equal codes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import B, E, char_ngrams, squeeze

# fixed values: regional spellings of legal suffixes, then rewrites in order
SUFFIXES = [
    r"praivarr\s+limirrad", r"praibheta\s+limiteDa", r"praibheta\s+limiteda", "praibheta", "praiveta", "praivet", "praivarr",
    "limirrad", "limidhedh", "limidhed", "limiteDa", "limiteda", "bhiraivedh", "bhiraived",
]
NASALS = [(rf"imga{E}", "ing"), (rf"mga{E}", "ng"), (rf"nga{E}", "ng"), ("mga", "ng"), ("m(?=[b-df-hj-np-tv-z])", "n")]
CONSONANTS = [
    ("ph", "f"), ("v", "w"), ("bh", "b"), ("dh", "d"), ("th", "t"), ("kh", "k"), ("gh", "g"), ("ch", "c"), ("sh", "s"),
    ("z", "s"), ("c([eiy])", "s$1"), ("c", "k"), ("q", "k"), ("x", "ks"),
]
VOWELS = [("ee|ea|ie|ei|ii", "i"), ("oo|ou|uu", "u"), ("ai|ay", "e"), ("au|aw", "o")]
FINAL_A = r"(\S[bcdfghjklmnpqrstvwxz])a(?=\s|$)"
# fixed value: soundex codes of A to Z, 0 for letters without one
CODES = "01230120022455012623010202"


def reduced(norm: Column) -> Column:
    """Phonetically reduced form of a normalized name."""
    t = F.trim(F.lower(F.coalesce(norm, F.lit(""))))
    for word in SUFFIXES:
        t = F.regexp_replace(t, f"(?i){B}{word}{E}", "")
    for pattern, put in [*NASALS, *CONSONANTS, *VOWELS, (r"(.)\1+", "$1")]:
        t = F.regexp_replace(t, pattern, put)
    return squeeze(F.regexp_replace(squeeze(t), FINAL_A, "$1"))


def applies(script: Column) -> Column:
    """Whether names of a script are to be reduced: any but Latin and the unknown."""
    return F.coalesce(~F.lower(F.trim(script)).isin("latin", "empty", "unknown", "none", ""), F.lit(False))


def jaccard(a: Column, b: Column, both_empty: float) -> Column:
    """Of two arrays of distinct items; 0 if one is empty, both_empty if both are."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(both_empty)).otherwise(F.size(F.array_intersect(a, b)) / union)


def similarity(a: Column, b: Column, n: int = 2) -> Column:
    """Jaccard similarity of the character n-grams of both reduced forms; 1 if both are empty."""
    return jaccard(char_ngrams(reduced(a), n), char_ngrams(reduced(b), n), 1.0)


def soundex(text: Column) -> Column:
    """Letter and three digits over the letters A to Z alone; equal codes collapse only where they touch. Empty without such a letter."""
    letters = F.regexp_replace(F.upper(text), "[^A-Z]", "")
    codes = F.translate(letters, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", CODES)
    rest = F.regexp_replace(F.regexp_replace(F.regexp_replace(codes, r"(.)\1+", "$1"), "^.", ""), "0", "")
    return F.when(letters == "", "").otherwise(F.rpad(F.concat(F.left(letters, F.lit(1)), F.left(rest, F.lit(3))), 4, "0"))
