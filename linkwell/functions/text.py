"""Normalization of names, addresses and countries as column expressions.

Everything but Indic transliteration runs on built-in functions. Word boundaries are written as
look-arounds over letters, digits and underscore, so that results do not depend on the JDK.
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scripts import to_latin

W = r"[\p{L}\p{N}_]"
B, E = rf"(?<!{W})", rf"(?!{W})"

# fixed values: patterns, words and abbreviations of the normalization rules
URL = r"(?i)(?:https?://\S+|www\.[a-zA-Z0-9\-\.]+\.[a-zA-Z]{2,}(?:/\S*)?|\b[a-zA-Z0-9\-\.]+\.(?:com|org|net|in|co|io|biz|info|us|edu|gov)\b)"
HANDLE = rf"@{W}+"
PLACEHOLDER = r"(?i)^(?:null|<null>|nan|n/a|none)$"
LEGAL_SUFFIXES = [
    "incorporated", "inc", "corporation", "corp", "private limited", "pvt ltd", "pvt limited", "private ltd",
    "limited", "ltd", "private", "pvt", "limited liability company", "limited liability partnership",
    "pllc", "llc", "llp", "lp", "company", "co", "public limited company", "plc",
    "gmbh", "sarl", "sas", "sa", "bv", "nv", "srl", "spa",
    "limiteDa", "limiteda", "limidhedh", "limidhed", "prAiveTa", "praiveta", "bhiraivedh", "bhiraived",
]
LANDMARK = rf"(?i){B}(?:near|behind|nr|opp|opposite|next\s+to|pass\s+ke\s+pass|phatak\s+ke\s+pass|ke\s+pass|in\s+front\s+of|adjacent\s+to|beside|c/o){E}"
PIN, ZIP = rf"{B}[1-9]\d{{5}}{E}", rf"{B}\d{{5}}(?:-\d{{4}})?{E}"
ABBREVIATIONS = {
    "st": "street", "str": "street", "rd": "road", "ave": "avenue", "av": "avenue", "apt": "apartment", "blvd": "boulevard",
    "dr": "drive", "ln": "lane", "ct": "court", "fl": "floor", "flr": "floor", "ste": "suite", "bldg": "building",
    "pkwy": "parkway", "pl": "place", "hwy": "highway", "nr": "near", "opp": "opposite", "hn": "house number",
}


def _accents() -> tuple[str, str]:
    """Latin letters that decompose into one plain letter and marks, and those letters."""
    pairs = []
    for code in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        plain = [c for c in unicodedata.normalize("NFKD", chr(code)) if not unicodedata.combining(c)]
        if len(plain) == 1 and plain[0] != chr(code):
            pairs.append((chr(code), plain[0]))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


_ACCENTED, _PLAIN = _accents()


def strip_marks(c: Column) -> Column:
    """Without diacritics: precomposed Latin letters become plain, combining marks go."""
    return F.regexp_replace(F.translate(c, _ACCENTED, _PLAIN), r"[̀-ͯ]", "")


def squeeze(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def _given(c: Column) -> Column:
    """Trimmed text; null for null, blank and placeholder values."""
    t = F.regexp_replace(c.cast("string"), r"^\s+|\s+$", "")
    return F.when((t != "") & ~t.rlike(PLACEHOLDER), t)


def embedded_url(name: Column) -> Column:
    """First URL of a name, else its first @handle, else null."""
    t = _given(name)
    first = lambda p: F.nullif(F.trim(F.regexp_extract(t, p, 0)), F.lit(""))
    return F.coalesce(first(URL), first(HANDLE))


def repair_digits(c: Column) -> Column:
    """5 for s and 6 for g, where the digit stands in or before letters."""
    for digit, letter in (("5", "s"), ("6", "g")):
        c = F.regexp_replace(c, rf"{B}{digit}([a-zA-Z]{{3,}}){E}", rf"{letter}$1")
        c = F.regexp_replace(c, rf"([a-zA-Z]+){digit}([a-zA-Z]+)", rf"$1{letter}$2")
    return c


_SUFFIX = rf"(?i){B}(?:{'|'.join(sorted(LEGAL_SUFFIXES, key=len, reverse=True))}){E}"


def normalize_name(name: Column, indic: bool = False) -> Column:
    t = _given(name)
    t = to_latin(t) if indic else t
    t = F.regexp_replace(F.regexp_replace(t, URL, " "), HANDLE, " ")
    t = F.lower(strip_marks(repair_digits(t)))
    t = F.regexp_replace(F.regexp_replace(t, "&", " and "), r"\s+\+\s+", " and ")
    t = F.regexp_replace(F.regexp_replace(t, _SUFFIX, " "), r"[^\p{L}\p{N}_\s]", " ")
    return F.coalesce(squeeze(t), F.lit(""))


def normalize_address(address: Column, indic: bool = False) -> Column:
    t = _given(address)
    t = to_latin(t) if indic else t
    t = F.regexp_replace(t, rf"(?i){B}(?:null|<null>|nan|n/a|none){E}", " ")
    t = squeeze(F.regexp_replace(F.lower(strip_marks(t)), r"[^\p{L}\p{N}_\s]", " "))
    table = F.create_map(*(F.lit(x) for pair in ABBREVIATIONS.items() for x in pair))
    words = F.transform(F.split(t, " "), lambda w: F.coalesce(F.try_element_at(table, w), w))
    return F.coalesce(F.array_join(words, " "), F.lit(""))


def normalize_country(country: Column) -> Column:
    t = _given(country)
    return F.coalesce(squeeze(F.regexp_replace(F.lower(t), r"[^a-z0-9\s\-]", " ")), F.lit(""))


def is_landmark(address: Column) -> Column:
    return F.coalesce(_given(address).rlike(LANDMARK), F.lit(False))


def postal_code(address: Column) -> Column:
    t = _given(address)
    first = lambda p: F.nullif(F.regexp_extract(t, p, 0), F.lit(""))
    return F.coalesce(first(PIN), first(ZIP))


def words(norm: Column) -> Column:
    """Tokens of a normalized text in order; none of an empty one."""
    return F.filter(F.split(norm, " "), lambda w: w != "")


def token_set(norm: Column) -> Column:
    return F.array_sort(F.array_distinct(words(norm)))


def char_ngrams(norm: Column, n: int) -> Column:
    """Distinct character n-grams; a shorter text is its own only one, an empty one has none."""
    many = F.transform(F.sequence(F.lit(1), F.length(norm) - n + 1), lambda i: F.substring(norm, i, F.lit(n)))
    return F.when(norm == "", F.array().cast("array<string>")).when(F.length(norm) < n, F.array(norm)).otherwise(F.array_distinct(many))


def name_from_url(raw: Column) -> Column:
    """A name out of a URL or handle, for names that are nothing else."""
    t = F.regexp_replace(F.lower(F.coalesce(raw, F.lit(""))), r"https?://|www\.|\.(?:com|org|net|in|co|io|biz|info|us|edu|gov)\b|@|[^\p{L}\p{N}_\s]", " ")
    return F.trim(t)
