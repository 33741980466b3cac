"""Writing systems of texts and romanization of Indic ones."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# fixed values: first code point of each Indic block; the nine blocks share one layout of 128 places
BLOCKS = {
    "devanagari": 0x0900, "bengali": 0x0980, "gurmukhi": 0x0A00, "gujarati": 0x0A80, "oriya": 0x0B00,
    "tamil": 0x0B80, "telugu": 0x0C00, "kannada": 0x0C80, "malayalam": 0x0D00,
}
# fixed values: ITRANS spellings by place in a block
CONSONANTS = dict(zip(range(0x15, 0x3A), "k kh g gh ~N ch Ch j jh ~n T Th D Dh N t th d dh n n p ph b bh m y r r l L L v sh Sh s h".split(), strict=True))
VOWELS = {0x05: "a", 0x06: "A", 0x07: "i", 0x08: "I", 0x09: "u", 0x0A: "U", 0x0B: "RRi", 0x0E: "e", 0x0F: "e", 0x10: "ai", 0x12: "o", 0x13: "o", 0x14: "au", 0x0D: "e", 0x11: "o"}
SIGNS = {0x3E: "A", 0x3F: "i", 0x40: "I", 0x41: "u", 0x42: "U", 0x43: "RRi", 0x45: "e", 0x46: "e", 0x47: "e", 0x48: "ai", 0x49: "o", 0x4A: "o", 0x4B: "o", 0x4C: "au"}
MARKS = {0x01: ".N", 0x02: "M", 0x03: "H"}
VIRAMA, NUKTA = 0x4D, 0x3C
# fixed values: Tamil stops, which have one letter for four sounds, and two letters left as they are
TAMIL = {0x15: "gh", 0x1A: "ch", 0x1F: "Dh", 0x24: "dh", 0x2A: "bh"}
TAMIL_KEPT = {0x29, 0x31}


def script_of(text: Column) -> Column:
    """empty, latin, unknown, one Indic script, or mixed."""
    flags = {"latin": text.rlike(r"[A-Za-zÀ-ɏ]")} | {n: text.rlike(rf"[\x{{{a:04X}}}-\x{{{a + 127:04X}}}]") for n, a in BLOCKS.items()}
    found = F.filter(F.array(*(F.when(c, F.lit(n)) for n, c in flags.items())), lambda x: x.isNotNull())
    ascii_only = F.when(text.rlike("[A-Za-z0-9]"), "latin").otherwise("unknown")
    other = F.when(F.size(found) == 0, "unknown").when(F.size(found) == 1, F.get(found, F.lit(0))).otherwise("mixed")
    return F.when(text.isNull() | ~text.rlike(r"\S"), "empty").when(~text.rlike(r"[^\x00-\x7F]"), ascii_only).otherwise(other)


def _block(c: str) -> tuple[str, int] | None:
    code = ord(c)
    if not 0x0900 <= code <= 0x0D7F:
        return None
    return next(((n, code - a) for n, a in BLOCKS.items() if a <= code < a + 128), None)


def romanize(text: str) -> str:
    """Indic letters as ITRANS: a consonant carries an a unless a vowel sign or a virama follows."""
    out, i = [], 0
    while i < len(text):
        at = _block(text[i])
        if at is None:
            out.append(text[i])
            i += 1
            continue
        name, place = at
        nxt = _block(text[i + 1]) if i + 1 < len(text) else None
        if name == "tamil" and place in TAMIL_KEPT:
            out.append(text[i])
        elif place in CONSONANTS:
            sound = TAMIL.get(place, CONSONANTS[place]) if name == "tamil" else CONSONANTS[place]
            out.append(sound)
            follow = nxt[1] if nxt and nxt[0] == name else None
            if follow == NUKTA:
                i += 1
                after = _block(text[i + 1]) if i + 1 < len(text) else None
                follow = after[1] if after else None
            if follow == VIRAMA:
                i += 1
            elif follow in SIGNS:
                out.append(SIGNS[follow])
                i += 1
            else:
                out.append("a")
        elif 0x66 <= place <= 0x6F:
            out.append(str(place - 0x66))
        else:
            out.append(VOWELS.get(place) or SIGNS.get(place) or MARKS.get(place) or ("" if place in (VIRAMA, NUKTA) else text[i]))
        i += 1
    return "".join(out)


@F.pandas_udf(StringType())
def _romanized(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: t if t is None or t.isascii() else romanize(t))


def to_latin(text: Column) -> Column:
    """Romanized text; anything but Indic letters stays."""
    return _romanized(text)
