"""Secrets in texts: rules for known forms and character Markov models for random strings.

The base rules find assignments to names such as password or token, cloud access keys and long runs
of hex digits. The method adds spans of kind random: runs of RUN key characters are scored by two
Markov models of characters (each given the two before it), one of random strings and one of
ordinary identifiers and words; the mean log-likelihood ratio per character decides. Both models
are trained, with back-off to lower orders, on labelled samples: strings drawn from a seeded generator over
the usual key alphabets, and identifiers joined from common words in the usual styles, long words, rules
and dates.

Cases: a null text counts as empty and has no spans; other columns pass through; repeated rows give
repeated results; an empty table gives an empty result. Offsets are code points, ends exclusive.
"""

from __future__ import annotations

import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import byte_slices, filled

KINDS = ("assign", "access", "hex", "random")
_NAMES = ("passw", "secret", "token", "key")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']? *[:=] *["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"[0-9a-f]{24,}")
_RUN = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
BACK = 8  # weight of the lower order against observed counts
LEAST_RATIO = 1.8  # mean natural log-likelihood ratio per character from which a run counts as random
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
_AT = {c: i + 1 for i, c in enumerate(ALPHABET)}  # 0 stands for the place before the first character
_N = len(ALPHABET) + 1
# fixed value: common words that the labelled identifiers are joined from
WORDS = (
    "get set add remove update create delete find list count index value name user account order item price total "
    "first last next previous current start end begin stop open close read write load save file path folder image "
    "text string number integer float double array table column row key map hash node tree graph edge link page "
    "request response server client session config option default error warning message event handler callback "
    "service manager factory builder provider controller model view data source target type class object function "
    "method parameter argument result status state version release test check valid enable disable max min size "
    "length width height time date year month day hour minute second the and for with from this that into over"
).split()

# fixed value: parts of long words in other languages
PARTS = (
    "donau dampf schiff fahrt gesellschaft versicherung recht schutz arbeit geschwindigkeit begrenzung kraft wagen haft pflicht bund land wirtschaft "
    "freund schaft zeug haus tür schlüssel anti constitution nelle ment internation alis ation electro encefalo grafista mente miento dad respons "
    "abilidad tele comunica ciones des oxy ribo nucle ic acid counter revolution ary hood ness able straße gegen stand ver ein ung heit keit lich"
).replace("ü", "ue").replace("ß", "ss").split()


def labelled_samples(seed: int = 20) -> tuple[list[str], list[str]]:
    """(random strings, ordinary identifiers) to learn from."""
    rng = random.Random(seed)
    lower, upper, digits = ALPHABET[:26], ALPHABET[26:52], ALPHABET[52:62]
    alphabets = [lower + upper + digits, ALPHABET, upper + digits, lower + digits]
    more = [upper + "234567", digits + upper[:6], digits + lower[:6]]
    strings = ["".join(rng.choices(a, k=rng.randint(20, 60))) for a in alphabets for _ in range(1500)]
    plain = []
    for _ in range(6000):
        words = [rng.choice(WORDS) for _ in range(rng.randint(2, 6))]
        style = rng.randrange(6)
        text = {
            0: "_".join(words),
            1: "-".join(words),
            2: words[0] + "".join(w.capitalize() for w in words[1:]),
            3: "".join(w.capitalize() for w in words),
            4: "_".join(words).upper(),
            5: "/".join(words),
        }[style]
        plain.append(text + (str(rng.randint(0, 2030)) if rng.random() < 0.25 else ""))
    strings += ["".join(rng.choices(a, k=rng.randint(20, 60))) for a in more for _ in range(1500)]
    for _ in range(2000):  # long words, rules of repeated marks, dates
        word = "".join(rng.choices(PARTS, k=rng.randint(2, 5)))
        mark = rng.choice([rng.choice(ALPHABET), "".join(rng.choices("+/_=-", k=2))])
        date = "-".join(str(rng.randint(1, 99)).zfill(2) for _ in range(rng.randint(4, 9)))
        plain += [rng.choice([word, word.capitalize(), word.upper()]), mark * rng.randint(10, 40), rng.choice("-=_+/") * rng.randint(20, 60), date]
    return strings, plain


class Markov:
    """Second-order character model over ALPHABET, backed off to first order and single characters, as log probabilities."""

    def __init__(self, samples: list[str]):
        counts = np.zeros((_N, _N, _N))
        for text in samples:
            a = b = 0
            for c in text:
                x = _AT[c]
                counts[a, b, x] += 1
                a, b = b, x
        two, one = counts.sum(axis=0), counts.sum(axis=(0, 1)) + 1
        one = one / one.sum()
        two = (two + BACK * one) / (two.sum(axis=1, keepdims=True) + BACK)
        self.log = np.log((counts + BACK * two) / (counts.sum(axis=2, keepdims=True) + BACK))


_ratio: list = []


def ratio_table() -> list:
    """log P(random) - log P(ordinary) of each character given the two before it; trained once a process."""
    if not _ratio:
        strings, plain = labelled_samples()
        _ratio.append((Markov(strings).log - Markov(plain).log).tolist())
    return _ratio[0]


def randomness(text: str, table: list) -> float:
    """Mean log-likelihood ratio per character of a text over ALPHABET."""
    a = b = 0
    total = 0.0
    for c in text:
        x = _AT[c]
        total += table[a][b][x]
        a, b = b, x
    return total / max(1, len(text))


def scan(text: str, table: list) -> list[tuple[str, int, int, str, float]]:
    """(kind, start, end, secret, score) of a text, by start, then kind as in KINDS."""
    found = []
    low = text.lower()
    if any(n in low for n in _NAMES):
        found += [("assign", m.start(), m.end(), m[2], 1.0) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [("access", m.start(), m.end(), m[0], 1.0) for m in _ACCESS.finditer(text)]
    found += [("hex", m.start(), m.end(), m[0], 1.0) for m in _HEX.finditer(text)]
    taken = sorted((s, e) for _, s, e, _, _ in found)
    for m in _RUN.finditer(text):
        run = m[0]
        score = randomness(run, table)
        if score >= LEAST_RATIO and not any(s < m.end() and m.start() < e for s, e in taken):
            found.append(("random", m.start(), m.end(), run, score))
    return sorted(found, key=lambda f: (f[1], KINDS.index(f[0])))


def find_secrets(docs: DataFrame, text_col: str = "text", out: str = "secrets") -> DataFrame:
    """docs with out, the array of spans (kind, start, end, secret, score) by start, then kind."""
    docs = docs.drop(out)
    at = docs.columns.index(text_col)
    fields = [("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("secret", pa.string()), ("score", pa.float64())]
    kind = pa.list_(pa.struct(fields))

    def run(batches):
        table = ratio_table()
        names = [n for n, _ in fields]
        for batch in batches:
            for a, n in byte_slices(batch.column(at)):
                part = batch.slice(a, n)
                spans = [[dict(zip(names, f, strict=True)) for f in scan(t, table)] for t in filled(part.column(at)).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(spans, kind)], [*part.schema.names, out])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(run, f"{schema}, `{out}` array<struct<kind:string,start:bigint,end:bigint,secret:string,score:double>>")
