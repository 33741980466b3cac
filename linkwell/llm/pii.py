"""Personal data in texts, with DataFrame functions only.

Regular expressions propose spans, checksums (Luhn for cards, mod 97 for IBANs) and ranges confirm
them, and words near a span raise its score. Base kinds are email, ip, card and phone; the method
adds iban (country code, check digits and 11 to 30 characters, in groups or not, mod 97 = 1) and
contact numbers without a plus sign (kind tel) where a telephone word stands close before them.

A text is split by a pattern, so that gaps and matches alternate; a span's place is the sum of the
lengths before it, taken in blocks of BLOCK so that many matches stay cheap. Patterns begin where a
run of their first class begins or the last match ended, which gives the leftmost non-overlapping
matches without trying every place of a long run.

Cases: a null text counts as empty and has no spans; every column but the text is passed through;
repeated rows give repeated results; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
IP_GOOD = r"^(?:0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])\.){3}0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"
CARD = r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){15,18}(?![ -]?[0-9])"
PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
IBAN_HEAD = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?=(?: ?[A-Z0-9]){11,30}(?![A-Za-z0-9]))"
IBAN_REST = (11, 30)  # characters after the head
TEL = r"(?<![0-9+])(?<![0-9][ ().-])\(?[0-9](?:[ ().-]{0,2}[0-9]){6,14}(?![0-9])"
BLOCK = 256
# fixed values: words whose presence shortly before a span makes it likelier
CONTEXT = {
    "email": "mail|contact|write|reach|kontakt|correo|courriel",
    "ip": "ip|address|host|server|login|adresse|servidor",
    "card": "card|visa|mastercard|credit|payment|karte|carte|tarjeta",
    "phone": "phone|call|tel|mobile|fax|telefon|appel|llame",
    "iban": "iban|account|bank|konto|compte|cuenta",
    "tel": "phone|telephone|mobile|fax|telefon|telefono",
}
BASE_SCORE = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.9, "tel": 0.35}
NEAR = 40  # characters before a span in which a context word counts
BOOST = 0.3
LEAST_SCORE = 0.5  # spans of added kinds below it are dropped; base kinds stay
BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "iban", "tel")


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0), lambda s, v: s + v)


def _let(value: Column, use) -> Column:
    """use(value) with value evaluated once, however often and in whatever lambda use refers to it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _before(lengths: Column) -> Column:
    """For each place of an int array the sum of what stands before it; lengths is a column or a bound variable."""
    n = F.size(lengths)
    blocks = F.sequence(F.lit(0), F.floor((n - 1) / BLOCK).cast("int"))

    def heads_of(sums: Column) -> Column:
        return F.transform(blocks, lambda b: F.when(b > 0, _sum(F.slice(sums, F.lit(1), b))).otherwise(0))

    def places(heads: Column) -> Column:
        def at(i: Column) -> Column:
            block = F.floor(i / BLOCK).cast("int")
            return F.get(heads, block) + F.when(i % BLOCK > 0, _sum(F.slice(lengths, block * BLOCK + 1, i % BLOCK))).otherwise(0)

        return F.transform(F.sequence(F.lit(0), n - 1), at)

    sums = F.transform(blocks, lambda b: _sum(F.slice(lengths, b * BLOCK + 1, F.lit(BLOCK))))
    whole = _let(sums, lambda x: _let(heads_of(x), places))
    return F.when(n > 0, whole).otherwise(F.array().cast("array<int>"))


def _digits(span: Column) -> Column:
    return F.regexp_replace(span, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a text of digits passes the Luhn check."""
    each = F.split(F.reverse(digits), "")
    total = F.aggregate(
        F.transform(F.filter(each, lambda d: d != ""), lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(F.when(d.cast("int") > 4, d.cast("int") * 2 - 9).otherwise(d.cast("int") * 2))),
        F.lit(0),
        lambda s, v: s + v,
    )
    return total % 10 == 0


def mod97(iban: Column) -> Column:
    """Whether an IBAN without blanks has remainder 1 (letters count 10 to 35, the first four characters go last)."""
    turned = F.concat(F.substring(iban, 5, 100), F.substring(iban, 1, 4))
    step = lambda r, c: F.when(c.rlike("[0-9]"), (r * 10 + c.try_cast("int")) % 97).otherwise((r * 100 + F.ascii(c) - 55) % 97)
    return F.aggregate(F.filter(F.split(turned, ""), lambda c: c != ""), F.lit(0), step) == 1


def _valid(kind: str, span: Column) -> Column:
    if kind == "ip":
        return span.rlike(IP_GOOD)
    if kind == "card":
        return luhn(_digits(span))
    if kind == "phone":
        return F.length(_digits(span)).between(8, 15)
    if kind == "tel":
        return F.length(_digits(span)).between(7, 15)
    return F.lit(True)


_PATTERN = {"email": EMAIL, "ip": IP, "card": CARD, "phone": PHONE, "iban": IBAN_HEAD, "tel": TEL}
_SPAN = "array<struct<kind:string,start:int,end:int,text:string,score:double>>"


def _longest_iban(window: Column) -> Column:
    """The longest valid IBAN a text begins with that ends on a word bound; empty if none."""
    ends = F.array(*(F.regexp_extract(window, rf"^[A-Z]{{2}}[0-9]{{2}}(?: ?[A-Z0-9]){{{n}}}(?![A-Za-z0-9])", 0) for n in range(IBAN_REST[1], IBAN_REST[0] - 1, -1)))
    good = F.filter(ends, lambda e: F.when(e != "", mod97(F.regexp_replace(e, " ", ""))).otherwise(F.lit(False)))
    return F.coalesce(F.get(good, F.lit(0)), F.lit(""))


def _ibans(text: Column, heads: Column) -> Column:
    """heads drawn out to whole IBANs; those without one, and those inside the IBAN before, are left out."""
    whole = F.transform(heads, lambda h: h.withField("text", _longest_iban(F.substring(text, h["start"] + 1, F.lit(4 + 2 * IBAN_REST[1] + 1)))))
    found = F.transform(F.filter(whole, lambda h: h["text"] != ""), lambda h: h.withField("end", h["start"] + F.length(h["text"])))
    none = F.array().cast(_SPAN)

    def step(kept: Column, h: Column) -> Column:
        return F.when(h["start"] >= F.coalesce(F.try_element_at(F.transform(kept, lambda k: k["end"]), F.lit(-1)), F.lit(0)), F.concat(kept, F.array(h))).otherwise(kept)

    return F.when(F.size(found) > 1, F.aggregate(found, none, step)).otherwise(found)


def _spans(kind: str, text: Column) -> Column:
    """Confirmed spans of one kind, in order."""
    pattern = _PATTERN[kind]

    def located(hit: Column, gaps: Column, starts: Column) -> Column:
        def span(h: Column, i: Column) -> Column:
            start = F.get(starts, i) + F.length(F.get(gaps, i))
            near = F.lower(F.right(F.get(gaps, i), F.lit(NEAR))).rlike(rf"(?<![a-z])(?:{CONTEXT[kind]})")
            score = F.least(F.lit(1.0), F.lit(BASE_SCORE[kind]) + F.when(near, BOOST).otherwise(0.0))
            return F.struct(F.lit(kind).alias("kind"), start.alias("start"), (start + F.length(h)).alias("end"), h.alias("text"), score.alias("score"))

        return F.transform(hit, span)

    def placed(hit: Column, gaps: Column) -> Column:
        steps = F.transform(hit, lambda h, i: F.length(F.get(gaps, i)) + F.length(h))
        return _let(steps, lambda x: _let(_before(x), lambda starts: located(hit, gaps, starts)))

    found = _let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda hit: _let(F.split(text, pattern, -1), lambda gaps: placed(hit, gaps)))
    good = _ibans(text, found) if kind == "iban" else F.filter(found, lambda s: _valid(kind, s["text"]))
    if kind not in BASE_KINDS:
        good = F.filter(good, lambda s: s["score"] >= LEAST_SCORE)
    return F.when(text.rlike(pattern), good).otherwise(F.array().cast(_SPAN))


def find_pii(docs: DataFrame, text_col: str = "text", out: str = "pii") -> DataFrame:
    """docs with out, the array of spans (kind, start, end, text, score) by kind as in KINDS, then start; end is exclusive, in code points."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    base = [_spans(k, text) for k in BASE_KINDS]
    rows = docs.withColumn(out, F.concat(*base, _spans("iban", text), _spans("tel", text)))
    # added spans that touch a span of an earlier kind are dropped
    clear = F.filter(
        F.col(out),
        lambda s: s["kind"].isin(*BASE_KINDS)
        | ~F.exists(F.col(out), lambda o: (o["start"] < s["end"]) & (s["start"] < o["end"]) & ((o["kind"] != s["kind"]) & ((s["kind"] == "tel") | o["kind"].isin(*BASE_KINDS)))),
    )
    return rows.withColumn(out, F.when(F.exists(F.col(out), lambda s: ~s["kind"].isin(*BASE_KINDS)), clear).otherwise(F.col(out)))


def masked(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with every span replaced by its kind in brackets, e.g. [EMAIL]; overlapping spans are masked as one.

    The text is cut where spans begin and end; the columns stay as they are, null texts stay null.
    """
    hold = "__pii"
    while hold in docs.columns:
        hold += "_"
    found = find_pii(docs, text_col, hold)
    text = F.col(text_col)
    order = F.array_sort(F.transform(hold, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    start = F.struct(F.array().cast("array<string>").alias("parts"), F.lit(0).alias("at"))

    def step(acc: Column, s: Column) -> Column:
        cut = F.substring(text, acc["at"] + 1, s["start"] - acc["at"])
        add = F.concat(acc["parts"], F.array(cut, F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]"))))
        return F.struct(F.when(s["start"] >= acc["at"], add).otherwise(acc["parts"]).alias("parts"), F.greatest(acc["at"], s["end"]).alias("at"))

    whole = F.aggregate(order, start, step, lambda acc: F.concat(F.array_join(acc["parts"], ""), F.substring(text, acc["at"] + 1, F.length(text))))
    return found.withColumn(text_col, F.when(F.size(hold) > 0, whole).otherwise(text)).drop(hold)
