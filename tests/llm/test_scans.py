"""Decontamination, secrets, personal data, page texts and packing."""

import hashlib
import random
import re
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest

from linkwell.llm import decontaminate, html_text, op04_secrets, op06_pii, packing, pii, secrets, tokens
from linkwell.llm.op09_packing import tokenizer_path


def greedy_tiling(p, t, least):
    free_p, free_t, total = [True] * len(p), [True] * len(t), 0
    while True:
        best, places = 0, []
        for i in range(len(p)):
            for j in range(len(t)):
                n = 0
                while i + n < len(p) and j + n < len(t) and free_p[i + n] and free_t[j + n] and p[i + n] == t[j + n]:
                    n += 1
                if n > best:
                    best, places = n, [(i, j)]
                elif n and n == best:
                    places.append((i, j))
        if best < min(least, len(p)):
            return total
        for i, j in places:
            if all(free_p[i : i + best]) and all(free_t[j : j + best]):
                free_p[i : i + best], free_t[j : j + best] = [False] * best, [False] * best
                total += best


def test_tiling_against_brute_force():
    rng = random.Random(2)
    for _ in range(150):
        size = rng.randint(2, 12)
        p, t = [rng.randint(1, size) for _ in range(rng.randint(1, 30))], []
        for _ in range(rng.randint(0, 4)):
            a = rng.randint(0, len(p))
            t += p[a : rng.randint(a, len(p))] + [rng.randint(1, size) for _ in range(rng.randint(0, 4))]
        got = sum(n for _, _, n in decontaminate.tile(np.array(p, np.uint64), np.array(t, np.uint64)))
        assert got == greedy_tiling(p, t, 5)


def test_leaks(spark, monkeypatch):
    item = "one two three four five six seven eight nine ten eleven twelve"
    turned = "seven eight nine ten eleven twelve filler one two three four five six"
    docs = [(1, f"Before. {item.upper()}! After."), (2, turned), (3, "one two three four nothing else"), (4, None), (5, ""), (6, "tiny item"), (None, item), (1, item), (8, "x " * 40_000 + item)]
    frame = spark.createDataFrame([(i, t, 0.5) for i, t in docs], "doc_id long, text string, coverage double")
    bench = spark.createDataFrame([(7, item), (8, "tiny item"), (9, None), (10, "")], "item_id long, text string")
    for block in (8 << 20, 20):
        monkeypatch.setattr(decontaminate, "BLOCK_CHARS", block)
        got = sorted(((r["doc_id"], r["item_id"]) for r in decontaminate.leaks(frame, bench).collect()), key=str)
        assert got == sorted([(1, 7), (1, 7), (2, 7), (6, 8), (None, 7), (8, 7)], key=str)
        assert sorted(r["doc_id"] for r in decontaminate.decontaminate(frame, bench).collect()) == [3, 4, 5]
    assert decontaminate.leaks(frame, bench.limit(0)).count() == 0 and decontaminate.leaks(frame.limit(0), bench).count() == 0


def test_leaks_of_repeated_words():
    """An item and a text of one word each cost their lengths, not the product."""
    block = decontaminate.Block.of([(1, "la " * 3000), (2, "na " * 40 + "batman")], 5)
    found = list(block.compare(pa.array(["la " * 60_000, "na " * 30_000, "la " * 1000]), 5, 0.6))
    assert [(d, i) for d, i, *_ in found] == [(0, 1), (1, 2)] and found[0][2] == 1.0


SECRET = {
    "assign": re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII),
    "access": re.compile("AKIA[A-Z0-9]+"),
    "hex": re.compile("[0-9a-f]+"),
}


def secret_spans(text):
    out = []
    for n, (kind, pattern) in enumerate(SECRET.items()):
        for m in pattern.finditer(text or ""):
            if {"assign": lambda m=m: len(m[2]) >= 6, "access": lambda m=m: len(m[0]) >= 20, "hex": lambda m=m: len(m[0]) >= 24}[kind]():
                out.append((m.start(), n, f"{kind}:{m.start()}:{m.end()}"))
    return [s for _, _, s in sorted(out)]


def test_secrets_against_brute_force(spark, monkeypatch):
    rng = random.Random(1)
    parts = ["password", "Token", "api_key", "APIKEY", "secret", "=", ":", " ", '"', "'", "abcdef", "AKIA", "ABCDEFGHIJ1234567890", "0123456789abcdef", "é", "."]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 16))) for _ in range(600)] + [None, "", "a" * 30_000, "AKIA" * 2000]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    monkeypatch.setattr(op04_secrets, "table", lambda *a: frame)
    for r in op04_secrets.op4_secrets(spark, "").collect():
        want = secret_spans(texts[r["doc_id"]])
        assert r["base_sha256"] == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == [sum(s.startswith(k) for s in want) for k in SECRET]
    assert secrets.find_secrets(frame.limit(0)).count() == 0


def test_random_strings_against_identifiers():
    strings, plain = secrets.labelled_samples(seed=77)
    table = secrets.ratio_table()
    assert np.mean([secrets.randomness(s, table) >= secrets.LEAST_RATIO for s in strings]) > 0.9
    assert np.mean([secrets.randomness(s, table) >= secrets.LEAST_RATIO for s in plain]) < 0.01
    text = "id é kJ8sQ2mZpX7vLw3nRt9bYc4D and getUserAccountByOrderNumber2"
    assert [(k, text[s:e]) for k, s, e, _, _ in secrets.scan(text, table)] == [("random", "kJ8sQ2mZpX7vLw3nRt9bYc4D")]


def test_scan_finds_keys_of_every_alphabet():
    rng, table = random.Random(9), secrets.ratio_table()
    low, up, digits = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    for alphabet in (low + up + digits, secrets.ALPHABET, up + digits, low + digits, up + "234567", digits + "ABCDEF", low, up):
        keys = ["".join(rng.choices(alphabet, k=32)) for _ in range(100)]
        assert np.mean([("random", 3, 35) in [f[:3] for f in secrets.scan(f"is {k} .", table)] for k in keys]) > 0.9
    for plain in ("-" * 40, "=" * 40, "+-" * 20, "Donaudampfschifffahrtsgesellschaft", "INTERNATIONALIZATION_STRING", "2024-01-01-12-30-45-00"):
        assert secrets.scan(plain, table) == []


PII = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    return sum(d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(map(int, reversed(digits)))) % 10 == 0


def pii_spans(text):
    out = []
    for kind, pattern in PII.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            good = {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")), "card": 16 <= len(digits) <= 19 and luhn(digits), "phone": 8 <= len(digits) <= 15}[kind]
            if good:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


def test_pii_against_brute_force(spark, monkeypatch):
    rng = random.Random(3)
    parts = ["4111 1111 1111 1111", "a@b.co", "a@b.c%d@e.f.g", "1.2.3.4", "999.1.2.3.4", "1.2.3.4.5.6.7.8", "+1 (555) 123-4567", "+49-30", "é", "🙂", " ", "@", ".", "-", "+", "0", "5", "x", "GB82 WEST 1234 5698 7654 32", "00.0.0.255"]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 14))) for _ in range(600)] + ["a@b.c " * 700, "9" * 5000, "a" * 20_000 + "@", "+1" * 3000, None, ""]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    monkeypatch.setattr(op06_pii, "table", lambda *a: frame)
    query = op06_pii.op6_pii(spark, "")
    assert not re.search("Python|Pandas|Arrow", query._jdf.queryExecution().toString())
    for r in query.collect():
        want = pii_spans(texts[r["doc_id"]])
        assert r["base_sha256"] == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert [r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]] == [sum(s.startswith(k + ":") for s in want) for k in PII]


def test_pii_added_kinds_and_masking(spark):
    rows = [(1, "Pay DE89370400440532013000 or DE88370400440532013000.", "k"), (2, "Telephone 030 1234567, code 030 1234567890123456789", "k"), (3, "mail a@b.co now", "k"), (4, None, "k")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, kind string")
    found = {r["doc_id"]: [(s["kind"], s["text"]) for s in r["pii"]] for r in pii.find_pii(frame).collect()}
    assert found[1] == [("iban", "DE89370400440532013000")] and found[2][0][0] == "tel" and found[4] == []
    masked = {r["doc_id"]: r["text"] for r in pii.masked(frame).collect()}
    assert masked[3] == "mail [EMAIL] now" and masked[4] is None and "[IBAN]" in masked[1]
    assert pii.masked(frame).columns == frame.columns and pii.masked(frame.limit(0)).count() == 0


def test_iban_followed_by_capitals_and_digits(spark):
    a, b = "DE89 3704 0044 0532 0130 00", "GB82 WEST 1234 5698 7654 32"
    texts = [f"IBAN {a} BIC COBADEFFXXX", "DE89370400440532013000 BIC COBADEFFXXX", "DE89370400440532013000 2024", f"{a} {b} X", "DE87370400440532013000 2024", ""]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r["doc_id"]: [(s["text"], r["text"][s["start"] : s["end"]]) for s in r["pii"] if s["kind"] == "iban"] for r in pii.find_pii(frame).collect()}
    plain = "DE89370400440532013000"
    assert found == {i: [(x, x) for x in want] for i, want in enumerate([[a], [plain], [plain], [a, b], [], []])}
    assert {r["doc_id"]: r["text"] for r in pii.masked(frame).collect()}[0] == "IBAN [IBAN] BIC COBADEFFXXX"


def minimum_cut(unary, edges):
    best = None
    for code in range(1 << len(unary)):
        side = [bool(code >> i & 1) for i in range(len(unary))]
        cost = sum(max(0, u) if not s else max(0, -u) for u, s in zip(unary, side, strict=True)) + sum(c for i, j, c in edges if side[i] != side[j])
        best = cost if best is None else min(best, cost)
    return best


def test_cut_is_minimal():
    rng = random.Random(5)
    for _ in range(150):
        n = rng.randint(1, 8)
        unary = [rng.uniform(-4, 4) for _ in range(n)]
        edges = [(i, j, rng.uniform(0, 2)) for i in range(n) for j in range(i) if rng.random() < 0.5]
        side = html_text.cut(unary, edges)
        cost = sum(max(0, u) if not s else max(0, -u) for u, s in zip(unary, side, strict=True)) + sum(c for i, j, c in edges if side[i] != side[j])
        assert cost == pytest.approx(minimum_cut(unary, edges))


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body><header><h1>Site</h1></header>
<div id="cookie-notice">We use cookies. Accept them now please.</div><nav><ul><li><a href="/x">Home</a></li></ul></nav><!-- ad --><div class="ad">Buy this now, it is good.</div>
<article><h1>A title</h1><p><b>Some &eacute; bold</b>ness.<br><p>Two &lt;tags&gt;&nbsp;and   blanks, in a text that goes on.</p><aside>By the way, this is a side note.</aside></article>
<form><p>Fill this form, please do.</p></form><section class="comments"><p>I liked this very much. Great article indeed.</p></section><footer>&copy; me</footer>"""


def test_main_text():
    assert html_text.main_text(PAGE) == "A title Some é boldness. Two <tags> and blanks, in a text that goes on."
    assert html_text.main_text("") == "" and html_text.main_text("<p>") == "" and html_text.main_text("<!-- open") == ""
    assert html_text.main_text("<article>" + "<div>" * 3000 + "Deep text here, it is.") == "Deep text here, it is."


def test_icons_formulas_and_plain_text_are_read():
    page = "<article><p>An icon <svg width='1'/> here and <math/> there, it goes on.</p><p>The sum <math><mi>x</mi><mo>+</mo><mn>1</mn></math> is seen, as is <object>this one</object>.</p><xmp><b>a &amp; b</b> stay.</xmp><p>Last <svg><path/> words of it.</p></article>"
    assert html_text.main_text(page) == "An icon here and there, it goes on. The sum x+1 is seen, as is this one. <b>a &amp; b</b> stay. Last words of it."
    assert html_text.main_text("<article><p>Before it. <svg><title>no</title></svg> After it.</p></article>") == "Before it. After it."


BARE = """<body><div class="x1"><a href="/a">Start</a> <a href="/b">Topics</a> <a href="/c">Shop</a></div><div class="x2">We use cookies on this site, please accept them.</div>
<div class="x3"><h2>On rivers</h2><p>A river begins where rain and meltwater gather, and it grows with every stream that joins it on its way.</p><p><a href="/d">A map of rivers</a></p>
<p>Below the hills it slows, bends and drops the sand it carried, so that its banks shift from year to year.</p><p>At last it meets the sea, where its mud builds new land.</p></div>
<div class="x4">Buy boots now, they are cheap.</div><div class="x5"><p>Nice read, thanks a lot.</p></div></body>"""


def test_pages_whose_names_say_nothing():
    """The article is told by its words and place, and the cut keeps a linked line in it that the classifier alone would drop."""
    got = html_text.main_text(BARE)
    assert got.startswith("On rivers A river begins") and "A map of rivers" in got and got.endswith("builds new land.")
    texts, unary, _ = html_text.labelled(BARE)
    assert unary[texts.index("A map of rivers")] < 0
    assert not any(x in got for x in ("cookies", "boots", "Nice read", "Topics"))


def test_weak_names_do_not_decide():
    page = "<article><h1>Old law</h1><p class='legal-history'>The first of these laws was written down long ago.</p><p class='alert'>It has been changed many times since, as we shall see.</p></article><div class='notice'>Closed on Monday, please note.</div>"
    assert html_text.main_text(page) == "Old law The first of these laws was written down long ago. It has been changed many times since, as we shall see."
    assert html_text.main_text("<p>Fine.</p><p>One line of prose that stands here.</p><h2>End</h2>") == "Fine. One line of prose that stands here. End"


def test_deep_pages_take_time_in_proportion():
    began = time.time()
    assert html_text.main_text("<div>" * 30_000 + "</p>" * 30_000 + "Some text stands here.") == "Some text stands here."
    assert time.time() - began < 5


def test_extract_cases(spark):
    frame = spark.createDataFrame([(1, None, "u"), (2, PAGE, None), (None, "", "u"), (2, PAGE, None)], "page_id long, html string, text string")
    got = html_text.extract(frame).collect()
    assert [r["text"][:7] for r in got] == ["", "A title", "", "A title"] and html_text.extract(frame.limit(0)).count() == 0


def check_pack(pieces, expected, most_segments=None):
    by_doc, by_sequence = {}, {}
    for p in pieces:
        by_doc.setdefault(p["id"], []).append(p)
        by_sequence.setdefault(p["sequence_id"], []).append(p)
    for key, own in by_doc.items():
        own.sort(key=lambda p: p["start"])
        assert b"".join(bytes(p["ids"]) for p in own) == expected[key]
        assert [p["start"] for p in own] == [sum(x["length"] for x in own[:i]) for i in range(len(own))]
    padding = 0
    for own in by_sequence.values():
        own.sort(key=lambda p: p["offset"])
        total = sum(p["length"] for p in own)
        assert [p["offset"] for p in own] == [sum(x["length"] for x in own[:i]) for i in range(len(own))] and total <= 2048
        assert most_segments is None or len(own) <= most_segments
        padding += 0 if total & (total - 1) == 0 else 2048 - total
    assert set(by_doc) == set(expected) and padding == 0


def test_packing_round_trip(spark):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(tokenizer_path())
    rng = random.Random(6)
    texts = [" ".join(rng.choices(["alpha", "été", "x1", "🙂", "  ", "\n", "don't", "<|endoftext|>"], k=rng.choice([0, 1, 5, 80, 900, 6000]))) for _ in range(120)] + [None, ""]
    frame = spark.createDataFrame([(i, t, "o") for i, t in enumerate(texts)], "doc_id long, text string, offset string").repartition(3)
    expected = {i: np.array([*whole.encode(t or "", add_special_tokens=False).ids, 1], "<u4").tobytes() for i, t in enumerate(texts)}
    check_pack(packing.pack(frame, tokenizer_path()).collect(), expected)
    check_pack(packing.pack(frame, tokenizer_path(), segments=4).collect(), expected, 4)
    assert packing.pack(frame.limit(0), tokenizer_path()).count() == 0


def test_long_blanks_and_words_are_encoded():
    encode = tokens.Encoder(tokenizer_path())
    for text in (" " * 600_000, "a" + " " * 700_000 + "b", "x" * 300_000):
        assert encode(text).tolist() == encode.whole.encode(text, add_special_tokens=False).ids


def test_packer_keeps_only_what_waits():
    packer = packing.Packer(tokens=64, pool=8)
    packer.add(1, np.arange(64 * 500 + 3, dtype="<u4"), np.ones(64 * 500 + 3, np.int64))
    assert max(len(e[1]) for e in packer.examples if e) == 3
    packer.end()
    rows = sorted(packer.taken(), key=lambda r: r[1])
    assert [r[1] for r in rows][-2:] == [64 * 500, 64 * 500 + 2] and {r[4] for r in rows} == {64 * 500 + 3}


def test_packer_limits():
    packer = packing.Packer(tokens=64, segments=3, loss=20, pool=8)
    rng = random.Random(7)
    for i in range(200):
        n = rng.randint(1, 150)
        packer.add(i, np.arange(n, dtype="<u4"), np.array([rng.random() < 0.3 for _ in range(n)], np.int64))
    packer.end()
    rows = packer.taken()
    by = {}
    for key, start, length, ids, total, loss, sequence, offset in rows:
        assert np.frombuffer(ids, "<u4").tolist() == list(range(start, start + length))
        by.setdefault(sequence, []).append((length, loss))
    assert all(sum(n for n, _ in s) <= 64 and len(s) <= 3 and sum(x for _, x in s) <= 20 for s in by.values())
    assert zlib.crc32(b"") == 0 and sum(r[2] for r in rows) == sum(r[4] for r in {r[0]: r for r in rows}.values())
