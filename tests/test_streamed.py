"""Candidate lists come out of slices of queries that the externals pass; the pairs are those of the four strategies, listed, scored and cut."""

import random

import numpy as np
import pytest

from linkwell.functions.similarity import token_sets
from linkwell.operators import blocking as B
from linkwell.operators import streamed
from linkwell.operators.normalize import add_phonetic, normalize_entities


def listed(s1, ext, k, floor):
    """The candidates by way of a list of all pairs."""
    s1, ext = B.with_fallback_names(s1), B.with_fallback_names(ext)
    pairs = B.unite(
        token=B.token_candidates(s1, B.token_index(ext, floor=floor)),
        phonetic=B.phonetic_candidates(s1, B.phonetic_index(ext)),
        postal_address=B.address_candidates(s1, B.postal_index(ext), B.address_index(ext, floor=floor)),
        neighbourhood=B.neighbour_candidates(s1, ext, 10),
    )
    return B.top_k(B.pre_score(B.same_country(pairs, s1, ext), s1, ext), k)


@pytest.fixture(scope="module")
def odd(spark):
    """Names of any length, without words or nothing but a URL, addresses of many words, countries that are missing, blank or only on one side."""
    draw = random.Random(9)
    word = lambda: "".join(draw.choice("abeß中") for _ in range(draw.choice([1, 2, 3, 5, 9])))
    text = lambda *many: " ".join(word() for _ in range(draw.choice(many)))
    rows = []
    for i in range(300):
        name = draw.choice([text(1, 3, 6, 6, 6), text(6), text(12, 20, 30, 90), "www.acme-bolts.com", "", None, "harbour bolts"])
        address = draw.choice([text(5, 14, 14), text(60), "near 12 copper road", None]) if i % 4 else f"{text(3)} {100000 + i % 5}"
        rows.append((f"S{i % 3 + 1}-{i}", name, address, draw.choice(["us", "us", "india", "", None, "peru" if i % 3 else "mali"])))
    kept = add_phonetic(normalize_entities(spark.createDataFrame(rows, "entity_id string, business_name string, business_address string, country string")))
    return kept.filter("entity_id like 'S1%'"), kept.filter("entity_id not like 'S1%'")


@pytest.mark.parametrize("k, floor, chunk", [(5, 500, 1 << 17), (40, 20, 50)])
def test_candidates_equal_listed_pairs(odd, monkeypatch, k, floor, chunk):
    monkeypatch.setattr(streamed, "CHUNK", chunk)
    rows = lambda df: sorted((r["s1"], r["id"], r["strategies"], r["score"]) for r in df.collect())
    got, want = rows(B.candidates(*odd, k=k, floor=floor)), rows(listed(*odd, k, floor))
    assert len(want) > 300 and got == want


def test_candidates_shuffle_no_pairs(odd):
    plan = B.candidates(*odd, k=5)._jdf.queryExecution().executedPlan().toString()
    assert not [line for line in plan.split("\n") if "Exchange hashpartitioning(" in line and ("(s1#" in line or "(id#" in line)]


def test_token_sets_of_one_name_against_many():
    draw = random.Random(3)
    name = lambda: " ".join("".join(draw.choice("abé") for _ in range(draw.choice([1, 2, 3, 9]))) for _ in range(draw.choice([0, 1, 3, 6, 8, 16, 25])))
    asked, found = [name() for _ in range(60)], [name() for _ in range(200)]
    chars, words = {}, {}
    patterns = [streamed.Pattern(t, chars, words) for t in asked]
    texts, worth = streamed.Texts(found + asked, chars, words), np.zeros(len(words) + 1, np.int64)
    for p in patterns:
        p.prepare(chars, words, worth)
        assert p.token_set(texts, np.arange(len(texts.names)), worth).tolist() == token_sets([p.name] * len(texts.names), texts.names)
        worth[p.ids] = 0
