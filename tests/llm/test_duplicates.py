"""Jaccard join, near vectors and components against brute force."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from linkwell.llm import components as stars
from linkwell.llm import jaccard_join, lattice, queries
from linkwell.llm.components import components


def roots(ids, links):
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def shingles(text, k):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if len(words) < k:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)}


def near_copies(seed, groups=12):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    texts = []
    for _ in range(groups):
        base = rng.choices(vocabulary, k=rng.choice([3, 8, 20, 60, 150]))
        for _ in range(rng.randint(1, 9)):
            words = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 25))):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            texts.append(" ".join(words))
    common = " ".join(rng.choices(vocabulary, k=50))
    texts += [common + " " + " ".join(rng.choices(vocabulary, k=rng.randint(5, 200))) for _ in range(40)]
    return texts + [None, "", " \t\n", "One", "one", "é É"]


@pytest.mark.parametrize(("k", "num", "seed"), [(4, 85, 1), (5, 80, 2)])
def test_jaccard_components(spark, k, num, seed):
    texts = near_copies(seed)
    rows = [(i, t, "x") for i, t in enumerate(texts)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, n string")
    got = {r["doc_id"]: r for r in jaccard_join.jaccard_components(frame, k=k, num=num, den=100).collect()}
    sets = {i: shingles(t, k) for i, t, _ in rows}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b])]
    want = roots(sets, links)
    assert {i: r["n_shingles"] for i, r in got.items()} == {i: len(s) for i, s in sets.items()}
    assert {i: r["component_id"] for i, r in got.items()} == want


def test_jaccard_cases(spark):
    schema = "doc_id long, text string"
    assert jaccard_join.jaccard_components(spark.createDataFrame([], schema)).count() == 0
    rows = [(None, "a b c d e f"), (5, "a b c d e f"), (5, "a b c d e f"), (3, "a b c d e f"), (7, None)]
    got = sorted(((r["doc_id"], r["component_id"]) for r in jaccard_join.jaccard_components(spark.createDataFrame(rows, schema)).collect()), key=str)
    assert got == [(3, 3), (5, 3), (5, 3), (7, 7), (None, None)]
    long = " ".join(str(i) for i in range(60_000))
    far = jaccard_join.jaccard_components(spark.createDataFrame([(1, long), (2, long + " x")], schema)).collect()
    assert {r["component_id"] for r in far} == {1}


def test_sketch_distance_is_a_lower_bound():
    rng = np.random.default_rng(4)
    for _ in range(50):
        a, b = (np.unique(rng.integers(0, 400, rng.integers(1, 200)).astype(np.uint64)) for _ in range(2))
        sketches = [jaccard_join._sketch(x, 64 << int(rng.integers(0, 4))) for x in (a, b)]
        x, y = (jaccard_join._folded(s, min(map(len, sketches))) for s in sketches)
        assert np.bitwise_count(x ^ y).sum() <= len(np.setxor1d(a, b))


@pytest.mark.parametrize(("num", "k"), [(80, 5), (85, 4), (60, 3)])
def test_linked_texts_post_a_common_segment(num, k):
    bands = jaccard_join.Bands(num, 100)
    texts = near_copies(num, 60)
    hashes, owner, first = jaccard_join._sets(pa.array(texts, pa.string()), k)
    text, keys = jaccard_join._segment_keys(hashes, owner, first, bands)
    posted = [set(keys[text == i].tolist()) for i in range(len(texts))]
    sets = [set(hashes[a:b].tolist()) for a, b in zip(first[:-1], first[1:], strict=True)]
    seen = 0
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and a != b and 100 * len(a & b) >= num * len(a | b):
                assert posted[i] & posted[j]
                seen += 1
    assert seen > 10


def test_large_groups_and_clusters_in_blocks(spark, monkeypatch):
    """One crowd of copies with edits, most of whose pairs stay below the threshold, in blocks of a few members."""
    monkeypatch.setattr(jaccard_join, "CHUNK", 8)
    monkeypatch.setattr(jaccard_join, "WEIGHT", 300)
    rng = random.Random(8)
    base = [f"w{i}" for i in range(60)]
    texts = []
    for _ in range(90):
        words = list(base)
        for _ in range(rng.choice([0, 1, 1, 2, 3])):
            words[rng.randrange(60)] = f"x{rng.randrange(9)}"
        texts.append(" ".join(words))
    sets = [shingles(t, 5) for t in texts]
    links = [(b, a) for a in range(90) for b in range(a) if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in jaccard_join.jaccard_components(frame).collect()}
    want = roots(range(90), links)
    assert 3 < len(set(want.values())) < 80 and got == want


def test_op7_query(spark, tmp_path):
    texts = near_copies(6, 8)
    spark.createDataFrame([(i + 10, t, "s") for i, t in enumerate(texts)], "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    sets = {i + 10: shingles(t, 4) for i, t in enumerate(texts)}
    links = [(b, a) for a in sets for b in sets if b < a and sets[a] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    want = roots(list(sets), links)
    rows = queries.QUERIES["op7_jaccard_join"](spark, str(tmp_path)).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows} == {i: (len(s), want[i]) for i, s in sets.items()}


def test_components(spark):
    links = [(1, 2), (2, 3), (10, 11), (3, 9), (20, 20)] + [(100 + i, 101 + i) for i in range(30)]
    got = {r["id"]: r["component_id"] for r in components(spark.createDataFrame(links, "a long, b long"), "a", "b").collect()}
    want = roots({x for p in links for x in p}, links)
    assert got == {i: r for i, r in want.items() if i != 20}


def test_e8_decoding():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(200, 8)) * 2
    own, other = lattice.decode(x)
    assert (own.sum(axis=1) % 4 == 0).all() and ((own % 2 == own[:, :1] % 2).all(axis=1)).all()
    near = np.linalg.norm(x - own / 2, axis=1)
    assert near.max() <= 1 + 1e-9  # the covering radius
    steps = (own[:, None] + lattice._STEPS[None]) / 2
    assert (np.linalg.norm(x[:, None] - steps, axis=2).min(axis=1) >= near - 1e-9).all()
    assert np.allclose(np.linalg.norm((other - own) / 2, axis=1), 2**0.5)


def test_near_vectors(spark, monkeypatch):
    monkeypatch.setattr(lattice, "CHUNK", 16)
    rng = np.random.default_rng(2)
    vectors, labels = [], []
    for g in range(12):
        base = rng.normal(size=64)
        for _ in range(int(rng.integers(1, 60))):
            vectors.append((base + rng.normal(size=64) * 0.1).tolist())
            labels.append(g % 3)
    vectors += [vectors[0], vectors[0], [0.0] * 64, None, [float("nan")] * 64, [None] * 64, [1.0, 2.0], [2.0, 4.0], vectors[1]]
    labels += [labels[0], labels[0], 0, 0, 0, 0, 1, 1, None]
    rows = [(i, v, x) for i, (v, x) in enumerate(zip(vectors, labels, strict=True))]
    got = {r["vec_id"]: r for r in lattice.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}

    def fine(v, x):
        return x is not None and v is not None and all(e is not None and np.isfinite(e) for e in v) and any(v)

    links = []
    for i, a, x in rows:
        for j, b, y in rows[:i]:
            if fine(a, x) and fine(b, y) and x == y and len(a) == len(b):
                if np.dot(a, b) / (np.linalg.norm(a) * np.linalg.norm(b)) >= 0.98:
                    links.append((j, i))
    degree = {i: sum(i in p for p in links) for i, _, _ in rows}
    found = sum(r["n_links"] for r in got.values())
    assert all(got[i]["n_links"] <= degree[i] for i in degree)
    assert found >= 0.99 * sum(degree.values())
    want = roots([i for i, _, _ in rows], links)
    assert {i: r["component_id"] for i, r in got.items()} == want
    assert all(r["kept"] == (i == r["component_id"]) for i, r in got.items())
    assert lattice.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


@pytest.mark.parametrize("few", [100, 2])
def test_component_plans_stay_small(spark, monkeypatch, few):
    """The driver keeps every plan of a round: none holds another one twice. Hot vertices (few = 2) give the same."""
    exchanges, write = [], stars.stage

    def noted(df, label):
        exchanges.append(len(re.findall(r"\bExchange ", df._jdf.queryExecution().executedPlan().toString())))
        return write(df, label)

    monkeypatch.setattr(stars, "stage", noted)
    monkeypatch.setattr(stars, "FEW", few)
    rng = random.Random(5)
    links = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 180)] + [(rng.randrange(200, 300), rng.randrange(200, 300)) for _ in range(80)] + [(7, 7), (None, 3), (5, 4), (4, 5)]
    got = components(spark.createDataFrame(links, "a long, b long"), "a", "b").collect()
    linked = [(a, b) for a, b in links if a is not None and a != b]
    want = roots({x for link in linked for x in link}, linked)
    assert len(got) == len(want) and {r["id"]: r["component_id"] for r in got} == want
    assert max(exchanges) <= 3
