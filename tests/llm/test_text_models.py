"""Classifiers and language ID: training, held-out results and odd rows."""

import random
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from linkwell.llm import langid, queries, subword

ODD = "doc_id long, text string, lang string, score string, lang_pred string"


def odd_rows(spark):
    rows = [(1, None, "en", "x", "y"), (2, "", None, None, None), (3, "123 !!", "en", None, None), (None, "the cat", None, None, None), (4, "a" * 50_000 + " the", "de", None, None), (4, "the", "de", None, None)]
    return spark.createDataFrame(rows, ODD)


def _texts(seed, words, n):
    rng = random.Random(seed)
    return [" ".join(rng.choices(words, k=rng.randint(20, 60))) for _ in range(n)]


EN = "the and of thing other with have which their about would there could people after first being through".split()
FR = "le les des une dans pour avec sont cette mais comme faire nous autre aussi leur bien entre".split()


def test_language_held_out():
    rows = [(lang, w.encode(), 1) for lang, words in (("en", EN), ("fr", FR)) for t in _texts(1, words, 60) for w in t.split()]
    net = langid.train(rows)
    column = pa.array(_texts(2, EN, 20) + _texts(3, FR, 20) + ["", None, "42 --"])
    sums, counts = langid.pooled(net, column)
    best = sums.argmax(axis=1)
    assert (best[:20] == 0).all() and (best[20:40] == 1).all()
    assert counts[40:].tolist() == [0, 0, 0]


def test_gradient_matches_differences():
    net = langid.Net.fresh(["a", "b"], seed=3)
    net.weights = {k: v.astype(np.float64) for k, v in net.weights.items()}
    seq, target = np.frombuffer(b" abc  xyz ", np.uint8).reshape(2, 5), np.array([0, 1])
    grads = net.gradients(seq, target)

    def loss():
        p = net.labels(seq)
        mask = langid._LETTER[seq.T]
        return -(np.log(p[:, np.arange(2), target]) * mask).sum() / mask.sum()

    for name, place in (("v", (3, 1)), ("uf", (2, 7)), ("xb", (ord("y"), 20)), ("bf", (5,))):
        w, step = net.weights[name], 1e-3
        w[place] += step
        up = loss()
        w[place] -= 2 * step
        down = loss()
        w[place] += step
        assert abs((up - down) / (2 * step) - grads[name][place]) < 1e-3


def test_language_odd_rows(spark):
    net = langid.train([(lang, w.encode(), 1) for lang, words in (("en", EN), ("fr", FR)) for w in words])
    rows = langid.predict(odd_rows(spark), net).collect()
    assert len(rows) == 6
    assert [r["lang_pred"] for r in rows[:3]] == ["und"] * 3 and [r["score"] for r in rows[:3]] == [0.0] * 3
    assert rows[0]["lang"] == "en" and rows[4]["lang_pred"] in ("en", "fr")
    nothing = langid.identify(odd_rows(spark).limit(0), odd_rows(spark).limit(0))
    assert nothing.count() == 0
    unknown = langid.identify(odd_rows(spark), odd_rows(spark).filter("lang = 'zz'")).select("lang_pred").distinct().collect()
    assert [r[0] for r in unknown] == ["und"]


def test_language_of_split_letters_and_query(spark, tmp_path):
    """A letter on the border of two windows still is one, and only texts without a letter are und."""
    rng = random.Random(4)
    texts = [(" ".join(rng.choices(words, k=30)), lang) for words, lang in ((EN, "en"), (FR, "fr")) for _ in range(60)]
    odd = ["1" * 29 + "é", "1" * 28 + "日", "1" * 29 + "🙂", "12 34", "", None, "-" * 59 + "ß" * 40]
    rows = [(i, t, lang, "s") for i, (t, lang) in enumerate([*texts, *((t, None) for t in odd)])]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in queries.QUERIES["op10_language_id"](spark, str(tmp_path)).collect()}
    assert [got[120 + i]["lang_pred"] == "und" for i in range(7)] == [False, False, True, True, True, True, False]
    held = [r for i, r in got.items() if i < 120 and r["held_out"]]
    assert len(held) > 10 and all(r["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in got.items())
    assert all(r["lang_pred"] == texts[r["doc_id"]][1] for r in held)


def _toxic(seed, n):
    rng = random.Random(seed)
    texts, labels = [], []
    for i in range(n):
        words = rng.choices(EN, k=40)
        if i % 3 == 0:
            words[rng.randrange(40)] = rng.choice(["worthless", "disgusting", "idiotic"])
            words[rng.randrange(40)] = rng.choice(["worthless", "disgusting", "idiotic"])
        texts.append(" ".join(words))
        labels.append(int(i % 3 == 0))
    return pa.array(texts), np.array(labels)


def test_subword_held_out_and_misspelt():
    model = subword.train(*_toxic(1, 400), subword.Shape(chars=(4, 5), distinct=True, prior=100))
    texts, labels = _toxic(2, 200)
    assert ((model.scores(texts) >= 0.5) == labels).mean() > 0.95
    plain, misspelt = model.scores(pa.array([" ".join(EN * 2), " ".join(EN * 2) + " worthlesss disgustinggg"]))
    assert misspelt > plain


def test_subword_cases(spark):
    empty = subword.train(pa.array([], pa.string()), np.zeros(0, np.int64), subword.Shape())
    assert empty.scores(pa.array([None, "", "x"])).tolist() == [0.5] * 3
    one = subword.train(pa.array(["a b"]), np.array([1]), subword.Shape())
    assert one.scores(pa.array([""]))[0] > 0.9
    docs = odd_rows(spark)
    labels = spark.createDataFrame([(1, 1), (2, 0), (2, 0), (4, None), (9, 7)], "doc_id long, toxic int")
    held = F.col("doc_id") == 3
    rows = subword.classify(docs, labels, F.coalesce(held, F.lit(False)), "toxic", subword.Shape()).collect()
    assert len(rows) == 6 and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in rows)
    assert subword.classify(docs.limit(0), labels.limit(0), held, "toxic", subword.Shape()).count() == 0
