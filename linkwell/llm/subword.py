"""Supervised subword embeddings: hashed n-gram vectors, averaged per document into a linear softmax.

A word gives one feature for itself, one for each of its character n-grams (between the marks < and
>) and, where asked for, one for each run of `word_ngrams` words that it begins. Features are hashed
to rows of an embedding table. A document is the mean of its features' vectors; a linear softmax over
it gives the probability of label 1. Table and softmax are trained together by stochastic gradient
descent in numpy. After training a feature acts only through one number, the difference its vector
makes to the two logits, so scoring carries one float per row of the table.

Training sees the whole texts of a bounded sample of the labelled rows (SAMPLE_DOCS documents of each
label); scoring reads every byte. A word longer than LONGEST bytes gives n-grams window by window.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import byte_slices, filled, utf8
from .textkit import U, lower_ascii, mix, word_bounds, word_hashes

SAMPLE_DOCS = 2000  # expected labelled documents of each label to learn from, at most
LONGEST = 60  # bytes of a word between whose n-grams none is left out; a longer word is cut into windows


@dataclass(frozen=True)
class Shape:
    buckets: int = 1 << 17
    dims: int = 8
    chars: tuple[int, ...] = (3, 4, 5)
    word_ngrams: int = 1
    lower: bool = True  # and signs other than @ and $ part words
    distinct: bool = False  # a document's distinct words count once
    prior: float = 0  # features with a zero vector that every document has besides its own: a short one tells little
    least_docs: int = 10  # a row is learned if so many sampled documents touch it
    epochs: int = 8
    rate: float = 40.0
    batch: int = 64


_SIGNS = np.arange(256, dtype=np.uint8)
_SIGNS[[c for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in "@$"]] = 32


def _bucket(h: np.ndarray, shape: Shape) -> np.ndarray:
    return (mix(h) & U(shape.buckets - 1)).astype(np.int32)


class Words:
    """The words of a batch of texts and the features of the distinct ones."""

    def __init__(self, column: pa.Array, shape: Shape):
        buf, off = utf8(column)
        self.buf = _SIGNS[lower_ascii(buf)] if shape.lower else buf
        starts, ends, first = word_bounds(self.buf, off)
        parts = (ends - starts + LONGEST - 1) // LONGEST
        begin = np.concatenate(([0], np.cumsum(parts)))
        s = np.repeat(starts, parts) + (np.arange(begin[-1]) - np.repeat(begin[:-1], parts)) * LONGEST
        e = np.minimum(s + LONGEST, np.repeat(ends, parts))
        self.first = begin[first]
        self.hashes = word_hashes(self.buf, s, e)
        _, at, self.inverse = np.unique(self.hashes, return_index=True, return_inverse=True)
        self.s, self.e, self.own = s[at], e[at], self.hashes[at]
        self.shape = shape
        self.doc, self.word = np.repeat(np.arange(len(off) - 1), np.diff(self.first)), self.inverse
        if shape.distinct and len(self.word):
            self.doc, self.word = np.divmod(np.unique(self.doc * len(at) + self.word), len(at))

    def features(self) -> tuple[np.ndarray, np.ndarray]:
        """(distinct word, bucket) of every feature of every distinct word."""
        shape, sizes = self.shape, self.e - self.s
        words, buckets = [np.arange(len(sizes))], [_bucket(self.own, shape)]
        for size in np.unique(sizes):
            rows = np.flatnonzero(sizes == size)
            text = np.empty((len(rows), size + 2), U)
            text[:, 0], text[:, -1] = 60, 62
            text[:, 1:-1] = self.buf[self.s[rows][:, None] + np.arange(size)]
            for n in shape.chars:
                if n > size + 2 or n == size + 2 and n > 3:
                    continue
                h = np.zeros((len(rows), size + 3 - n), U)
                with np.errstate(over="ignore"):
                    for i in range(n):
                        h = h * U(0x100000001B3) + text[:, i : i + h.shape[1]] + U(1)
                    h = h * U(31) + U(n)
                words.append(np.repeat(rows, h.shape[1]))
                buckets.append(_bucket(h.ravel(), shape))
        return np.concatenate(words), np.concatenate(buckets)

    def runs(self) -> tuple[np.ndarray, np.ndarray]:
        """(text, bucket) of every run of 2 to word_ngrams words, and of whether its words are the same one."""
        texts, buckets = [], []
        doc = np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))
        for n in range(2, self.shape.word_ngrams + 1):
            if len(doc) < n:
                break
            h = np.zeros(len(doc) - n + 1, U)
            with np.errstate(over="ignore"):
                for i in range(n):
                    h = h * U(0x9FB21C651E98DF25) + self.hashes[i : i + len(h)]
            inside = doc[: len(h)] == doc[n - 1 :]
            same = self.hashes[: len(h)] == self.hashes[n - 1 :]
            texts += [doc[: len(h)][inside]] * 2
            buckets += [_bucket(h[inside], self.shape), _bucket(same[inside].astype(U) + U(2 * n), self.shape)]
        if not texts:
            return np.zeros(0, np.int64), np.zeros(0, np.int32)
        return np.concatenate(texts), np.concatenate(buckets)


def bags(column: pa.Array, shape: Shape) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sparse document features: (document, bucket, share of the document's features), sorted by document."""
    parts = []
    for at, n in byte_slices(column, 1 << 18):  # what a slice needs besides its result stays small
        doc, bucket, share = _bags(column.slice(at, n), shape)
        parts.append((doc.astype(np.int32) + np.int32(at), bucket, share))
    if not parts:
        return np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0, np.float32)
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def _bags(column: pa.Array, shape: Shape) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    w = Words(column, shape)
    word, bucket = w.features()
    order = np.argsort(word, kind="stable")
    word, bucket = word[order], bucket[order]
    ptr = np.searchsorted(word, np.arange(len(w.s) + 1))
    per = np.diff(ptr)[w.word]
    at = np.repeat(ptr[w.word] - np.concatenate(([0], np.cumsum(per)[:-1])), per) + np.arange(int(per.sum()))
    doc = np.repeat(w.doc, per)
    run_doc, run_bucket = w.runs()
    code = np.concatenate((doc, run_doc)).astype(np.int64) * shape.buckets + np.concatenate((bucket[at], run_bucket))
    code, counts = np.unique(code, return_counts=True)
    doc = code // shape.buckets
    return doc, (code % shape.buckets).astype(np.int32), (counts / (np.bincount(doc, counts, len(column)) + shape.prior)[doc]).astype(np.float32)


@dataclass
class Model:
    """What scoring needs: by bucket the difference of the logits, and the constant."""

    shape: Shape
    effect: np.ndarray
    bias: float

    def scores(self, column: pa.Array) -> np.ndarray:
        """Probability of label 1 of each text; one without words gets the constant's."""
        w, n = Words(column, self.shape), len(column)
        word, bucket = w.features()
        total = np.bincount(word, self.effect[bucket], len(w.s))
        count = np.bincount(word, minlength=len(w.s))
        run_doc, run_bucket = w.runs()
        sums = np.bincount(w.doc, total[w.word], n) + np.bincount(run_doc, self.effect[run_bucket], n)
        counts = np.bincount(w.doc, count[w.word], n) + np.bincount(run_doc, minlength=n) + self.shape.prior
        return 1 / (1 + np.exp(-np.clip(self.bias + sums / np.maximum(counts, 1), -500, 500)))


def train(texts: pa.Array, labels: np.ndarray, shape: Shape, seed: int = 5) -> Model:
    """Both classes weigh the same. With one class or none the model is constant."""
    if not len(labels):
        return Model(shape, np.zeros(shape.buckets, np.float32), 0.0)
    if labels.min() == labels.max():
        return Model(shape, np.zeros(shape.buckets, np.float32), 4.0 if labels[0] else -4.0)
    rng = np.random.default_rng(seed)
    doc, bucket, share = bags(texts, shape)
    known = np.bincount(bucket, minlength=shape.buckets) >= shape.least_docs
    hold = known[bucket]
    doc, bucket, share = doc[hold], bucket[hold], share[hold]
    table = (rng.normal(0, 0.05, (shape.buckets, shape.dims)) * known[:, None]).astype(np.float32)
    soft = rng.normal(0, 1, (shape.dims, 2)).astype(np.float32)
    bias = np.zeros(2, np.float32)
    weight = np.where(labels == 1, 0.5 / max(1, (labels == 1).sum()), 0.5 / max(1, (labels == 0).sum())) * len(labels)
    target = np.eye(2, dtype=np.float32)[labels]
    first = np.searchsorted(doc, np.arange(len(labels) + 1))
    batches = []
    for rows in np.array_split(rng.permutation(len(labels)), max(1, len(labels) // shape.batch)):
        at = np.concatenate([np.arange(first[r], first[r + 1]) for r in rows])
        local = np.repeat(np.arange(len(rows)), first[rows + 1] - first[rows])
        order = np.argsort(bucket[at], kind="stable")
        touched, begin = np.unique(bucket[at][order], return_index=True)
        batches.append((rows, bucket[at], share[at], local.astype(np.uint16), order.astype(np.int32), touched, begin.astype(np.int32)))
    del doc, bucket, share
    steps, largest = 0, 1e-12
    for epoch in range(shape.epochs):
        for i in rng.permutation(len(batches)):
            rows, b, x, local, order, touched, begin = batches[i]
            steps += 1
            rate = shape.rate * (1 - steps / (shape.epochs * len(batches) + 1))
            mean = np.stack([np.bincount(local, table[b, k] * x, len(rows)) for k in range(shape.dims)], axis=1).astype(np.float32)
            logits = mean @ soft + bias
            p = np.exp(logits - logits.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            wrong = (p - target[rows]) * weight[rows, None].astype(np.float32)
            back = wrong @ soft.T
            if len(touched):
                g = np.add.reduceat((x[:, None] * back[local])[order], begin, axis=0)
                largest = max(largest, float(np.abs(g).max()))
                table[touched] -= (rate / largest) * g
            soft -= rate * 0.02 * (mean.T @ wrong) / len(rows)
            bias -= rate * 0.2 * wrong.mean(0)
    effect = (table @ (soft[:, 1] - soft[:, 0])).astype(np.float32)
    return Model(shape, effect, float(bias[1] - bias[0]))


def labelled_sample(docs: DataFrame, marks: DataFrame, id_col: str, text_col: str) -> tuple[pa.Array, np.ndarray]:
    """Whole texts and labels of about SAMPLE_DOCS documents of each label 0 and 1, chosen by a hash of the id.

    marks: (id_col, label). The choice is made before texts are read; the chosen ids, at most
    4 * SAMPLE_DOCS rows of two numbers, are what is broadcast. Where rows repeat, the first by hash and text count.
    """
    totals = {r[0]: r[1] for r in marks.groupBy("label").count().collect()}
    at = F.pmod(F.xxhash64(F.col(id_col)), F.lit(1 << 30))
    most = [min(1 << 30, int((1 << 30) * SAMPLE_DOCS / max(1, totals.get(k, 0)))) for k in (0, 1)]
    ids = marks.filter(at < F.when(F.col("label") == 1, most[1]).otherwise(most[0])).orderBy(at, id_col, "label").limit(4 * SAMPLE_DOCS)
    chosen = docs.join(F.broadcast(ids), id_col).select("label", F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = chosen.orderBy(F.xxhash64("text"), "text", "label").limit(8 * SAMPLE_DOCS).toArrow().sort_by([("label", "ascending"), ("text", "ascending")])
    return filled(rows["text"]), np.asarray(rows["label"]).astype(np.int64)


def score(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """docs with score (of label 1) and predicted added; columns of those names are replaced."""
    docs = docs.drop("score", "predicted")
    at = docs.columns.index(text_col)

    def run(batches):
        for batch in batches:
            for a, n in byte_slices(batch.column(at), 16 << 20):
                part = batch.slice(a, n)
                got = model.scores(part.column(at))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(got), pa.array((got >= 0.5).astype(np.int32))], [*part.schema.names, "score", "predicted"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(run, f"{schema}, score double, predicted int")


def classify(docs: DataFrame, labels: DataFrame, held_out: Column, label_col: str, shape: Shape, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with held_out, score and predicted; learns from the labels of rows that are not held out.

    A null label or one other than 0 and 1 teaches nothing; a document that is labelled twice counts twice.
    """
    marks = labels.select(F.col(id_col), F.col(label_col).cast("int").alias("label")).filter("label in (0, 1)").filter(~held_out)
    model = train(*labelled_sample(docs.filter(~held_out).select(id_col, text_col), marks, id_col, text_col), shape)
    return score(docs.select(id_col, text_col, held_out.alias("held_out")), model, text_col).drop(text_col)
