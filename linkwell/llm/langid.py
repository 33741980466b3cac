"""Language identification by a bidirectional gated recurrent network over bytes.

The network reads every byte of a text, left to right and right to left within windows, and labels
each letter position with a distribution over the languages; a document's distribution is the mean
over its positions. A window is a word (cut at character borders into runs of about WINDOW bytes
where longer) between two space marks, so equal words have equal labels and each distinct word of a
task is read once; no state crosses a blank. The weights are trained in numpy by backpropagation
through time on all windows of a bounded sample of labelled documents (SAMPLE_DOCS of each language).

Cases: a text that is null, empty or without any letter is "und" with score 0; if there are no
labelled rows, no language is known and every row is "und" with score 0; ties go to the language
that sorts first; texts of any length are read whole; repeated rows are scored alike and taught from
as often as the sample holds them; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_slices, filled, utf8
from .textkit import U, word_bounds, word_hashes

WINDOW = 30  # bytes of a word that are read together, or up to three fewer or more at a character border
HIDDEN = 16  # units in each direction
SAMPLE_DOCS = 1000  # expected labelled documents of each language to learn from, at most
STEPS, BATCH, RATE = 600, 512, 0.01
_LETTER = np.zeros(256, np.float32)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = 1


def _sigmoid(x):
    return 1 / (1 + np.exp(-x))


@dataclass
class Net:
    """Weights: by direction x (byte to gates), u (state to gates), b; then v, c of the softmax."""

    langs: list[str]
    weights: dict[str, np.ndarray]

    @staticmethod
    def fresh(langs: list[str], seed: int = 7) -> Net:
        rng, h, n = np.random.default_rng(seed), HIDDEN, len(langs)
        w = {}
        for d in "fb":
            w[f"x{d}"] = rng.normal(0, 0.3, (256, 3 * h))
            w[f"u{d}"] = rng.normal(0, h**-0.5, (h, 3 * h))
            w[f"b{d}"] = np.zeros(3 * h)
        w["v"], w["c"] = rng.normal(0, 0.2, (2 * h, n)), np.zeros(n)
        return Net(langs, {k: x.astype(np.float32) for k, x in w.items()})

    def _run(self, d: str, seq: np.ndarray, keep: list | None):
        """States after each step, (steps, rows, units); keep gets what backpropagation needs."""
        w, h = self.weights, HIDDEN
        state = np.zeros((len(seq), h), np.float32)
        table, states = w[f"x{d}"] + w[f"b{d}"], np.empty((seq.shape[1], len(seq), h), np.float32)
        for t in range(seq.shape[1]):
            x, a = table[seq[:, t]], state @ w[f"u{d}"]
            zr = _sigmoid(x[:, : 2 * h] + a[:, : 2 * h])
            z, r = zr[:, :h], zr[:, h:]
            c = np.tanh(x[:, 2 * h :] + r * a[:, 2 * h :])
            if keep is not None:
                keep.append((state, zr, a[:, 2 * h :], c))
            state = z * state + (1 - z) * c
            states[t] = state
        return states

    def labels(self, seq: np.ndarray, keep: dict | None = None) -> np.ndarray:
        """Distribution at each position, (steps, rows, languages); seq: (rows, steps) bytes."""
        kf, kb = ([], []) if keep is not None else (None, None)
        both = np.concatenate((self._run("f", seq, kf), self._run("b", seq[:, ::-1], kb)[::-1]), axis=2)
        logits = both @ self.weights["v"] + self.weights["c"]
        p = np.exp(logits - logits.max(axis=2, keepdims=True))
        p /= p.sum(axis=2, keepdims=True)
        if keep is not None:
            keep |= {"f": kf, "b": kb, "both": both}
        return p

    def gradients(self, seq: np.ndarray, target: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean cross entropy over letter positions; target: language index of each row."""
        h, w, keep = HIDDEN, self.weights, {}
        p = self.labels(seq, keep)
        mask = _LETTER[seq.T]
        p[:, np.arange(len(seq)), target] -= 1
        d_logits = p * (mask / max(1.0, mask.sum()))[:, :, None]
        flat = d_logits.reshape(-1, p.shape[2])
        g = {"v": keep["both"].reshape(-1, 2 * h).T @ flat, "c": flat.sum(0)}
        d_both = d_logits @ w["v"].T
        for d, part, order in (("f", d_both[:, :, :h], seq), ("b", d_both[::-1, :, h:], seq[:, ::-1])):
            gx, gu, gb = np.zeros_like(w[f"x{d}"]), np.zeros_like(w[f"u{d}"]), np.zeros_like(w[f"b{d}"])
            carry = np.zeros((len(seq), h), np.float32)
            for t in range(seq.shape[1] - 1, -1, -1):
                before, zr, a_c, c = keep[d][t]
                z, r = zr[:, :h], zr[:, h:]
                ds = carry + part[t]
                dc = ds * (1 - z) * (1 - c * c)
                dz = ds * (before - c) * z * (1 - z)
                dr = dc * a_c * r * (1 - r)
                d_in = np.concatenate((dz, dr, dc), axis=1)
                d_a = np.concatenate((dz, dr, dc * r), axis=1)
                gu += before.T @ d_a
                gb += d_in.sum(0)
                np.add.at(gx, order[:, t], d_in)
                carry = ds * z + d_a @ w[f"u{d}"].T
            g |= {f"x{d}": gx, f"u{d}": gu, f"b{d}": gb}
        return g

    def fit(self, groups: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]], seed: int = 11) -> Net:
        """Adam over batches of one length; groups: length -> (rows of bytes, language index, occurrences). Languages are drawn evenly, rows by occurrence."""
        rng = np.random.default_rng(seed)
        sizes = sorted(groups)
        share = np.array([groups[s][2].sum() * s for s in sizes], float)
        share /= share.sum()
        pools = {}
        for s in sizes:
            for i in range(len(self.langs)):
                at = np.flatnonzero(groups[s][1] == i)
                if len(at):
                    pools.setdefault(s, []).append((at, np.cumsum(groups[s][2][at], dtype=float)))
        m, v = ({k: np.zeros_like(x) for k, x in self.weights.items()} for _ in range(2))
        for step in range(1, STEPS + 1):
            s = sizes[rng.choice(len(sizes), p=share)]
            each = BATCH // len(pools[s]) + 1
            rows = np.concatenate([at[np.searchsorted(upto, rng.random(each) * upto[-1], side="right")] for at, upto in pools[s]])
            g = self.gradients(groups[s][0][rows], groups[s][1][rows])
            norm = np.sqrt(sum(float((x * x).sum()) for x in g.values()))
            rate = RATE * (1 - step / (STEPS + 1))
            for k, x in g.items():
                x = x / max(1.0, norm)
                m[k] += 0.1 * (x - m[k])
                v[k] += 0.01 * (x * x - v[k])
                self.weights[k] -= (rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-7)).astype(np.float32)
        return self


def _windows(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray):
    """Starts and ends of the windows of words; a cut within a character moves back to its first byte."""
    parts = (ends - starts + WINDOW - 1) // WINDOW
    first = np.concatenate(([0], np.cumsum(parts)))
    step = np.arange(first[-1]) - np.repeat(first[:-1], parts)
    s = np.repeat(starts, parts) + step * WINDOW
    for _ in range(3):
        s -= (step > 0) & (buf[s] & 0xC0 == 0x80)
    e = np.append(s[1:], 0)
    e[first[1:] - 1] = ends
    return s, e


def _rows(buf: np.ndarray, s: np.ndarray, size: int) -> np.ndarray:
    """Bytes of windows of one size, between two spaces."""
    out = np.full((len(s), size + 2), 32, np.uint8)
    out[:, 1:-1] = buf[s[:, None] + np.arange(size)]
    return out


class Known:
    """Label sums and letter positions of windows that were read before, by hash; emptied when it holds MOST, which changes no result."""

    MOST = 1 << 19

    def __init__(self, langs: int):
        self.langs = langs
        self.clear()

    def clear(self) -> None:
        self.hashes, self.got, self.weight = np.zeros(0, U), np.zeros((0, self.langs), np.float32), np.zeros(0, np.float32)

    def missing(self, hashes: np.ndarray) -> np.ndarray:
        """Places of the sorted distinct hashes that are not known."""
        at = np.minimum(np.searchsorted(self.hashes, hashes), max(0, len(self.hashes) - 1))
        return np.flatnonzero(self.hashes[at] != hashes) if len(self.hashes) else np.arange(len(hashes))

    def add(self, hashes: np.ndarray, got: np.ndarray, weight: np.ndarray) -> None:
        at = np.searchsorted(self.hashes, hashes)
        self.hashes, self.got, self.weight = np.insert(self.hashes, at, hashes), np.insert(self.got, at, got, axis=0), np.insert(self.weight, at, weight)

    def of(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(self.hashes, hashes)
        return self.got[at], self.weight[at]


def _read(net: Net, buf: np.ndarray, us: np.ndarray, ue: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Summed distributions over the letter positions of each window, and their number."""
    got, weight = np.zeros((len(us), len(net.langs)), np.float32), np.zeros(len(us), np.float32)
    for size in np.unique(ue - us):
        rows = np.flatnonzero(ue - us == size)
        for at in range(0, len(rows), 8192):
            here = rows[at : at + 8192]
            seq = _rows(buf, us[here], int(size))
            mask = _LETTER[seq].T
            got[here] = np.einsum("trl,tr->rl", net.labels(seq), mask)
            weight[here] = mask.sum(0)
    # bytes of other scripts and signs count as letters only where their window has a letter
    for i in np.flatnonzero(weight > 0):
        raw = buf[us[i] : ue[i]]
        if not ((raw | 32) - 97 < 26).any() and not any(c.isalpha() for c in raw.tobytes().decode("utf-8", "ignore")):
            got[i], weight[i] = 0, 0
    return got, weight


def pooled(net: Net, column: pa.Array, known: Known | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Summed distributions (texts x languages) over the letter positions of each text, and their number; 0 without a letter.

    Windows in known are not read again, and the others are added to it.
    """
    n, langs = len(column), len(net.langs)
    known = Known(langs) if known is None else known
    sums, counts = np.zeros((n, langs)), np.zeros(n)
    buf, off = utf8(column)
    starts, ends, first = word_bounds(buf, off)
    s, e = _windows(buf, starts, ends)
    hashes, firsts, inverse = np.unique(word_hashes(buf, s, e), return_index=True, return_inverse=True)
    if len(known.hashes) > Known.MOST:
        known.clear()
    new = known.missing(hashes)
    known.add(hashes[new], *_read(net, buf, s[firsts[new]], e[firsts[new]]))
    got, weight = known.of(hashes)
    doc = np.searchsorted(off, s, side="right") - 1
    for k in range(langs):
        sums[:, k] = np.bincount(doc, got[inverse, k], minlength=n)
    counts[:] = np.bincount(doc, weight[inverse], minlength=n)
    return sums, counts


def train(rows: list[tuple[str, bytes, int]]) -> Net:
    """A net from (language, window, occurrences) rows."""
    langs = sorted({lang for lang, _, _ in rows})
    number = {lang: i for i, lang in enumerate(langs)}
    net = Net.fresh(langs)
    by_size: dict[int, tuple[list, list, list]] = {}
    for lang, word, count in rows:
        if any(b > 127 or chr(b).isalpha() for b in word):
            xs, ys, ns = by_size.setdefault(len(word), ([], [], []))
            xs.append(b" " + word + b" ")
            ys.append(number[lang])
            ns.append(count)
    groups = {k: (np.frombuffer(b"".join(x), np.uint8).reshape(-1, k + 2), np.array(y), np.array(n)) for k, (x, y, n) in by_size.items()}
    return net.fit(groups) if groups and len(langs) > 1 else net


def sampled(labelled: DataFrame, id_col: str, text_col: str, lang_col: str) -> list[tuple[str, bytes, int]]:
    """(language, window, occurrences) of the whole texts of about SAMPLE_DOCS labelled documents of each language.

    Documents are chosen by a hash of id and text, and their windows are counted on the executors, so
    the driver receives each distinct window of the bounded sample once.
    """
    labelled = labelled.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))
    share = F.lit(float(SAMPLE_DOCS)) / F.count("*")
    shares = {r["lang"]: r["share"] for r in labelled.groupBy("lang").agg(share.alias("share")).collect()}
    if not shares:
        return []
    most = F.create_map(*(F.lit(x) for lang, part in shares.items() for x in (lang, int(min(1.0, part) * (1 << 30)))))
    chosen = labelled.filter(F.pmod(F.xxhash64("id", "text"), F.lit(1 << 30)) < F.element_at(most, F.col("lang"))).select("lang", "text")

    def run(batches):
        for batch in batches:
            for a, n in byte_slices(batch.column(1)):
                part = batch.slice(a, n)
                buf, off = utf8(part.column(1))
                starts, ends, _ = word_bounds(buf, off)
                s, e = _windows(buf, starts, ends)
                langs = filled(part.column(0)).to_pylist()
                doc = np.searchsorted(off, s, side="right") - 1
                words = [buf[x:y].tobytes() for x, y in zip(s, e, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array([langs[d] for d in doc], pa.string()), pa.array(words, pa.binary())], ["lang", "word"])

    counts = chosen.mapInArrow(run, "lang string, word binary").groupBy("lang", "word").agg(F.count("*").alias("n")).toArrow()
    return sorted(zip(counts["lang"].to_pylist(), counts["word"].to_pylist(), counts["n"].to_pylist(), strict=True))


def predict(docs: DataFrame, net: Net, text_col: str = "text", out: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """docs with the language and its probability added; columns of the names in out are replaced."""
    docs = docs.drop(*out)
    at = docs.columns.index(text_col)

    def run(batches):
        known = Known(len(net.langs))
        for batch in batches:
            for a, n in byte_slices(batch.column(at)):
                part = batch.slice(a, n)
                names, scores = ["und"] * n, np.zeros(n)
                if net.langs:
                    sums, counts = pooled(net, part.column(at), known)
                    best = sums.argmax(axis=1)
                    some = counts > 0
                    scores[some] = np.clip(sums[some, best[some]] / counts[some], 0, 1)
                    names = [net.langs[b] if s else "und" for b, s in zip(best, some, strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(names, pa.string()), pa.array(scores)], [*part.schema.names, *out])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(run, f"{schema}, `{out[0]}` string, `{out[1]}` double")


def identify(docs: DataFrame, labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Train on labelled, then docs with lang_pred and score."""
    return predict(docs, train(sampled(labelled, id_col, text_col, lang_col)), text_col)


