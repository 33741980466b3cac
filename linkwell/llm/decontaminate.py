"""Benchmark decontamination by greedy string tiling.

Words are lower-cased runs of letters, digits and bytes beyond ASCII. A document and a test item that
share a seed (LEAST words in a row) are compared: maximal common runs of words are marked longest
first, without overlap, until none of LEAST words or more is left. Runs are found by Karp-Rabin
window hashes, for falling window lengths; a hit is confirmed word by word before it is marked. The
share of the item's words that are marked is its coverage. As tiles may lie in any order, a passage
that was reordered is covered like one that was not; from COVERAGE on the item counts as leaked.

The seeds of the test items travel to the executors with the task, which is bounded: items are
dealt into blocks of about BLOCK_CHARS characters, and each block makes one pass over all
documents. One block is the rule; a larger benchmark takes more passes, each written before the
next block is read, so the driver holds one block at a time.

Cases: a null or wordless text or item matches nothing; an item of fewer words than LEAST is a seed
as a whole; a seed that an item repeats is kept once, with its places; texts of any length are read
whole; repeated rows are compared each; extra columns are ignored; an empty table gives an
empty result; equally long tiles are marked in order of their place in the item, then the text.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_slices, stage, unstage, utf8
from .textkit import U, shingle_hashes, word_bounds, word_hashes

LEAST = 5
COVERAGE = 0.6
BLOCK_CHARS = 8 << 20
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_FOLD[[c for c in range(128) if not chr(c).isalnum()]] = 32
_BASE = 0x9E3779B97F4A7C15
_BACK = pow(_BASE, -1, 1 << 64)
_BITS = 20


def _words(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes and each text's first word (n + 1 entries)."""
    buf, off = utf8(column)
    buf = _FOLD[buf]
    starts, ends, first = word_bounds(buf, off)
    return word_hashes(buf, starts, ends), first


def _windows(words: np.ndarray, free: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Karp-Rabin hashes of the windows of free words, and their places."""
    if len(words) < size:
        return np.zeros(0, U), np.zeros(0, np.int64)
    taken = np.concatenate(([0], np.cumsum(~free)))
    at = np.flatnonzero(taken[size:] == taken[:-size])
    powers, back = np.full(len(words), _BASE, U), np.full(len(words), _BACK, U)
    powers[0] = back[0] = 1
    powers, back = np.cumprod(powers), np.cumprod(back)
    sums = np.concatenate((np.zeros(1, U), np.cumsum(words * powers, dtype=U)))
    return (sums[at + size] - sums[at]) * back[at], at  # as if each window began at place 0


def _run(item: np.ndarray, text: np.ndarray, free_i: np.ndarray, free_t: np.ndarray, i: int, t: int) -> int:
    """Number of equal free words from place i of the item and place t of the text on, compared in growing steps."""
    n, step, most = 0, 16, min(len(item) - i, len(text) - t)
    while n < most:
        m = min(step, most - n)
        x, y = slice(i + n, i + n + m), slice(t + n, t + n + m)
        same = (item[x] == text[y]) & free_i[x] & free_t[y]
        if not same.all():
            return n + int(same.argmin())
        n, step = n + m, 2 * step
    return n


def tile(item: np.ndarray, text: np.ndarray, least: int = LEAST) -> list[tuple[int, int, int]]:
    """Greedy string tiling: (place in item, place in text, length) of the tiles, in the order of marking."""
    free_i, free_t = np.ones(len(item), bool), np.ones(len(text), bool)
    least = max(1, min(least, len(item)))
    size, tiles = max(least, min(len(item), len(text))), []
    while size >= least:
        hashes_t, places_t = _windows(text, free_t, size)
        hashes_i, places_i = _windows(item, free_i, size)
        order = np.argsort(hashes_t, kind="stable")
        low, high = np.searchsorted(hashes_t[order], hashes_i, "left"), np.searchsorted(hashes_t[order], hashes_i, "right")
        found: dict[int, list[tuple[int, int]]] = {}
        for k in np.flatnonzero(high > low):
            i = int(places_i[k])
            at = places_t[order[low[k] : high[k]]]
            if i and free_i[i - 1]:  # only where a run begins
                at = at[(at == 0) | ~free_t[at - 1] | (text[at - 1] != item[i - 1])]
            for t in at.tolist():
                n = _run(item, text, free_i, free_t, i, t)
                if n >= size:
                    found.setdefault(n, []).append((i, t))
        longest = max(found, default=0)
        if longest > 2 * size:
            size = longest
            continue
        left = False
        for n in sorted(found, reverse=True):
            for i, t in found[n]:
                if free_i[i : i + n].all() and free_t[t : t + n].all():
                    tiles.append((i, t, n))
                    free_i[i : i + n] = free_t[t : t + n] = False
                else:
                    left = True  # what is free of it may still be longer than the next runs
            if left:
                break
        if left:
            continue
        if size == least:
            break
        size = max(least, size // 2)
    return tiles


@dataclass
class Block:
    """Test items with an index of their seeds."""

    ids: np.ndarray
    words: np.ndarray
    first: np.ndarray
    seeds: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]  # by length: sorted hashes and items without repeats, first place of each (n + 1), places

    @staticmethod
    def of(rows: list[tuple[int, str]], least: int) -> Block:
        words, first = _words(pa.array([t for _, t in rows], pa.string()))
        counts, seeds = np.diff(first), {}
        for size in sorted({min(least, int(c)) for c in counts if c}):
            own = np.flatnonzero(np.minimum(counts, least) == size)
            hashes, item, place = [], [], []
            for d in own:
                w = words[first[d] : first[d + 1]]
                h, _ = shingle_hashes(w, np.array([0, len(w)]), size)
                hashes.append(h)
                item.append(np.full(len(h), d))
                place.append(np.arange(len(h)))
            h, d, p = (np.concatenate(x) for x in (hashes, item, place))
            order = np.lexsort((p, d, h))
            h, d, p = h[order], d[order], p[order]
            begin = np.flatnonzero(np.concatenate(([True], (h[1:] != h[:-1]) | (d[1:] != d[:-1]))))
            seeds[size] = (h[begin], d[begin], np.append(begin, len(h)), p)
        return Block(np.array([i for i, _ in rows], np.int64), words, first, seeds)

    def hits(self, words: np.ndarray, first: np.ndarray):
        """(text, item, place in the text's words, number of the item's seed, length) of every seed that texts and items share."""
        doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
        for size, (hashes, item, _, _) in self.seeds.items():
            if len(words) < size:
                continue
            some = np.zeros(1 << _BITS, bool)
            some[(hashes & U((1 << _BITS) - 1)).astype(np.int64)] = True
            whole, _ = shingle_hashes(words, np.array([0, len(words)]), size)
            at = np.flatnonzero(some[(whole & U((1 << _BITS) - 1)).astype(np.int64)] & (doc[: len(whole)] == doc[size - 1 :]))
            low, high = np.searchsorted(hashes, whole[at], "left"), np.searchsorted(hashes, whole[at], "right")
            n = high - low
            pick = np.repeat(low - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(int(n.sum()))
            where = np.repeat(at, n)
            yield doc[where], item[pick], where, pick, size

    def compare(self, column: pa.Array, least: int, coverage: float):
        """(text, item id, coverage, tiles, longest tile) of every leaked item of every text."""
        words, first = _words(column)
        for docs, items, where, seed, size in self.hits(words, first):
            if not len(docs):
                continue
            pair = docs.astype(np.int64) * len(self.ids) + items
            order = np.lexsort((where, pair))
            pair, where, seed = pair[order], where[order], seed[order]
            begin, places = self.seeds[size][2:]
            bounds = np.flatnonzero(np.concatenate(([True], pair[1:] != pair[:-1], [True])))
            for a, b in zip(bounds[:-1], bounds[1:], strict=True):
                d, i = divmod(int(pair[a]), len(self.ids))
                item = self.words[self.first[i] : self.first[i + 1]]
                need = math.ceil(coverage * len(item) - 1e-9)
                covered = np.zeros(len(item) + 1, np.int64)
                place = np.concatenate([places[begin[x] : begin[x + 1]] for x in np.unique(seed[a:b])])
                np.add.at(covered, place, 1)
                np.add.at(covered, np.minimum(place + size, len(item)), -1)
                if (np.cumsum(covered[:-1]) > 0).sum() < need:  # the tiles cannot cover more than the seeds
                    continue
                # only words within shared seeds can be in a tile; between runs of them a word stands that no item has
                at = np.unique((where[a:b][:, None] + np.arange(size)).ravel())
                gaps = np.flatnonzero(np.diff(at) > 1) + 1
                text = np.insert(words[at], gaps, U(0))
                tiles = tile(item, text, least)
                marked = sum(n for _, _, n in tiles)
                if marked >= max(1, need):
                    yield d, int(self.ids[i]), marked / len(item), len(tiles), max(n for _, _, n in tiles)


def _blocks(benchmark: DataFrame, id_col: str, text_col: str):
    """(whether it is the last, test items) of each block; a block is collected when it is asked for."""
    rows = benchmark.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text")).filter("id is not null and text is not null")
    total = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    parts = max(1, math.ceil(1.5 * total / BLOCK_CHARS)) if total > BLOCK_CHARS else 1
    for part in range(parts):
        some = rows if parts == 1 else rows.filter(F.pmod(F.xxhash64("id"), F.lit(parts)) == part)
        yield part == parts - 1, sorted((r["id"], r["text"]) for r in some.collect())


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", least: int = LEAST, coverage: float = COVERAGE) -> DataFrame:
    """(id_col, item_col, coverage, n_tiles, longest_tile) of every document that contains an item of the benchmark."""
    texts = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"))
    schema = f"`{id_col}` bigint, `{item_col}` bigint, coverage double, n_tiles bigint, longest_tile bigint"
    out = None
    for last, rows in _blocks(benchmark, item_col, item_text_col):

        def run(batches, block=Block.of(rows, least)):
            for batch in batches:
                for at, n in byte_slices(batch.column(1)):
                    part = batch.slice(at, n)
                    found = list(block.compare(part.column(1), least, coverage))
                    ids = part.column(0).to_pylist()
                    columns = list(zip(*found, strict=True)) if found else [()] * 5
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([ids[d] for d in columns[0]], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.float64()), pa.array(columns[3], pa.int64()), pa.array(columns[4], pa.int64())],
                        [id_col, item_col, "coverage", "n_tiles", "longest_tile"],
                    )

        found = texts.mapInArrow(run, schema)
        found = found if last else stage(found, "leaks")
        out = found if out is None else out.union(found)
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", least: int = LEAST, coverage: float = COVERAGE) -> DataFrame:
    """docs without the documents that contain an item of the benchmark; rows are dropped where they are read."""
    at, schema, before = docs.columns.index(text_col), docs.schema, None
    for last, rows in _blocks(benchmark, item_col, item_text_col):

        def run(batches, block=Block.of(rows, least)):
            for batch in batches:
                for a, n in byte_slices(batch.column(at)):
                    part = batch.slice(a, n)
                    clean = np.ones(n, bool)
                    clean[[d for d, *_ in block.compare(part.column(at), least, coverage)]] = False
                    yield part.filter(pa.array(clean))

        docs = docs.mapInArrow(run, schema)
        if not last:
            docs = stage(docs, "clean")
            if before is not None:
                unstage(before)
            before = docs
    return docs
