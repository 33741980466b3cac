"""Pairs found and scored where a slice of the queries meets the passing externals, so that no pair is written or shuffled.

Queries are dealt into slices of a bounded number of rows. Each slice is a task that holds its queries, reads the externals
once, in the order of their ids, CHUNK of them at a time, and keeps the best of each query. Scores are those of
blocking.pre_score, digit for digit: all candidates of a query are compared at once, on arrays.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from linkwell.functions.similarity import token_sets

CHUNK = 1 << 16  # externals in memory at a time
WIDE, LONG, WORDS = 256, 96, 24  # characters of a query's name, of an external's name and words of either on arrays; others are scored one by one
MOST = 48  # address words on arrays
TOKEN, SOUND, PLACE, NEAR = 1, 2, 4, 8  # what found a pair
NAMES = {TOKEN: "token", SOUND: "phonetic", PLACE: "postal_address", NEAR: "neighbourhood"}
ANY = "__any__"
STRATEGIES = [sorted(n for b, n in NAMES.items() if found & b) for found in range(16)]


def lcs_counts(table: np.ndarray, codes: np.ndarray, left: np.ndarray, masks: np.ndarray) -> np.ndarray:
    """Lengths of the longest common subsequences of one pattern and many texts. table: (words, codes), the places of each code in
    the pattern; codes: (texts, characters); left: how many texts, from the first on, reach each character; masks: (words, texts),
    the places of the pattern that count for each text."""
    words, n = len(table), len(codes)
    state = np.full((words, n), ~np.uint64(0))
    flat = np.ascontiguousarray(codes.T[: len(left)])
    hits = [table[k][flat] for k in range(words)]
    for k in range(words):
        hits[k] &= masks[k]
    buffer, spare = np.empty(n, np.uint64), np.empty(n, np.uint64)
    for j, m in enumerate(left):
        carry = None
        for k in range(words):
            row, hit, more = state[k, :m], buffer[:m], spare[:m]
            np.bitwise_and(hits[k][j, :m], row, out=hit)
            np.add(row, hit, out=more)
            if words > 1:
                over = more < row
                if carry is not None:
                    more += carry
                    over |= more < carry
                carry = over.astype(np.uint64)
            np.subtract(row, hit, out=row)
            np.bitwise_or(row, more, out=row)
    return np.bitwise_count(~state & masks).sum(axis=0, dtype=np.int64)


class Texts:
    """Names of a chunk on arrays: codes of their sorted words joined by blanks, and which word each character belongs to."""

    def __init__(self, names: list[str], chars: dict[str, int], vocabulary: dict[str, int]):
        self.names = names
        words = [sorted(set(t.split())) for t in names]
        joined = [" ".join(w) for w in words]
        self.count = np.fromiter(map(len, words), np.int64, len(words))
        self.size = np.fromiter(map(len, joined), np.int64, len(words))
        usual = lambda sizes, most: min(most, int(np.quantile(sizes, 0.9995, method="higher"))) if len(sizes) else 1  # noqa: E731  a few long names widen no array
        many, length = max(1, usual(self.count, WORDS)), max(1, usual(self.size, LONG))
        self.odd = (self.count > many) | (self.size > length)
        n, plain = len(names), np.flatnonzero(~self.odd)
        self.codes, self.slot = np.zeros((n, length), np.uint16), np.zeros((n, length), np.uint8)
        self.words, self.start = np.zeros((n, many), np.int32), np.zeros((n, many), np.uint8)
        points = np.frombuffer("".join(joined[i] for i in plain).encode("utf-32-le", "surrogatepass"), np.uint32)
        known = np.zeros(0x110000, np.uint16)
        known[[ord(c) for c in chars]] = list(chars.values())
        sizes = self.size[plain]
        row = np.repeat(plain, sizes)
        begin = np.repeat(np.cumsum(sizes) - sizes, sizes)
        at = np.arange(len(points)) - begin
        self.codes[row, at] = known[points]
        blank = points == ord(" ")
        before = np.cumsum(blank)
        slot = before - np.repeat((before - blank)[(np.cumsum(sizes) - sizes)[sizes > 0]], sizes[sizes > 0])  # the blank before a word is that word's
        self.slot[row, at] = slot
        self.start[row[blank], slot[blank]] = at[blank] + 1
        counts = self.count[plain]
        ids = np.fromiter((vocabulary.get(w, 0) for i in plain for w in words[i]), np.int32, int(counts.sum()))
        self.words[np.repeat(plain, counts), np.arange(len(ids)) - np.repeat(np.cumsum(counts) - counts, counts)] = ids


class Pattern:
    """A query's name: the table of its characters, and what its words are worth where an external has them too."""

    def __init__(self, name: str, chars: dict[str, int], vocabulary: dict[str, int]):
        self.name, self.words = name, sorted(set(name.split()))
        self.joined = " ".join(self.words)
        self.odd = len(self.joined) > WIDE or len(self.words) > WORDS
        for c in self.joined:
            chars.setdefault(c, len(chars) + 1)
        for w in self.words:
            vocabulary.setdefault(w, len(vocabulary) + 1)

    def prepare(self, chars: dict[str, int], vocabulary: dict[str, int], worth: np.ndarray) -> None:
        """Fill worth (by word: characters and a blank, one word, its bit) and make the table; clear() takes the words out again."""
        self.ids: list[int] = []
        if self.odd:
            return
        self.width = max(1, -(-len(self.joined) // 64))
        places: dict[int, int] = {}
        for i, c in enumerate(self.joined):
            places[chars[c]] = places.get(chars[c], 0) | 1 << i
        self.table = np.zeros((self.width, len(chars) + 1), np.uint64)
        for code, bits in places.items():
            for k in range(self.width):
                self.table[k, code] = bits >> 64 * k & 0xFFFFFFFFFFFFFFFF
        self.ids = [vocabulary[w] for w in self.words]
        for k, (i, w) in enumerate(zip(self.ids, self.words, strict=True)):
            worth[i] = (len(w) + 1) << 32 | 1 << 24 | 1 << k
        self.masks: dict[int, list[int]] = {}

    def mask(self, gone: int) -> list[int]:
        """Places, in 64-bit words, of the words that are not gone and of the blanks between them."""
        if gone not in self.masks:
            bits, at, first = 0, 0, True
            for k, w in enumerate(self.words):
                if not gone >> k & 1:
                    begin = at if first else at - 1
                    bits |= ((1 << at + len(w)) - 1) & ~((1 << begin) - 1)
                    first = False
                at += len(w) + 1
            self.masks[gone] = [bits >> 64 * k & 0xFFFFFFFFFFFFFFFF for k in range(self.width)]
        return self.masks[gone]

    def token_set(self, texts: Texts, at: np.ndarray, worth: np.ndarray) -> np.ndarray:
        """similarity.token_set of this name and those at the given places."""
        out = np.zeros(len(at))
        odd = texts.odd[at] if not self.odd else np.ones(len(at), bool)
        if odd.any():
            rows = np.flatnonzero(odd)
            out[rows] = token_sets([self.name] * len(rows), [texts.names[i] for i in at[rows]])
            if len(rows) == len(at):
                return out
            rows = np.flatnonzero(~odd)
            out[rows] = self.token_set(texts, at[rows], worth)
            return out
        if not self.words or not len(at):
            return out
        held = worth[texts.words[at]]
        total = held.sum(axis=1)
        chars, count, gone = total >> 32, total >> 24 & 0xFF, total & 0xFFFFFF
        codes, size = texts.codes[at], texts.size[at]
        some = np.flatnonzero(count)
        if len(some):
            own = at[some]
            drop = held[some] > 0
            codes[some] *= ~np.take_along_axis(drop, texts.slot[own], axis=1)
            drop |= np.arange(drop.shape[1]) >= texts.count[own][:, None]
            first = drop.argmin(axis=1)
            lead = np.flatnonzero((first > 0) & ~drop.all(axis=1))
            codes[some[lead], texts.start[own[lead], first[lead]].astype(np.int64) - 1] = 0
        longest = np.maximum.accumulate(size[::-1])[::-1]
        left = np.searchsorted(-longest, -np.arange(int(longest[0])), side="left")
        kinds, which = np.unique(gone, return_inverse=True)
        masks = np.array([self.mask(int(g)) for g in kinds], dtype=np.uint64)
        shared = lcs_counts(self.table, codes, left, masks.T[:, which])
        mine = len(self.joined)
        best = 2 * (chars + shared) / np.maximum(mine + size, 1)  # chars: the common words, and a blank behind them
        common = chars - 1
        with_common = np.maximum(best, np.maximum(2 * common / np.maximum(common + mine, 1), 2 * common / np.maximum(common + size, 1)))
        best = np.where(count > 0, with_common, best)
        best[(count > 0) & ((count == len(self.words)) | (count == texts.count[at]))] = 1.0
        best[texts.count[at] == 0] = 0.0
        return best


class Slice:
    """The queries of a slice and the k best externals of each so far."""

    def __init__(self, rows: list[tuple], drop: dict[str, set], generic: frozenset[str], k: int):
        self.drop, self.generic, self.k = drop, generic, k
        self.chars: dict[str, int] = {}
        self.vocabulary: dict[str, int] = {}
        self.address: dict[str, int] = {}
        self.codes: dict[str, int] = {}
        self.asked: set = set()
        self.units: dict[str, list] = {}
        for s1, part, tokens, sounds, words, code, name, reduced, near in rows:
            q = (part, tokens or [], sounds or [], list(dict.fromkeys(words or [])), code, Pattern(name, self.chars, self.vocabulary), Pattern(reduced, self.chars, self.vocabulary), near or [])
            self.units.setdefault(s1, []).append(q)
            self.asked.update((TOKEN, t) for t in q[1])
            self.asked.update((SOUND, t) for t in q[2])
            self.asked.update((PLACE, t) for t in q[3])
            for w in q[3]:
                self.address.setdefault(w, len(self.address) + 1)
            if code is not None:
                self.codes.setdefault(code, len(self.codes))
        n = len(self.units)
        self.score, self.place = np.full((n, k), -np.inf), np.zeros((n, k), np.int64)
        self.found, self.full = np.zeros((n, k), np.uint8), np.zeros(n, np.int64)
        self.worth, self.worth_address = np.zeros(len(self.vocabulary) + 1, np.int64), np.zeros(len(self.address) + 1, bool)

    def meet(self, rows: list[tuple], base: int) -> None:
        """Compare all queries with a chunk of externals, the first of which is at place base of all."""
        order = sorted(range(len(rows)), key=lambda i: -len(rows[i][6]))
        place = base + np.array(order, dtype=np.int64)
        rows = [rows[i] for i in order]
        post = defaultdict(list)
        parts, at = set(), defaultdict(list)
        for i, (id_, part, tokens, sounds, words, code, *_) in enumerate(rows):
            parts.add(part)
            at[id_].append(i)
            for t in dict.fromkeys(tokens or ()):
                if (TOKEN, t) in self.asked and len(t) >= 2 and t not in self.drop["token_stop"] and (part, t) not in self.drop["token"]:
                    post[TOKEN, part, t].append(i)
            for t in sounds or ():
                if (SOUND, t) in self.asked and (part, t) not in self.drop["phonetic"]:
                    post[SOUND, part, t].append(i)
            for t in dict.fromkeys(words or ()):
                if (PLACE, t) in self.asked and len(t) >= 3 and t not in self.generic and t not in self.drop["address_stop"]:
                    post[PLACE, part, t].append(i)
            if code is not None and code.strip(" ") and code in self.codes and (part, code) not in self.drop["postal"]:
                post[0, part, code].append(i)
        post = {key: np.array(v, dtype=np.int32) for key, v in post.items()}
        twins = [np.array(v) for v in at.values() if len(v) > 1] if len(at) < len(rows) else []
        norm, reduced = (Texts([r[c] for r in rows], self.chars, self.vocabulary) for c in (6, 7))
        blank = np.array([r[6] == "" for r in rows], dtype=bool)
        foreign = np.array([0.08 if r[8] else 0.0 for r in rows])
        code = np.array([-2 if r[5] is None else self.codes.get(r[5], -2) for r in rows], dtype=np.int64)
        distinct = [list(dict.fromkeys(r[4] or ())) for r in rows]
        sizes = np.fromiter(map(len, distinct), np.int64, len(rows))
        most = max(1, min(MOST, int(np.quantile(sizes, 0.9995, method="higher"))))
        words = np.zeros((len(rows), most), np.int32)
        for i, w in enumerate(distinct):
            if len(w) <= most:
                words[i, : len(w)] = [self.address.get(x, 0) for x in w]
        long_ones = sizes > most
        seen, shared = np.zeros(len(rows), np.uint8), np.zeros(len(rows), np.int32)
        for unit, queries in enumerate(self.units.values()):
            for own, tokens, sounds, address, postal, _, _, near in queries:
                where = (own, ANY) if own else parts
                for kind, keys in ((TOKEN, tokens), (SOUND, sounds)):
                    for t in keys:
                        for p in where:
                            if (hit := post.get((kind, p, t))) is not None:
                                seen[hit] |= kind
                for t in address:
                    for p in where:
                        if (hit := post.get((PLACE, p, t))) is not None:
                            shared[hit] += 1
                if address:
                    seen[shared >= 2] |= PLACE
                    shared[:] = 0
                if postal is not None and postal.strip(" "):
                    for p in where:
                        if (hit := post.get((0, p, postal))) is not None:
                            seen[hit] |= PLACE
                for id_ in near:
                    if id_ in at:
                        seen[at[id_]] |= NEAR
            for group in twins:
                seen[group] = np.bitwise_or.reduce(seen[group])
            idx = np.flatnonzero(seen)
            if not len(idx):
                continue
            found = seen[idx]
            seen[idx] = 0
            for _, _, _, address, postal, a_norm, a_reduced, _ in queries:
                name = np.zeros(len(idx))
                for pattern, texts in ((a_norm, norm), (a_reduced, reduced)):
                    pattern.prepare(self.chars, self.vocabulary, self.worth)
                    name = np.maximum(name, pattern.token_set(texts, idx, self.worth))
                    self.worth[pattern.ids] = 0
                    pattern.table = pattern.masks = None
                name[blank[idx]] = 0.0
                mine = [self.address[w] for w in address]
                self.worth_address[mine] = True
                both = self.worth_address[words[idx]].sum(axis=1)
                self.worth_address[mine] = False
                for i in np.flatnonzero(long_ones[idx]):
                    both[i] = len(set(address) & set(distinct[idx[i]]))
                union = len(address) + sizes[idx] - both
                place_score = both / np.maximum(union, 1)
                post_score = (code[idx] == (-1 if postal is None else self.codes[postal])).astype(float)
                score = np.maximum(name, place_score) + 0.15 * np.minimum(name, place_score) + 0.10 * post_score + foreign[idx]
                self.keep(unit, score, place[idx], found)

    def keep(self, unit: int, score: np.ndarray, place: np.ndarray, found: np.ndarray) -> None:
        n = int(self.full[unit])
        if n == self.k:
            good = score >= self.score[unit].min()
            score, place, found = score[good], place[good], found[good]
            if not len(score):
                return
        score, place, found = (np.concatenate(x) for x in ((self.score[unit, :n], score), (self.place[unit, :n], place), (self.found[unit, :n], found)))
        if len(score) > self.k:
            good = np.flatnonzero(score >= np.partition(score, len(score) - self.k)[len(score) - self.k])
            good = good[np.lexsort((place[good], -score[good]))[: self.k]]
            score, place, found = score[good], place[good], found[good]
        n = self.full[unit] = len(score)
        self.score[unit, :n], self.place[unit, :n], self.found[unit, :n] = score, place, found


def best(batches: Iterator[pa.RecordBatch], k: int, generic: frozenset[str], chunk: int = CHUNK) -> Iterator[pa.RecordBatch]:
    """(s1, id, strategies, score) of one slice: keys that are left out (kind 0), queries (1) and externals (2), in this order."""
    drop, queries, held, ids, done = defaultdict(set), [], [], [], 0
    queries_of = None
    known: dict[str, str] = {}  # one object for each key, however many rows have it
    same = lambda keys: None if keys is None else [known.setdefault(x, x) for x in keys]
    for batch in batches:
        columns = {c: batch.column(c).to_pylist() for c in batch.schema.names}
        for kind, id_, part, tokens, sounds, words, code, name, reduced, foreign, near in zip(*(columns[c] for c in COLUMNS), strict=True):
            tokens, sounds, words = same(tokens), same(sounds), same(words)
            if kind == 0:
                drop[id_].add(name if part is None else (part, name))
            elif kind == 1:
                queries.append((id_, part, tokens, sounds, words, code, name, reduced, near))
            else:
                if queries_of is None:
                    queries_of = Slice(queries, drop, generic, k)
                if len(held) >= chunk and held[-1][0] != id_:  # rows of one id meet the queries together
                    ids.append(pa.array([r[0] for r in held], pa.string()))
                    queries_of.meet(held, done)
                    done, held = done + len(held), []
                    known.clear()
                held.append((id_, part, tokens, sounds, words, code, name, reduced, foreign))
    if queries_of is None:
        return
    ids.append(pa.array([r[0] for r in held], pa.string()))
    queries_of.meet(held, done)
    everyone, names = pa.chunked_array(ids), pa.array(STRATEGIES, pa.list_(pa.string()))
    units = pa.array(list(queries_of.units), pa.string())
    for begin in range(0, len(units), 2000):
        used = np.arange(k) < queries_of.full[begin : begin + 2000, None]
        row = np.nonzero(used)[0] + begin
        take = lambda x: x[begin : begin + 2000][used]
        found = [units.take(pa.array(row)), everyone.take(pa.array(take(queries_of.place))).combine_chunks(), names.take(pa.array(take(queries_of.found))), pa.array(take(queries_of.score))]
        yield pa.RecordBatch.from_arrays(found, names=["s1", "id", "strategies", "score"])


COLUMNS = ["kind", "id", "part", "tokens", "sounds", "words", "code", "name", "reduced", "foreign", "near"]
