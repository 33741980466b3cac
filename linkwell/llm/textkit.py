"""Vectorised word splitting and hashing over the UTF-8 bytes of many texts at once."""

from __future__ import annotations

import numpy as np

U = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = np.asarray(x, U)
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


_BYTE_AT = mix(np.arange(1, 64 * 256 + 1, dtype=U) * U(0x9E3779B97F4A7C15))
_BLOCK = 1 << 20


def lower_ascii(buf: np.ndarray) -> np.ndarray:
    return _LOWER[buf]


def word_bounds(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words [^\\x20\\x09-\\x0D]+, and for each text its first word's index (n + 1 entries)."""
    n = len(buf)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(off), np.int64)
    tok = ~_SPACE[buf]
    before = np.empty(n, bool)
    before[0], before[1:] = False, tok[:-1]
    before[off[:-1][off[:-1] < n]] = False
    after = np.empty(n, bool)
    after[-1], after[:-1] = False, tok[1:]
    after[off[1:][off[1:] > 0] - 1] = False
    starts = np.flatnonzero(tok & ~before)
    ends = np.flatnonzero(tok & ~after) + 1
    return starts, ends, np.searchsorted(starts, off)


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit tabulation hash of each word, in blocks of bytes so that memory stays bounded for any word length."""
    out = np.zeros(len(starts), U)
    for a in range(0, len(buf), _BLOCK):
        b = min(a + _BLOCK, len(buf))
        i, j = int(np.searchsorted(ends, a, side="right")), int(np.searchsorted(starts, b))
        if i >= j:
            continue
        s, e = np.maximum(starts[i:j], a), np.minimum(ends[i:j], b)
        lens = e - s
        at = np.repeat(s - np.concatenate(([0], np.cumsum(lens)[:-1])), lens) + np.arange(int(lens.sum()))
        pos = at - np.repeat(starts[i:j], lens)
        h = _BYTE_AT[((pos & 63) << 8) | buf[at]]
        far = pos >= 64
        if far.any():
            h[far] = mix(h[far] + (pos[far] >> 6).astype(U) * U(0xD6E8FEB86659FD93))
        with np.errstate(over="ignore"):
            out[i:j] += np.add.reduceat(h, np.cumsum(lens) - lens)
    with np.errstate(over="ignore"):
        return mix(out + (ends - starts).astype(U) * U(0xA0761D6478BD642F))


def shingle_hashes(words: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of k words of each text, repeats kept, and each text's first shingle (n + 1 entries).

    A text with 1 to k - 1 words has one shingle, its whole word sequence; one without words has none.
    """
    n = np.diff(first)
    counts = np.where(n >= k, n - k + 1, (n > 0).astype(n.dtype))
    ptr = np.concatenate(([0], np.cumsum(counts)))
    out = np.zeros(int(ptr[-1]), U)
    with np.errstate(over="ignore"):
        if len(words) >= k:
            roll = np.zeros(len(words) - k + 1, U)
            for i in range(k):
                roll = roll * U(0x9FB21C651E98DF25) + words[i : i + len(roll)]
            roll = mix(roll + U(k))
            full = np.flatnonzero(n >= k)
            if len(full):
                reps = counts[full]
                src = np.repeat(first[full] - ptr[full], reps)
                dst = np.repeat(ptr[full] - np.concatenate(([0], np.cumsum(reps)[:-1])), reps) + np.arange(int(reps.sum()))
                out[dst] = roll[dst + src]
        for d in np.flatnonzero((n > 0) & (n < k)):
            h = U(0)
            for w in words[first[d] : first[d + 1]]:
                h = h * U(0x9FB21C651E98DF25) + w
            out[ptr[d]] = mix(np.array([h + U(n[d])]))[0]
    return out, ptr
