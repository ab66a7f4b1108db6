"""Five-word shingles of whole texts as 64-bit hashes, for many texts at once."""

from __future__ import annotations

import numpy as np

#: The ASCII white space that separates words.
SPACES = b" \t\n\x0b\x0c\r"
WORDS = 5
_SPACE = np.zeros(256, bool)
_SPACE[list(SPACES)] = True
_BASE, _STEP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _powers(n: int) -> np.ndarray:
    out = np.ones(n, np.uint64)
    if n > 1:
        out[1:] = _BASE
        np.multiply.accumulate(out, out=out)
    return out


def shingle_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, counts): the hashes of all texts one after another, sorted within each text, and how many each has.

    A text of fewer words than a shingle has one shingle of all its words, a text without words has none.
    """
    counts = np.zeros(len(texts), np.int64)
    raw = np.frombuffer(b" " + b" ".join(texts) + b" ", np.uint8)
    ends_at = np.cumsum([len(t) + 1 for t in texts])
    space = _SPACE[raw]
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    starts, stops = edge[0::2], edge[1::2]
    if not len(starts):
        return np.zeros(0, np.uint64), counts
    size = stops - starts
    at = np.arange(len(raw)) - np.repeat(np.append(0, starts), np.diff(np.append(np.append(0, starts), len(raw))))
    part = (raw.astype(np.uint64) + np.uint64(1)) * _powers(int(size.max()) + 1)[np.minimum(at, size.max())]
    part[space] = 0
    word = mix(np.add.reduceat(part, starts) ^ size.astype(np.uint64))
    n_words = np.diff(np.searchsorted(starts, np.append(0, ends_at + 1)))
    first = np.cumsum(n_words) - n_words
    padded = np.append(word, np.zeros(WORDS, np.uint64))
    rolled = np.zeros(len(word), np.uint64)
    for i in range(WORDS):
        rolled = rolled * _STEP + padded[i:i + len(word)]
    counts = np.where(n_words >= WORDS, n_words - WORDS + 1, np.minimum(n_words, 1))
    for d in np.flatnonzero((n_words > 0) & (n_words < WORDS)):
        h = np.uint64(n_words[d])
        for w in word[first[d]:first[d] + n_words[d]]:
            h = np.uint64((int(h) * int(_STEP) + int(w)) & 0xFFFFFFFFFFFFFFFF)
        rolled[first[d]] = h
    kept = np.repeat(first - (np.cumsum(counts) - counts), counts) + np.arange(int(counts.sum()))
    hashes = mix(rolled[kept])
    stop = np.cumsum(counts)
    for lo, hi in zip((stop - counts).tolist(), stop.tolist()):
        hashes[lo:hi].sort()
    return hashes, counts


def occurrence(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """0 for the first occurrence of a hash in its text, 1 for the second, and so on."""
    new = np.ones(len(hashes), bool)
    new[1:] = hashes[1:] != hashes[:-1]
    heads = np.cumsum(counts) - counts
    new[heads[counts > 0]] = True
    at = np.flatnonzero(new)
    return np.arange(len(hashes)) - np.repeat(at, np.diff(np.append(at, len(hashes))))


def jaccards(a: np.ndarray, b: np.ndarray) -> tuple[float, float]:
    """Jaccard similarity of two sorted hash lists as sets and as multisets."""
    ua, na = np.unique(a, return_counts=True)
    ub, nb = np.unique(b, return_counts=True)
    at = np.minimum(np.searchsorted(ua, ub), max(0, len(ua) - 1))
    hit = ua[at] == ub if len(ua) else np.zeros(len(ub), bool)
    sets, both = int(hit.sum()), int(np.minimum(na[at[hit]], nb[hit]).sum())
    return sets / max(1, len(ua) + len(ub) - sets), both / max(1, len(a) + len(b) - both)
