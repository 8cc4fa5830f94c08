"""Distinct word-shingle sets of texts as sorted 64-bit hashes (numpy)."""

from __future__ import annotations

import numpy as np
import xxhash

_GOLD = np.uint64(0x9E3779B97F4A7C15)
_M1 = np.uint64(0xBF58476D1CE4E5B9)
_M2 = np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over all 64 (wraps on purpose)."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """64-bit hashes of words, remembered up to ``limit`` words."""

    def __init__(self, limit: int = 400_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


def shingle_set(text: str | None, width: int, words: WordHashes) -> np.ndarray:
    """Sorted distinct hashes of the ``width``-word shingles of a whole text.

    A-Z are lower-cased and words are split at ASCII white space.  A text with
    fewer words is one shingle of all of them; without words the set is empty.
    """
    flat, _ = shingle_sets([text], width, words)
    return flat


def _rolled(h: np.ndarray, wide: int) -> np.ndarray:
    """Hashes of every ``wide`` values in a row, one for each start."""
    n = len(h) - wide + 1
    out = np.zeros(n, np.uint64)
    for i in range(wide):
        out = mix((out + _GOLD) ^ h[i : i + n])
    return out


def shingle_sets(texts: list[str | None], width: int, words: WordHashes) -> tuple[np.ndarray, np.ndarray]:
    """The sets of several texts one after the other, and how large each is."""
    # bytes.lower and bytes.split act on ASCII only, as wanted.
    parts = [(t or "").encode("utf-8", "surrogatepass").lower().split() for t in texts]
    long = np.array([len(p) for p in parts], np.int64)
    h = np.fromiter((words[w] for p in parts for w in p), np.uint64, int(long.sum()))
    # Windows over all texts at once; those that cross an end are left out.
    rolled = _rolled(h, width) if len(h) >= width else h[:0]
    ends, out = np.cumsum(long), []
    for n, end in zip(long.tolist(), ends.tolist(), strict=True):
        if n >= width:
            s = np.sort(rolled[end - n : end - width + 1])
            out.append(s[np.r_[True, s[1:] != s[:-1]]])
        elif n:
            out.append(mix(_rolled(h[end - n : end], n) + np.uint64(n)))
        else:
            out.append(h[:0])
    return np.concatenate(out) if out else h, np.array([len(s) for s in out], np.int64)


def digests(s: np.ndarray) -> tuple[int, int]:
    """Two independent 64-bit digests of a sorted set, as signed integers."""
    raw = xxhash.xxh3_128_digest(s.tobytes())
    a, b = np.frombuffer(raw, np.int64)
    return int(a), int(b)
