"""Hashed word shingles of whole texts, in numpy, inside tasks."""

from __future__ import annotations

from itertools import chain

import numpy as np

#: Words that a worker remembers before it starts afresh, and bytes handled at a time.
CACHE = 400_000
CHUNK = 1 << 20
_A, _B = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
#: Odd multipliers of the positions in a shingle.
_PLACES = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser, elementwise."""
    x = x ^ (x >> np.uint64(30))
    x = x * _A
    x ^= x >> np.uint64(27)
    x *= _B
    x ^= x >> np.uint64(31)
    return x


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        import xxhash

        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


class Shingler:
    """64-bit hashes of the ``width``-word shingles of texts.

    Words are ``[^\\x20\\x09-\\x0D]+`` after A-Z became lower case.  A text with fewer
    words than ``width`` has its whole sequence as one shingle, one without words none.
    """

    def __init__(self, width: int, seed: int = 0):
        self.width, self.words = width, _Words()
        self.seed = np.array([(seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & 0xFFFFFFFFFFFFFFFF], np.uint64)

    def sequences(self, texts: list[bytes]) -> list[np.ndarray]:
        """Of each text, in UTF-8, the shingle hashes by position."""
        split = [t.lower().split() for t in texts]
        if len(self.words) > CACHE:
            self.words = _Words()
        counts = [len(x) for x in split]
        ends = np.cumsum(counts)
        total = int(ends[-1]) if counts else 0
        w = np.fromiter(map(self.words.__getitem__, chain.from_iterable(split)), np.uint64, total)
        k = self.width
        n = max(0, total - k + 1)
        s = np.repeat(self.seed, n)
        for i in range(k):
            s += w[i : i + n] * _PLACES[i]
        s = mix(s)
        out, a = [], 0
        for count, b in zip(counts, ends.tolist()):
            if count >= k:
                out.append(s[a : b - k + 1])
            elif count:
                own = w[a:b] * _PLACES[k - count : k]
                out.append(mix(np.add.reduce(own, keepdims=True) + (self.seed + np.uint64(count))))
            else:
                out.append(s[:0])
            a = b
        return out


def distinct(hashes: np.ndarray) -> np.ndarray:
    """Sorted, each once."""
    s = np.sort(hashes)
    return s[np.append(True, s[1:] != s[:-1])] if len(s) > 1 else s


def text_chunks(column):
    """(first row, texts in UTF-8) of an Arrow column, about CHUNK bytes at a time; null is empty."""
    column, at = column.cast("binary"), 0
    while at < len(column):
        first, some, size = at, [], 0
        while at < len(column) and size < CHUNK:
            some.append(column[at].as_py() or b"")
            size, at = size + len(some[-1]), at + 1
        yield first, some
