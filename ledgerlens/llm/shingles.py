"""Word shingles as 64-bit keys, a batch of documents at a time.

Words are the maximal runs without the six ASCII white-space characters, A-Z
lower-cased; a shingle is ``k`` words in a row. A document with fewer words is
one shingle of all its words, one without words has none.
"""

from __future__ import annotations

import numpy as np
import xxhash

_MULT = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of unsigned 64-bit values."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


class Shingler:
    """Shingle keys of whole texts; remembers the keys of up to ``max_words`` distinct words."""

    def __init__(self, k: int = 5, max_words: int = 300_000):
        self.k = k
        self.max_words = max_words
        self._keys: dict[bytes, bytes] = {}
        self._factors = [np.uint64(pow(_MULT, i, _MASK + 1)) for i in range(k)]

    def word_keys(self, text: str | None) -> np.ndarray:
        words = (text or "").encode("utf-8", "surrogatepass").lower().split()
        keys = self._keys
        try:
            packed = b"".join([keys[w] for w in words])
        except KeyError:
            if len(keys) > self.max_words:
                keys.clear()
            for w in words:
                if w not in keys:
                    keys[w] = xxhash.xxh64_digest(w)
            packed = b"".join([keys[w] for w in words])
        return np.frombuffer(packed, dtype=np.uint64)

    def shingles(self, text: str | None) -> np.ndarray:
        """The distinct shingle keys of one text, ascending."""
        w = self.word_keys(text)
        if not len(w):
            return w
        k = min(self.k, len(w))
        n = len(w) - k + 1
        with np.errstate(over="ignore"):
            acc = w[:n] + np.uint64(k)
            for i in range(1, k):
                acc = acc + w[i:i + n] * self._factors[i]
        keys = mix64(acc)
        keys.sort()
        if n > 1:
            keep = np.empty(n, dtype=bool)
            keep[0] = True
            np.not_equal(keys[1:], keys[:-1], out=keep[1:])
            keys = keys[keep]
        return keys
