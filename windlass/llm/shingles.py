"""Word shingles as arrays of 64-bit hashes."""

from __future__ import annotations

import numpy as np
import xxhash

from .common import ASCII_LOWER

_U = np.uint64
_MULT = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)
_MEMO = 300_000


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: each bit of the result depends on all bits of the input."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class WordHashes(dict):
    """word -> 64-bit hash, remembered for up to _MEMO words."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= _MEMO:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def word_hashes(texts: list, memo: WordHashes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of all texts (A-Z lower-cased, split at ASCII white space), and where each text begins."""
    lists = [(t or "").encode("utf-8", "surrogatepass").translate(ASCII_LOWER).split() for t in texts]
    begins = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int64)
    get = memo.__getitem__
    return np.fromiter((get(w) for x in lists for w in x), np.uint64, begins[-1]), begins


def sets(texts: list, n: int, memo: WordHashes) -> list[np.ndarray]:
    """The sorted distinct n-word shingles of each text; a text of fewer words is one shingle, one without words none."""
    h, begins = word_hashes(texts, memo)
    size = max(0, len(h) - n + 1)
    s = np.zeros(size, np.uint64)
    for k in range(n):
        s += h[k:k + size] * _MULT[k]
    s = mix(s)
    out = []
    for b, e in zip(begins[:-1].tolist(), begins[1:].tolist()):
        if e - b >= n:
            out.append(np.unique(s[b:e - n + 1]))
        elif e > b:
            out.append(mix((h[b:e] * _MULT[:e - b]).sum(keepdims=True) + _U(e - b)))
        else:
            out.append(h[:0])
    return out
