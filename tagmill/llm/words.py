"""Words of many texts at once, and hashes of runs of them, without a Python object per word."""

from __future__ import annotations

import hashlib

import numpy as np

#: Lower-cases A-Z and makes every byte that can't be in a word 0.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 0 for c in range(256))
_P = np.uint64(0x100000001B3)
_Q = np.uint64(0x9E3779B97F4A7C15)


class Words:
    """Words of several texts at once: where each starts and ends, and a 64-bit hash of each."""

    def __init__(self, texts: list[bytes]):
        joined = b"\0".join(texts).translate(_FOLD)
        self.bytes = joined
        raw = np.frombuffer(joined, np.uint8)
        inside = raw != 0
        edge = np.flatnonzero(np.diff(inside, prepend=False, append=False))
        self.start, self.stop = edge[0::2], edge[1::2]
        sizes = np.array([len(t) + 1 for t in texts], np.int64)
        ends = np.cumsum(sizes)
        #: words before each text, and after the last
        self.bounds = np.searchsorted(self.start, np.concatenate([[0], ends]))
        self.hash = self._hashes(raw)

    def _hashes(self, raw: np.ndarray) -> np.ndarray:
        """Polynomial in the bytes of a word, then mixed. Sums wrap, so the hash of a word is the same in any place."""
        if not len(self.start):
            return np.empty(0, np.uint64)
        length = self.stop - self.start
        out = np.zeros(len(length), np.uint64)
        most = 12
        for i in range(min(int(length.max()), most)):  # few words are longer
            at = length > i
            if at.all():
                out = out * _P + raw[self.start + i] + np.uint64(1)
            else:
                out[at] = out[at] * _P + raw[self.start[at] + i] + np.uint64(1)
        for w in np.flatnonzero(length > most).tolist():
            rest = hashlib.blake2b(self.bytes[self.start[w] + most : self.stop[w]], digest_size=8).digest()
            out[w] ^= np.uint64(int.from_bytes(rest, "little"))
        out *= _Q
        return out ^ (out >> np.uint64(29))

    def word(self, i: int) -> bytes:
        return self.bytes[self.start[i] : self.stop[i]]

    def same(self, i: int, other: Words, j: int) -> bool:
        return self.hash[i] == other.hash[j] and self.word(i) == other.word(j)


def grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k words from each place on."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for i in range(k):
        out = out * _P + (hashes[i : i + n] ^ np.uint64(i))
    out *= _Q
    return out ^ (out >> np.uint64(31))
