"""Words and pairs of words of texts as counts in hashed columns.

Columns and counts are those of ``RegexTokenizer`` (pattern ``\\W+``), ``NGram`` (n=2) and ``HashingTF`` of pyspark.ml; here
a batch of texts is one array of bytes, and a string is hashed once a batch.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of words in lower case; 0 for what is between words.
_WORD = np.array([ord(chr(b).lower()) if b < 128 and (chr(b).isalnum() or b == 95) else 0 for b in range(256)], np.uint8)


def _murmur3(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, seed: int = 42) -> np.ndarray:
    """MurmurHash3 (x86, 32 bits) of many strings in one array of bytes, which three more bytes follow."""
    c1, c2 = np.uint32(0xCC9E2D51), np.uint32(0x1B873593)
    turn = lambda x, r: (x << np.uint32(r)) | (x >> np.uint32(32 - r))
    h = np.full(len(starts), seed, np.uint32)
    order = np.argsort(-sizes, kind="stable")  # strings that go on are a prefix
    at, left, h_ = starts[order], sizes[order], h[order]
    whole = left // 4

    def word(i):
        return data[i].astype(np.uint32) | data[i + 1].astype(np.uint32) << np.uint32(8) | data[i + 2].astype(np.uint32) << np.uint32(16) | data[i + 3].astype(np.uint32) << np.uint32(24)

    for step in range(int(whole.max(initial=0))):
        n = np.searchsorted(-whole, -step, "left")  # whole > step
        k = turn(word(at[:n] + 4 * step) * c1, 15) * c2
        h_[:n] = turn(h_[:n] ^ k, 13) * np.uint32(5) + np.uint32(0xE6546B64)
    rest = (left % 4).astype(np.uint32)
    k = word(at + 4 * whole) & ((np.uint32(1) << (rest * np.uint32(8))) - np.uint32(1))
    h_ ^= turn(k * c1, 15) * c2  # 0 where nothing is left
    h_ ^= left.astype(np.uint32)
    h_ = (h_ ^ (h_ >> np.uint32(16))) * np.uint32(0x85EBCA6B)
    h_ = (h_ ^ (h_ >> np.uint32(13))) * np.uint32(0xC2B2AE35)
    h[order] = h_ ^ (h_ >> np.uint32(16))
    return h


def _spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Places starts[i], starts[i] + 1, ... of each run, one after the other."""
    before = np.cumsum(sizes) - sizes
    return np.repeat(starts - before, sizes) + np.arange(int(sizes.sum()))


def counts(texts: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Columns (ascending in a text), counts, and where each text starts in them; width: a power of two."""
    # of characters beyond ASCII, two become letters of it in lower case
    texts = pc.replace_substring(pc.replace_substring(pc.fill_null(texts.cast(pa.large_string()), ""), "\u212a", "k"), "\u0130", "i\u0307")
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = _WORD[np.frombuffer(texts.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]]
    ends = ends - ends[0]
    inside = raw > 0
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    cuts = ends[:-1][(ends[:-1] < ends[1:])]  # a text's first word starts there, even if the text before ends in a word
    first[cuts] = inside[cuts]
    starts = np.flatnonzero(first)
    data = raw[inside]
    offsets = np.append(np.cumsum(inside)[starts] - 1, len(data)) if len(starts) else np.zeros(1, np.int64)
    doc = np.searchsorted(ends, starts, "right") - 1
    words = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data)]).dictionary_encode()
    word, known = words.indices.to_numpy().astype(np.int64), words.dictionary
    at = np.frombuffer(known.buffers()[1], np.int64)[: len(known) + 1] if len(known) else np.zeros(1, np.int64)
    letters = np.concatenate([np.frombuffer(known.buffers()[2] or b"", np.uint8)[: at[-1]], np.zeros(4, np.uint8)])
    sizes = np.diff(at)
    single = _murmur3(letters, at[:-1], sizes) & np.uint32(width - 1)
    both = doc[1:] == doc[:-1]
    pairs, which = np.unique(word[:-1][both] * len(known) + word[1:][both], return_inverse=True)
    a, b = np.divmod(pairs, max(len(known), 1))
    long = sizes[a] + 1 + sizes[b]
    begin = np.cumsum(long) - long
    joined = np.full(int(long.sum()) + 4, 32, np.uint8)
    joined[_spread(begin, sizes[a])] = letters[_spread(at[a], sizes[a])]
    joined[_spread(begin + sizes[a] + 1, sizes[b])] = letters[_spread(at[b], sizes[b])]
    double = _murmur3(joined, begin, long) & np.uint32(width - 1)
    keys = np.concatenate([doc * width + single[word], doc[1:][both] * width + double[which]])
    keys, n = np.unique(keys, return_counts=True)
    return keys % width, n, np.searchsorted(keys, np.arange(len(texts) + 1) * width)
