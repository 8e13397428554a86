"""Byte-level BPE encoding and decoding (operator 7).

Merging runs on a hierarchical-bitmap rank queue. Every merge rank has a bucket of linked-list positions, kept as a
small heap so that the leftmost pair of a rank goes first. Two levels of bitmaps say which buckets hold anything: words
of 256 ranks, and one word over those; find-first-set on each level gives the lowest rank. An entry whose pair has since
changed is stale and is skipped when it is popped. A pre-token of n bytes costs O(n log n) however long it is.

Results are those of encoding each match of the split pattern on its own: a pre-token that is itself a rank maps to
it, any other is merged by lowest rank, leftmost first.

Texts are cut into pieces that encode independently, and ids of short pieces are kept in a table of bounded size per
Python worker (see ``pieces``); ids of pre-tokens that a new piece is made of are remembered, too.

Null and empty texts have no ids; repeated rows give repeated results; an empty table gives an empty one.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator, Sequence
from functools import cache
from heapq import heappop, heappush
from itertools import pairwise
from struct import pack

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tagmill.llm.common import slices, small_batches, tidy, two_columns
from tagmill.llm.pieces import Memo, PieceEncoder

#: Pre-tokens of up to so many characters are remembered, in two generations of so many.
MEMO_CHARS = 48
MEMO_SIZE = 120_000
#: log2 of the slots of the table of pieces.
TABLE_BITS = 20
#: Ranks of one word of the lower bitmap; Python's integers make words of any width.
SHIFT = 8
MASK = (1 << SHIFT) - 1


class ByteBPE:
    """Encoder and decoder over mergeable ranks (bytes -> id) and a split pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        self.ranks = ranks
        self.findall = regex.compile(pattern).findall
        self._tokens = Memo(self._encode_token, MEMO_SIZE)
        self.table = PieceEncoder(self._encode_pieces, TABLE_BITS)
        tokens = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            tokens[rank] = token
        self.bytes = np.frombuffer(b"".join(tokens), np.uint8)
        self.length = np.fromiter(map(len, tokens), np.int64, len(tokens))
        self.place = np.cumsum(self.length) - self.length

    @classmethod
    def from_file(cls, path: str, pattern: str) -> ByteBPE:
        with open(path, "rb") as lines:
            return cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}, pattern)

    def merge(self, data: bytes) -> list[int]:
        """Ids of one pre-token."""
        ranks = self.ranks
        whole = ranks.get(data)
        if whole is not None:
            return [whole]
        n = len(data)
        get = ranks.get
        end = list(range(1, n + 1))  # of the node that starts at i
        back = list(range(-1, n - 1))
        rank_at = [-1] * n  # rank of the pair that starts at i, -1 if none: an entry of another rank is stale
        buckets: dict[int, int | list[int]] = {}  # a single position, or a heap of several
        low: dict[int, int] = {}  # word -> which of its WORD ranks have a bucket
        top = 0  # which words hold anything
        for i in range(n - 1):
            r = get(data[i : i + 2])
            if r is not None:
                rank_at[i] = r
                bucket = buckets.get(r)
                if bucket is None:
                    buckets[r] = i
                    w = r >> SHIFT
                    low[w] = low.get(w, 0) | 1 << (r & MASK)
                    top |= 1 << w
                elif type(bucket) is list:
                    bucket.append(i)  # positions ascend here, so this is a heap
                else:
                    buckets[r] = [bucket, i]
        while top:
            w = (top & -top).bit_length() - 1
            bits = low[w]
            rank = (w << SHIFT) + (bits & -bits).bit_length() - 1
            bucket = buckets[rank]
            if type(bucket) is list:
                i = heappop(bucket)
                if not bucket:
                    bucket = None
            else:
                i, bucket = bucket, None
            if bucket is None:
                del buckets[rank]
                bits &= bits - 1
                low[w] = bits
                if not bits:
                    top &= top - 1
            if rank_at[i] != rank:
                continue  # stale
            j = end[i]
            rank_at[j] = -1
            e = end[i] = end[j]
            p = back[i]
            if e < n:
                back[e] = i
                r = get(data[i : end[e]])
            else:
                r = None
            q = get(data[p:e]) if p >= 0 else None
            rank_at[i] = -1 if r is None else r
            if p >= 0:
                if q == rank_at[p]:
                    q = None
                else:
                    rank_at[p] = -1 if q is None else q
            for r, i in ((r, i), (q, p)):
                if r is not None:
                    bucket = buckets.get(r)
                    if bucket is None:
                        buckets[r] = i
                        w = r >> SHIFT
                        low[w] = low.get(w, 0) | 1 << (r & MASK)
                        top |= 1 << w
                    elif type(bucket) is list:
                        heappush(bucket, i)
                    else:
                        buckets[r] = [bucket, i] if bucket < i else [i, bucket]
        out, i = [], 0
        while i < n:
            out.append(ranks[data[i : end[i]]])
            i = end[i]
        return out

    def _encode_token(self, token: str) -> bytes:
        ids = self.merge(token.encode())
        return pack(f"<{len(ids)}I", *ids)

    def _encode_pieces(self, parts: list[str], first: bool) -> list[bytes]:
        make, lead = self._tokens.__getitem__, "" if first else " "
        return [b"".join([make(t) if len(t) <= MEMO_CHARS else self._encode_token(t) for t in self.findall(lead + p)]) for p in parts]

    def encode(self, text: str) -> list[int]:
        return self.table.encode([text])[0].tolist()

    def decode_all(self, ids: np.ndarray) -> np.ndarray:
        """Bytes of the tokens end to end."""
        sizes = self.length[ids]
        ends = np.cumsum(sizes)
        return self.bytes[np.repeat(self.place[ids] - (ends - sizes), sizes) + np.arange(int(ends[-1]) if len(ends) else 0)]

    def decode(self, ids: Sequence[int]) -> bytes:
        return self.decode_all(np.asarray(ids, np.int64)).tobytes()


@cache
def encoder(path: str, pattern: str) -> ByteBPE:
    """One encoder for each Python worker."""
    return ByteBPE.from_file(path, pattern)


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str, key: str = "doc_id", text: str = "text", keep_ids: bool = False) -> DataFrame:
    """Encode and decode every whole text: doc_id, n_tokens, ids_sha256, decoded_sha256 (and ids, if asked for).

    ``ranks_path`` must be readable on the executors. No shuffle: rows stay in their partitions.
    """
    small_batches(docs.sparkSession)
    source = two_columns(docs, key, text)
    kind = dict(source.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(ranks_path, pattern)
        for whole in batches:
            for batch in slices(whole, "text", 2 << 20):
                ids, counts = bpe.table.encode([x or "" for x in batch.column(1).to_pylist()])
                text = memoryview(bpe.decode_all(ids).tobytes())
                raw = memoryview(ids.astype("<u4").tobytes())
                stops = np.cumsum(counts)
                sizes = np.concatenate([[0], np.cumsum(bpe.length[ids])])
                id_cuts, text_cuts = [0, *(4 * stops).tolist()], [0, *sizes[stops].tolist()]
                digests = [hashlib.sha256(raw[a:b]).hexdigest() for a, b in pairwise(id_cuts)]
                decoded = [hashlib.sha256(text[a:b]).hexdigest() for a, b in pairwise(text_cuts)]
                kept = [bytes(raw[a:b]) for a, b in pairwise(id_cuts)] if keep_ids else []
                columns = [batch.column(0), pa.array(counts, pa.int64()), pa.array(digests, pa.string()), pa.array(decoded, pa.string())]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                yield pa.RecordBatch.from_arrays(columns + [pa.array(kept, pa.binary())] * keep_ids, names + ["ids"] * keep_ids)

    return source.mapInArrow(tidy(run), f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids binary" * keep_ids)
