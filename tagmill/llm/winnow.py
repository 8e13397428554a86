"""Benchmark decontamination by winnowing (operator 9).

Words are runs of letters and digits (ASCII lower-cased) or of any non-ASCII characters. Of every ``SPAN`` consecutive
words of an item, ``SPAN - K + 1`` neighbouring k-grams of words are hashed and the smallest hash is its fingerprint
(the last one on ties). Which k-gram a window picks depends on the window alone, so an item and a document that share
``SPAN`` consecutive words share a fingerprint. Documents are winnowed the same way, their fingerprints are looked up in
the items' sorted ones, and every hit is extended word by word, comparing the words themselves, to the longest run that
both share. A run of at least ``SPAN`` words covers all of its words with windows of the item.

Items of fewer words than ``SPAN`` are one window as a whole. Winnowing can't promise to meet those, so the whole-item
hashes are looked up at every place of a document, one pass for each length that occurs among the items.

Items of ``BLOCK_BYTES`` of text at most are broadcast, and documents pass through them in their partitions, without a
shuffle. Of more items, those of at least ``SPAN`` words are met by a join: documents are winnowed once, their fingerprints
join the items' ones, and only the documents of a match move their texts, each with a bounded part of its items at a time, to
be extended as above. Items of fewer words go through the documents in blocks, as short as they are.

Null and empty texts have no words and no hits, null or word-less items have no windows; items that repeat a text each
count; rows that repeat a doc_id each get their own result; empty tables give an empty result or no hits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagmill.llm.common import BROADCAST_IDS, materialise, slices, small_batches, tidy
from tagmill.llm.words import Words, grams

#: Words of a window.
SPAN = 10
#: Words of a hashed k-gram.
K = 5
#: Bytes of item text that are broadcast at once.
BLOCK_BYTES = 16 << 20
#: Parts of the items that a document meets, which are extended one after the other.
ITEM_PARTS = 8
#: A word, for counting them.
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def winnow(values: np.ndarray, window: int) -> np.ndarray:
    """Places of the smallest value (the last on ties) of every window."""
    n = len(values) - window + 1
    if n <= 0:
        return np.empty(0, np.int64)
    least, place = values[:n].copy(), np.zeros(n, np.int8)
    for i in range(1, window):
        now = values[i : i + n]
        better = now <= least
        np.copyto(least, now, where=better)
        place[better] = i
    spots = np.arange(n) + place
    return spots[np.flatnonzero(np.diff(spots, prepend=-1))]


class Items:
    """Fingerprints of a block of items."""

    def __init__(self, ids: list[str], texts: list[bytes], span: int = SPAN, k: int = K):
        self.ids, self.span, self.k = ids, span, k
        self.words = w = Words(texts)
        self.item = np.repeat(np.arange(len(ids)), np.diff(w.bounds))
        marks: list[np.ndarray] = []
        short: dict[int, list[int]] = {}
        all_grams = grams(w.hash, k)
        for a, b in zip(w.bounds[:-1].tolist(), w.bounds[1:].tolist(), strict=True):
            if b - a >= span:
                marks.append(a + winnow(all_grams[a : b - k + 1], span - k + 1))
            elif b > a:
                short.setdefault(b - a, []).append(a)
        self.long = self._table(all_grams, np.concatenate(marks) if marks else np.empty(0, np.int64))
        self.short = {n: self._table(grams(w.hash, n), np.array(at)) for n, at in short.items()}

    @staticmethod
    def _table(values: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sorted fingerprints, their places, and a bitmap of their low 20 bits that lets most lookups end early."""
        order = np.argsort(values[at], kind="stable")
        keys = values[at][order]
        sieve = np.zeros(1 << 20, bool)
        sieve[(keys & np.uint64((1 << 20) - 1)).astype(np.int64)] = True
        return keys, at[order], sieve


def _lookup(table: tuple, values: np.ndarray, spots: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (place in the documents, place in the items) with one fingerprint."""
    keys, at, sieve = table
    if not len(keys):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    chosen = values if spots is None else values[spots]
    maybe = np.flatnonzero(sieve[(chosen & np.uint64((1 << 20) - 1)).astype(np.int64)])
    chosen = chosen[maybe]
    lo, hi = np.searchsorted(keys, chosen, "left"), np.searchsorted(keys, chosen, "right")
    n = hi - lo
    where = maybe if spots is None else spots[maybe]
    ends = np.cumsum(n)
    inner = np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - n, n)
    return np.repeat(where, n), at[np.repeat(lo, n) + inner]


def matches(texts: list[bytes], items: Items) -> tuple[Words, np.ndarray, list[set[int]]]:
    """Words of the texts, which of them are hit, and the items (by number) with occurring windows of each text."""
    w, of = Words(texts), items.words
    hit = np.zeros(len(w.hash), bool)
    found: list[set[int]] = [set() for _ in texts]
    k, span = items.k, items.span
    five = grams(w.hash, k)
    # windows that cross from one text to the next do no harm: a hit is extended inside its own text only
    i_at, j_at = _lookup(items.long, five, winnow(five, span - k + 1) if len(five) >= span - k + 1 else np.empty(0, np.int64))
    seen: dict[tuple[int, int], int] = {}  # diagonal -> end of the last run on it
    for i, j in zip(i_at.tolist(), j_at.tolist(), strict=True):
        item = int(items.item[j])
        diagonal = (item, i - j)
        if seen.get(diagonal, -1) > i:
            continue
        text = int(np.searchsorted(w.bounds, i, "right")) - 1
        a, b = int(w.bounds[text]), int(w.bounds[text + 1])
        c, d = int(of.bounds[item]), int(of.bounds[item + 1])
        left = 0
        while i - left > a and j - left > c and w.same(i - left - 1, of, j - left - 1):
            left += 1
        right = 0
        while i + right < b and j + right < d and w.same(i + right, of, j + right):
            right += 1
        seen[diagonal] = i + max(right, 1)
        if left + right >= span:
            hit[i - left : i + right] = True
            found[text].add(item)
    for n, table in items.short.items():
        for i, j in zip(*(x.tolist() for x in _lookup(table, grams(w.hash, n), None)), strict=True):
            text = int(np.searchsorted(w.bounds, i, "right")) - 1
            if i + n <= w.bounds[text + 1] and all(w.same(i + x, of, j + x) for x in range(n)):
                hit[i : i + n] = True
                found[text].add(int(items.item[j]))
    return w, hit, found


def blocks(items: DataFrame, block_bytes: int = BLOCK_BYTES) -> Iterator[tuple[list[str], list[bytes]]]:
    """Items (item, text) in blocks of bounded size, streamed through the driver one at a time."""
    ids, texts, size = [], [], 0
    for name, value in items.select("item", "text").toLocalIterator():
        data = (value or "").encode()
        if ids and size + len(data) > block_bytes:
            yield ids, texts
            ids, texts, size = [], [], 0
        ids.append(name)
        texts.append(data)
        size += len(data)
    yield ids, texts


def _joined_spans(spans: list[int], hit: np.ndarray) -> list[int]:
    """The hit words, and those of the spans start, end, start, end ..., as spans."""
    now = hit.copy()
    for x, y in zip(spans[::2], spans[1::2], strict=True):
        now[x:y] = True
    return np.flatnonzero(np.diff(now, prepend=False, append=False)).tolist()


def _through(shared, span: int, k: int):
    """Over rows of _FOUND: adds the hits of one block of items."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, item_texts = shared.value
        index = Items(ids, item_texts, span, k)
        for whole in batches:
            for batch in slices(whole, "text"):
                w, hit, found = matches([(x or "").encode() for x in batch.column(1).to_pylist()], index)
                spans, names = batch.column(3).to_pylist(), batch.column(4).to_pylist()
                for t, numbers in enumerate(found):
                    if numbers:
                        spans[t] = _joined_spans(spans[t], hit[w.bounds[t] : w.bounds[t + 1]])
                        names[t] = sorted({*names[t], *(ids[x] or "" for x in numbers)})
                made = [pa.array(np.diff(w.bounds), pa.int64()), pa.array(spans, pa.list_(pa.int64())), pa.array(names, pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays([*batch.columns[:2], *made, *batch.columns[5:]], batch.schema.names)

    return run


def _marks(frame: DataFrame, key: str, span: int, k: int) -> DataFrame:
    """key, mark: the fingerprints of each text (column text), once each."""
    kind = dict(frame.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                w = Words([(x or "").encode() for x in batch.column(1).to_pylist()])
                every = grams(w.hash, k)
                own = [every[a : b - k + 1] if b - a >= span else every[:0] for a, b in zip(w.bounds[:-1].tolist(), w.bounds[1:].tolist(), strict=True)]
                found = [np.unique(x[winnow(x, span - k + 1)]) if len(x) else x for x in own]
                rows = np.repeat(np.arange(len(found)), [len(x) for x in found])
                if len(rows):
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), pa.array(np.concatenate(found).view(np.int64))], [key, "mark"])

    return frame.select(key, "text").mapInArrow(tidy(run), f"{key} {kind}, mark bigint")


def _by_join(docs: DataFrame, items: DataFrame, span: int, k: int) -> DataFrame:
    """row_key, more_spans, more_items: hits of long items (item, text) in documents (row_key, text)."""
    numbered = materialise(items.select("item", "text").distinct().withColumn("number", F.monotonically_increasing_id()), "items")
    # equal documents have one key and one set of hits
    met = _marks(docs, "row_key", span, k).join(_marks(numbered, "number", span, k), "mark").select("row_key", "number").distinct()
    some = met.join(numbered, "number").groupBy("row_key", F.pmod("number", F.lit(ITEM_PARTS)).alias("part")).agg(F.collect_list("item").alias("ids"), F.collect_list(F.coalesce("text", F.lit(""))).alias("texts"))
    some = materialise(some, "met-items")
    asked = some.select("row_key").distinct()
    few = asked.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    pairs = docs.join(F.broadcast(asked) if few else asked.hint("shuffle_hash"), "row_key", "left_semi").join(some, "row_key").select("row_key", "text", "ids", "texts")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, text, ids, texts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                _, hit, found = matches([(text or "").encode()], Items(ids, [x.encode() for x in texts], span, k))
                if found[0]:
                    yield pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([_joined_spans([], hit)], pa.list_(pa.int64())), pa.array([[ids[x] or "" for x in found[0]]], pa.list_(pa.string()))], ["row_key", "spans", "items"])

    hits = pairs.mapInArrow(tidy(run), "row_key binary, spans array<bigint>, items array<string>").distinct()
    return hits.groupBy("row_key").agg(F.collect_list("spans").alias("more_spans"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("more_items"))


def _row_key(key: str, text: str) -> Column:
    """128 bits of a row's id and text."""
    return F.unhex(F.md5(F.concat_ws("\0", F.coalesce(F.col(key).cast("string"), F.lit("")), F.coalesce(F.col(text), F.lit("")))))


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over rows doc_id, n_words, spans, items, more_spans, more_items: the spans and items of both."""
    for batch in batches:
        spans, items = [], []
        for n, own, names, more, others in zip(*(c.to_pylist() for c in batch.columns[1:]), strict=True):
            spans.append(_joined_spans([x for part in [own, *more] for x in part], np.zeros(n, bool)) if more else own)
            items.append(sorted({*names, *(others or ())}))
        yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(spans, pa.list_(pa.int64())), pa.array(items, pa.list_(pa.string()))], batch.schema.names[:4])


def decontaminate(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", span: int = SPAN, k: int = K, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, and spans [start, end) of hit words.

    A null item_id counts under the empty name. Items that repeat an id count once in n_items.
    """
    k = min(k, span)
    small_batches(docs.sparkSession)
    items = benchmark.select(F.col(item_id).cast("string").alias("item"), F.col(item_text).alias("text"))
    few = (items.agg(F.sum(F.octet_length("text"))).first()[0] or 0) <= block_bytes
    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"), F.lit(0).cast("bigint").alias("n_words"), F.array().cast("array<bigint>").alias("spans"), F.array().cast("array<string>").alias("items"))
    if not few:
        rows = rows.withColumn("row_key", _row_key("doc_id", "text"))
    is_long = F.regexp_count("text", F.lit(WORD)) >= span
    for block in blocks(items if few else items.filter(~is_long), block_bytes):
        rows = rows.mapInArrow(tidy(_through(docs.sparkSession.sparkContext.broadcast(block), span, k)), rows.schema)
    if not few:
        more = _by_join(docs.select(_row_key(key, text).alias("row_key"), F.col(text).alias("text")), items.filter(is_long), span, k)
        rows = rows.drop("text").join(more.hint("shuffle_hash"), "row_key", "left")
        kind = dict(rows.dtypes)["doc_id"]
        rows = rows.select("doc_id", "n_words", "spans", "items", "more_spans", "more_items").mapInArrow(tidy(_merged), f"doc_id {kind}, n_words bigint, spans array<bigint>, items array<string>")
    # spans are start, end, start, end ..., so the hit words are the sum with alternating signs
    n_hit = F.aggregate(F.transform("spans", lambda x, i: F.when(i % 2 == 1, x).otherwise(-x)), F.lit(0).cast("bigint"), lambda a, x: a + x)
    return rows.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("bigint").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"), "spans")
