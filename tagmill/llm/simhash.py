"""SimHash near-duplicates over a byte-position inverted index (operator 3).

Fingerprints of 64 bits come from word shingles, repeats included. Two fingerprints link if they differ in ``max_bits``
bits at most; then at least ``8 - max_bits`` of their 8 bytes are equal, position by position.

The inverted index holds distinct fingerprints only, so exact copies cost one entry however many there are. A posting
list for one byte would hold a 256th of the corpus and give quadratically many pairs, so a list is kept for several
positions at once: a family of position sets such that any ``8 - max_bits`` equal positions contain one of them (20
triples for 4 bits, the smallest such family). Each pair that meets in a list has its equal bytes tallied, is retained
if the tally reaches the guaranteed minimum, and is verified by its differing bits; it counts in the list of the first
position set that it agrees on, and nowhere else. Pairs are never emitted: a list's output is a spanning forest of its
verified links, so a list of n entries gives less than n rows.

A list longer than ``LIST_SIZE`` is not worked on. Those that a sample of the fingerprints shows to be long aren't brought
together at all, so a hot list costs no task its whole length. The bits that its entries don't agree on by the key are cut into
``max_bits + 1`` blocks, of which a linked pair has at least one equal, and its entries are dealt again by each block.
This repeats until no list is too long: with 13 free bits a list has 8192 entries at most, so it ends, and nothing is lost.

Null and empty texts have no words and fingerprint zero, which links like any other. Rows that repeat a doc_id each keep
their fingerprint. A null doc_id is never a component's id unless the component has no other. Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagmill.llm.common import BROADCAST_IDS, discard, materialise, slices, small_batches, tidy, two_columns, workspace
from tagmill.llm.components import connected_components

SHINGLE = 4
MAX_BITS = 4
LIST_SIZE = 10_000
#: One in this many fingerprints is counted to tell long lists. Dealing a list again is right whatever its length.
SAMPLE = 16
#: Lists of this many entries at most are compared all at once by shifting, longer ones one by one.
SMALL_LIST = 24


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Unsigned 64-bit SimHash: a bit is 1 if more than half of the shingles' XXH64 (seed 42) have it."""
    from xxhash import xxh64_digest

    words = (text or "").encode().lower().split()  # of bytes: only ASCII is lower-cased and white space
    n = len(words)
    if not n:
        return 0
    joined = b" ".join(words)
    if n <= shingle:
        return int.from_bytes(xxh64_digest(joined, 42), "big")
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    hashes = [xxh64_digest(joined[a:b], 42) for a, b in zip(starts[: n - shingle + 1].tolist(), ends[shingle - 1 :].tolist(), strict=True)]
    bits = np.unpackbits(np.frombuffer(b"".join(hashes), np.uint8).reshape(-1, 8), axis=1)
    return int.from_bytes(np.packbits(_ones(bits) * 2 > len(hashes)).tobytes(), "big")


def _ones(bits: np.ndarray) -> np.ndarray:
    """Column sums; runs of 255 rows fit in a byte each, which is much faster than wide sums."""
    if len(bits) <= 255:
        return np.add.reduce(bits, axis=0, dtype=np.uint8).astype(np.int64)
    whole = len(bits) // 255 * 255
    return np.add.reduce(bits[:whole].reshape(-1, 255, 64), axis=1, dtype=np.uint8).sum(0, dtype=np.int64) + np.add.reduce(bits[whole:], axis=0, dtype=np.uint8)


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fp (the fingerprint as a signed 64-bit integer)."""
    small_batches(docs.sparkSession)
    source = two_columns(docs, key, text)
    kind = dict(source.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                made = np.array([fingerprint(x, shingle) for x in batch.column(1).to_pylist()], np.uint64)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made.view(np.int64))], ["doc_id", "fp"])

    return source.mapInArrow(tidy(run), f"doc_id {kind}, fp bigint")


def position_sets(max_bits: int) -> list[tuple[int, ...]]:
    """Sets of byte positions such that any 8 - max_bits positions contain one."""
    equal = 8 - max_bits
    if not 0 <= max_bits <= 7:
        raise ValueError("max_bits must be from 0 to 7: beyond, no byte need be equal")
    if equal <= 3:
        return list(combinations(range(8), equal))
    groups = [(0, 1, 2), (3, 4, 5), (6, 7)]  # triples inside a group, or two of a group and one of the next
    inside = [t for g in groups for t in combinations(g, 3)]
    across = [tuple(sorted((*two, one))) for g, after in zip(groups, groups[1:] + groups[:1], strict=True) for two in combinations(g, 2) for one in after]
    return inside + across


def _mask(positions: tuple[int, ...]) -> int:
    value = sum(0xFF << (56 - 8 * p) for p in positions)
    return value - (1 << 64) if value >> 63 else value


def _finer(mask: int, parts: int) -> list[int]:
    """The mask with one of ``parts`` blocks of its free bits added, for each block."""
    free = [b for b in range(64) if not mask >> b & 1]
    cuts = [len(free) * i // parts for i in range(parts + 1)]
    return [mask | sum(1 << b for b in free[x:y]) for x, y in zip(cuts, cuts[1:], strict=False) if y > x]


_TALLY = np.array([i.bit_count() for i in range(256)], np.uint8)


def _verified(a: np.ndarray, b: np.ndarray | np.uint64, max_bits: int, mine: np.ndarray | None) -> np.ndarray:
    """Places where the tally of equal bytes reaches the minimum, the differing bits are few enough and, by ``mine`` (a table
    over the patterns of equal bytes), the pair counts in this list."""
    x = np.ascontiguousarray(a ^ b)
    pattern = np.packbits(x[:, None].byteswap().view(np.uint8) == 0, axis=1).ravel()  # first byte first
    keep = _TALLY[pattern] >= 8 - max_bits
    if mine is not None:
        keep &= mine[pattern] if mine.ndim == 1 else mine[np.arange(len(x)), pattern]
    at = np.flatnonzero(keep)
    return at[np.bitwise_count(x[at]) <= max_bits]


def _forest(entries: np.ndarray, max_bits: int, mine: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Links that span each component of one list, found breadth first."""
    left, right = [], []
    waiting = entries
    while len(waiting):
        front, waiting = [waiting[0]], waiting[1:]
        while front and len(waiting):
            node = front.pop()
            at = _verified(waiting, node, max_bits, mine)
            if len(at):
                found = waiting[at]
                left.append(np.full(len(at), node, np.uint64))
                right.append(found)
                front += list(found)
                waiting = np.delete(waiting, at)
    none = np.empty(0, np.uint64)
    return (np.concatenate(left), np.concatenate(right)) if left else (none, none)


def _first_sets(max_bits: int) -> dict[int, np.ndarray]:
    """mask -> for each pattern of equal bytes whether the mask's position set is the first that lies in it."""
    sets = position_sets(max_bits)
    bits = [sum(1 << 7 - p for p in s) for s in sets]
    first = [next((i for i, b in enumerate(bits) if pattern & b == b), -1) for pattern in range(256)]
    return {_mask(s): np.array([f == i for f in first]) for i, s in enumerate(sets)}


def _work(max_bits: int, list_size: int):
    """Over rows (seed, mask, list, fp) sorted by these: links, and the keys of lists that are too long (long is true)."""
    mine = _first_sets(max_bits)
    always = np.ones(256, bool)  # for masks of lists that were dealt again

    def lists(seeds: np.ndarray, masks: np.ndarray, keys: np.ndarray, fps: np.ndarray) -> Iterator[pa.RecordBatch]:
        cut = np.flatnonzero(np.concatenate([[True], (seeds[1:] != seeds[:-1]) | (masks[1:] != masks[:-1]) | (keys[1:] != keys[:-1])]))
        sizes = np.diff(cut, append=len(fps))
        number = np.repeat(np.arange(len(cut)), sizes)
        here = np.flatnonzero((sizes <= SMALL_LIST)[number])
        left, right, whose = [], [], []
        own = {m: mine.get(m, always) for m in np.unique(masks).tolist()}
        tables = np.stack([own[m] for m in own])
        table_of = np.searchsorted(np.array(list(own)), masks)
        for step in range(1, SMALL_LIST):
            here = here[here + step < len(fps)]
            here = here[number[here] == number[here + step]]
            if not len(here):
                break
            at = here[_verified(fps[here], fps[here + step], max_bits, tables[table_of[here]])]
            left.append(fps[at])
            right.append(fps[at + step])
            whose.append(seeds[at])
        long: list[int] = []
        for i in np.flatnonzero(sizes > SMALL_LIST).tolist():
            if sizes[i] > list_size:
                long.append(int(cut[i]))
                continue
            a, b = _forest(fps[cut[i] : cut[i] + sizes[i]], max_bits, own[int(masks[cut[i]])])
            left.append(a)
            right.append(b)
            whose.append(np.full(len(a), seeds[cut[i]]))
        a, b = (np.concatenate(x).view(np.int64) if x else np.empty(0, np.int64) for x in (left, right))
        if len(a) or long:
            seed = np.concatenate([*whose, seeds[long]]).astype(np.int64)
            flags = np.concatenate([np.zeros(len(a), bool), np.ones(len(long), bool)])
            yield pa.RecordBatch.from_arrays([pa.array(seed), pa.array(np.concatenate([a, masks[long]]).astype(np.int64)), pa.array(np.concatenate([b, keys[long]]).astype(np.int64)), pa.array(flags)], ["seed", "a", "b", "long"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.empty(0, np.int64)] * 3 + [np.empty(0, np.uint64)]
        for batch in batches:
            if not batch.num_rows:
                continue
            came = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            held = [np.concatenate([x, y.view(x.dtype)]) for x, y in zip(held, came, strict=True)]
            last = np.flatnonzero((held[0] != held[0][-1]) | (held[1] != held[1][-1]) | (held[2] != held[2][-1]))
            done = int(last[-1]) + 1 if len(last) else 0
            if done:
                yield from lists(*(x[:done] for x in held))
            # of a list that goes on, no more is held than shows that it is too long
            held = [x[done:][: list_size + 1] for x in held]
        if len(held[3]):
            yield from lists(*held)

    return run


def links(distinct: DataFrame, max_bits: int = MAX_BITS, list_size: int = LIST_SIZE) -> DataFrame:
    """Links seed, a, b between distinct fingerprints that span the components of all pairs within ``max_bits``.

    distinct: fp, or seed (bigint) and fp, where fingerprints of different seeds have nothing to do with each other.
    """
    if list_size < 1 << 13:
        raise ValueError("a list of fewer than 8192 entries can't always be cut")
    if "seed" not in distinct.columns:
        distinct = distinct.select(F.lit(0).cast("bigint").alias("seed"), "fp")
    found: DataFrame | None = None
    held: DataFrame | None = None
    masks = [_mask(p) for p in position_sets(max_bits)]
    entries = distinct.select("seed", F.explode(F.array(*(F.lit(m).cast("bigint") for m in masks))).alias("mask"), "fp")
    key = ["seed", "mask", "list"]
    sampled = distinct.limit(list_size + 1).count() > list_size  # else no list can be long
    while True:
        entries = entries.select("seed", "mask", F.col("mask").bitwiseAND(F.col("fp")).alias("list"), "fp")
        short, hot = entries, None
        if sampled:
            counts = entries.filter(F.pmod(F.xxhash64("fp"), F.lit(SAMPLE)) == 0).groupBy(*key).count()
            likely = materialise(counts.filter(F.col("count") > list_size // SAMPLE).select(*key), "likely-long")
            n_likely = likely.limit(BROADCAST_IDS + 1).count()
            if 0 < n_likely <= BROADCAST_IDS:
                short, hot = entries.join(F.broadcast(likely), key, "left_anti"), entries.join(F.broadcast(likely), key, "left_semi")
        dealt = short.repartition(*key).sortWithinPartitions(*key, "fp")
        done = materialise(dealt.mapInArrow(tidy(_work(max_bits, list_size)), "seed bigint, a bigint, b bigint, long boolean"), "links")
        now = done.filter("NOT long").select("seed", "a", "b")
        found = now if found is None else found.unionByName(now)
        long = done.filter("long").select("seed", F.col("a").alias("mask"), F.col("b").alias("list"))
        if hot is None and long.isEmpty():
            return found.distinct()
        again = short.join(long, key, "left_semi")
        held, last = materialise(again if hot is None else again.unionByName(hot), "long-lists"), held
        if last is not None:
            discard(last)
        entries = held.select("seed", "mask", "fp").mapInArrow(_deal_again(max_bits + 1), "seed bigint, mask bigint, fp bigint").distinct()


def _deal_again(parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seeds, masks, fps = (c.to_numpy() for c in batch.columns)
            for mask in np.unique(masks).tolist():
                own = masks == mask
                for finer in _finer(mask & (1 << 64) - 1, parts):
                    signed = finer - (1 << 64) if finer >> 63 else finer
                    yield pa.RecordBatch.from_arrays([pa.array(seeds[own]), pa.array(np.full(int(own.sum()), signed, np.int64)), pa.array(fps[own])], ["seed", "mask", "fp"])

    return run


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE, max_bits: int = MAX_BITS, list_size: int = LIST_SIZE) -> DataFrame:
    """Per document: doc_id, fingerprint (16 hex digits), component_id (the smallest doc_id that links reach)."""
    with workspace(docs.sparkSession):
        made = materialise(fingerprints(docs, key, text, shingle), "fingerprints")
        distinct = materialise(made.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
        joined = connected_components(links(distinct.select("fp"), max_bits, list_size).select("a", "b")).withColumnRenamed("node", "fp")
        rooted = distinct.join(joined, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
        component = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
        of = rooted.join(component, "root").select("fp", "component_id")
        return materialise(made.join(of, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"), "near-duplicates", keep=True)
