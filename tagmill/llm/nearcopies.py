"""Near copies by verified shingles: what the pipeline's near-copy stage runs.

Words are those of ``words``. Two texts are near copies if the Jaccard similarity of their sets of five-word shingles is
``similarity`` or more; classes are the components of all such pairs. Candidates come in two ways, and every candidate is
verified by the sets themselves.

The first way is quick and not complete: ``SEEDS`` fingerprints over two-word shingles, each searched by the byte-position
index of ``simhash`` within ``max_bits``. It gives spanning trees of candidates, so some of its pairs are never looked at.
It makes classes of most copies, in time that doesn't grow with the square of a group; more fingerprints would leave less
to the second way, and change nothing in the result.

The second way is complete. All shingles are put in one order, those that a sample of the texts shows to be frequent last.
If n shingles of a text are to have c in common with another text, one of its first n - c + 1 is shared, so each text is
entered under these for the smallest c that it can need. Two texts that meet under a shingle are a candidate unless what is left
of either from there on is too short, which is safe at the first shingle that they share. Pairs that are of one class
already can't change a class and aren't looked at; all others are: first one of each two classes a shingle, to join groups with
few pairs, then whatever is still between different classes.

A candidate first moves two sketches: how many shingles of each set fall in each of about n / 4 bins by their hash. Sets
can't share more than the smaller count of every bin, which most pairs of unlike texts don't pass. What passes moves both
arrays of shingle hashes; only texts that are in such a pair have theirs made.

Texts with one set of shingles are one node from the start, so a group of copies of any size costs one fingerprint. Sets are
told apart by 128 bits; where unlike ones agree in the first 64, which name a node, all but one get another name.

Null and empty texts have no shingles and no copies: each is a class of its own. Rows without an id are in no class.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagmill.llm.common import BROADCAST_IDS, materialise, slices, small_batches, tidy, two_columns, workspace
from tagmill.llm.components import connected_components
from tagmill.llm.simhash import LIST_SIZE, MAX_BITS, links
from tagmill.llm.words import Words, grams

SEEDS = 2
CANDIDATE_WORDS = 2
SHINGLE_WORDS = 5
SIMILARITY = 0.8
#: One in this many texts tells which shingles are frequent: those that ``HOT_TEXTS`` of them hold, ``HOT_SHINGLES`` at most.
#: That is for speed only; any order of the shingles finds all pairs.
HOT_SAMPLE = 32
HOT_TEXTS = 3
HOT_SHINGLES = 500_000
#: Distinct nodes of a task that are remembered, so that exact copies are entered once.
SEEN_NODES = 1 << 20
#: Lists of this many entries at most are compared all at once by shifting, longer ones entry by entry.
SMALL_LIST = 24
#: Hashes of 64 bits that unlike sets share, at most: two or three are to be expected among 10^10 texts, this many among 10^12.
CLASHES = 30_000
#: Shingles of a bin of a sketch, about.
BIN = 4


def _shingles(w: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the k-word shingles of all texts end to end (the whole text if it has fewer words), and how many each has."""
    n = np.diff(w.bounds)
    counts = np.where(n >= k, n - k + 1, (n > 0).astype(n.dtype))
    all_k = grams(w.hash, k)
    out = np.empty(int(counts.sum()), np.uint64)
    ends = np.cumsum(counts)
    long = n >= k
    inner = np.arange(len(out)) - np.repeat(ends - counts, counts)
    place = np.repeat(w.bounds[:-1], counts) + inner
    whole = np.repeat(long, counts)
    out[whole] = all_k[place[whole]]
    for t in np.flatnonzero(~long & (n > 0)).tolist():
        out[ends[t] - 1] = grams(w.hash[w.bounds[t] : w.bounds[t + 1]], int(n[t]))[0] ^ np.uint64(n[t])
    return out, counts


def fingerprints_of(w: Words, k: int, seeds: int) -> np.ndarray:
    """A row per text, a column per seed. Texts without words have zeros."""
    shingles, counts = _shingles(w, k)
    out = np.zeros((len(counts), seeds), np.uint64)
    some = np.flatnonzero(counts)
    if not len(some):
        return out
    begin = (np.cumsum(counts) - counts)[some]
    for j in range(seeds):
        h = shingles + np.uint64(0x9E3779B97F4A7C15 * (j + 1) & (1 << 64) - 1)
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        h ^= h >> np.uint64(31)
        bits = np.unpackbits(h.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        ones = np.add.reduceat(bits, begin, axis=0, dtype=np.int32)
        out[some, j] = np.packbits(ones * 2 > counts[some, None], axis=1).view(">u8").ravel()
    return out


def shingle_set(w: Words, k: int) -> list[np.ndarray]:
    shingles, counts = _shingles(w, k)
    return [np.unique(x) for x in np.split(shingles, np.cumsum(counts)[:-1])]


def _node(x: np.ndarray) -> np.uint64:
    """Hash of a set of shingles."""
    with np.errstate(over="ignore"):
        return (x * (x | np.uint64(1))).sum(dtype=np.uint64) ^ np.uint64(len(x))


def _check(x: np.ndarray) -> np.uint64:
    """Another hash of a set of shingles; sets that agree in both are taken to be one."""
    with np.errstate(over="ignore"):
        return ((x ^ (x >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)).sum(dtype=np.uint64)


def _name(x: np.ndarray, clash: dict[int, int]) -> np.uint64:
    """The node of a set. clash: hashes that unlike sets have -> the check of the one that keeps it."""
    h = _node(x)
    if clash and int(h) in clash and (c := _check(x)) != clash[int(h)]:
        with np.errstate(over="ignore"):
            return (h ^ c) * np.uint64(0x9E3779B97F4A7C15) ^ c
    return h


def sketch(x: np.ndarray) -> bytes:
    """How many of a set of shingles fall in each of a power of two of bins, by their highest bits."""
    bits = max(len(x) // BIN, 1).bit_length() - 1
    counts = np.bincount((x >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(x), np.int64), minlength=1 << bits)
    return np.minimum(counts, 0xFFFF).astype("<u2").tobytes()


def most_shared(a: bytes, b: bytes) -> int:
    """Shingles that two sets can share at most, by their sketches."""
    one, two = np.frombuffer(a, "<u2").astype(np.int64), np.frombuffer(b, "<u2").astype(np.int64)
    if len(one) != len(two):  # the finer one is made coarser
        if len(one) > len(two):
            one, two = two, one
        two = two.reshape(len(one), -1).sum(1)
    least = np.minimum(one, two)
    return int(least.sum()) if not (least >= 0xFFFF).any() else 1 << 62


def _nodes(docs: DataFrame, seeds: int, candidate_words: int, words: int, clash: dict[int, int]) -> DataFrame:
    """doc_id, node (a hash of the set of shingles), check (another one), n (shingles), fps, sketch; texts without words and rows without an id are left out."""
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text", 1 << 20):
                w = Words([(x or "").encode() for x in batch.column(1).to_pylist()])
                fps = fingerprints_of(w, candidate_words, seeds)
                sets = shingle_set(w, words)
                node, check = (np.array([f(x) for x in sets], np.uint64).view(np.int64) for f in (lambda x: _name(x, clash), _check))
                has = pa.array(np.diff(w.bounds) > 0)
                listed = pa.FixedSizeListArray.from_arrays(pa.array(fps.view(np.int64).ravel()), seeds).cast(pa.list_(pa.int64()))
                columns = [batch.column(0), pa.array(node), pa.array(check), pa.array([len(x) for x in sets], pa.int32()), listed, pa.array([sketch(x) for x in sets], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "node", "check", "n", "fps", "sketch"]).filter(has)

    return docs.filter("doc_id IS NOT NULL").mapInArrow(tidy(run), f"doc_id {kind}, node bigint, check bigint, n int, fps array<bigint>, sketch binary")


def _sets(docs: DataFrame, words: int, clash: dict[int, int]) -> DataFrame:
    """node, shingles of the texts asked for; a text that has but the id of one that was asked for is left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text", 1 << 20):
                sets = shingle_set(Words([(x or "").encode() for x in batch.column(1).to_pylist()]), words)
                own = pa.array([int(_name(x, clash).view(np.int64)) == node for x, node in zip(sets, batch.column(0).to_pylist(), strict=True)], pa.bool_())
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.view(np.int64) for x in sets], pa.list_(pa.int64()))], ["node", "shingles"]).filter(own)

    return docs.mapInArrow(tidy(run), "node bigint, shingles array<bigint>")


def _needed(n, similarity: float):
    """Shingles in common that sets of n shingles together must have, rounded down where it is a close call."""
    return np.ceil(similarity / (1 + similarity) * n - 1e-6)


def _frequent(docs: DataFrame, words: int) -> np.ndarray:
    """Shingles that many texts hold, the rarest of them first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text", 1 << 20):
                sets = shingle_set(Words([(x or "").encode() for x in batch.column(0).to_pylist()]), words)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sets).view(np.int64))], ["shingle"])

    picked = docs.filter(F.pmod(F.xxhash64("text"), F.lit(HOT_SAMPLE)) == 0).select("text").distinct()
    counted = picked.mapInArrow(tidy(run), "shingle bigint").groupBy("shingle").count().filter(F.col("count") >= HOT_TEXTS)
    top = counted.orderBy(F.desc("count"), "shingle").limit(HOT_SHINGLES).select("shingle").toArrow()
    return top["shingle"].to_numpy().view(np.uint64)[::-1].copy()


def prefix(shingles: np.ndarray, hot: np.ndarray, rank: np.ndarray, similarity: float) -> np.ndarray:
    """The first shingles of a sorted set, of which any set as similar as that shares one. ``hot`` is sorted, ``rank`` its order."""
    n = len(shingles)
    if len(hot):
        at = np.minimum(np.searchsorted(hot, shingles), len(hot) - 1)
        is_hot = hot[at] == shingles
        shingles = np.concatenate([shingles[~is_hot], shingles[is_hot][np.argsort(rank[at[is_hot]])]])
    return shingles[: n - int(np.ceil(similarity * n - 1e-6)) + 1]


def _entries(docs: DataFrame, words: int, similarity: float, hot: np.ndarray, clash: dict[int, int]) -> DataFrame:
    """shingle, node, n (shingles of the node), rest (how many there are from this one on): the prefixes of all texts."""
    order = np.argsort(hot)
    shared = docs.sparkSession.sparkContext.broadcast((hot[order], order))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, rank = shared.value
        seen: set[int] = set()
        for whole in batches:
            for batch in slices(whole, "text", 1 << 20):
                out: list[tuple] = []
                for x in shingle_set(Words([(t or "").encode() for t in batch.column(0).to_pylist()]), words):
                    if not len(x) or (node := int(_name(x, clash))) in seen:
                        continue
                    if len(seen) < SEEN_NODES:
                        seen.add(node)
                    first = prefix(x, known, rank, similarity)
                    out.append((first, np.full(len(first), node, np.uint64), np.full(len(first), len(x), np.int32), np.arange(len(x), len(x) - len(first), -1, dtype=np.int32)))
                if out:
                    shingle, node, n, rest = (np.concatenate(c) for c in zip(*out, strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array(shingle.view(np.int64)), pa.array(node.view(np.int64)), pa.array(n), pa.array(rest)], ["shingle", "node", "n", "rest"])

    return docs.filter("doc_id IS NOT NULL").select("text").mapInArrow(tidy(run), "shingle bigint, node bigint, n int, rest int")


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of entries sorted by shingle and node those whose shingle another node has, too, each once."""
    held, before = None, None  # the last row, and the shingle of the row before it
    names = ["shingle", "node", "n", "rest"]

    def out(cols: list[np.ndarray], keep: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c[keep]) for c in cols], names)

    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [c.to_numpy() for c in batch.columns]
        if held is not None:
            cols = [np.concatenate([h, c]) for h, c in zip(held, cols, strict=True)]
        fresh = np.concatenate([[True], (np.diff(cols[0]) != 0) | (np.diff(cols[1]) != 0)])
        cols = [c[fresh] for c in cols]
        same = cols[0][1:] == cols[0][:-1]
        behind = np.concatenate([[before is not None and before == cols[0][0]], same])
        keep = behind.copy()
        keep[:-1] |= same
        held, before = [c[-1:] for c in cols], (cols[0][-1] if behind[-1] else None)
        keep[-1] = False
        if keep.any():
            yield out(cols, keep)
    if held is not None and before is not None:
        yield out(held, np.array([True]))


def _between(similarity: float, one_each: bool):
    """Over rows (shingle, node, n, rest, root) sorted by shingle and root: candidates of different classes; with ``one_each``
    of one shingle's list one for each two classes."""

    def fits(n, rest, i, j):
        return np.minimum(rest[i], rest[j]) >= _needed(n[i].astype(np.int64) + n[j], similarity)

    def thin(shingle, root, i, j):
        if not one_each or not len(i):
            return i, j
        with np.errstate(over="ignore"):  # another pair of the same classes under each shingle
            mixed = (shingle[i] ^ (i * 1000003 + j).astype(np.int64) * np.int64(0x5851F42D4C957F2D)).astype(np.int64)
        order = np.lexsort((mixed, np.maximum(root[i], root[j]), np.minimum(root[i], root[j]), shingle[i]))
        i, j = i[order], j[order]
        keys = np.stack([shingle[i], np.minimum(root[i], root[j]), np.maximum(root[i], root[j])])
        new = np.concatenate([[True], (keys[:, 1:] != keys[:, :-1]).any(0)])
        return i[new], j[new]

    def emit(node, i, j):
        for a in range(0, len(i), 1 << 16):
            x, y = node[i[a : a + (1 << 16)]], node[j[a : a + (1 << 16)]]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], ["a", "b"])

    def lists(shingle, node, n, rest, root) -> Iterator[pa.RecordBatch]:
        cut = np.flatnonzero(np.concatenate([[True], shingle[1:] != shingle[:-1]]))
        sizes = np.diff(cut, append=len(shingle))
        mixed = np.minimum.reduceat(root, cut) != np.maximum.reduceat(root, cut)
        number = np.repeat(np.arange(len(cut)), sizes)
        here = np.flatnonzero((mixed & (sizes <= SMALL_LIST))[number])
        left, right = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for step in range(1, SMALL_LIST):
            here = here[here + step < len(shingle)]
            here = here[number[here] == number[here + step]]
            if not len(here):
                break
            at = here[(root[here] != root[here + step]) & fits(n, rest, here, here + step)]
            left.append(at)
            right.append(at + step)
        yield from emit(node, *thin(shingle, root, np.concatenate(left), np.concatenate(right)))
        for k in np.flatnonzero(mixed & (sizes > SMALL_LIST)).tolist():
            own = np.arange(cut[k], cut[k] + sizes[k])
            names, counts = np.unique(root[own], return_counts=True)
            largest = names[counts.argmax()]  # its members meet all others, but not each other
            own = np.concatenate([own[root[own] != largest], own[root[own] == largest]])
            left, right, held = [], [], 0
            for m in range(len(own) - int(counts.max())):
                after = own[m + 1 :]
                j = after[(root[after] != root[own[m]]) & fits(n, rest, own[m : m + 1], after)]
                i, j = thin(shingle, root, np.full(len(j), own[m]), j)
                left.append(i)
                right.append(j)
                held += len(j)
                if held > 1 << 18:
                    i, j = thin(shingle, root, np.concatenate(left), np.concatenate(right))
                    if one_each and len(i) < 1 << 17:
                        left, right, held = [i], [j], len(i)
                    else:
                        yield from emit(node, i, j)
                        left, right, held = [], [], 0
            if held:
                yield from emit(node, *thin(shingle, root, np.concatenate(left), np.concatenate(right)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[list[np.ndarray]] = []  # rows of lists that may go on
        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [c.to_numpy() for c in batch.columns]
            last = np.flatnonzero(cols[0] != cols[0][-1])
            done = int(last[-1]) + 1 if len(last) else 0
            if parts and (done or parts[-1][0][-1] != cols[0][0]):
                yield from lists(*(np.concatenate(x) for x in zip(*parts, [c[:done] for c in cols], strict=True)))
                parts = []
            elif done:
                yield from lists(*(c[:done] for c in cols))
            parts.append([c[done:] for c in cols])
        if parts:
            yield from lists(*(np.concatenate(x) for x in zip(*parts, strict=True)))

    return run


def near_copies(docs: DataFrame, key: str = "doc_id", text: str = "text", seeds: int = SEEDS, max_bits: int = MAX_BITS, similarity: float = SIMILARITY, candidate_words: int = CANDIDATE_WORDS, words: int = SHINGLE_WORDS, list_size: int = LIST_SIZE) -> DataFrame:
    """doc_id, keep_id (the smallest id of its class) of every document that has an id and words."""
    small_batches(docs.sparkSession)
    source = two_columns(docs, key, text)
    with workspace(docs.sparkSession):
        clash: dict[int, int] = {}
        while True:
            made = materialise(_nodes(source, seeds, candidate_words, words, clash), "nodes")
            nodes = made.groupBy("node").agg(F.min("doc_id").alias("least"), F.min("check").alias("lo"), F.max("check").alias("hi"), *(F.first(c).alias(c) for c in ("n", "fps", "sketch")))
            nodes = materialise(nodes, "distinct-nodes")
            unlike = nodes.filter("lo <> hi").select("node", "lo").limit(CLASHES + 1).collect()
            if not unlike:
                break
            if len(unlike) > CLASHES:
                raise ValueError("far more equal hashes of unlike texts than can be")
            clash |= {r["node"] % (1 << 64): r["lo"] % (1 << 64) for r in unlike}
        verified = lambda pairs: _verified(source, nodes, pairs, similarity, words, clash)
        true = verified(_by_fingerprints(nodes, max_bits, list_size))
        root = connected_components(true)
        entries = _entries(source, words, similarity, _frequent(source, words), clash).repartition("shingle").sortWithinPartitions("shingle", "node")
        entries = materialise(entries.mapInArrow(tidy(_shared), "shingle bigint, node bigint, n int, rest int"), "entries")
        for one_each in (True, False):
            found = verified(_by_prefixes(entries, root, similarity, one_each))
            if not found.isEmpty():
                root = connected_components(root.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(found))
        rooted = nodes.join(root, "node", "left").select("node", "least", F.coalesce("root", "node").alias("root"))
        keep = rooted.groupBy("root").agg(F.min("least").alias("keep_id"))
        classes = made.select("doc_id", "node").join(rooted.join(keep, "root").select("node", "keep_id"), "node")
        return materialise(classes.select("doc_id", "keep_id"), "classes", keep=True)


def _by_fingerprints(nodes: DataFrame, max_bits: int, list_size: int) -> DataFrame:
    """Candidates a, b: nodes of one fingerprint with the first of them, and the first ones of linked fingerprints."""
    own = nodes.select("node", F.posexplode("fps").alias("seed", "fp")).withColumn("seed", F.col("seed").cast("bigint"))
    head = materialise(own.groupBy("seed", "fp").agg(F.min("node").alias("head")), "heads")
    same = own.join(head, ["seed", "fp"]).filter("node <> head").select(F.col("node").alias("a"), F.col("head").alias("b"))
    side = lambda c: head.select("seed", F.col("fp").alias(c), F.col("head").alias(f"h{c}"))
    near = links(head.select("seed", "fp"), max_bits, list_size).join(side("a"), ["seed", "a"]).join(side("b"), ["seed", "b"])
    return same.unionByName(near.select(F.col("ha").alias("a"), F.col("hb").alias("b")))


def _by_prefixes(entries: DataFrame, root: DataFrame, similarity: float, one_each: bool) -> DataFrame:
    """Candidates a, b that meet under a shingle and aren't of one class (root) by the pairs known so far."""
    lists = entries.join(root, "node", "left").select("shingle", "node", "n", "rest", F.coalesce("root", "node").alias("root"))
    lists = lists.repartition("shingle").sortWithinPartitions("shingle", "root", "node")
    return lists.mapInArrow(tidy(_between(similarity, one_each)), "a bigint, b bigint")


def _can_reach(similarity: float):
    """Over rows (a, b, na, nb, sa, sb): the pairs whose sketches allow the similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shared = np.fromiter(map(most_shared, batch.column(4).to_pylist(), batch.column(5).to_pylist()), np.int64, batch.num_rows)
            n = batch.column(2).to_numpy().astype(np.int64) + batch.column(3).to_numpy()
            yield batch.select([0, 1]).filter(pa.array(shared >= _needed(n, similarity)))

    return run


def _verified(source: DataFrame, nodes: DataFrame, pairs: DataFrame, similarity: float, words: int, clash: dict[int, int]) -> DataFrame:
    """The pairs a, b of nodes whose sets of shingles are similar enough."""
    with workspace(source.sparkSession):
        pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        side = lambda c: nodes.select(F.col("node").alias(c), F.col("n").alias(f"n{c}"), F.col("sketch").alias(f"s{c}"))
        pairs = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "na", "nb", "sa", "sb")
        pairs = materialise(pairs.mapInArrow(tidy(_can_reach(similarity)), "a bigint, b bigint"), "pairs")
        asked = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
        where = materialise(nodes.join(asked, "node", "left_semi").select("node", F.col("least").alias("__id")), "asked")
        few = where.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
        # a repeated id may bring another text along, which _sets leaves out
        texts = source.join(F.broadcast(where) if few else where, source["doc_id"] == where["__id"]).select("node", "text")
        sets = materialise(_sets(texts, words, clash).dropDuplicates(["node"]), "sets")
        side = lambda c: sets.select(F.col("node").alias(c), F.col("shingles").alias(f"s{c}"))
        both = F.size(F.array_intersect("sa", "sb"))
        jaccard = both / (F.size("sa") + F.size("sb") - both)
        return materialise(pairs.join(side("a"), "a").join(side("b"), "b").filter(jaccard >= similarity).select("a", "b"), "true-pairs", keep=True)
