"""Reversible line deduplication (operator 6).

A line's key is the line stripped of ASCII white space with A-Z lower-cased. A key of at least ``MIN_CHARS`` code points
that at least ``MIN_DOCS`` documents hold is *spent*: it loses its lines in all documents but the one with the largest
id. The index of a corpus is a folder with

* ``postings`` (slot, digest, doc_id): which document holds which key, once each;
* ``counts`` (slot, digest, n_docs, max_doc): exact reference counts, from the postings;
* ``filters`` (shard, n_shards, n_keys, filter): a cuckoo filter of the shard's spent keys.

A digest has one of ``SLOTS`` slots, and a shard is every n_shards-th slot; there are as many shards as keep each near
``SHARD_KEYS`` spent keys. Whether a line is spent is asked of its shard's filter first; only lines that it lets through are
looked up in the exact counts: in the worker where these are few, else by a join. ``insert`` and ``delete`` take documents in and out: counts of the touched keys are
made anew from their postings, and keys that cross the threshold enter or leave the filters. Deleting what was inserted
gives the index as it was. Every version is written beside the last one, so a lost executor never spoils an index.

Null and empty texts are one empty line. A column ``__drops`` or ``__drop_id`` of the documents would clash and is refused. Rows that repeat a doc_id count as documents of their own (they can't be deleted
one by one), and all rows of the largest id keep their lines. A null doc_id counts as the smallest. An empty table gives
an empty index and an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagmill.llm.common import ASCII_SPACE, scratch, slices, small_batches, tidy, two_columns
from tagmill.llm.cuckoo import CuckooFilter

MIN_CHARS = 40
MIN_DOCS = 5
#: Slots are a power of two, so that any smaller power of two of shards is a grouping of them.
SLOTS = 1 << 16
#: Spent keys of a shard, about, and shards at least.
SHARD_KEYS = 50_000
LEAST_SHARDS = 8
#: Spent keys whose exact counts are broadcast at most (24 bytes each); beyond, keys that the filters let through meet them
#: in a join.
BROADCAST_KEYS = 1_000_000
#: Bytes of filters that are broadcast at once; more are asked group by group, with a pass over the documents each.
FILTER_BYTES = 128 << 20


def keys_of(text: str | None, min_chars: int = MIN_CHARS) -> tuple[list[str], list[bytes | None]]:
    """Lines, and for each the 16-byte digest of its key, or None if the key is too short to count."""
    lines = (text or "").split("\n")
    out: list[bytes | None] = []
    for line in lines:
        key = line.strip(ASCII_SPACE)
        out.append(hashlib.blake2b(key.encode().lower(), digest_size=16).digest() if len(key) >= min_chars else None)
    return lines, out


def _words(digests: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Both 64-bit halves of the digests."""
    both = np.frombuffer(b"".join(digests), "<u8").reshape(-1, 2)
    return both[:, 0], both[:, 1]


def postings(docs: DataFrame, key: str = "doc_id", text: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """slot, digest, doc_id: each long enough key of each document once."""
    small_batches(docs.sparkSession)
    source = two_columns(docs, key, text)
    kind = dict(source.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                digests: list[bytes] = []
                rows: list[int] = []
                for i, value in enumerate(batch.column(1).to_pylist()):
                    own = {x for x in keys_of(value, min_chars)[1] if x is not None}
                    digests += own
                    rows += [i] * len(own)
                if rows:
                    slot = (_words(digests)[0] % np.uint64(SLOTS)).astype(np.int32)
                    yield pa.RecordBatch.from_arrays([pa.array(slot), pa.array(digests, pa.binary()), batch.column(0).take(pa.array(rows))], ["slot", "digest", "doc_id"])

    return source.mapInArrow(tidy(run), f"slot int, digest binary, doc_id {kind}")


def reference_counts(rows: DataFrame) -> DataFrame:
    """Spark adds up within each task before the shuffle, so a key of any frequency costs a row per task."""
    return rows.groupBy("slot", "digest").agg(F.count(F.lit(1)).alias("n_docs"), F.max("doc_id").alias("max_doc"))


def shards_for(keys: int) -> int:
    """Shards, a power of two, for so many spent keys."""
    n = LEAST_SHARDS
    while n * SHARD_KEYS < keys and n < SLOTS:
        n *= 2
    return n


def build_filters(counts: DataFrame, n_shards: int, min_docs: int = MIN_DOCS) -> DataFrame:
    """One cuckoo filter a shard, over the first half of the spent keys' digests. A task holds one shard's keys at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made(s: int, parts: list[np.ndarray]) -> pa.RecordBatch:
            hashes = np.unique(np.concatenate(parts))
            values = [pa.array([s], pa.int32()), pa.array([n_shards], pa.int32()), pa.array([len(hashes)], pa.int64()), pa.array([CuckooFilter.of(hashes).to_bytes()], pa.binary())]
            return pa.RecordBatch.from_arrays(values, ["shard", "n_shards", "n_keys", "filter"])

        now, held = -1, []
        for batch in batches:
            shard = batch.column(0).to_numpy()
            first = _words(batch.column(1).to_pylist())[0] if batch.num_rows else np.empty(0, np.uint64)
            for s in np.unique(shard).tolist():  # shards come one after the other
                if s != now and held:
                    yield made(now, held)
                    held = []
                now = s
                held.append(first[shard == s])
        if held:
            yield made(now, held)

    spent = counts.filter(F.col("n_docs") >= min_docs).select((F.col("slot") % n_shards).alias("shard"), "digest")
    return spent.repartition("shard").sortWithinPartitions("shard").mapInArrow(tidy(run), _FILTERS)


_FILTERS = "shard int, n_shards int, n_keys bigint, filter binary"


class LineIndex:
    """An index in a folder. Methods that change it write a new folder and return its index."""

    def __init__(self, spark: SparkSession, path: str, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS):
        self.spark, self.path, self.min_chars, self.min_docs = spark, path, min_chars, min_docs

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}")

    def _next(self) -> LineIndex:
        return LineIndex(self.spark, scratch(self.spark, "line-index"), self.min_chars, self.min_docs)

    def _postings(self, docs: DataFrame, key: str, text: str) -> DataFrame:
        return postings(docs, key, text, self.min_chars)

    @classmethod
    def build(cls, docs: DataFrame, key: str = "doc_id", text: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> LineIndex:
        spark = docs.sparkSession
        index = cls(spark, scratch(spark, "line-index"), min_chars, min_docs)
        index._postings(docs, key, text).write.parquet(f"{index.path}/postings")
        reference_counts(index.table("postings")).write.parquet(f"{index.path}/counts")
        index._write_filters()
        return index

    def _write_filters(self) -> None:
        counts = self.table("counts")
        keys = counts.filter(F.col("n_docs") >= self.min_docs).count()
        build_filters(counts, shards_for(keys), self.min_docs).write.parquet(f"{self.path}/filters")

    def _changed(self, touched: DataFrame, rows: DataFrame) -> LineIndex:
        """The index over ``rows`` of postings, of which only the touched keys' counts differ from this one's."""
        after = self._next()
        rows.write.parquet(f"{after.path}/postings")
        touched = touched.select("slot", "digest").distinct()
        again = reference_counts(after.table("postings").join(touched, ["slot", "digest"], "left_semi"))
        self.table("counts").join(touched, ["slot", "digest"], "left_anti").unionByName(again).write.parquet(f"{after.path}/counts")
        after._move_filters(self)
        return after

    def _move_filters(self, before: LineIndex) -> None:
        """Take this version's filters from the last one's, key by key: in on reaching the threshold, out on falling below.

        Where the spent keys ask for more or fewer shards, all filters are built anew.
        """
        stored = before.table("filters")
        n_shards = stored.agg(F.max("n_shards")).first()[0]
        keys = self.table("counts").filter(F.col("n_docs") >= self.min_docs).count()
        if n_shards is None or shards_for(keys) != n_shards:
            self._write_filters()
            return
        is_spent = lambda name: F.coalesce(F.col(name) >= self.min_docs, F.lit(False))
        old = before.table("counts").select("slot", "digest", F.col("n_docs").alias("n_old"))
        new = self.table("counts").select("slot", "digest", F.col("n_docs").alias("n_new"))
        moved = old.join(new, ["slot", "digest"], "full").select((F.col("slot") % n_shards).alias("shard"), "digest", is_spent("n_old").alias("was"), is_spent("n_new").alias("now")).filter("was <> now")

        def move(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
            hashes = _words(left["digest"].to_pylist())[0].tolist() if left.num_rows else []
            data = right["filter"].to_pylist()
            n = right["n_keys"].to_pylist()[0] if data else 0
            f = CuckooFilter.from_bytes(data[0]) if data else CuckooFilter()
            full = False
            for h, now in zip(hashes, left["now"].to_pylist(), strict=True):
                full |= now and not f.insert(h)
                if not now:
                    f.delete(h)
                n += 1 if now else -1
            shard = key[0].as_py() if hasattr(key[0], "as_py") else key[0]
            return pa.table({"shard": pa.array([shard], pa.int32()), "n_shards": pa.array([n_shards], pa.int32()), "n_keys": pa.array([n], pa.int64()), "filter": pa.array([None if full else f.to_bytes()], pa.binary())})

        # a shard has about SHARD_KEYS spent keys, so its changes are bounded, too
        out = moved.groupBy("shard").cogroup(stored.groupBy("shard")).applyInArrow(move, _FILTERS)
        path = f"{self.path}/moved-filters"
        out.write.parquet(path)
        moved_filters = self.spark.read.parquet(path)
        full = moved_filters.filter("filter IS NULL").select(F.col("shard").alias("full"))  # a full filter is built anew, and larger
        again = self.table("counts").join(full, F.col("slot") % n_shards == F.col("full"), "left_semi")
        moved_filters.filter("filter IS NOT NULL").unionByName(build_filters(again, n_shards, self.min_docs)).filter("n_keys > 0").write.parquet(f"{self.path}/filters")

    def insert(self, docs: DataFrame, key: str = "doc_id", text: str = "text") -> LineIndex:
        came = self._postings(docs, key, text)
        return self._changed(came, self.table("postings").unionByName(came))

    def delete(self, ids: DataFrame, key: str = "doc_id") -> LineIndex:
        """Take out the documents with these ids."""
        ids = ids.select(F.col(key).alias("doc_id")).distinct()
        rows = self.table("postings")
        return self._changed(rows.join(ids, "doc_id", "left_semi"), rows.join(ids, "doc_id", "left_anti"))

    def spent(self) -> DataFrame:
        """digest, max_doc of the keys that lose lines."""
        return self.table("counts").filter(F.col("n_docs") >= self.min_docs).select("digest", "max_doc")

    def apply(self, docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
        """Documents without their spent lines: doc_id, n_lines, n_dropped, kept (the text that stays)."""
        source = two_columns(docs, key, text)
        kind = dict(source.dtypes)["doc_id"]
        return self._without_spent(source, "doc_id", "text", _kept, f"doc_id {kind}, n_lines bigint, n_dropped bigint, kept string")

    def rewrite(self, docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
        """The same rows and columns, texts without their spent lines. A null text becomes an empty one."""
        names = docs.columns
        at = names.index(text)

        def put(batch: pa.RecordBatch, lines: list[list[str]], drop: list[set[int]]) -> pa.RecordBatch:
            kept = _kept(batch, lines, drop).column("kept")
            return pa.RecordBatch.from_arrays([kept if i == at else batch.column(i) for i in range(len(names))], names)

        return self._without_spent(docs, key, text, put, docs.schema)

    def _without_spent(self, source: DataFrame, key: str, text: str, put, schema) -> DataFrame:
        if taken := {"__drops", "__drop_id"} & set(source.columns):
            raise ValueError(f"columns used inside: {sorted(taken)}")
        small_batches(self.spark)
        spent = self.spent()
        if (self.table("filters").agg(F.sum("n_keys")).first()[0] or 0) <= BROADCAST_KEYS:
            return source.mapInArrow(tidy(self._by_broadcast(spent, key, text, put)), schema)
        return self._by_join(source, spent, key, text).mapInArrow(_drop_listed(self.min_chars, text, put), schema)

    def _groups(self) -> Iterator[tuple[int, dict[int, bytes]]]:
        """Filters in groups of at most FILTER_BYTES: number of shards, and shard -> filter."""
        group, size, n_shards = {}, 0, LEAST_SHARDS
        for r in self.table("filters").toLocalIterator():
            if group and size + len(r["filter"]) > FILTER_BYTES:
                yield n_shards, group
                group, size = {}, 0
            group[r["shard"]], n_shards = r["filter"], r["n_shards"]
            size += len(r["filter"])
        yield n_shards, group

    def _by_broadcast(self, spent: DataFrame, key: str, text: str, put):
        rows = spent.toArrow()
        # of so few keys the filters are one group
        n_shards, filters = next(self._groups())
        shared = self.spark.sparkContext.broadcast((filters, b"".join(rows["digest"].to_pylist()), rows["max_doc"].to_pylist()))
        min_chars = self.min_chars

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            stored, digests, last = shared.value
            gates = {s: CuckooFilter.from_bytes(f) for s, f in stored.items()}
            exact = {digests[16 * i : 16 * i + 16]: doc for i, doc in enumerate(last)}
            for whole in batches:
                for batch in slices(whole, text):
                    docs = batch.column(key).to_pylist()
                    split = [keys_of(x, min_chars) for x in batch.column(text).to_pylist()]
                    maybe = _gate([x for _, own in split for x in own if x is not None], gates, n_shards)
                    drop = [{i for i, x in enumerate(own) if x in maybe and x in exact and exact[x] is not None and (doc is None or doc < exact[x])} for doc, (_, own) in zip(docs, split, strict=True)]
                    yield put(batch, [lines for lines, _ in split], drop)

        return run

    def _by_join(self, source: DataFrame, spent: DataFrame, key: str, text: str) -> DataFrame:
        """Documents, and last the list of digests that they lose.

        Lines that the filters let through meet the exact counts, in which a digest is one row. Then the short side of the join
        with the documents is built; texts aren't sorted.
        """
        slim = two_columns(source, key, text)
        kind = dict(slim.dtypes)["doc_id"]
        min_chars = self.min_chars
        through: DataFrame | None = None
        for n_shards, filters in self._groups():
            shared = self.spark.sparkContext.broadcast(filters)

            def run(batches: Iterator[pa.RecordBatch], shared=shared, n_shards=n_shards) -> Iterator[pa.RecordBatch]:
                gates = {s: CuckooFilter.from_bytes(f) for s, f in shared.value.items()}
                for whole in batches:
                    for batch in slices(whole, "text"):
                        own = [{x for x in keys_of(t, min_chars)[1] if x is not None} for t in batch.column(1).to_pylist()]
                        maybe = _gate(list(set().union(*own)), gates, n_shards)
                        found = [(i, x) for i, keys in enumerate(own) for x in keys if x in maybe]
                        if found:
                            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array([i for i, _ in found])), pa.array([x for _, x in found], pa.binary())], ["doc_id", "digest"])

            asked = slim.mapInArrow(tidy(run), f"doc_id {kind}, digest binary")
            through = asked if through is None else through.unionByName(asked)
        losing = through.join(spent, "digest").filter("doc_id IS NULL AND max_doc IS NOT NULL OR doc_id < max_doc")
        listed = losing.groupBy("doc_id").agg(F.collect_set("digest").alias("__drops")).withColumnRenamed("doc_id", "__drop_id")
        return source.join(listed.hint("shuffle_hash"), source[key].eqNullSafe(listed["__drop_id"]), "left").drop("__drop_id")


def _gate(digests: list[bytes], gates: dict[int, CuckooFilter], shards: int) -> set[bytes]:
    """Digests that their shard's filter lets through."""
    if not digests or not gates:
        return set()
    first = _words(digests)[0]
    shard = first % np.uint64(shards)
    through = np.zeros(len(digests), bool)
    order = np.argsort(shard, kind="stable")
    cuts = np.flatnonzero(np.diff(shard[order], prepend=np.uint64(shards), append=np.uint64(shards)))
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        gate = gates.get(int(shard[order[a]]))
        if gate is not None:
            through[order[a:b]] = gate.contains(first[order[a:b]])
    return {digests[i] for i in np.flatnonzero(through).tolist()}


def _kept(batch: pa.RecordBatch, lines: list[list[str]], drop: list[set[int]]) -> pa.RecordBatch:
    """What ``apply`` returns; the ids are the batch's first column."""
    kept = ["\n".join(x for i, x in enumerate(own) if i not in gone) if gone else "\n".join(own) for own, gone in zip(lines, drop, strict=True)]
    return pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) for x in lines], pa.int64()), pa.array([len(x) for x in drop], pa.int64()), pa.array(kept, pa.string())], ["doc_id", "n_lines", "n_dropped", "kept"])


def _drop_listed(min_chars: int, text: str, put):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, text):
                split = [keys_of(x, min_chars) for x in batch.column(text).to_pylist()]
                lost = [set(x or ()) for x in batch.column(batch.num_columns - 1).to_pylist()]
                yield put(batch, [lines for lines, _ in split], [{i for i, x in enumerate(own) if x in gone} if gone else set() for (_, own), gone in zip(split, lost, strict=True)])

    return run
