"""Merkle fixity audit of WARC records (operator 5).

Records lie in order of their id (ties by digest) and have byte offsets from the start of the archive. A *range* holds the
records that start in ``RANGE_BYTES`` of the first replica's offsets. The other replica is cut at the same records, by id and
digest, so a missing or longer record changes its own range and no other. A range's hash covers the lengths and digests of
its records in order. Ranges are the leaves of a tree in which a node's hash covers the numbers and hashes of up to
``FANOUT`` children. Two replicas are compared from the roots down: a level looks only at children of nodes that differed,
and records are compared only in the ranges that are left, by id and digest, so that each damaged, missing or extra record
is named.

Everything after the digest of a record works on narrow rows, and records that repeat id and digest are one row with a
count. Offsets come from sums within ranges of ids and one total per such range, so no task sees all records. A group is at
most FANOUT children, or the records that start in RANGE_BYTES; where the other replica has more between two cuts, they
are hashed in pieces of that size first.

``read_warc`` gives the records of WARC files with their places in them; ``warc_record`` makes a record of a page.

Null urls and bodies count as empty, null ids come first; repeated rows are records of their own. Empty replicas have
no nodes and are equal; against a filled one every record is missing (or extra).
"""

from __future__ import annotations

import gzip
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tagmill.llm.common import materialise

RANGE_BYTES = 1 << 18
FANOUT = 16
_LENGTH = re.compile(rb"^content-length:[ \t]*(\d+)[ \t]*\r?$", re.I | re.M)
_ID = re.compile(rb"^warc-record-id:[ \t]*<?([^>\r\n]*)>?[ \t]*\r?$", re.I | re.M)


def parse_warc(data: bytes) -> Iterator[tuple[str, int, bytes]]:
    """Id, offset and bytes of each record of a file. A record that is cut short is given as far as it goes."""
    at = 0
    while (at := data.find(b"WARC/", at)) >= 0:
        head = data.find(b"\r\n\r\n", at)
        head = len(data) if head < 0 else head + 4
        length, name = _LENGTH.search(data, at, head), _ID.search(data, at, head)
        end = head + (int(length[1]) if length else 0) + 4  # two line ends close a record
        yield (name[1].decode("utf-8", "replace") if name else ""), at, data[at:end]
        at = end


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """file, offset (in the unpacked file), rec_id (its WARC-Record-ID), record (bytes) of WARC files, plain or gzipped.

    A file is read as a whole, so it must fit in a worker's memory (a gigabyte is usual). Records without an id have an empty
    one; files without a record give no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                plain = gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data  # also of several members
                for rec_id, offset, record in parse_warc(plain):
                    yield pa.RecordBatch.from_arrays([pa.array([file]), pa.array([offset], pa.int64()), pa.array([rec_id]), pa.array([record], pa.binary())], ["file", "offset", "rec_id", "record"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(run, "file string, offset bigint, rec_id string, record binary")


def warc_record(page_id: Column, url: Column, body: Column) -> Column:
    """A response record: header block, blank line, body, two line ends."""
    body = F.coalesce(body, F.lit(""))
    end = F.lit("\r\n")
    return F.concat(
        F.lit("WARC/1.1"), end,
        F.lit("WARC-Type: response"), end,
        F.lit("WARC-Target-URI: "), F.coalesce(url, F.lit("")), end,
        F.lit("WARC-Record-ID: <urn:page:"), F.coalesce(page_id.cast("string"), F.lit("")), F.lit(">"), end,
        F.lit("Content-Length: "), F.octet_length(body).cast("string"), end,
        end, body, end, end,
    )


def index(records: DataFrame, range_bytes: int = RANGE_BYTES, key: str = "rec_id", record: str = "record", cuts: DataFrame | None = None) -> DataFrame:
    """rec_id, digest, n_bytes, times (equal records), offset (of the first of them), range_no, piece.

    cuts (rec_id, digest, range_no): the records with which ranges start; without them they are taken from the offsets.
    """
    body = F.coalesce(F.col(record), F.lit("").cast(dict(records.dtypes)[record]))
    slim = records.select(F.col(key).alias("rec_id"), F.octet_length(body).cast("bigint").alias("n_bytes"), F.sha2(body.cast("binary"), 256).alias("digest"))
    slim = slim.groupBy("rec_id", "digest", "n_bytes").agg(F.count(F.lit(1)).alias("times")).withColumn("cut", F.lit(None).cast("bigint"))
    if cuts is not None:
        slim = slim.unionByName(cuts.select("rec_id", "digest", F.lit(0).cast("bigint").alias("n_bytes"), F.lit(0).cast("bigint").alias("times"), F.col("range_no").alias("cut")))
    # the part of a row must not change between the sums below, so it is written
    dealt = materialise(slim.repartitionByRange("rec_id", "digest").withColumn("part", F.spark_partition_id()), "records")
    inside = Window.partitionBy("part").orderBy("rec_id", "digest", F.col("cut").isNull(), "n_bytes").rowsBetween(Window.unboundedPreceding, 0)
    size = F.col("n_bytes") * F.col("times")
    local = dealt.withColumn("before", F.sum(size).over(inside) - size)
    local = local.withColumn("last", F.last(F.when(F.col("cut").isNotNull(), F.struct("cut", F.col("before").alias("at"))), ignorenulls=True).over(inside))
    # as many rows as shuffle partitions
    parts = local.groupBy("part").agg(F.sum(size).alias("n"), F.max("last").alias("top"))
    so_far = Window.orderBy("part")
    parts = parts.withColumn("start", F.sum("n").over(so_far) - F.col("n"))
    top = F.struct(F.col("top.cut").alias("cut"), (F.col("top.at") + F.col("start")).alias("at"))
    parts = parts.withColumn("carried", F.max(F.when(F.col("top").isNotNull(), top)).over(so_far.rowsBetween(Window.unboundedPreceding, -1)))
    placed = local.filter("cut IS NULL").join(parts.select("part", "start", "carried"), "part").withColumn("offset", F.col("start") + F.col("before"))
    if cuts is None:
        places = [F.floor(F.col("offset") / range_bytes).cast("bigint").alias("range_no"), F.lit(0).cast("bigint").alias("piece")]
    else:
        begin = F.coalesce(F.col("last.at") + F.col("start"), F.col("carried.at"), F.lit(0))
        places = [F.coalesce("last.cut", "carried.cut", F.lit(0)).cast("bigint").alias("range_no"), F.floor((F.col("offset") - begin) / range_bytes).cast("bigint").alias("piece")]
    return placed.select("rec_id", "digest", "n_bytes", "times", "offset", *places)


def cuts_of(rows: DataFrame) -> DataFrame:
    """rec_id, digest, range_no: with which record each range starts."""
    return rows.groupBy("range_no").agg(F.min_by(F.struct("rec_id", "digest"), "offset").alias("first")).select("first.rec_id", "first.digest", "range_no")


@dataclass
class Tree:
    """Records and levels of nodes (node, hash): ranges first, then ever fewer, up to one."""

    records: DataFrame
    levels: list[DataFrame]

    def root(self) -> str | None:
        top = self.levels[-1].collect()  # one node
        return top[0]["hash"] if top else None


def _joined(parts: list[str], by: str) -> Column:
    """SHA-256 over a group's parts in order."""
    return F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(by, *(p for p in parts if p != by)))), lambda x: F.concat_ws(":", *(x[p].cast("string") for p in parts))), ","), 256)


def build(records: DataFrame, range_bytes: int = RANGE_BYTES, fanout: int = FANOUT, height: int | None = None, key: str = "rec_id", record: str = "record", cuts: DataFrame | None = None) -> Tree:
    """Tree over records; trees that are to be compared have the ``cuts`` and ``height`` (levels above the ranges) of one of them."""
    rows = materialise(index(records, range_bytes, key, record, cuts), "index")
    pieces = rows.groupBy("range_no", "piece").agg(_joined(["n_bytes", "times", "digest"], "offset").alias("hash"))
    level = materialise(pieces.groupBy(F.col("range_no").alias("node")).agg(_joined(["piece", "hash"], "piece").alias("hash")), "ranges")
    levels = [level]
    if height is None:
        last = level.agg(F.max("node")).first()[0] or 0
        height = 0
        while last:
            last, height = last // fanout, height + 1
    for _ in range(height):
        level = materialise(level.withColumn("child", F.col("node")).groupBy(F.floor(F.col("child") / fanout).cast("bigint").alias("node")).agg(_joined(["child", "hash"], "child").alias("hash")), "nodes")
        levels.append(level)
    return Tree(rows, levels)


def copies(rows: DataFrame, first: Column | None = None) -> DataFrame:
    """A row for each of several equal records, from the ``first`` on, with nth and its own offset."""
    nth = F.explode(F.sequence(F.lit(1).cast("bigint") if first is None else first, F.col("times")))
    return rows.withColumn("nth", nth).withColumn("offset", F.col("offset") + (F.col("nth") - 1) * F.col("n_bytes"))


def audit(a: Tree, b: Tree, fanout: int = FANOUT) -> DataFrame:
    """Records that differ: rec_id, digest_a, digest_b, status (changed, missing in b, extra in b), offset_a, offset_b.

    Both trees must have the same cuts and height. Only mismatching branches are read below the roots.
    """
    if len(a.levels) != len(b.levels):
        raise ValueError("trees of different heights")
    doubt: DataFrame | None = None
    for one, two in zip(reversed(a.levels), reversed(b.levels), strict=True):
        if doubt is not None:
            parents = doubt.select(F.col("node").alias("parent"))
            one, two = (x.withColumn("parent", F.floor(F.col("node") / fanout).cast("bigint")).join(parents, "parent", "left_semi").drop("parent") for x in (one, two))
        both = one.select("node", F.col("hash").alias("x")).join(two.select("node", F.col("hash").alias("y")), "node", "full")
        doubt = materialise(both.filter(~F.col("x").eqNullSafe(F.col("y"))).select("node"), "doubt")
        if doubt.isEmpty():
            break
    ranges = doubt.select(F.col("node").alias("range_no"))
    one, two = (t.records.join(ranges, "range_no", "left_semi") for t in (a, b))
    # equal records cancel out first; what is left of an id is paired in order, so one damaged record is one row
    def surplus(x: DataFrame, y: DataFrame) -> DataFrame:
        y = y.select(F.col("rec_id").alias("other_id"), F.col("digest").alias("other_digest"), F.col("times").alias("other_times"))
        left = x.join(y, F.col("rec_id").eqNullSafe(F.col("other_id")) & (F.col("digest") == F.col("other_digest")), "left").withColumn("known", F.coalesce("other_times", F.lit(0)))
        return copies(left.filter("times > known"), F.col("known") + 1)

    left, right = surplus(one, two), surplus(two, one)
    order = Window.partitionBy("rec_id").orderBy("digest", "nth")
    left = left.select(F.col("rec_id").alias("id_a"), F.row_number().over(order).alias("n_a"), F.col("digest").alias("digest_a"), F.col("offset").alias("offset_a"))
    right = right.select(F.col("rec_id").alias("id_b"), F.row_number().over(order).alias("n_b"), F.col("digest").alias("digest_b"), F.col("offset").alias("offset_b"))
    found = left.join(right, F.col("id_a").eqNullSafe(F.col("id_b")) & (F.col("n_a") == F.col("n_b")), "full")
    status = F.when(F.col("digest_b").isNull(), "missing").when(F.col("digest_a").isNull(), "extra").otherwise("changed")
    return found.select(F.coalesce("id_a", "id_b").alias("rec_id"), "digest_a", "digest_b", status.alias("status"), "offset_a", "offset_b")


def fixity(a: DataFrame, b: DataFrame, range_bytes: int = RANGE_BYTES, fanout: int = FANOUT, key: str = "rec_id", record: str = "record") -> tuple[Tree, Tree, DataFrame]:
    """Trees of both replicas and the records that differ."""
    one = build(a, range_bytes, fanout, key=key, record=record)
    cuts = materialise(cuts_of(one.records), "cuts")
    two = build(b, range_bytes, fanout, len(one.levels) - 1, key, record, cuts)
    return one, two, audit(one, two, fanout)
