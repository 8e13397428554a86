"""Sharded tables with size-tiered compaction (operator 4). DataFrame functions only; the driver handles metadata.

A table is a folder. ``data/`` holds immutable Parquet shards, ``manifests/`` a folder per version that lists the shards
alive in it, and ``commits/`` one small file per version that names the manifest. A version exists once its commit file
does; that file comes by a rename that fails if the name is taken, so of two writers one wins. The other puts its change on
top of the new version: arrivals always fit; a compaction fits as long as all shards that it merged are still alive, and
otherwise starts over. Readers take the highest commit and never see half a change. Files of a failed writer are in no
manifest; ``vacuum`` removes them once they are older than any writer can be.

``append`` writes arrivals as they are partitioned, a small shard per task, without a shuffle. ``compact`` deals the
shards below the target size into tiers (each ``fanout`` times the size of the one before), and where a tier has at
least ``fanout`` shards, merges them, in order of arrival, into files of about the target size. Merging shuffles the rows
of those shards only, by the file they go to; shards of the target size are sealed and not written again. A file takes
shards until it has the target size, so a merging task reads less than twice that (compressed), whatever the table's size.

Rows are kept as they are: nulls, empty texts, repeated rows and all columns. The columns ``__arrival``, ``__into`` and
``__path`` are used inside; a table can't have them. An empty arrival commits a version without new shards; a table without
shards reads as an empty frame of the schema it was made with.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tagmill.llm.common import drop_path, settings

TARGET_BYTES = 64 << 20
FANOUT = 4
#: Sizes below this are one tier.
LEAST_BYTES = 64 << 10
#: Versions that stay readable after a vacuum, and hours that a file without a version stays, as a writer may still need it.
KEEP_VERSIONS = 2
KEEP_HOURS = 24.0
#: Times that a change is put on a newer version before the writer gives up.
ATTEMPTS = 50
#: Shards in one plan that are sent to every task at most.
BROADCAST_SHARDS = 100_000

_MANIFEST = "path string, rows bigint, bytes bigint, added int"


class CommitConflict(RuntimeError):
    """Another writer has made this version."""


class ShardTable:
    def __init__(self, spark: SparkSession, root: str, schema):
        """``schema``: of the rows, as a StructType."""
        if taken := {"__arrival", "__into", "__path"} & set(schema.fieldNames()):
            raise ValueError(f"columns used inside: {sorted(taken)}")
        self.spark, self.root, self.schema = spark, root.rstrip("/"), schema

    # -- metadata, through Hadoop's file system -------------------------------------------------------------------

    def _hadoop(self, path: str):
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        return jvm, p, p.getFileSystem(conf), conf

    def versions(self) -> list[int]:
        _, p, fs, _ = self._hadoop(f"{self.root}/commits")
        return sorted(int(s.getPath().getName()[1:]) for s in fs.listStatus(p) if s.getPath().getName().startswith("v")) if fs.exists(p) else []

    def _commit(self, version: int, manifest: DataFrame) -> int:
        name = f"v{version:08d}-{uuid.uuid4().hex}"
        manifest.coalesce(1).write.parquet(f"{self.root}/manifests/{name}")
        jvm, draft, fs, conf = self._hadoop(f"{self.root}/commits/.{name}")
        out = fs.create(draft)
        out.write(bytearray(name.encode()))
        out.close()
        _, final, _, _ = self._hadoop(f"{self.root}/commits/v{version:08d}")
        none = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(final.toUri(), conf).rename(draft, final, none)
        except Exception as error:
            if fs.exists(final):
                fs.delete(draft, False)
                raise CommitConflict(f"version {version} is there already") from error
            raise
        return version

    def _change(self, change: Callable[[DataFrame, int], DataFrame | None]) -> int | None:
        """Commit ``change(manifest, version)`` on top of the newest version, whichever that is by then; None if it no longer fits."""
        for _ in range(ATTEMPTS):
            base = (self.versions() or [0])[-1]
            manifest = change(self.manifest(base or None), base + 1)
            if manifest is None:
                return None
            try:
                return self._commit(base + 1, manifest)
            except CommitConflict:
                continue
        raise CommitConflict(f"{ATTEMPTS} versions came in between")

    def manifest(self, version: int | None = None) -> DataFrame:
        """Shards alive in a version (the newest): path, rows, bytes, added (the version that made the shard)."""
        have = self.versions()
        if not have:
            return self.spark.createDataFrame([], _MANIFEST)
        version = have[-1] if version is None else version
        _, p, fs, _ = self._hadoop(f"{self.root}/commits/v{version:08d}")
        stream = fs.open(p)
        name = bytes(stream.readAllBytes()).decode()
        stream.close()
        return self.spark.read.schema(_MANIFEST).parquet(f"{self.root}/manifests/{name}")

    def _paths(self, manifest: DataFrame) -> list[str]:
        return [r[0] for r in manifest.select("path").orderBy("path").toLocalIterator()]

    # -- rows --------------------------------------------------------------------------------------------------------

    def _rows(self, paths: list[str]) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def read(self, version: int | None = None) -> DataFrame:
        return self._rows(self._paths(self.manifest(version)))

    def _shards(self, folder: str) -> DataFrame:
        """What a write has left: a row a file; no column of the data is read."""
        files = self.spark.read.schema(self.schema).option("recursiveFileLookup", "true").parquet(folder)
        return files.groupBy(F.col("_metadata.file_path").alias("path")).agg(F.count(F.lit(1)).alias("rows"), F.max("_metadata.file_size").alias("bytes"))

    def _write(self, rows: DataFrame, by: str) -> DataFrame:
        folder = f"{self.root}/data/{uuid.uuid4().hex}"
        # several files are open in a task, so rows needn't be sorted by the file they go to
        with settings(self.spark, {"spark.sql.maxConcurrentOutputFileWriters": "64"}):
            rows.write.option("compression", "zstd").partitionBy(by).parquet(folder)
        return self._shards(folder).withColumn("label", F.regexp_extract("path", f"/{by}=([^/]*)/", 1))

    def append(self, rows: DataFrame, arrivals: int = 1, by=None) -> list[int]:
        """Write rows as small shards and commit them; with ``arrivals`` > 1 as so many versions, dealt by the column ``by``.

        All arrivals are written in one pass; each becomes visible by its own commit.
        """
        label = F.pmod(by, F.lit(arrivals)) if by is not None else F.lit(0)
        written = self._write(rows.select(*self.schema.fieldNames(), F.coalesce(label.cast("int"), F.lit(0)).alias("__arrival")), "__arrival")
        listed = f"{self.root}/manifests/.{uuid.uuid4().hex}"
        written.write.parquet(listed)
        written = self.spark.read.parquet(listed)
        made = []
        for i in range(arrivals):
            new = written.filter(F.col("label").cast("int") == i).select("path", "rows", "bytes")
            made.append(self._change(lambda manifest, version, new=new: manifest.unionByName(new.withColumn("added", F.lit(version)))))
        drop_path(self.spark, listed)
        return made

    def plan(self, target: int = TARGET_BYTES, fanout: int = FANOUT) -> DataFrame:
        """path, into: shards to merge, and the number of the file each goes to."""
        # shards of a tier are ordered by age; windows here are over shards, not rows
        open_ = self.manifest().filter(F.col("bytes") < target)
        size = F.greatest(F.col("bytes"), F.lit(LEAST_BYTES)) / LEAST_BYTES
        tiered = open_.withColumn("tier", F.floor(F.log(float(fanout), size)).cast("int"))
        ages = Window.partitionBy("tier").orderBy("added", "path")
        many = tiered.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("tier"))).filter(F.col("n") >= fanout)
        before = F.sum("bytes").over(ages) - F.col("bytes")
        numbered = many.select("path", "tier", F.floor(before / target).alias("file"))
        # files are numbered tier after tier; there are about ten tiers
        files = numbered.groupBy("tier").agg((F.max("file") + 1).alias("n"))
        files = files.select("tier", (F.sum("n").over(Window.orderBy("tier")) - F.col("n")).alias("first"))
        return numbered.join(F.broadcast(files), "tier").select("path", (F.col("first") + F.col("file")).cast("int").alias("into"))

    def compact(self, target: int = TARGET_BYTES, fanout: int = FANOUT) -> int | None:
        """Merge once and commit. None if no tier has enough shards."""
        while True:
            folder = f"{self.root}/manifests/.{uuid.uuid4().hex}"
            self.plan(target, fanout).write.parquet(folder)
            plan = self.spark.read.parquet(folder)
            paths = self._paths(plan)
            if not paths:
                drop_path(self.spark, folder)
                return None
            files = plan.agg(F.max("into")).first()[0] + 1
            side = F.broadcast(plan) if len(paths) <= BROADCAST_SHARDS else plan
            source = self._rows(paths).select("*", F.col("_metadata.file_path").alias("__path"))
            rows = source.join(side.select(F.col("path").alias("__path"), F.col("into").alias("__into")), "__path").drop("__path")
            listed = f"{self.root}/manifests/.{uuid.uuid4().hex}"
            self._write(rows.repartitionById(files, F.col("__into")), "__into").select("path", "rows", "bytes").write.parquet(listed)
            written = self.spark.read.parquet(listed)

            def merged(manifest: DataFrame, version: int) -> DataFrame | None:
                if not plan.join(manifest, "path", "left_anti").isEmpty():
                    return None  # another writer has merged some of them
                stay = manifest.join(plan.select("path"), "path", "left_anti").select("path", "rows", "bytes", "added")
                return stay.unionByName(written.withColumn("added", F.lit(version)))

            made = self._change(merged)
            if made is None:
                for path in self._paths(written):
                    drop_path(self.spark, path)
            drop_path(self.spark, folder)
            drop_path(self.spark, listed)
            if made is not None:
                return made

    def vacuum(self, keep_versions: int = KEEP_VERSIONS, keep_hours: float = KEEP_HOURS) -> int:
        """Delete data that none of the last versions lists and that is older than any writer may be; returns how many files went.

        Earlier versions can't be read any more. Without hours to keep, no other writer may be at work.
        """
        alive = {p.rsplit("/data/", 1)[1] for v in self.versions()[-max(keep_versions, 1) :] for p in self._paths(self.manifest(v))}
        before = (time.time() - keep_hours * 3600) * 1000
        _, p, fs, _ = self._hadoop(f"{self.root}/data")
        gone, walk = 0, fs.listFiles(p, True)
        while walk.hasNext():
            status = walk.next()
            path = status.getPath().toString()
            if path.endswith(".parquet") and path.rsplit("/data/", 1)[1] not in alive and status.getModificationTime() <= before:
                drop_path(self.spark, path)
                gone += 1
        return gone
