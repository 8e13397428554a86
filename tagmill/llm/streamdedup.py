"""Exact deduplication as a stateful stream (operator 8).

Two streams run until their input is used up and can be resumed from their checkpoints:

1. *log*: every row's normalised text gets a SHA-256; the log keeps (doc_id, sha, content locator). The locator is the
   file and the row in it, so that the content can be fetched again.
2. *state*: a keyed aggregation over the log in RocksDB, without expiry. Per digest it keeps the stable identifier (the
   smallest doc_id), that row's locator, and how many rows came. It is read back as a table.

A digest that several rows share is a *hit*; its rows' full normalised texts are then compared. The comparison is the
smallest and the largest text of a digest, which Spark reduces before the shuffle, so a group of any size moves two
texts per task. Digests under which different texts meet are split by the text itself.

Null texts count as empty. Null ids count as larger than all others. Rows that repeat both id and text form one group,
and the one with the first locator stays. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tagmill.llm.common import scratch, settings

_ROCKS = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
    # a store would otherwise reserve about 4 MB of local disk whatever it holds
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}
#: Locators of hits that are sent to every task at most; beyond, both sides are shuffled by them.
BROADCAST_ROWS = 1_000_000


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def _glob(path: str) -> str:
    """The same path as a pattern: a stream then takes a single file as well as a folder."""
    return f"{path[:-1]}[{path[-1]}]"


def write_log(spark: SparkSession, table: str, log: str, checkpoint: str, files_per_trigger: int = 10_000, key: str = "doc_id", text: str = "text") -> None:
    """Stream 1: append (doc_id, sha, file, row) of every row that came since the last run."""
    source = spark.readStream.schema(spark.read.parquet(table).select(key, text).schema).option("maxFilesPerTrigger", files_per_trigger).parquet(_glob(table))
    rows = source.select(F.col(key).alias("doc_id"), F.unhex(F.sha2(normalised(F.col(text)), 256)).alias("sha"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    rows.writeStream.format("parquet").option("path", log).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def _place() -> Column:
    return F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "file", "row")


def update_state(spark: SparkSession, log: str, checkpoint: str, digest: Callable[[Column], Column] = lambda sha: sha) -> DataFrame:
    """Stream 2: bring the keyed state up to the log. Returns the state: digest, keeper (struct), n."""
    schema = spark.read.parquet(log).schema
    with settings(spark, _ROCKS):
        rows = spark.readStream.schema(schema).parquet(log).withColumn("digest", digest(F.col("sha")))
        state = rows.groupBy("digest").agg(F.min(_place()).alias("keeper"), F.count(F.lit(1)).alias("n"))
        state.writeStream.format("noop").outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
        stored = spark.read.format("statestore").load(checkpoint)
    buffers = stored.schema["value"].dataType.fieldNames()
    return stored.select(F.col("key")[stored.schema["key"].dataType.fieldNames()[0]].alias("digest"), F.col("value")[buffers[0]].alias("keeper"), F.col("value")[buffers[1]].alias("n"))


def deduplicate(spark: SparkSession, table: str, digest: Callable[[Column], Column] = lambda sha: sha, key: str = "doc_id", text: str = "text", work: str | None = None) -> DataFrame:
    """Every row of a Parquet table: doc_id, keep_id, group_size, kept, text_sha256.

    ``work`` names the folder of log and state; a later call with the same folder takes only what is new in the table.
    """
    work = work or scratch(spark, "stream-dedup")
    write_log(spark, table, f"{work}/log", f"{work}/log-checkpoint", key=key, text=text)
    state = update_state(spark, f"{work}/log", f"{work}/state-checkpoint", digest)
    log = spark.read.parquet(f"{work}/log").withColumn("digest", digest(F.col("sha")))
    rows = log.join(state, "digest").withColumn("hit", F.col("n") > 1)

    # full bytes of the hits, fetched by their locators
    hits = state.filter("n > 1").select("digest")
    of_hits = log.join(hits, "digest", "left_semi").select(F.col("file").alias("hit_file"), F.col("row").alias("hit_row"))
    few = of_hits.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    docs = spark.read.parquet(table).select(F.col(key).alias("doc_id"), F.col(text).alias("text"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    located = (F.col("file") == F.col("hit_file")) & (F.col("row") == F.col("hit_row"))
    again = docs.join(F.broadcast(of_hits) if few else of_hits, located, "left_semi").select("doc_id", normalised(F.col("text")).alias("norm"))
    again = again.withColumn("sha", F.unhex(F.sha2("norm", 256))).withColumn("digest", digest(F.col("sha")))
    unlike = again.groupBy("digest").agg(F.min("norm").alias("lo"), F.max("norm").alias("hi")).filter("lo <> hi").select("digest")
    path = f"{work}/unlike-{scratch(spark, 'x').rsplit('-', 1)[1]}"
    unlike.write.parquet(path)
    unlike = spark.read.parquet(path)
    out = ["doc_id", F.col("keeper.doc_id").alias("keep_id"), F.col("n").alias("group_size"), (_place() == F.col("keeper")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256")]
    if unlike.isEmpty():
        return rows.select(*out)
    # different texts under one digest: group by digest and text, place by place
    located = spark.read.parquet(table).select(F.col(key).alias("doc_id"), normalised(F.col(text)).alias("norm"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    located = located.withColumn("sha", F.unhex(F.sha2("norm", 256))).withColumn("digest", digest(F.col("sha"))).join(unlike, "digest", "left_semi")
    groups = located.groupBy("digest", "norm").agg(F.min(_place()).alias("keeper"), F.count(F.lit(1)).alias("n"))
    return rows.join(unlike, "digest", "left_anti").select(*out).unionByName(located.join(groups, ["digest", "norm"]).select(*out))
