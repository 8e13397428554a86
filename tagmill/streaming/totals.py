"""Running totals per key as a Structured Streaming query: what mastery updates and usage reports need, as evidence adds up."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tagmill.sources.scratch import folder


def running_totals(spark: SparkSession, source: DataFrame, keys: Sequence[str], sums: Mapping[str, Column], work: str | None = None) -> DataFrame:
    """Totals after all input that is there. ``source`` is a stream; with the same ``work`` folder a later call takes only what is new.

    Changed keys of each batch are appended with the batch's number; the newest row of a key counts. State is kept without
    expiry, as evidence never gets too late.
    """
    work = work or folder(spark, "totals")
    out = f"{work}/changes"
    totals = source.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *(F.sum(c).alias(name) for name, c in sums.items()))

    def keep(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{out}/b={number}")

    totals.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{work}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    changes = spark.read.parquet(out).drop("b")
    values = [c for c in changes.columns if c not in (*keys, "batch")]
    return changes.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch").alias("x")).select(*keys, *(F.col(f"x.{v}").alias(v) for v in values))


def windowed_counts(source: DataFrame, time: str, key: str, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts per key and window of event time; rows later than the watermark are dropped by Spark."""
    return source.withWatermark(time, late).groupBy(F.window(time, width), key).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), key, "n")
