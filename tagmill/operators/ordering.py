"""Numbering and latest-row operators that don't need all rows in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def number_rows(rows: DataFrame, by: Sequence[str], key: str, width: int = 100_000, name: str = "n") -> DataFrame:
    """Consecutive numbers from 1 within ``by`` in order of an integer key, also where ``by`` has few values.

    Keys are cut into buckets of ``width``; rows are numbered inside their bucket, and a running count over the buckets
    (one row each) is added.
    """
    cut = rows.withColumn("__bucket", F.floor(F.col(key) / width))
    sizes = cut.groupBy(*by, "__bucket").agg(F.count(F.lit(1)).alias("__size"))
    before = sizes.select(*by, "__bucket", (F.sum("__size").over(Window.partitionBy(*by).orderBy("__bucket")) - F.col("__size")).alias("__before"))
    inside = F.row_number().over(Window.partitionBy(*by, "__bucket").orderBy(key))
    return cut.withColumn("__inside", inside).join(before, [*by, "__bucket"]).withColumn(name, F.col("__inside") + F.col("__before")).drop("__bucket", "__inside", "__before")


def latest(rows: DataFrame, key: Sequence[str], order: str) -> DataFrame:
    """Of the rows of a key the one that comes last by ``order``; Spark reduces before the shuffle."""
    whole = F.max_by(F.struct(*(c for c in rows.columns if c not in key)), F.col(order)).alias("__row")
    return rows.groupBy(*key).agg(whole).select(*key, "__row.*")


def batches(rows: DataFrame, by: Sequence[str], key: str, size: int) -> DataFrame:
    """Batch numbers from 0 of ``size`` rows within ``by``."""
    return number_rows(rows, by, key, name="__n").withColumn("batch", F.floor((F.col("__n") - 1) / size)).drop("__n")
