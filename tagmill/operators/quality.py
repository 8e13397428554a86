"""Data-quality rules: checks with a verdict, and problem rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def check(rows: DataFrame, name: str, violation: Column, level: str = "error") -> DataFrame:
    """One row: how many rows break the rule. Information rows (level warning) never fail a report."""
    return rows.agg(F.coalesce(F.sum(F.when(F.coalesce(violation, F.lit(False)), 1).otherwise(0)), F.lit(0)).alias("violations")).select(F.lit(name).alias("name"), (F.col("violations") == 0).alias("passed"), "violations", F.lit(level).alias("level"))


def unique(rows: DataFrame, name: str, *key: str, level: str = "error") -> DataFrame:
    return check(rows.groupBy(*key).agg(F.count(F.lit(1)).alias("__n")), name, F.col("__n") > 1, level)


def missing(rows: DataFrame, others: DataFrame, name: str, key: str, other_key: str, level: str = "error") -> DataFrame:
    """Rows whose key the other table lacks."""
    alone = rows.join(others.select(F.col(other_key).alias("__key")).distinct(), F.col(key) == F.col("__key"), "left_anti")
    return alone.agg(F.count(F.lit(1)).alias("violations")).select(F.lit(name).alias("name"), (F.col("violations") == 0).alias("passed"), "violations", F.lit(level).alias("level"))


def report(*checks: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, checks)


def passed(checks: DataFrame) -> DataFrame:
    """One row: whether all checks of level error hold."""
    return checks.agg(F.bool_and(F.col("passed") | (F.col("level") != "error")).alias("passed"), F.count(F.lit(1)).alias("checks"), F.sum(F.when(F.col("passed"), 0).otherwise(1)).alias("failed"))


def problems(*found: DataFrame) -> DataFrame:
    """Union of (id, problem) frames."""
    return reduce(DataFrame.unionByName, found)


def manifest_problems(manifest: DataFrame, files: DataFrame, key: str = "name", digest: str = "sha256") -> DataFrame:
    """Entries of a manifest whose file is missing or has another checksum."""
    there = files.select(F.col(key).alias("__key"), F.col(digest).alias("__digest"))
    both = manifest.join(there, F.col(key) == F.col("__key"), "left")
    problem = F.when(F.col("__key").isNull(), "missing").when(F.col("__digest") != F.col(digest), "checksum mismatch")
    return both.select(F.col(key).alias("name"), problem.alias("problem")).filter("problem IS NOT NULL")


def mirror_agreement(copies: DataFrame, document: str, mirror: str, body: str, valid: Column) -> DataFrame:
    """Per document: copies fetched, valid ones, distinct checksums among these, whether they agree, and the first good mirror's checksum."""
    digest = F.sha2(F.col(body), 256)
    rows = copies.select(F.col(document).alias("document"), F.col(mirror).alias("mirror"), valid.alias("ok"), digest.alias("digest"))
    return rows.groupBy("document").agg(
        F.count(F.lit(1)).alias("copies"),
        F.sum(F.col("ok").cast("int")).alias("valid"),
        F.countDistinct(F.when(F.col("ok"), F.col("digest"))).alias("digests"),
        F.min_by(F.when(F.col("ok"), F.col("digest")), F.when(F.col("ok"), F.col("mirror"))).alias("sha256"),
    ).withColumn("agree", F.col("digests") <= 1)
