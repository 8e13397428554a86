"""As-of, interval and overlap joins, and thresholds over groups, as compositions that never build a Cartesian product."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def as_of(left: DataFrame, right: DataFrame, by: Sequence[str], on: str, right_columns: Sequence[str], strict: bool = False, keep_unmatched: bool = False) -> DataFrame:
    """Each left row with the last right row of its group whose ``on`` is at or before (``strict``: before) its own.

    Both sides are laid in one order and the last owner is carried on: one shuffle by the group, no pair is ever made.
    """
    marks = right.select(*by, F.col(on).alias("__on"), F.struct(*right_columns).alias("__owner"))
    rows = left.select(*by, F.col(on).alias("__on"), F.struct(*left.columns).alias("__row"))
    first = F.lit(1) if strict else F.lit(0)
    both = rows.withColumn("__owner", F.lit(None).cast(marks.schema["__owner"].dataType)).withColumn("__side", 1 - first)
    marks = marks.withColumn("__row", F.lit(None).cast(rows.schema["__row"].dataType)).withColumn("__side", first)
    order = Window.partitionBy(*by).orderBy("__on", "__side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    owned = both.unionByName(marks).withColumn("__last", F.last("__owner", ignorenulls=True).over(order)).filter("__row IS NOT NULL")
    if not keep_unmatched:
        owned = owned.filter("__last IS NOT NULL")
    return owned.select("__row.*", "__last.*")


def bands(anchors: DataFrame, by: Sequence[str], page: str, top: str, first_y: float, last_y: float, last_page: Column) -> DataFrame:
    """Bands (page, band_top, band_bottom) that each anchor owns: from its place to the next anchor's, page by page."""
    order = Window.partitionBy(*by).orderBy(page, top)
    rows = anchors.withColumn("__next_page", F.coalesce(F.lead(page).over(order), last_page)).withColumn("__next_top", F.coalesce(F.lead(top).over(order), F.lit(last_y)))
    rows = rows.withColumn("__page", F.explode(F.sequence(page, "__next_page")))
    start = F.when(F.col("__page") == F.col(page), F.col(top)).otherwise(F.lit(first_y))
    end = F.when(F.col("__page") == F.col("__next_page"), F.col("__next_top")).otherwise(F.lit(last_y))
    keep = [c for c in anchors.columns if c not in (page, top)]
    return rows.select(*keep, F.col("__page").alias("page"), start.cast("double").alias("band_top"), end.cast("double").alias("band_bottom")).filter("band_bottom > band_top")


def points_in_bands(points: DataFrame, owned: DataFrame, by: Sequence[str], at: str, top: str, bottom: str, slack: float = 1.0) -> DataFrame:
    """Points joined to the bands of their group that hold them: top - slack <= at < bottom."""
    return points.join(owned, list(by)).filter((F.col(at) >= F.col(top) - slack) & (F.col(at) < F.col(bottom)))


def overlapping_pairs(rows: DataFrame, by: Sequence[str], id_: str, start: str, end: str, width: float, least_share: float) -> DataFrame:
    """Pairs a, b of intervals of one group that overlap by ``least_share`` of the shorter one, a before b by (start, id).

    Intervals are laid into buckets of ``width``, and a pair is taken in the bucket in which its overlap begins: each
    pair comes once, and rows meet only if they share a bucket.
    """
    slim = rows.select(*by, F.col(id_).alias("i"), F.col(start).cast("double").alias("s"), F.col(end).cast("double").alias("e")).filter("e > s")
    laid = slim.withColumn("bucket", F.explode(F.sequence(F.floor(F.col("s") / width), F.floor(F.col("e") / width))))
    a, b = (laid.select(*by, "bucket", *(F.col(c).alias(f"{c}_{n}") for c in "ise")) for n in "ab")
    after = (F.col("s_b") > F.col("s_a")) | ((F.col("s_b") == F.col("s_a")) & (F.col("i_b") > F.col("i_a")))
    met = a.join(b, [*by, "bucket"]).filter(after & (F.col("s_b") < F.col("e_a")) & (F.floor(F.col("s_b") / width) == F.col("bucket")))
    overlap = F.least("e_a", "e_b") - F.col("s_b")
    shorter = F.least(F.col("e_a") - F.col("s_a"), F.col("e_b") - F.col("s_b"))
    return met.filter(overlap >= least_share * shorter).select(*by, F.col("i_a").alias("a"), F.col("i_b").alias("b"), F.col("s_b").alias("overlap_start"), overlap.alias("overlap"))


def near_levels(rows: DataFrame, others: DataFrame, by: Sequence[str], level: str, reach: float) -> DataFrame:
    """Rows that have another of ``others`` in their group at a different level within ``reach``: buckets of that width, and the neighbours of each."""
    near = others.select(*by, F.col(level).alias("__o"), F.explode(F.array(*(F.floor(F.col(level) / reach) + d for d in (-1, 0, 1)))).alias("__b"))
    cut = rows.withColumn("__b", F.floor(F.col(level) / reach))
    gap = F.abs(cut[level] - near["__o"])
    on = [cut[c] == near[c] for c in [*by, "__b"]]
    return cut.join(near, [*on, gap > 0, gap <= reach], "left_semi").drop("__b")


def frequent_signatures(rows: DataFrame, signature: str, page: str, least: int, share: float) -> DataFrame:
    """Signatures on at least max(least, share of all pages) different pages."""
    pages = rows.agg(F.countDistinct(page).alias("pages"))
    counted = rows.groupBy(signature).agg(F.countDistinct(page).alias("n_pages"))
    return counted.crossJoin(F.broadcast(pages)).filter(F.col("n_pages") >= F.greatest(F.lit(least), F.floor(F.col("pages") * share))).drop("pages")  # one row is broadcast


def base_metrics(glyphs: DataFrame, by: Sequence[str], size: str, baseline: str) -> DataFrame:
    """Base size of a line (the largest half-point size that two glyphs have, else the largest) and the median baseline at it."""
    rounded = F.bround(F.col(size) * 2) / 2
    sizes = glyphs.select(*by, rounded.alias("size"), F.col(baseline).alias("__y"))
    counted = sizes.groupBy(*by, "size").agg(F.count(F.lit(1)).alias("n"), F.percentile("__y", F.lit(0.5)).alias("y"))
    chosen = F.max_by(F.struct("size", "y"), F.struct(F.col("n") >= 2, F.col("size")))
    return counted.groupBy(*by).agg(chosen.alias("m")).select(*by, F.col("m.size").alias("base_size"), F.col("m.y").alias("baseline"))
