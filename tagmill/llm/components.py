"""Connected components of an edge table, by alternating large-star and small-star steps.

Every step is an aggregation and a join; no neighbourhood is gathered in one task. Each round is written to the shared
folder, which cuts lineage and lets a lost executor's work be redone from there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagmill.llm.common import discard, materialise


def _large_star(edges: DataFrame) -> DataFrame:
    """Every node's larger neighbours are hung on the smallest node around."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
    return both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Edges run from the larger node u to the smaller v: u and its smaller neighbours are hung on the smallest."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    return edges.join(least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).distinct()


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, root: every node that has an edge, with the smallest node of its component. Ids are integers.

    Edges may repeat and come in either direction; loops are ignored; no edges give no rows.
    """
    now = materialise(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct(), "edges")
    mark = lambda df: df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    before = mark(now)
    while before[0]:
        large = materialise(_large_star(now), "stars")
        last, now = now, materialise(_small_star(large), "stars")
        discard(large, last)
        after = mark(now)
        if after == before:
            break
        before = after
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
