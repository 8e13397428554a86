"""Vector retrieval: exact top-k within parts, neighbour votes, blended rankings, folds.

All pairs of a part are compared, in blocks: rows are packed into blocks of ``BLOCK`` vectors, blocks of a part meet in
an equi-join, and each pair of blocks is one matrix product in numpy that returns its best k. No task holds more than
two blocks, and what is shuffled after it is k rows per query and block.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 512
#: Scores are rounded to so many digits before they are ranked, so that the order of summation can't decide; ties go to the smaller id.
DIGITS = 12


def _blocks(rows: DataFrame, id_: str, vector: str, group: str, n_blocks: int, name: str) -> DataFrame:
    packed = F.collect_list(F.struct(F.col(id_).cast("bigint").alias("id"), F.col(group).cast("bigint").alias("g"), F.col(vector).cast("array<double>").alias("v")))
    return rows.groupBy("part", F.pmod(F.xxhash64(id_), F.lit(n_blocks)).alias(f"{name}_block")).agg(packed.alias(name))


def all_scores(queries: DataFrame, candidates: DataFrame, id_: str = "id", vector: str = "vector") -> DataFrame:
    """part, id, other, score: every candidate of the same part but the row itself. For few candidates, such as the items of a part."""
    return _compared(queries, candidates, None, id_, vector, None)


def top_k(queries: DataFrame, candidates: DataFrame, k: int, id_: str = "id", vector: str = "vector", group: str | None = None) -> DataFrame:
    """part, id, other, score, rank: the k most similar candidates of the same part, never the row itself.

    With ``group``, candidates of the query's own group don't count. Vectors are taken as they are: unit vectors give cosines.
    """
    found = _compared(queries, candidates, k, id_, vector, group)
    rank = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("score"), "other"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k)


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest scores of each row, ties to the smaller id, in any order; also more, where many are equal."""
    if scores.shape[1] <= k:
        return np.isfinite(scores)
    least = np.partition(scores, scores.shape[1] - k, axis=1)[:, -k, None]  # the k-th largest
    keep = scores > least
    for row in np.flatnonzero((scores >= least).sum(1) >= k):  # of those that equal it, the smallest ids
        equal = np.flatnonzero(scores[row] == least[row])
        keep[row, equal[np.argsort(ids[equal], kind="stable")[: k - int(keep[row].sum())]]] = True
    return keep & np.isfinite(scores)


def _compared(queries: DataFrame, candidates: DataFrame, k: int | None, id_: str, vector: str, group: str | None) -> DataFrame:
    """part, id, other, score: of each two blocks the best k, or all."""
    group = group or "__none"
    if group == "__none":
        queries, candidates = (x.withColumn(group, F.lit(side)) for x, side in ((queries, -1), (candidates, -2)))
    # blocks follow the largest part; smaller parts have smaller blocks
    largest = candidates.groupBy("part").count().agg(F.max("count")).first()[0] or 0
    n = max(1, -(-largest // BLOCK))
    pairs = _blocks(queries, id_, vector, group, n, "q").join(_blocks(candidates, id_, vector, group, n, "c"), "part")
    kind = dict(queries.dtypes)["part"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                part = batch.column("part").slice(i, 1)
                sides = [batch.column(c)[i].values for c in ("q", "c")]
                ids = [s.field("id").to_numpy() for s in sides]
                groups = [s.field("g").to_numpy() for s in sides]
                q, c = (np.stack([np.asarray(v) for v in s.field("v").to_pylist()]) for s in sides)
                scores = np.round(q @ c.T, DIGITS)
                out = (ids[0][:, None] == ids[1][None, :]) | (groups[0][:, None] == groups[1][None, :])
                scores[out] = -np.inf
                keep = np.isfinite(scores) if k is None else _best(scores, ids[1], k)
                at = np.nonzero(keep)
                yield pa.RecordBatch.from_arrays([pa.concat_arrays([part] * len(at[0])) if len(at[0]) else part.slice(0, 0), pa.array(ids[0][at[0]]), pa.array(ids[1][at[1]]), pa.array(scores[keep])], ["part", "id", "other", "score"])

    return pairs.select("part", "q", "c").mapInArrow(run, f"part {kind}, id bigint, other bigint, score double")


def folds(rows: DataFrame, stratum: str, id_: str, n: int, seed: int) -> DataFrame:
    """Stratified folds 0 .. n-1: rows of a stratum in the order of a hash of id and seed are dealt in turn."""
    from tagmill.operators.ordering import number_rows

    digest = F.conv(F.substring(F.md5(F.concat_ws("/", F.col(id_).cast("string"), F.lit(str(seed)))), 1, 13), 16, 10).cast("bigint")
    numbered = number_rows(rows.withColumn("__h", digest), [stratum], "__h", width=1 << 44, name="__n")
    return numbered.withColumn("fold", F.pmod(F.col("__n") - 1, F.lit(n))).drop("__h", "__n")


def softmax(score: Column, temperature: Column | float, over: Sequence[str]) -> Column:
    w = Window.partitionBy(*over)
    logit = score / temperature
    weight = F.exp(logit - F.max(logit).over(w))
    return weight / F.sum(weight).over(w)


def votes(neighbours: DataFrame, labelled: DataFrame, label: str) -> DataFrame:
    """id, label, p_knn: shares of the neighbours' labels, weighted by similarity; none where no neighbour is similar."""
    rows = neighbours.join(labelled.select(F.col("id").alias("other"), F.col(label).alias("label")), "other")
    sums = rows.groupBy("id", "label").agg(F.sum(F.greatest(F.col("score"), F.lit(0.0))).alias("s"))
    total = F.sum("s").over(Window.partitionBy("id"))
    return sums.withColumn("p_knn", F.col("s") / total).filter(F.col("s") > 0).select("id", "label", "p_knn")


def blend(similarity: DataFrame, knn: DataFrame, weight: Column | float, temperature: Column | float, over: Sequence[str] = ("id",)) -> DataFrame:
    """Mixture of the softmax over the items of the part and the neighbours' votes (uniform if there are none).

    similarity: id, item, score of every item of the part; knn: id, label, p_knn.
    """
    p_sim = softmax(F.col("score"), temperature, over)
    rows = similarity.withColumn("p_sim", p_sim).join(knn.withColumnRenamed("label", "item"), ["id", "item"], "left")
    w = Window.partitionBy(*over)
    uniform = 1 / F.count(F.lit(1)).over(w)
    p = F.when(F.max("p_knn").over(w).isNull(), uniform).otherwise(F.coalesce("p_knn", F.lit(0.0)))
    return rows.withColumn("blended", weight * F.col("p_sim") + (1 - weight) * p)
