"""Scores of taggers against reference tags.

Frame: one row a record with primary, secondary (the reference), guess_primary, guess_secondary, ranking, and columns
that name subsets. Section and cluster of an item come from a lookup that the caller has joined.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagmill.functions.stats import binomial_two_sided

RANK_CUTOFFS = (1, 3, 5, 10, 15)


def subsets(rows: DataFrame, conditions: Mapping[str, Column]) -> DataFrame:
    """Every row once for each subset it is in; empty subsets have no rows."""
    names = F.filter(F.array(*(F.when(c, F.lit(n)) for n, c in conditions.items())), lambda x: x.isNotNull())
    return rows.withColumn("subset", F.explode(names))


def share(condition: Column) -> Column:
    return F.round(F.avg(condition.cast("int")), 4)


def scores(rows: DataFrame, by: Sequence[str] = ("subset",)) -> DataFrame:
    """Exact item, acceptable item, cluster and section accuracy."""
    accepted = F.array_contains(F.concat(F.array("primary"), "secondary"), F.col("guess_primary"))
    return rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        share(F.col("guess_primary") == F.col("primary")).alias("primary_accuracy"),
        share(accepted).alias("acceptable_accuracy"),
        share(F.col("guess_cluster") == F.col("cluster")).alias("cluster_accuracy"),
        share(F.col("guess_section") == F.col("section")).alias("section_accuracy"),
    )


def recall(rows: DataFrame, by: Sequence[str] = ("subset",), cutoffs: Sequence[int] = RANK_CUTOFFS) -> DataFrame:
    """Recall at cut-offs and mean reciprocal rank of the true item in the ranking (absent: 0)."""
    rank = F.array_position("ranking", F.col("primary"))
    ranked = rows.withColumn("rank", rank)
    reciprocal = F.round(F.avg(F.when(F.col("rank") > 0, 1 / F.col("rank")).otherwise(0.0)), 4)
    return ranked.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *(share((F.col("rank") > 0) & (F.col("rank") <= k)).alias(f"recall_at_{k}") for k in cutoffs), reciprocal.alias("mrr"))


def set_scores(rows: DataFrame, by: Sequence[str] = ("subset",)) -> DataFrame:
    """Micro precision, recall and F1 of the sets of items."""
    truth, guess = F.array_distinct(F.concat(F.array("primary"), "secondary")), F.array_distinct(F.concat(F.array("guess_primary"), "guess_secondary"))
    sums = rows.groupBy(*by).agg(F.sum(F.size(F.array_intersect(truth, guess))).alias("tp"), F.sum(F.size(F.array_except(guess, truth))).alias("fp"), F.sum(F.size(F.array_except(truth, guess))).alias("fn"))
    p, r = F.col("tp") / F.greatest(F.col("tp") + F.col("fp"), F.lit(1)), F.col("tp") / F.greatest(F.col("tp") + F.col("fn"), F.lit(1))
    return sums.select(*by, "tp", "fp", "fn", F.round(p, 4).alias("item_precision"), F.round(r, 4).alias("item_recall"), F.round(2 * p * r / F.greatest(p + r, F.lit(1e-9)), 4).alias("item_f1"))


def kappa(rows: DataFrame, truth: str, guess: str) -> DataFrame:
    """Cohen's kappa: from the confusion matrix, which is small however many rows there are."""
    cells = rows.groupBy(F.col(truth).alias("t"), F.col(guess).alias("g")).agg(F.count(F.lit(1)).alias("n"))
    total = cells.agg(F.sum("n").alias("n"), F.sum(F.when(F.col("t") == F.col("g"), F.col("n")).otherwise(0)).alias("same"))
    t, g = cells.groupBy("t").agg(F.sum("n").alias("a")), cells.groupBy("g").agg(F.sum("n").alias("b"))
    chance = t.join(g, t["t"] == g["g"]).agg(F.coalesce(F.sum(F.col("a") * F.col("b")), F.lit(0)).alias("ab"))
    both = total.crossJoin(F.broadcast(chance))  # one row each
    po, pe = F.col("same") / F.col("n"), F.col("ab") / (F.col("n") * F.col("n"))
    return both.select("n", F.round(po, 4).alias("observed"), F.round(pe, 4).alias("expected"), F.round(F.try_divide(po - pe, 1 - pe), 3).alias("kappa"))


def agreement(rows: DataFrame, first: str, second: str, truth: str) -> DataFrame:
    """How often two taggers agree, and how often they are right when they do or don't."""
    same = F.col(first) == F.col(second)
    right = lambda c: (F.col(c) == F.col(truth)).cast("int")
    return rows.agg(
        F.count(F.lit(1)).alias("n"),
        F.round(F.avg(same.cast("int")), 4).alias("agreement_rate"),
        F.round(F.avg(F.when(same, right(first))), 4).alias("accuracy_when_agree"),
        F.round(F.avg(F.when(~same, right(first))), 4).alias("first_accuracy_when_disagree"),
        F.round(F.avg(F.when(~same, right(second))), 4).alias("second_accuracy_when_disagree"),
    )


def mcnemar(rows: DataFrame, first: str, second: str, truth: str) -> DataFrame:
    """Exact test on the records that only one of two taggers has right."""
    a, b = F.col(first).eqNullSafe(F.col(truth)), F.col(second).eqNullSafe(F.col(truth))
    counts = rows.agg(F.count(F.lit(1)).alias("n"), F.sum((a & ~b).cast("bigint")).alias("only_first_right"), F.sum((~a & b).cast("bigint")).alias("only_second_right"))
    return counts.withColumn("p_value", F.round(binomial_two_sided(F.col("only_first_right"), F.col("only_second_right")), 4))


def class_scores(rows: DataFrame, truth: str, guess: str) -> DataFrame:
    """Per class precision, recall, F1 and support; zero where undefined."""
    cells = rows.groupBy(F.col(truth).alias("t"), F.col(guess).alias("g")).agg(F.count(F.lit(1)).alias("n"))
    side = lambda c, name: cells.groupBy(F.col(c).alias("class")).agg(F.sum("n").alias(name))
    hits = cells.filter("t = g").select(F.col("t").alias("class"), F.col("n").alias("tp"))
    rows = side("t", "support").join(side("g", "predicted"), "class", "full").join(hits, "class", "left").fillna(0, ["support", "predicted", "tp"])
    p, r = F.coalesce(F.try_divide(F.col("tp"), F.col("predicted")), F.lit(0.0)), F.coalesce(F.try_divide(F.col("tp"), F.col("support")), F.lit(0.0))
    f1 = F.coalesce(F.try_divide(2.0 * F.col("tp"), F.col("predicted") + F.col("support")), F.lit(0.0))
    return rows.select("class", "support", p.alias("class_precision"), r.alias("class_recall"), f1.alias("f1"))


def class_report(rows: DataFrame, truth: str, guess: str) -> DataFrame:
    return class_scores(rows, truth, guess).select("class", "support", *(F.round(c, 4).alias(c) for c in ("class_precision", "class_recall", "f1")))


def accuracy_and_macro_f1(rows: DataFrame, truth: str, guess: str) -> DataFrame:
    """Accuracy and the mean F1 over all classes that occur on either side."""
    cells = rows.groupBy(F.col(truth).alias("t"), F.col(guess).alias("g")).agg(F.count(F.lit(1)).alias("n"))
    accuracy = cells.agg((F.sum(F.when(F.col("t") == F.col("g"), F.col("n")).otherwise(0)) / F.sum("n")).alias("accuracy"))
    macro = class_scores(rows, truth, guess).agg(F.avg("f1").alias("macro_f1"))
    return accuracy.crossJoin(F.broadcast(macro)).select(F.round("accuracy", 4).alias("accuracy"), F.round("macro_f1", 4).alias("macro_f1"))
