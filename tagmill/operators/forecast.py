"""Empirical-Bayes forecast of item counts: Gamma-Poisson with section means and one shape a part, and its backtests.

The likelihood needs only how often each (section mean, count) occurs, so fitting never sees single items. Frames of
totals have item_id, section_id, total and the columns of ``by`` that fits are kept apart by.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PSEUDO = 0.5
#: Shapes that are tried: a grid on the logarithm from 1e-3 to 1e3.
GRID_STEPS = 60
LOG_LOW, LOG_HIGH = math.log(1e-3), math.log(1e3)
CLIP = 1e-6


def rates(totals: DataFrame, years: int, by: Sequence[str]) -> DataFrame:
    """Mean rate of a section's items per year, with half a question added."""
    return totals.groupBy(*by, "section_id").agg(F.sum("total").alias("s"), F.count(F.lit(1)).alias("items")).select(*by, "section_id", ((F.col("s") + PSEUDO) / (years * F.col("items"))).alias("rate"))


def statistics(totals: DataFrame, years: int, by: Sequence[str]) -> DataFrame:
    """by, mu, y, n: how many items of section mean mu have count y. Sections share fits, so this is a small frame."""
    r = rates(totals, years, by)
    return totals.join(r, [*by, "section_id"]).groupBy(*by, (F.col("rate") * years).alias("mu"), F.col("total").alias("y")).agg(F.count(F.lit(1)).alias("n"))


def log_likelihood(shape: Column, mu: Column, y: Column) -> Column:
    """Negative-binomial log mass. The ratio of gamma functions is a product of y factors."""
    factors = F.when(y > 0, F.aggregate(F.sequence(F.lit(0).cast("bigint"), F.greatest(y.cast("bigint") - 1, F.lit(0).cast("bigint"))), F.lit(0.0), lambda s, j: s + F.log(shape + j) - F.log(j + 1.0))).otherwise(0.0)
    return factors + shape * F.log(shape / (shape + mu)) + y * F.log(mu / (shape + mu))


def shape_grid(totals: DataFrame, years: int, by: Sequence[str]) -> DataFrame:
    """by, k, shape, log_likelihood for every shape of the grid."""
    grid = F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.lit(math.exp(LOG_LOW + (LOG_HIGH - LOG_LOW) * k / GRID_STEPS)).alias("shape")) for k in range(GRID_STEPS + 1))))
    rows = statistics(totals, years, by).withColumn("__grid", grid).select(*by, "mu", "y", "n", "__grid.k", "__grid.shape")
    return rows.groupBy(*by, "k", "shape").agg(F.sum(F.col("n") * log_likelihood(F.col("shape"), F.col("mu"), F.col("y"))).alias("log_likelihood"))


def fit_grid(totals: DataFrame, years: int, by: Sequence[str]) -> DataFrame:
    """by, shape: the best of the grid, the smaller one on ties."""
    best = F.min_by("shape", F.struct(-F.round("log_likelihood", 6), F.col("k"))).alias("shape")
    return shape_grid(totals, years, by).groupBy(*by).agg(best)


def fit_exact(totals: DataFrame, years: int) -> float:
    """The shape of the largest likelihood, by golden sections on the collected statistics (one row per section and count)."""
    rows = [(r["mu"], r["y"], r["n"]) for r in statistics(totals, years, ()).collect()]

    def cost(log_shape: float) -> float:
        a = math.exp(log_shape)
        return -sum(n * (math.lgamma(a + y) - math.lgamma(a) - math.lgamma(y + 1) + a * math.log(a / (a + mu)) + y * math.log(mu / (a + mu))) for mu, y, n in rows)

    low, high, ratio = LOG_LOW, LOG_HIGH, (math.sqrt(5) - 1) / 2
    c, d = high - ratio * (high - low), low + ratio * (high - low)
    fc, fd = cost(c), cost(d)
    while high - low > 1e-10:
        if fc < fd:
            high, d, fd = d, c, fc
            c = high - ratio * (high - low)
            fc = cost(c)
        else:
            low, c, fc = c, d, fd
            d = low + ratio * (high - low)
            fd = cost(d)
    return math.exp((low + high) / 2)


def posterior(totals: DataFrame, fits: DataFrame, years: int, by: Sequence[str]) -> DataFrame:
    """Every item with expected questions a year and the chance of being asked; shape and rate of its posterior beside."""
    rows = totals.join(rates(totals, years, by), [*by, "section_id"])
    rows = rows.join(fits, list(by)) if by else rows.crossJoin(F.broadcast(fits))  # without by there is one fit
    a, b = F.col("shape") + F.col("total"), F.col("shape") / F.col("rate") + years
    return rows.select(*totals.columns, "rate", a.alias("post_shape"), b.alias("post_rate"), (a / b).alias("expected_questions"), (1 - F.pow(b / (b + 1), a)).alias("p_asked"))


def brier(p: Column, asked: Column) -> Column:
    return F.pow(p - asked, 2)


def log_loss(p: Column, asked: Column) -> Column:
    q = F.least(F.greatest(p, F.lit(CLIP)), F.lit(1 - CLIP))
    return -(asked * F.log(q) + (1 - asked) * F.log(1 - q))


def backtest(long: DataFrame, years: Sequence[int], part: str = "part") -> DataFrame:
    """Leave one period out: pooled, empirical and Bayesian predictions scored. long: item_id, section_id, part, year, n."""
    held = F.explode(F.array(*map(F.lit, years))).alias("held")
    per = long.select("*", held).groupBy("held", part, "section_id", "item_id").agg(F.sum(F.when(F.col("year") != F.col("held"), F.col("n")).otherwise(0)).alias("total"), F.sum(F.when((F.col("year") != F.col("held")) & (F.col("n") > 0), 1).otherwise(0)).alias("years_asked"), F.sum(F.when(F.col("year") == F.col("held"), F.col("n")).otherwise(0)).alias("actual"))
    m, by = len(years) - 1, ["held", part]
    rows = posterior(per, fit_grid(per, m, by), m, by)
    asked = F.when(F.col("actual") > 0, 1.0).otherwise(0.0)
    methods = {
        "pooled": (1 - F.exp(-F.col("rate")), F.col("rate")),
        "empirical": (F.col("years_asked") / m, F.col("total") / m),
        "bayes": (F.col("p_asked"), F.col("expected_questions")),
    }
    scored = rows.select(part, F.col("actual"), asked.alias("asked"), F.explode(F.array(*(F.struct(F.lit(name).alias("method"), p.cast("double").alias("p"), e.cast("double").alias("e")) for name, (p, e) in methods.items()))).alias("x"))
    return scored.groupBy(part, "x.method").agg(
        F.round(F.avg(brier(F.col("x.p"), F.col("asked"))), 4).alias("brier"),
        F.round(F.avg(log_loss(F.col("x.p"), F.col("asked"))), 4).alias("log_loss"),
        F.round(F.sqrt(F.avg(F.pow(F.col("x.e") - F.col("actual"), 2))), 4).alias("count_rmse"),
    )


def dirichlet(units: DataFrame, alpha: Column | float, years: int, by: Sequence[str] = ()) -> DataFrame:
    """Expected marks of units (unit_id, section_id, items, total): the section's mean by shares smoothed towards breadth."""
    sections = units.groupBy(*by, "section_id").agg(F.sum("total").alias("s"), F.sum("items").alias("all_items"))
    rows = units.join(sections, [*by, "section_id"])
    share = F.try_divide(F.col("total") + alpha * F.col("items") / F.col("all_items"), F.col("s") + alpha)
    return rows.withColumn("expected_marks", F.col("s") / years * share).drop("s", "all_items")
