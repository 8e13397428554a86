"""Queries of the forecast family."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from tagmill.functions.stats import gamma_interval
from tagmill.operators import forecast as f
from tagmill.operators import weightage as w
from tagmill.plans.binding import YEARS, ctes, items, records
from tagmill.sources.scratch import written

C = ctes()
ALPHAS = (1.0, 2.0, 5.0, 10.0, 20.0)


def _long(spark, d):
    r, i = records(spark, d), items(spark, d)
    counts = r.groupBy(F.col("primary").alias("item_id")).pivot("year", list(YEARS)).count()
    wide = i.select("item_id", "section_id", "part", "unit_id").join(counts, "item_id", "left")
    return wide.select("item_id", "section_id", "part", "unit_id", F.explode(F.array(*(F.struct(F.lit(y).alias("year"), F.coalesce(F.col(str(y)), F.lit(0)).alias("n")) for y in YEARS))).alias("y")).select("item_id", "section_id", "part", "unit_id", "y.year", "y.n")


def _totals(spark, d):
    return _long(spark, d).groupBy("item_id", "section_id", "part").agg(F.sum("n").alias("total"))


def section_rates(spark, d):
    return f.rates(_totals(spark, d), len(YEARS), ["part"]).withColumn("rate", F.round("rate", 8))


def nb_shape_grid(spark, d):
    grid = f.shape_grid(_totals(spark, d), len(YEARS), ["part"])
    return grid.select("part", "k", F.round("shape", 6).alias("shape"), F.round("log_likelihood", 3).alias("log_likelihood"))


def _posterior(spark, d):
    t = _totals(spark, d)
    return f.posterior(t, f.fit_grid(t, len(YEARS), ["part"]), len(YEARS), ["part"])


def forecast_posterior(spark, d):
    per = w.marks_per_question(records(spark, d), items(spark, d)).select("section_id", "marks_per_question")
    rows = _posterior(spark, d).join(per, "section_id", "left")
    return rows.select("item_id", "part", "section_id", F.round("expected_questions", 4).alias("expected_questions"), F.round("p_asked", 4).alias("p_asked"), F.round(F.col("expected_questions") * F.coalesce("marks_per_question", F.lit(1.5)), 4).alias("expected_marks"))


def forecast_top(spark, d):
    """The 25 items of the highest chance: a report, so the limit is part of the query."""
    return forecast_posterior(spark, d).orderBy(F.desc("p_asked"), F.desc("expected_marks"), "item_id").limit(25)


def forecast_interval(spark, d):
    """80 % intervals of the rates; quantiles are computed once per distinct posterior."""
    rows = _posterior(spark, d).select("item_id", "part", "post_shape", "post_rate")
    each = rows.select("post_shape", "post_rate").distinct()
    each = each.select("post_shape", "post_rate", F.round(gamma_interval(0.1)("post_shape", "post_rate"), 4).alias("rate_low"), F.round(gamma_interval(0.9)("post_shape", "post_rate"), 4).alias("rate_high"))
    return rows.join(each, ["post_shape", "post_rate"]).select("item_id", "part", "rate_low", "rate_high")


def forecast_backtest(spark, d):
    return f.backtest(_long(spark, d), YEARS)


def _unit_years(spark, d):
    u = w.unit_marks(records(spark, d), items(spark, d), YEARS)
    return u.select("unit_id", "section_id", "items", F.explode(F.array(*(F.struct(F.lit(y).alias("year"), F.col(f"marks_{y}").alias("m")) for y in YEARS))).alias("y")).select("unit_id", "section_id", "items", "y.year", "y.m")


def dirichlet_marks(spark, d):
    u = _unit_years(spark, d).groupBy("unit_id", "section_id", "items").agg(F.sum("m").alias("total"))
    return f.dirichlet(u, 10.0, len(YEARS)).select("unit_id", "section_id", "items", "total", F.round("expected_marks", 4).alias("expected_marks"))


def dirichlet_backtest(spark, d):
    """Root mean squared error of each estimator of a unit's marks in a year that was held out."""
    m = len(YEARS) - 1
    held = written(_unit_years(spark, d), "unit-years").withColumn("held", F.explode(F.array(*map(F.lit, YEARS))))
    per = held.groupBy("held", "unit_id", "section_id", "items").agg(F.sum(F.when(F.col("year") != F.col("held"), F.col("m")).otherwise(0)).alias("total"), F.sum(F.when(F.col("year") == F.col("held"), F.col("m")).otherwise(0)).alias("actual"))
    per = written(per, "held-units")
    grid = F.explode(F.array(*(F.struct(F.lit(n).alias("estimator"), F.lit(a).alias("alpha")) for n, a in [*((f"dirichlet {a:g}", a) for a in ALPHAS), ("breadth", 1e9)])))
    smooth = f.dirichlet(per.withColumn("g", grid).select("*", "g.estimator", "g.alpha"), F.col("alpha"), m, ["held", "estimator"]).select("estimator", "actual", F.col("expected_marks").alias("e"))
    mean = per.select(F.lit("unit mean").alias("estimator"), "actual", (F.col("total") / m).alias("e"))
    both = smooth.unionByName(mean).unionByName(_item_estimates(spark, d, per))
    return both.groupBy("estimator").agg(F.round(F.sqrt(F.avg(F.pow(F.col("e") - F.col("actual"), 2))), 4).alias("rmse"))


def _item_estimates(spark, d, per):
    """Item forecasts refitted without the held-out year, times the section's marks per question, summed per unit."""
    m = len(YEARS) - 1
    r, i = records(spark, d), items(spark, d)
    long = written(_long(spark, d), "item-years").withColumn("held", F.explode(F.array(*map(F.lit, YEARS))))
    totals = long.groupBy("held", "part", "section_id", "unit_id", "item_id").agg(F.sum(F.when(F.col("year") != F.col("held"), F.col("n")).otherwise(0)).alias("total"))
    totals = written(totals, "held-totals")
    post = f.posterior(totals, f.fit_grid(totals, m, ["held", "part"]), m, ["held", "part"])
    sections = r.select(F.col("primary").alias("item_id"), "year", "marks").join(i.select("item_id", "section_id"), "item_id").withColumn("held", F.explode(F.array(*map(F.lit, YEARS)))).filter("year <> held").groupBy("held", "section_id").agg((F.sum("marks") / F.count(F.lit(1))).alias("each"))
    units = post.join(sections, ["held", "section_id"], "left").groupBy("held", "unit_id").agg(F.sum(F.col("expected_questions") * F.coalesce("each", F.lit(1.5))).alias("e"))
    return per.join(units, ["held", "unit_id"]).select(F.lit("item forecast").alias("estimator"), "actual", "e")


_SHAPE = f"exp({math.log(1e-3)!r} + ({math.log(1e3)!r} - {math.log(1e-3)!r}) * k / 60)"
_LL = "lgamma(a + y) - lgamma(a) - lgamma(y + 1) + a * ln(a / (a + mu)) + y * ln(mu / (a + mu))"


def _fit(source: str, years: int, by: str, name: str) -> str:
    """Views: rates, grid and the best shape over a view with section_id, total and the columns of by."""
    on = " AND ".join(f"x.{c} = r.{c}" for c in [*(b.strip() for b in by.split(",")), "section_id"])
    pre = ", ".join(f"x.{b.strip()}" for b in by.split(","))
    return f""", {name}_rate AS (SELECT {by}, section_id, (sum(total) + 0.5) / ({years} * count(*)) AS rate FROM {source} GROUP BY {by}, section_id),
    {name}_stat AS (SELECT {pre}, r.rate * {years} AS mu, x.total AS y, count(*) AS n FROM {source} x JOIN {name}_rate r ON {on} GROUP BY ALL),
    {name}_grid AS (SELECT {by}, k, a AS shape, sum(n * ({_LL})) AS log_likelihood FROM {name}_stat, (SELECT k, {_SHAPE} AS a FROM (SELECT unnest(range(0, 61)) AS k)) GROUP BY {by}, k, a),
    {name}_fit AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY round(log_likelihood, 6) DESC, k) AS pos FROM {name}_grid) WHERE pos = 1)"""


_LONG = ", y AS (SELECT unnest([1998, 1999, 2000]) AS year), g AS (SELECT i.item_id, i.section_id, i.part, i.unit_id, y.year, count(r.id) AS n FROM i CROSS JOIN y LEFT JOIN r ON r.primary_item = i.item_id AND r.year = y.year GROUP BY ALL), tot AS (SELECT item_id, section_id, part, sum(n) AS total FROM g GROUP BY ALL)"
_POST = (
    _LONG
    + _fit("tot", 3, "part", "f")
    + """, mq AS (SELECT i.section_id, sum(marks) / count(*) AS each FROM r JOIN i ON i.item_id = r.primary_item GROUP BY 1),
    post AS (SELECT tot.*, f_fit.shape + total AS a, f_fit.shape / rate + 3 AS b, coalesce(each, 1.5) AS each FROM tot JOIN f_rate USING (part, section_id) JOIN f_fit USING (part) LEFT JOIN mq USING (section_id)),
    fc AS (SELECT item_id, part, section_id, round(a / b, 4) AS expected_questions, round(1 - (b / (b + 1)) ** a, 4) AS p_asked, round(a / b * each, 4) AS expected_marks FROM post)"""
)
_HELD = (
    _LONG
    + """, h AS (SELECT y.year AS held, part, section_id, unit_id, item_id, sum(CASE WHEN g.year <> y.year THEN n ELSE 0 END) AS total, sum(CASE WHEN g.year <> y.year AND n > 0 THEN 1 ELSE 0 END) AS years_asked, sum(CASE WHEN g.year = y.year THEN n ELSE 0 END) AS actual FROM g CROSS JOIN y GROUP BY ALL)"""
    + _fit("h", 2, "held, part", "f")
)
_UNITS = """, um AS (SELECT i.unit_id, i.section_id, y.year, count(DISTINCT i.item_id) AS items, coalesce(sum(r.marks), 0) AS m FROM i CROSS JOIN (SELECT unnest([1998, 1999, 2000]) AS year) y LEFT JOIN r ON r.primary_item = i.item_id AND r.year = y.year GROUP BY ALL)"""

QUERIES = {x.__name__: x for x in (section_rates, nb_shape_grid, forecast_posterior, forecast_top, forecast_interval, forecast_backtest, dirichlet_marks, dirichlet_backtest)}
ORACLES = {
    "section_rates": C + _LONG + _fit("tot", 3, "part", "f") + " SELECT part, section_id, round(rate, 8) AS rate FROM f_rate",
    "nb_shape_grid": C + _LONG + _fit("tot", 3, "part", "f") + " SELECT part, CAST(k AS INTEGER) AS k, round(shape, 6) AS shape, round(log_likelihood, 3) AS log_likelihood FROM f_grid",
    "forecast_posterior": C + _POST + " SELECT * FROM fc",
    "forecast_top": C + _POST + " SELECT * FROM fc ORDER BY p_asked DESC, expected_marks DESC, item_id LIMIT 25",
    "forecast_backtest": C
    + _HELD
    + """, p AS (SELECT h.*, rate, f_fit.shape + total AS a, f_fit.shape / rate + 2 AS b FROM h JOIN f_rate USING (held, part, section_id) JOIN f_fit USING (held, part)),
        m AS (SELECT part, 'pooled' AS method, 1 - exp(-rate) AS p, rate AS e, actual FROM p UNION ALL SELECT part, 'empirical', years_asked / 2, total / 2, actual FROM p UNION ALL SELECT part, 'bayes', 1 - (b / (b + 1)) ** a, a / b, actual FROM p),
        z AS (SELECT *, CASE WHEN actual > 0 THEN 1.0 ELSE 0.0 END AS asked, least(greatest(p, 1e-6), 1 - 1e-6) AS c FROM m)
        SELECT part, method, round(avg((p - asked) ** 2), 4) AS brier, round(avg(-(asked * ln(c) + (1 - asked) * ln(1 - c))), 4) AS log_loss, round(sqrt(avg((e - actual) ** 2)), 4) AS count_rmse FROM z GROUP BY ALL""",
    "dirichlet_marks": C + _UNITS + ", t2 AS (SELECT unit_id, section_id, max(items) AS items, sum(m) AS total FROM um GROUP BY ALL) SELECT unit_id, section_id, items, total, round(sum(total) OVER s / 3 * (total + 10 * items / sum(items) OVER s) / (sum(total) OVER s + 10), 4) AS expected_marks FROM t2 WINDOW s AS (PARTITION BY section_id)",
    "dirichlet_backtest": C
    + _HELD
    + _UNITS
    + """, uh AS (SELECT y.year AS held, unit_id, section_id, max(items) AS items, sum(CASE WHEN um.year <> y.year THEN m ELSE 0 END) AS total, sum(CASE WHEN um.year = y.year THEN m ELSE 0 END) AS actual FROM um CROSS JOIN y GROUP BY ALL),
        al AS (SELECT * FROM (VALUES ('dirichlet 1', 1.0), ('dirichlet 2', 2.0), ('dirichlet 5', 5.0), ('dirichlet 10', 10.0), ('dirichlet 20', 20.0), ('breadth', 1e9)) v(estimator, alpha)),
        sm AS (SELECT estimator, actual, sum(total) OVER s / 2 * (total + CAST(alpha AS DOUBLE) * items / sum(items) OVER s) / (sum(total) OVER s + CAST(alpha AS DOUBLE)) AS e FROM uh, al WINDOW s AS (PARTITION BY held, estimator, section_id)),
        mq AS (SELECT y.year AS held, i.section_id, sum(marks) / count(*) AS each FROM r JOIN i ON i.item_id = r.primary_item JOIN y ON y.year <> r.year GROUP BY ALL),
        ie AS (SELECT held, unit_id, sum((f_fit.shape + total) / (f_fit.shape / rate + 2) * coalesce(each, 1.5)) AS e FROM h JOIN f_rate USING (held, part, section_id) JOIN f_fit USING (held, part) LEFT JOIN mq USING (held, section_id) GROUP BY ALL),
        b AS (SELECT * FROM sm UNION ALL SELECT 'unit mean', actual, total / 2 FROM uh UNION ALL SELECT 'item forecast', actual, e FROM uh JOIN ie USING (held, unit_id))
        SELECT estimator, round(sqrt(avg((e - actual) ** 2)), 4) AS rmse FROM b GROUP BY estimator""",
}
