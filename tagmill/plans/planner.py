"""Queries of the planner family. Market segments are profiles, sections and brands their units."""

from __future__ import annotations

from pyspark.sql import functions as F

from tagmill.functions import planning as pl
from tagmill.functions import stats
from tagmill.operators import forecast as f
from tagmill.operators import planner as p
from tagmill.operators import weightage as w
from tagmill.plans.binding import YEARS, ctes, items, records, table
from tagmill.sources.scratch import written

C = ctes()


def _units(spark, d):
    """Units with hours, expected marks, prerequisites (the brand before, in one of three units) and questions."""
    r, i = records(spark, d), items(spark, d)
    marks = w.unit_marks(r, i, YEARS).select("unit_id", "section_id", "part", "items", sum(F.col(f"marks_{y}") for y in YEARS).alias("total"))
    rows = f.dirichlet(marks, 10.0, len(YEARS))
    size = table(spark, d, "part").groupBy(F.concat("p_type", F.lit(":"), "p_brand").alias("unit_id")).agg((F.sum("p_size") % 16 + 4).cast("double").alias("hours"))
    number = F.regexp_extract("unit_id", r"#(\d+)$", 1).cast("int")
    before = F.concat(F.regexp_extract("unit_id", r"^(.*#)\d+$", 1), (number - 1).cast("string"))
    prereqs = F.when((number % 3 == 0) & (number > 1), F.array(before)).otherwise(F.array().cast("array<string>"))
    return rows.join(size, "unit_id").withColumn("prereqs", prereqs)


def _profiles(spark, d):
    s = table(spark, d, "customer").groupBy(F.col("c_mktsegment").alias("profile")).agg(F.count(F.lit(1)).alias("n"))
    start = F.date_add(F.lit("2001-01-01").cast("date"), (F.length("profile") % 5).cast("int"))
    return s.select("profile", start.alias("start"), F.date_add(start, (60 + F.col("n") % 40).cast("int")).alias("exam"), (2 + F.length("profile") % 3).cast("double").alias("hours_per_day"), F.lit(6).alias("study_days"), F.lit(4).alias("final_weeks"))


def _unit_profiles(spark, d):
    """Every unit for every profile: segments are a handful."""
    return _units(spark, d).crossJoin(F.broadcast(_profiles(spark, d).select("profile")))


def _ratings(spark, d):
    """Ratings of units, sections, a part and a default, some of each."""
    who = _profiles(spark, d).select("profile")
    names = ["not_started", "weak", "basic", "okay", "good", "strong"]
    pick = lambda n: F.element_at(F.array(*map(F.lit, names)), (F.pmod(n, F.lit(6)) + 1).cast("int"))
    unit = items(spark, d).select(F.col("unit_id").alias("key")).distinct().filter(F.length("key") % 4 == 0)
    section = items(spark, d).select(F.col("section_id").alias("key")).distinct().filter(F.col("key") > "M")
    every = unit.select("key", (F.ascii(F.substring("key", -1, 1))).alias("n")).unionByName(section.select("key", F.length("key").alias("n"))).crossJoin(F.broadcast(who))
    rows = every.select("profile", "key", pick(F.col("n") + F.length("profile")).alias("level"))
    part = who.filter(F.length("profile") % 2 == 0).select("profile", F.lit("GA").alias("key"), F.lit("okay").alias("level"))
    default = who.filter(F.length("profile") > 8).select("profile", F.lit("default").alias("key"), F.lit("weak").alias("level"))
    return rows.unionByName(part).unionByName(default)


def rating_precedence(spark, d):
    return p.precedence(_unit_profiles(spark, d), _ratings(spark, d)).select("profile", "unit_id", "prior")


def _mastery(spark, d):
    units = written(p.precedence(_unit_profiles(spark, d), _ratings(spark, d)), "rated-units")
    done = units.filter(F.length("unit_id") % 3 == 0).select("profile", "unit_id", F.lit(2.5).alias("hours_done"))
    results = units.select("profile", F.col("section_id").alias("key"), F.length("section_id").alias("correct"), (F.length("section_id") + 3).alias("attempted")).distinct()
    results = results.unionByName(units.filter(F.length("unit_id") % 5 == 1).select("profile", F.col("unit_id").alias("key"), F.lit(1).alias("correct"), F.lit(4).alias("attempted")))
    return p.update_mastery(units, done, results)


def mastery_update(spark, d):
    return _mastery(spark, d).select("profile", "unit_id", F.round("mastery", 6).alias("mastery"))


def learning_curve(spark, d):
    u = _units(spark, d)
    tau = pl.constant(F.col("hours"))
    start = F.lit(0.35)
    return u.select("unit_id", F.round(pl.mastery_after(start, F.lit(4.0), tau), 6).alias("after_four"), F.round(pl.hours_cap(start, tau), 6).alias("cap"), F.round(pl.marginal_value(F.col("expected_marks"), start, tau), 6).alias("value"))


def _budgets(spark, d):
    cal = p.weeks(_profiles(spark, d)).filter("phase = 'learn'").groupBy("profile").agg((F.sum(F.col("capacity").cast("decimal(12,2)")).cast("double") / (1 + pl.REVISION_SHARE)).alias("budget"))
    return written(_mastery(spark, d).join(cal, "profile"), "budgets")


def water_filling(spark, d):
    return p.allocate(_budgets(spark, d)).select("profile", "unit_id", F.round("planned", 5).alias("planned"), F.round("lam", 7).alias("lam"))


def expected_secured(spark, d):
    """Marks secured before and after the planned hours."""
    rows = p.allocate(_budgets(spark, d))
    after = pl.mastery_after(F.col("mastery"), F.col("planned"), pl.constant(F.col("hours")))
    return rows.groupBy("profile").agg(F.round(F.sum(F.col("expected_marks") * F.col("mastery")), 4).alias("before"), F.round(F.sum(F.col("expected_marks") * after), 4).alias("after"))


def build_weeks(spark, d):
    return p.weeks(_profiles(spark, d))


def spaced_offsets(spark, d):
    """Revision of units that were finished in the first weeks."""
    done = _unit_profiles(spark, d).select("profile", "unit_id", (F.length("unit_id") % 6).alias("week"), F.col("hours").alias("planned"))
    return p.spaced_revision(done, p.weeks(_profiles(spark, d)))


def targeted_revision(spark, d):
    """Six units of each profile with most marks at risk: the size of a week's focus."""
    from pyspark.sql import Window

    rows = _mastery(spark, d).withColumn("risk", F.round(F.col("expected_marks") * (1 - F.col("mastery")), 6))
    n = F.row_number().over(Window.partitionBy("profile").orderBy(F.desc("risk"), "unit_id"))
    return rows.withColumn("place", n).filter(F.col("place") <= pl.TARGETED).select("profile", "place", "unit_id", "risk")


def practice_questions(spark, d):
    """The first six questions of each unit, latest year first, without those of a year kept for mocks."""
    r, i = records(spark, d), items(spark, d)
    facts = w.touches(r).join(i.select("item_id", "unit_id"), "item_id").filter("year <> 2000").select("unit_id", "year", "id").distinct()
    ids = F.transform(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("year")).alias("y"), "id"))), 1, pl.PRACTICE), lambda x: x["id"].cast("string"))
    return facts.groupBy("unit_id").agg(F.array_join(ids, ",").alias("practice"))


def unit_table(spark, d):
    return _units(spark, d).select("unit_id", "section_id", "part", "items", "hours", F.array_join("prereqs", ",").alias("prereqs"), F.round("expected_marks", 4).alias("expected_marks"))


def round_half_even(spark, d):
    """Quantities in quarters rounded to halves, ties to the even half, and down to halves."""
    q = table(spark, d, "lineitem").select((F.col("l_quantity") / 4).alias("x")).distinct()
    return q.select("x", stats.half_even(F.col("x"), 0.5).alias("near"), stats.down(F.col("x")).alias("low"))


def _planned(spark, d):
    """Units with planned hours, the worth of the first one (to nine decimals, so that ties are ties) and practice questions."""
    rows = p.allocate(_budgets(spark, d))
    value = F.round(pl.marginal_value(F.col("expected_marks"), F.col("mastery"), pl.constant(F.col("hours"))), 9)
    practice = practice_questions(spark, d).select("unit_id", F.split("practice", ",").alias("questions"))
    rows = rows.withColumn("value", value).withColumn("planned", F.round("planned", 6)).join(practice, "unit_id", "left")
    return written(rows.withColumn("questions", F.coalesce("questions", F.array().cast("array<string>"))), "planned-units")


def learning_order(spark, d):
    return p.learning_order(_planned(spark, d))


def weekly_plan(spark, d):
    return p.weekly_plan(_planned(spark, d), p.weeks(_profiles(spark, d)), mocks=["paper 2000"])


def plan_notes(spark, d):
    """Remarks on each profile's plan, in order."""
    units, calendar = _planned(spark, d), p.weeks(_profiles(spark, d))
    return p.plan_notes(written(p.weekly_plan(units, calendar, mocks=["paper 2000"]), "plan"), units, calendar)


def plan_totals(spark, d):
    """Hours of each kind per profile and week, beside the week's capacity."""
    calendar = p.weeks(_profiles(spark, d))
    used = weekly_plan(spark, d).filter("kind <> 'finish'").groupBy("profile", "week").agg(*(F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("plan_hours"))), F.lit(0.0)).alias(k) for k in ("learn", "revise", "mock", "target")))
    return calendar.join(used, ["profile", "week"], "left").select("profile", "week", "phase", "capacity", *(F.coalesce(k, F.lit(0.0)).alias(k) for k in ("learn", "revise", "mock", "target")))


def plan_document(spark, d):
    """A JSON document per profile: its weeks with what is planned in each, in order."""
    week = weekly_plan(spark, d).groupBy("profile", "week").agg(F.array_sort(F.collect_list(F.struct("kind", "unit_id", "plan_hours", "practice"))).alias("blocks"))
    return week.groupBy("profile").agg(F.to_json(F.array_sort(F.collect_list(F.struct("week", "blocks")))).alias("document"))


def chart_ticks(spark, d):
    """Axis ticks for the marks of each unit's chart."""
    from tagmill.functions.charts import ticks

    u = w.unit_marks(records(spark, d), items(spark, d), YEARS)
    top = F.greatest(*(F.col(f"marks_{y}") for y in YEARS)).cast("double")
    return u.select("unit_id", top.alias("top"), F.array_join(F.transform(ticks(top), lambda x: F.format_string("%.2f", x)), ",").alias("ticks"))


_U = """, um AS (SELECT i.unit_id, i.section_id, i.part, count(DISTINCT i.item_id) AS items, coalesce(sum(r.marks), 0) AS total FROM i LEFT JOIN r ON r.primary_item = i.item_id GROUP BY ALL),
uh AS (SELECT concat(p_type, ':', p_brand) AS unit_id, CAST(sum(p_size) % 16 + 4 AS DOUBLE) AS hours FROM part GROUP BY 1),
un AS (SELECT um.*, sum(total) OVER s / 3 * (total + 10 * items / sum(items) OVER s) / (sum(total) OVER s + 10) AS expected_marks, hours FROM um JOIN uh USING (unit_id) WINDOW s AS (PARTITION BY section_id)),
pr AS (SELECT profile, st AS start, st + CAST(60 + n % 40 AS INTEGER) AS exam, CAST(2 + length(profile) % 3 AS DOUBLE) AS hpd FROM (SELECT c_mktsegment AS profile, DATE '2001-01-01' + CAST(length(c_mktsegment) % 5 AS INTEGER) AS st, count(*) AS n FROM customer GROUP BY ALL)),
lv AS (SELECT * FROM (VALUES ('not_started', 0.05), ('weak', 0.2), ('basic', 0.35), ('okay', 0.5), ('good', 0.7), ('strong', 0.85)) v(level, m)),
rt AS (SELECT profile, key, ['not_started', 'weak', 'basic', 'okay', 'good', 'strong'][(n + length(profile)) % 6 + 1] AS level FROM pr, (SELECT DISTINCT unit_id AS key, ascii(right(unit_id, 1)) AS n FROM um WHERE length(unit_id) % 4 = 0 UNION ALL SELECT DISTINCT section_id, length(section_id) FROM um WHERE section_id > 'M')
       UNION ALL SELECT profile, 'GA', 'okay' FROM pr WHERE length(profile) % 2 = 0 UNION ALL SELECT profile, 'default', 'weak' FROM pr WHERE length(profile) > 8),
pri AS (SELECT pr.profile, un.*, CAST(lv.m AS DOUBLE) AS prior FROM pr CROSS JOIN un LEFT JOIN rt a ON a.profile = pr.profile AND a.key = un.unit_id LEFT JOIN rt b ON b.profile = pr.profile AND b.key = un.section_id
        LEFT JOIN rt c ON c.profile = pr.profile AND c.key = un.part LEFT JOIN rt e ON e.profile = pr.profile AND e.key = 'default' JOIN lv ON lv.level = coalesce(a.level, b.level, c.level, e.level, 'basic')),
ma AS (SELECT *, ((1 - (1 - prior) * exp(-CASE WHEN length(unit_id) % 3 = 0 THEN 2.5 ELSE 0 END / (hours / 2))) * 8 + share * length(section_id) + CASE WHEN length(unit_id) % 5 = 1 THEN 1 ELSE 0 END)
              / (8 + share * (length(section_id) + 3) + CASE WHEN length(unit_id) % 5 = 1 THEN 4 ELSE 0 END) AS mastery
       FROM (SELECT *, CASE WHEN sum(expected_marks) OVER s > 0 THEN expected_marks / sum(expected_marks) OVER s ELSE 1 / count(*) OVER s END AS share FROM pri WINDOW s AS (PARTITION BY profile, section_id))),
wk AS (SELECT profile, CAST(k AS INTEGER) AS week, start + 7 * CAST(k AS INTEGER) AS week_start, least(start + 7 * CAST(k AS INTEGER) + 6, exam - 1) AS week_end, hpd, count(*) OVER (PARTITION BY profile) AS n FROM (SELECT *, unnest(range(0, (exam - 1 - start) // 7 + 1)) AS k FROM pr)),
cal AS (SELECT profile, week, week_start, week_end, round(hpd * (week_end - week_start + 1) * 6 / 7, 2) AS capacity, CASE WHEN week >= n - least(4, greatest(1, n // 4)) THEN 'final' ELSE 'learn' END AS phase FROM wk),
bu AS (SELECT profile, CAST(sum(CAST(capacity AS DECIMAL(12, 2))) AS DOUBLE) / 1.15 AS budget FROM cal WHERE phase = 'learn' GROUP BY profile)"""
_WATER = (
    _U
    + """, x AS (SELECT ma.*, budget, hours / 2 AS t, CASE WHEN mastery >= 0.95 THEN 0 ELSE hours / 2 * ln((1 - mastery) / (1 - 0.95)) END AS cap, expected_marks * (1 - mastery) / (hours / 2) AS v FROM ma JOIN bu USING (profile)),
    sl AS (SELECT profile, sum(cap) <= any_value(budget) AS slack FROM x GROUP BY profile),
    it(step, profile, lo, hi) AS (SELECT 0, profile, ln(1e-12), max(ln(v)) FILTER (v > 0) FROM x GROUP BY profile UNION ALL
        SELECT step + 1, profile, CASE WHEN h > budget THEN (lo + hi) / 2 ELSE lo END, CASE WHEN h > budget THEN hi ELSE (lo + hi) / 2 END
        FROM (SELECT it.step, it.profile, it.lo, it.hi, any_value(x.budget) AS budget, sum(CASE WHEN v > 0 THEN least(greatest(t * (ln(v) - (it.lo + it.hi) / 2), 0), cap) ELSE 0 END) AS h FROM it JOIN x ON x.profile = it.profile WHERE it.step < 90 GROUP BY it.step, it.profile, it.lo, it.hi)),
    sol AS (SELECT profile, hi AS mu FROM it WHERE step = 90),
    pl AS (SELECT x.*, CASE WHEN slack THEN cap WHEN v > 0 THEN least(greatest(t * (ln(v) - mu), 0), cap) ELSE 0 END AS planned, CASE WHEN slack THEN 0 ELSE exp(mu) END AS lam FROM x JOIN sl USING (profile) JOIN sol USING (profile))"""
)
R = C.replace("WITH i AS", "WITH RECURSIVE i AS", 1)

QUERIES = {x.__name__: x for x in (rating_precedence, mastery_update, learning_curve, water_filling, expected_secured, build_weeks, spaced_offsets, targeted_revision, practice_questions, unit_table, round_half_even, learning_order, weekly_plan, plan_notes, plan_totals, plan_document, chart_ticks)}
ORACLES = {
    "rating_precedence": C + _U + " SELECT profile, unit_id, prior FROM pri",
    "mastery_update": C + _U + " SELECT profile, unit_id, round(mastery, 6) AS mastery FROM ma",
    "learning_curve": C + _U + " SELECT unit_id, round(1 - 0.65 * exp(-4 / (hours / 2)), 6) AS after_four, round(hours / 2 * ln(0.65 / (1 - 0.95)), 6) AS cap, round(expected_marks * 0.65 / (hours / 2), 6) AS value FROM un",
    "water_filling": R + _WATER + " SELECT profile, unit_id, round(planned, 5) AS planned, round(lam, 7) AS lam FROM pl",
    "expected_secured": R + _WATER + ' SELECT profile, round(sum(expected_marks * mastery), 4) AS "before", round(sum(expected_marks * (1 - (1 - mastery) * exp(-planned / (hours / 2)))), 4) AS "after" FROM pl GROUP BY profile',
    "build_weeks": C + _U + " SELECT * FROM cal",
    "spaced_offsets": C + _U + ", fin AS (SELECT profile, unit_id, length(unit_id) % 6 AS wk, greatest(0.5, round_even(0.15 * hours / 3 / 0.5, 0) * 0.5) AS each FROM pr CROSS JOIN un), du AS (SELECT profile, unit_id, each, wk + o AS week FROM fin, (SELECT unnest([1, 3, 7]) AS o)) SELECT du.profile, unit_id, cal.week, sum(each) AS hours FROM du LEFT JOIN cal ON cal.profile = du.profile AND cal.week = du.week AND phase = 'learn' GROUP BY ALL",
    "targeted_revision": C + _U + ", k AS (SELECT profile, unit_id, round(expected_marks * (1 - mastery), 6) AS risk FROM ma) SELECT * FROM (SELECT profile, row_number() OVER (PARTITION BY profile ORDER BY risk DESC, unit_id) AS place, unit_id, risk FROM k) WHERE place <= 6",
    "practice_questions": C + ", z AS (SELECT DISTINCT unit_id, r.year, r.id FROM u JOIN i USING (item_id) JOIN r ON r.id = u.id WHERE r.year <> 2000), n AS (SELECT *, row_number() OVER (PARTITION BY unit_id ORDER BY year DESC, id) AS k FROM z) SELECT unit_id, string_agg(CAST(id AS VARCHAR), ',' ORDER BY k) AS practice FROM n WHERE k <= 6 GROUP BY unit_id",
    "unit_table": C + _U + " SELECT unit_id, section_id, part, items, hours, CASE WHEN b % 3 = 0 AND b > 1 THEN concat(regexp_extract(unit_id, '^(.*#)[0-9]+$', 1), b - 1) ELSE '' END AS prereqs, round(expected_marks, 4) AS expected_marks FROM (SELECT *, CAST(regexp_extract(unit_id, '#([0-9]+)$', 1) AS INTEGER) AS b FROM un)",
    "chart_ticks": C + """, m AS (SELECT unit_id, max(t) AS top FROM (SELECT i.unit_id, y.year, CAST(coalesce(sum(r.marks), 0) AS DOUBLE) AS t FROM i CROSS JOIN (SELECT unnest([1998, 1999, 2000]) AS year) y LEFT JOIN r ON r.primary_item = i.item_id AND r.year = y.year GROUP BY ALL) GROUP BY unit_id),
        p AS (SELECT *, top / 5 AS rough, 10.0 ** floor(log10(top / 5)) AS pw FROM m WHERE top > 0),
        s AS (SELECT *, CASE WHEN pw >= rough * (1 - 1e-9) THEN pw WHEN 2 * pw >= rough * (1 - 1e-9) THEN 2 * pw WHEN 2.5 * pw >= rough * (1 - 1e-9) THEN 2.5 * pw WHEN 5 * pw >= rough * (1 - 1e-9) THEN 5 * pw ELSE 10 * pw END AS step FROM p)
        SELECT unit_id, top, array_to_string(list_transform(range(0, CAST(ceil(top / step - 1e-9) AS BIGINT) + 1), lambda i: printf('%.2f', CAST(i * step AS DOUBLE))), ',') AS ticks FROM s UNION ALL SELECT unit_id, top, '0.00' FROM m WHERE top <= 0""",
    "learning_order": R + _WATER + """, f AS (SELECT profile, unit_id, round(expected_marks * (1 - mastery) / (hours / 2), 9) AS value, CASE WHEN b % 3 = 0 AND b > 1 THEN concat(regexp_extract(unit_id, '^(.*#)[0-9]+$', 1), b - 1) ELSE '' END AS pre
            FROM (SELECT *, CAST(regexp_extract(unit_id, '#([0-9]+)$', 1) AS INTEGER) AS b FROM pl) WHERE round_even(round(planned, 6) / 0.5, 0) > 0),
        h AS (SELECT f.profile, f.unit_id, f.value, CASE WHEN g.unit_id IS NULL THEN '' ELSE f.pre END AS pre FROM f LEFT JOIN f g ON g.profile = f.profile AND g.unit_id = f.pre),
        lo(place, profile, unit_id, done) AS (SELECT 0, profile, '', ['']  FROM (SELECT DISTINCT profile FROM h) UNION ALL
            SELECT place, profile, pick, list_append(done, pick) FROM (
                SELECT lo.place + 1 AS place, lo.profile, lo.done, first(h.unit_id ORDER BY list_contains(lo.done, h.pre) DESC, h.value DESC, h.unit_id) AS pick
                FROM lo JOIN h ON h.profile = lo.profile AND NOT list_contains(lo.done, h.unit_id) GROUP BY lo.place, lo.profile, lo.done))
        SELECT profile, CAST(place AS INTEGER) AS place, unit_id FROM lo WHERE place > 0""",
    "round_half_even": "SELECT DISTINCT l_quantity / 4 AS x, round_even(l_quantity / 4 / 0.5, 0) * 0.5 AS near, floor(l_quantity / 4 / 0.5 + 1e-9) * 0.5 AS low FROM lineitem",
}
