"""Queries of the weightage family."""

from __future__ import annotations

from pyspark.sql import functions as F

from tagmill.functions.weights import attribution, tile_level
from tagmill.operators import weightage as w
from tagmill.plans.binding import YEARS, ctes, items, records

C = ctes()


def _pair(spark, d):
    return records(spark, d), items(spark, d)


def attribution_weights(spark, d):
    return records(spark, d).select("id", F.explode(attribution(F.col("primary"), F.col("secondary"), "shared")).alias("a")).select("id", "a.item_id", (F.col("a.weight") / 60).alias("weight"))


def tagged_facts(spark, d):
    r, _ = _pair(spark, d)
    return w.touches(r).select("id", "year", "part", "marks", "item_id", "is_primary")


def item_year_cube(spark, d):
    r, i = _pair(spark, d)
    cube = w.item_year_cube(r, i, YEARS, "shared")
    return cube.select("item_id", "year", F.round("marks", 3).alias("marks"), F.round("questions", 3).alias("questions"))


def section_weightage(spark, d):
    """Both schemes, DA first, largest total first."""
    r, i = _pair(spark, d)
    both = w.rollup(r, i, YEARS, "primary", "section").unionByName(w.rollup(r, i, YEARS, "shared", "section"))
    return both.orderBy("scheme", w.part_first(), F.desc("marks_total"), "id")


def cluster_weightage(spark, d):
    r, i = _pair(spark, d)
    return w.rollup(r, i, YEARS, "primary", "cluster").unionByName(w.rollup(r, i, YEARS, "shared", "cluster"))


def item_weightage(spark, d):
    r, i = _pair(spark, d)
    return w.item_table(r, i, YEARS)


def never_asked(spark, d):
    return item_weightage(spark, d).filter("status = 'never_asked'").select("part", "section_id", "cluster", "item_id", "label")


def never_asked_lists(spark, d):
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("item_id", "label"))), lambda x: F.concat_ws(" ", x["item_id"].cast("string"), x["label"]))
    return never_asked(spark, d).groupBy("part", "section_id").agg(F.count(F.lit(1)).alias("n"), F.array_join(ordered, "; ").alias("never"))


def type_mix(spark, d):
    return w.type_mix(*_pair(spark, d))


def yearly_coverage(spark, d):
    return w.yearly_coverage(*_pair(spark, d), YEARS)


def marks_per_question(spark, d):
    return w.marks_per_question(*_pair(spark, d))


def primary_counts(spark, d):
    return w.primary_counts(*_pair(spark, d), YEARS, "DA")


def unit_marks(spark, d):
    return w.unit_marks(*_pair(spark, d), YEARS)


def unit_questions(spark, d):
    return w.unit_questions(*_pair(spark, d))


def tag_sensitivity(spark, d):
    return w.sensitivity(*_pair(spark, d))


def key_findings(spark, d):
    """Per section: share of NAT-like questions, never-asked items, whether it had marks in every year, mean marks."""
    r, i = _pair(spark, d)
    mix = w.type_mix(r, i).groupBy("section_id").agg(F.sum("questions").alias("questions"), F.sum(F.when(F.col("type") == "O", F.col("questions")).otherwise(0)).alias("open_questions"))
    never = w.item_table(r, i, YEARS).groupBy("section_id").agg(F.sum(F.when(F.col("status") == "never_asked", 1).otherwise(0)).alias("never"), F.count(F.lit(1)).alias("items"), F.sum(F.when((F.col("primary_marks_1998") > 0) & (F.col("primary_marks_1999") > 0) & (F.col("primary_marks_2000") > 0), 1).otherwise(0)).alias("evergreen_items"))
    top = w.rollup(r, i, YEARS, "primary", "section").select("section_id", "marks_mean", "trend")
    return mix.join(never, "section_id").join(top, "section_id").select("section_id", "questions", F.round(F.col("open_questions") / F.col("questions"), 4).alias("open_share"), "never", "items", "evergreen_items", "marks_mean", "trend")


def report_tables(spark, d):
    """Section table with the shared scheme's mean beside it, and questions by type."""
    r, i = _pair(spark, d)
    one = w.rollup(r, i, YEARS, "primary", "section").select("part", "id", "marks_total", "marks_mean", "trend")
    two = w.rollup(r, i, YEARS, "shared", "section").select("id", F.col("marks_mean").alias("shared_mean"))
    mix = w.type_mix(r, i).groupBy(F.col("section_id").alias("id")).pivot("type", ["F", "O", "P"]).sum("questions").na.fill(0)
    mix = mix.withColumn("open_share", F.round(F.try_divide(F.col("O"), F.col("F") + F.col("O") + F.col("P")), 4)).withColumnsRenamed({"F": "n_f", "O": "n_o", "P": "n_p"})
    return one.join(two, "id").join(mix, "id", "left")


def tile_levels(spark, d):
    t = item_weightage(spark, d)
    return t.select("item_id", "section_id", tile_level(F.col("primary_marks_total"), F.col("years_touched") > 0).alias("tile"))


def chart_coverage(spark, d):
    """Sections by share of items that were never asked, largest first."""
    t = item_weightage(spark, d).groupBy("section_id").agg(F.sum(F.when(F.col("status") == "never_asked", 1).otherwise(0)).alias("never"), F.sum(F.when(F.col("status") == "asked", 1).otherwise(0)).alias("asked"), F.count(F.lit(1)).alias("items"))
    return t.withColumn("never_share", F.round(F.col("never") / F.col("items"), 4)).orderBy(F.desc("never_share"), F.desc("never"), "section_id")


def cooccurrence(spark, d):
    return w.cooccurrence_labelled(*_pair(spark, d))


def cooccurrence_top(spark, d):
    """The 40 most frequent pairs: a report, so the limit is part of the query."""
    return cooccurrence(spark, d).orderBy(F.desc("questions"), "item_a", "item_b").limit(40)


def cooccurrence_sections(spark, d):
    return w.cooccurrence(*_pair(spark, d), by="section_id").withColumnsRenamed({"a": "section_a", "b": "section_b"})


def map_default(spark, d):
    """Item that a map opens with in each section: the one of most marks, smallest id on ties; sections by mean marks."""
    r, i = _pair(spark, d)
    best = w.item_table(r, i, YEARS).groupBy("section_id").agg(F.min_by("item_id", F.struct(-F.col("primary_marks_total"), F.col("item_id"))).alias("item_id"), F.max("primary_marks_total").alias("marks"))
    means = w.rollup(r, i, YEARS, "primary", "section").select("section_id", "marks_mean")
    return best.join(means, "section_id").orderBy(F.desc("marks_mean"), "section_id")


def _rollup_sql(scheme: str, level: str) -> str:
    key, title = ("section_id", "section_id") if level == "section" else ("unit_id", "cluster")
    weight = "weight" if scheme == "shared" else "60 * is_primary"
    years = "".join(f", round(coalesce(sum({weight} * marks) FILTER (w.year = {y}), 0) / 60.0, 3) AS marks_{y}, round(coalesce(sum({weight}) FILTER (w.year = {y}), 0) / 60.0, 3) AS questions_{y}" for y in YEARS)
    total = " + ".join(f"marks_{y}" for y in YEARS)
    a, b, c = (f"marks_{y}" for y in YEARS)
    return f"""SELECT '{scheme}' AS scheme, *, round(marks_total / 3, 3) AS marks_mean, least({a}, {b}, {c}) AS marks_min, greatest({a}, {b}, {c}) AS marks_max,
        round(marks_total / nullif(sum(marks_total) OVER (PARTITION BY part), 0), 4) AS share_of_part, round(({c} - {a}) / 2, 4) AS trend_marks_per_year,
        CASE WHEN ({c} - {a}) / 2 >= 2 AND {b} >= {a} AND {c} >= {b} THEN 'rising' WHEN ({c} - {a}) / 2 <= -2 AND {b} <= {a} AND {c} <= {b} THEN 'falling'
             WHEN greatest({a}, {b}, {c}) - least({a}, {b}, {c}) >= 4 THEN 'mixed' ELSE 'stable' END AS trend
    FROM (SELECT *, round({total}, 3) AS marks_total FROM (
        SELECT i.part, i.{key} AS id, i.section_id, i.{title} AS title, count(DISTINCT i.item_id) AS items{years}
        FROM i LEFT JOIN w ON w.item_id = i.item_id GROUP BY i.part, i.{key}, i.section_id, i.{title}))"""


_ITEMS = (
    "x AS (SELECT i.*, "
    + ", ".join(f"coalesce(sum(u.marks * is_primary) FILTER (u.year = {y}), 0) AS primary_marks_{y}" for y in YEARS)
    + """, coalesce(sum(is_primary), 0) AS primary_questions, coalesce(sum(is_primary * u.marks), 0) AS primary_marks_total, coalesce(sum(1 - is_primary), 0) AS secondary_uses,
    count(DISTINCT u.year) AS years_touched, min(u.year) AS first_year, max(u.year) AS last_year, round(coalesce(sum(weight * u.marks), 0) / 60.0, 3) AS shared_marks_total,
    CASE WHEN coalesce(sum(is_primary), 0) > 0 THEN 'asked' WHEN count(u.year) > 0 THEN 'only_secondary' ELSE 'never_asked' END AS status
    FROM i LEFT JOIN w u ON u.item_id = i.item_id GROUP BY ALL)"""
)
_MIX = "m AS (SELECT r.part, i.section_id, r.type, r.marks AS marks_each, count(*) AS questions, count(*) * r.marks AS marks FROM r JOIN i ON i.item_id = r.primary_item GROUP BY r.part, i.section_id, r.type, r.marks)"
_PAIRS = "p AS (SELECT a.item_id AS item_a, b.item_id AS item_b, count(*) AS questions FROM u a JOIN u b ON a.id = b.id AND a.item_id < b.item_id GROUP BY ALL)"
_PAIRS_LABELLED = "SELECT item_a, a.label AS label_a, item_b, b.label AS label_b, questions, a.section_id <> b.section_id AS cross_section FROM p JOIN i a ON a.item_id = item_a JOIN i b ON b.item_id = item_b"

QUERIES = {f.__name__: f for f in (attribution_weights, tagged_facts, item_year_cube, section_weightage, cluster_weightage, item_weightage, never_asked, never_asked_lists, type_mix, yearly_coverage, marks_per_question, primary_counts, unit_marks, unit_questions, tag_sensitivity, key_findings, report_tables, tile_levels, chart_coverage, cooccurrence, cooccurrence_top, cooccurrence_sections, map_default)}

ORACLES = {
    "attribution_weights": C + "SELECT id, item_id, CASE WHEN rp = 1 THEN 1.0 ELSE 0.5 END / (1 + 0.5 * (n_tags - 1)) AS weight FROM u",
    "tagged_facts": C + "SELECT id, year, part, marks, item_id, is_primary FROM u",
    "item_year_cube": C + "SELECT i.item_id, CAST(y.year AS INTEGER) AS year, round(coalesce(sum(weight * marks), 0) / 60.0, 3) AS marks, round(coalesce(sum(weight), 0) / 60.0, 3) AS questions FROM i CROSS JOIN (SELECT unnest([1998, 1999, 2000]) AS year) y LEFT JOIN w ON w.item_id = i.item_id AND w.year = y.year GROUP BY ALL",
    "section_weightage": C + _rollup_sql("primary", "section") + " UNION ALL BY NAME " + _rollup_sql("shared", "section"),
    "cluster_weightage": C + _rollup_sql("primary", "cluster") + " UNION ALL BY NAME " + _rollup_sql("shared", "cluster"),
    "item_weightage": C + "," + _ITEMS + " SELECT * FROM x",
    "never_asked": C + "," + _ITEMS + " SELECT part, section_id, cluster, item_id, label FROM x WHERE status = 'never_asked'",
    "never_asked_lists": C + "," + _ITEMS + " SELECT part, section_id, count(*) AS n, string_agg(concat(item_id, ' ', label), '; ' ORDER BY item_id) AS never FROM x WHERE status = 'never_asked' GROUP BY ALL",
    "type_mix": C + "," + _MIX + " SELECT * FROM m",
    "yearly_coverage": C + "SELECT part, year, items_touched, items_total, round(items_touched / items_total, 4) AS share FROM (SELECT n.part, CAST(y.year AS INTEGER) AS year, n.items_total, count(DISTINCT u.item_id) AS items_touched FROM (SELECT part, count(*) AS items_total FROM i GROUP BY part) n CROSS JOIN (SELECT unnest([1998, 1999, 2000]) AS year) y LEFT JOIN u ON u.part = n.part AND u.year = y.year GROUP BY ALL)",
    "marks_per_question": C + "SELECT i.section_id, sum(marks) AS marks, count(*) AS questions, sum(marks) / count(*) AS marks_per_question FROM r JOIN i ON i.item_id = r.primary_item GROUP BY ALL",
    "primary_counts": C + "SELECT i.item_id, i.section_id, " + ", ".join(f"count(r.id) FILTER (r.year = {y}) AS n_{y}" for y in YEARS) + " FROM i LEFT JOIN r ON r.primary_item = i.item_id WHERE i.part = 'DA' GROUP BY ALL",
    "unit_marks": C + "SELECT i.unit_id, i.section_id, i.part, count(DISTINCT i.item_id) AS items, " + ", ".join(f"coalesce(sum(r.marks) FILTER (r.year = {y}), 0) AS marks_{y}" for y in YEARS) + " FROM i LEFT JOIN r ON r.primary_item = i.item_id GROUP BY ALL",
    "unit_questions": C + "SELECT unit_id, count(*) AS n, string_agg(CAST(id AS VARCHAR), ',' ORDER BY year DESC, id) AS ids FROM (SELECT DISTINCT unit_id, year, id FROM u JOIN i USING (item_id)) GROUP BY unit_id",
    "tag_sensitivity": C
    + """, a AS (SELECT year, i.section_id, sum(marks) AS r FROM r JOIN i ON i.item_id = primary_item GROUP BY ALL), b AS (SELECT year, i.section_id, sum(marks) AS s FROM r JOIN i ON i.item_id = guess_primary GROUP BY ALL),
        c AS (SELECT year, section_id, coalesce(s, 0) - coalesce(r, 0) AS change FROM a FULL JOIN b USING (year, section_id))
        SELECT max(abs(change)) AS max_abs_change_marks, (SELECT concat(year, ' ', section_id) FROM c ORDER BY abs(change) DESC, year, section_id LIMIT 1) AS where_changed, round(avg(abs(change)), 2) AS mean_abs_change_marks FROM c""",
    "key_findings": C
    + ","
    + _ITEMS
    + ","
    + _MIX
    + ", s AS ("
    + _rollup_sql("primary", "section")
    + """), a AS (SELECT section_id, sum(questions) AS questions, coalesce(sum(questions) FILTER (type = 'O'), 0) AS o FROM m GROUP BY ALL),
        n AS (SELECT section_id, count(*) FILTER (status = 'never_asked') AS never, count(*) AS items, count(*) FILTER (primary_marks_1998 > 0 AND primary_marks_1999 > 0 AND primary_marks_2000 > 0) AS evergreen_items FROM x GROUP BY ALL)
        SELECT section_id, questions, round(o / questions, 4) AS open_share, never, n.items, evergreen_items, s.marks_mean, s.trend FROM a JOIN n USING (section_id) JOIN s USING (section_id)""",
    "report_tables": C
    + ","
    + _MIX
    + ", s AS ("
    + _rollup_sql("primary", "section")
    + "), h AS ("
    + _rollup_sql("shared", "section")
    + """), k AS (SELECT section_id AS id, coalesce(sum(questions) FILTER (type = 'F'), 0) AS n_f, coalesce(sum(questions) FILTER (type = 'O'), 0) AS n_o, coalesce(sum(questions) FILTER (type = 'P'), 0) AS n_p FROM m GROUP BY ALL)
        SELECT s.part, s.id, s.marks_total, s.marks_mean, s.trend, h.marks_mean AS shared_mean, n_f, n_o, n_p, round(n_o / (n_f + n_o + n_p), 4) AS open_share FROM s JOIN h USING (id) LEFT JOIN k USING (id)""",
    "tile_levels": C + "," + _ITEMS + " SELECT item_id, section_id, CASE WHEN primary_marks_total >= 9 THEN 'l4' WHEN primary_marks_total >= 5 THEN 'l3' WHEN primary_marks_total >= 3 THEN 'l2' WHEN primary_marks_total >= 1 THEN 'l1' WHEN years_touched > 0 THEN 'secondary' ELSE 'never' END AS tile FROM x",
    "chart_coverage": C + "," + _ITEMS + " SELECT section_id, count(*) FILTER (status = 'never_asked') AS never, count(*) FILTER (status = 'asked') AS asked, count(*) AS items, round(count(*) FILTER (status = 'never_asked') / count(*), 4) AS never_share FROM x GROUP BY section_id",
    "cooccurrence": C + "," + _PAIRS + " " + _PAIRS_LABELLED,
    "cooccurrence_top": C + "," + _PAIRS + " SELECT * FROM (" + _PAIRS_LABELLED + ") ORDER BY questions DESC, item_a, item_b LIMIT 40",
    "cooccurrence_sections": C + ", z AS (SELECT DISTINCT id, section_id FROM u JOIN i USING (item_id)) SELECT a.section_id AS section_a, b.section_id AS section_b, count(*) AS questions FROM z a JOIN z b ON a.id = b.id AND a.section_id < b.section_id GROUP BY ALL",
    "map_default": C + "," + _ITEMS + ", s AS (" + _rollup_sql("primary", "section") + ") SELECT section_id, item_id, primary_marks_total AS marks, marks_mean FROM (SELECT *, row_number() OVER (PARTITION BY section_id ORDER BY primary_marks_total DESC, item_id) AS n FROM x) JOIN (SELECT section_id, marks_mean FROM s) USING (section_id) WHERE n = 1",
}
