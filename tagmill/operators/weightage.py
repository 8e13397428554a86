"""Weightage of taxonomy items: attribution, cubes, roll-ups, coverage, co-occurrence.

Frames: *items* (item_id, label, section_id, cluster, unit_id, part) and *records* (id, year, type, marks, part, primary,
secondary array). Both are scanned once per result; the fact side is aggregated before it meets the items.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tagmill.functions.weights import UNIT, attribution, coverage_status, slope, trend


def tag_weights(records: DataFrame, scheme: str) -> DataFrame:
    """id, year, marks, item_id, weight (UNIT parts): one row per record and item."""
    return records.select("id", "year", "marks", F.explode(attribution(F.col("primary"), F.col("secondary"), scheme)).alias("a")).select("id", "year", "marks", "a.item_id", "a.weight")


def item_year_cube(records: DataFrame, items: DataFrame, years: Sequence[int], scheme: str) -> DataFrame:
    """Every item and year with its attributed marks and questions, zero where there are none."""
    used = tag_weights(records, scheme).groupBy("item_id").pivot("year", list(years)).agg(F.sum(F.col("weight") * F.col("marks")).alias("m"), F.sum("weight").alias("q"))
    wide = items.join(used, "item_id", "left")
    stacked = F.explode(F.array(*(F.struct(F.lit(y).alias("year"), F.coalesce(F.col(f"{y}_m"), F.lit(0)).alias("m"), F.coalesce(F.col(f"{y}_q"), F.lit(0)).alias("q")) for y in years))).alias("y")
    return wide.select(*items.columns, stacked).select(*items.columns, "y.year", (F.col("y.m") / UNIT).alias("marks"), (F.col("y.q") / UNIT).alias("questions"))


def rollup(records: DataFrame, items: DataFrame, years: Sequence[int], scheme: str, level: str) -> DataFrame:
    """Sections or clusters with marks and questions by year, totals, share of the part, slope and trend."""
    key, title = ("section_id", "section_id") if level == "section" else ("unit_id", "cluster")
    facts = tag_weights(records, scheme).join(items.select("item_id", "part", "section_id", F.col(key).alias("group_id"), F.col(title).alias("title")), "item_id")
    sums = facts.groupBy("part", "section_id", "group_id", "title").pivot("year", list(years)).agg(F.sum(F.col("weight") * F.col("marks")).alias("m"), F.sum("weight").alias("q"))
    groups = items.groupBy("part", "section_id", F.col(key).alias("group_id"), F.col(title).alias("title")).agg(F.count(F.lit(1)).alias("items"))
    rows = groups.join(sums, ["part", "section_id", "group_id", "title"], "left")
    marks = [F.round(F.coalesce(F.col(f"{y}_m"), F.lit(0)) / UNIT, 3).alias(f"marks_{y}") for y in years]
    questions = [F.round(F.coalesce(F.col(f"{y}_q"), F.lit(0)) / UNIT, 3).alias(f"questions_{y}") for y in years]
    rows = rows.select(F.lit(scheme).alias("scheme"), "part", F.col("group_id").alias("id"), "section_id", "title", "items", *marks, *questions)
    by_year = [F.col(f"marks_{y}") for y in years]
    total = sum(by_year[1:], by_year[0])
    in_part = F.sum("marks_total").over(Window.partitionBy("part"))  # one row a group: few rows
    rows = rows.withColumn("marks_total", F.round(total, 3))
    return rows.select(
        "*",
        F.round(F.col("marks_total") / len(years), 3).alias("marks_mean"),
        F.least(*by_year).alias("marks_min"),
        F.greatest(*by_year).alias("marks_max"),
        F.round(F.try_divide(F.col("marks_total"), in_part), 4).alias("share_of_part"),
        F.round(slope(by_year), 4).alias("trend_marks_per_year"),
        trend(by_year).alias("trend"),
    )


def touches(records: DataFrame) -> DataFrame:
    """id, year, part, item_id, is_primary: every use of an item."""
    uses = F.explode(F.concat(F.array(F.struct(F.col("primary").alias("item_id"), F.lit(1).alias("p"))), F.transform("secondary", lambda x: F.struct(x.alias("item_id"), F.lit(0).alias("p"))))).alias("u")
    return records.select("id", "year", "part", "marks", uses).select("id", "year", "part", "marks", "u.item_id", F.col("u.p").alias("is_primary"))


def item_table(records: DataFrame, items: DataFrame, years: Sequence[int]) -> DataFrame:
    """One row per item: primary marks by year, totals, secondary uses, years touched, coverage status."""
    uses = touches(records).groupBy("item_id").agg(
        *(F.sum(F.when((F.col("year") == y) & (F.col("is_primary") == 1), F.col("marks")).otherwise(0)).alias(f"primary_marks_{y}") for y in years),
        F.sum("is_primary").alias("primary_questions"),
        F.sum(F.col("is_primary") * F.col("marks")).alias("primary_marks_total"),
        F.sum(1 - F.col("is_primary")).alias("secondary_uses"),
        F.countDistinct("year").alias("years_touched"),
        F.min("year").alias("first_year"),
        F.max("year").alias("last_year"),
    )
    shared = tag_weights(records, "shared").groupBy("item_id").agg(F.sum(F.col("weight") * F.col("marks")).alias("s"))
    zero = [c for c in uses.columns if c not in ("item_id", "first_year", "last_year")]
    rows = items.join(uses, "item_id", "left").join(shared, "item_id", "left").fillna(0, zero)
    return rows.select(
        *items.columns, *zero, "first_year", "last_year", F.round(F.coalesce(F.col("s"), F.lit(0)) / UNIT, 3).alias("shared_marks_total"), coverage_status(F.col("primary_questions"), F.col("years_touched")).alias("status")
    )


def type_mix(records: DataFrame, items: DataFrame) -> DataFrame:
    """Questions and marks by part, section of the primary item, type and marks each."""
    facts = records.select(F.col("primary").alias("item_id"), "part", "type", F.col("marks").alias("marks_each")).join(items.select("item_id", "section_id"), "item_id")
    return facts.groupBy("part", "section_id", "type", "marks_each").agg(F.count(F.lit(1)).alias("questions")).withColumn("marks", F.col("questions") * F.col("marks_each"))


def yearly_coverage(records: DataFrame, items: DataFrame, years: Sequence[int]) -> DataFrame:
    """Distinct items touched by part and year, and their share of the part."""
    touched = touches(records).groupBy("part", "year").agg(F.countDistinct("item_id").alias("n"))
    dense = items.groupBy("part").agg(F.count(F.lit(1)).alias("items_total")).select("part", "items_total", F.explode(F.array(*map(F.lit, years))).alias("year"))
    return dense.join(touched, ["part", "year"], "left").select("part", "year", F.coalesce("n", F.lit(0)).alias("items_touched"), "items_total", F.round(F.coalesce("n", F.lit(0)) / F.col("items_total"), 4).alias("share"))


def cooccurrence(records: DataFrame, items: DataFrame, by: str = "item_id") -> DataFrame:
    """Pairs of items of one record, smaller id first, with how many records hold both.

    Pairs are made inside a record, of its few tags; only counted pairs are shuffled.
    """
    ids = F.array_sort(F.array_distinct(F.concat(F.array("primary"), "secondary")))
    if by != "item_id":
        long = touches(records).join(items.select("item_id", by), "item_id").groupBy("id").agg(F.array_sort(F.collect_set(by)).alias("ids"))
    else:
        long = records.select(ids.alias("ids"))
    pair = F.flatten(F.transform("ids", lambda a, i: F.transform(F.slice("ids", i + 2, F.greatest(F.size("ids") - i - 1, F.lit(0))), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    return long.select(F.explode(pair).alias("p")).groupBy("p.a", "p.b").agg(F.count(F.lit(1)).alias("questions"))


def cooccurrence_labelled(records: DataFrame, items: DataFrame) -> DataFrame:
    pairs = cooccurrence(records, items)
    a = items.select(F.col("item_id").alias("item_a"), F.col("label").alias("label_a"), F.col("section_id").alias("sa"))
    b = items.select(F.col("item_id").alias("item_b"), F.col("label").alias("label_b"), F.col("section_id").alias("sb"))
    rows = pairs.withColumnsRenamed({"a": "item_a", "b": "item_b"}).join(a, "item_a").join(b, "item_b")
    return rows.select("item_a", "label_a", "item_b", "label_b", "questions", (F.col("sa") != F.col("sb")).alias("cross_section"))


def sensitivity(records: DataFrame, items: DataFrame, guess: str = "guess_primary") -> DataFrame:
    """Change of section marks by year if the other tagger's primaries counted."""
    section = items.select("item_id", "section_id")
    side = lambda column, name: records.select("year", "marks", F.col(column).alias("item_id")).join(section, "item_id").groupBy("year", "section_id").agg(F.sum("marks").alias(name))
    both = side("primary", "r").join(side(guess, "s"), ["year", "section_id"], "full")
    change = both.select("year", "section_id", (F.coalesce("s", F.lit(0)) - F.coalesce("r", F.lit(0))).alias("change"))
    # of equal changes the first by year and section counts
    where = F.min_by(F.concat_ws(" ", F.col("year").cast("string"), "section_id"), F.struct(-F.abs("change"), F.col("year"), F.col("section_id")))
    return change.agg(F.max(F.abs("change")).alias("max_abs_change_marks"), where.alias("where_changed"), F.round(F.avg(F.abs("change")), 2).alias("mean_abs_change_marks"))


def marks_per_question(records: DataFrame, items: DataFrame) -> DataFrame:
    facts = records.select(F.col("primary").alias("item_id"), "marks").join(items.select("item_id", "section_id"), "item_id")
    return facts.groupBy("section_id").agg(F.sum("marks").alias("marks"), F.count(F.lit(1)).alias("questions")).withColumn("marks_per_question", F.col("marks") / F.col("questions"))


def primary_counts(records: DataFrame, items: DataFrame, years: Sequence[int], part: str) -> DataFrame:
    """Dense counts of primary uses: a row per item of the part, a column per year."""
    counts = records.filter(F.col("year").isin(list(years))).groupBy(F.col("primary").alias("item_id")).pivot("year", list(years)).count()
    return items.filter(F.col("part") == part).select("item_id", "section_id").join(counts, "item_id", "left").select("item_id", "section_id", *(F.coalesce(F.col(str(y)), F.lit(0)).alias(f"n_{y}") for y in years))


def unit_marks(records: DataFrame, items: DataFrame, years: Sequence[int]) -> DataFrame:
    """Marks by unit and year of the primary item; units without any are there too."""
    facts = records.select(F.col("primary").alias("item_id"), "year", "marks").join(items.select("item_id", "unit_id"), "item_id")
    sums = facts.groupBy("unit_id").pivot("year", list(years)).agg(F.sum("marks"))
    units = items.groupBy("unit_id", "section_id", "part").agg(F.count(F.lit(1)).alias("items"))
    return units.join(sums, "unit_id", "left").select("unit_id", "section_id", "part", "items", *(F.coalesce(F.col(str(y)), F.lit(0)).alias(f"marks_{y}") for y in years))


def unit_questions(records: DataFrame, items: DataFrame) -> DataFrame:
    """Per unit its records, once each, latest year first."""
    facts = touches(records).join(items.select("item_id", "unit_id"), "item_id").select("unit_id", "year", "id").distinct()
    ordered = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("year")).alias("y"), "id"))), lambda x: x["id"])
    return facts.groupBy("unit_id").agg(F.count(F.lit(1)).alias("n"), F.array_join(ordered, ",").alias("ids"))




def part_first(part: str = "part", first: str = "DA") -> Column:
    """Sort key that puts one part before the others."""
    return F.col(part) != first
