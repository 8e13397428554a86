"""Queries of the export family, and the streamed totals."""

from __future__ import annotations

from pyspark.sql import functions as F

from tagmill.operators import weightage as w
from tagmill.plans.binding import YEARS, ctes, items, records, table
from tagmill.streaming.totals import running_totals

C = ctes()


def atlas_questions(spark, d):
    """Compact rows: a question with its tags, the other tagger's pick and whether both agree."""
    r = records(spark, d)
    return r.select("id", "year", "type", "marks", "part", F.col("primary").alias("primary_item"), F.concat_ws(";", F.transform("secondary", lambda x: x.cast("string"))).alias("secondary"), "guess_primary", (F.col("guess_primary") == F.col("primary")).alias("agree"))


def atlas_document(spark, d):
    """A JSON document per section: its roll-up, items with status, and question types."""
    r, i = records(spark, d), items(spark, d)
    roll = w.rollup(r, i, YEARS, "primary", "section").select(F.col("id").alias("section_id"), F.struct("marks_total", "marks_mean", "trend", "share_of_part").alias("weightage"))
    status = w.item_table(r, i, YEARS).groupBy("section_id").agg(F.array_sort(F.collect_list(F.struct("item_id", "label", "status", "primary_marks_total"))).alias("items"))
    mix = w.type_mix(r, i).groupBy("section_id").agg(F.array_sort(F.collect_list(F.struct("type", "marks_each", "questions"))).alias("types"))
    return roll.join(status, "section_id").join(mix, "section_id", "left").select("section_id", F.to_json(F.struct("section_id", "weightage", "items", "types")).alias("document"))


def streamed_totals(spark, d):
    """Events as a stream: calls and hundredths of value per user and type."""
    path = f"{d}/events.parquet"
    schema = table(spark, d, "events").schema
    source = spark.readStream.schema(schema).parquet(f"{path[:-1]}[{path[-1]}]")
    return running_totals(spark, source, ["user_id", "event_type"], {"cents": F.round(F.col("value") * 100).cast("bigint")})


QUERIES = {f.__name__: f for f in (atlas_questions, atlas_document, streamed_totals)}
ORACLES = {
    "atlas_questions": C + "SELECT r.id, r.year, r.type, r.marks, r.part, r.primary_item, coalesce((SELECT string_agg(CAST(item_id AS VARCHAR), ';' ORDER BY rp) FROM t WHERE t.id = r.id AND rp BETWEEN 2 AND 4), '') AS secondary, r.guess_primary, r.guess_primary = r.primary_item AS agree FROM r",
    "streamed_totals": "SELECT user_id, event_type, count(*) AS n, sum(CAST(round(value * 100) AS BIGINT)) AS cents FROM events GROUP BY ALL",
}
