"""The driver's tables seen as tagged records: Spark frames, and the same as SQL for the oracles.

item = part, section = its type, cluster = its brand; suppliers are further items, which no record is tagged with. record =
order, tagged with its lines' parts: by price the first is primary and the next three are secondary. A second tagger goes by
quantity. Records are of one of three editions, by the year of the order modulo three.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

YEARS = (1998, 1999, 2000)
#: What is added to a supplier's key to make it an item's.
SUPPLIERS = 1_000_000_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def items(spark: SparkSession, d: str) -> DataFrame:
    """item_id, label, section_id, cluster, unit_id, part. A supplier is of a section and cluster that parts have, by its key."""
    parts = table(spark, d, "part").select(F.col("p_partkey").alias("item_id"), F.col("p_name").alias("label"), F.col("p_type").alias("section_id"), F.col("p_brand").alias("cluster"))
    units = parts.agg(F.array_sort(F.collect_set(F.struct("section_id", "cluster"))).alias("units"))  # one row
    unit = F.get("units", (F.col("s_suppkey") % F.size("units")).cast("int"))
    more = table(spark, d, "supplier").crossJoin(F.broadcast(units)).select((F.col("s_suppkey") + SUPPLIERS).alias("item_id"), F.col("s_name").alias("label"), unit["section_id"].alias("section_id"), unit["cluster"].alias("cluster"))
    part = F.when(F.col("section_id").isin("PROMO", "STANDARD"), "GA").otherwise("DA")
    return parts.unionByName(more).select("item_id", "label", "section_id", "cluster", F.concat("section_id", F.lit(":"), "cluster").alias("unit_id"), part.alias("part"))


def tags(spark: SparkSession, d: str) -> DataFrame:
    """id, primary, secondary, guess_primary, guess_secondary, ranking: one aggregation over the lines."""
    lines = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("id"), F.col("l_partkey").alias("item")).agg(F.max("l_extendedprice").alias("price"), F.max("l_quantity").alias("qty"))
    by = lambda c: F.transform(F.array_sort(F.collect_list(F.struct((-F.col(c)).alias("k"), "item"))), lambda x: x["item"])
    both = lines.groupBy("id").agg(by("price").alias("a"), by("qty").alias("b"))
    return both.select("id", F.col("a")[0].alias("primary"), F.slice("a", 2, 3).alias("secondary"), F.col("b")[0].alias("guess_primary"), F.slice("b", 2, 3).alias("guess_secondary"), F.slice("b", 1, 15).alias("ranking"))


def questions(spark: SparkSession, d: str) -> DataFrame:
    year = (F.lit(YEARS[0]) + F.year("o_orderdate") % len(YEARS)).cast("int")
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), year.alias("year"), F.col("o_orderstatus").alias("type"), F.when(F.col("o_totalprice") >= 150000, 2).otherwise(1).alias("marks"), F.col("o_orderpriority").alias("priority"))


def records(spark: SparkSession, d: str) -> DataFrame:
    """Tagged questions with the part of their primary item."""
    tagged = questions(spark, d).join(tags(spark, d), "id")
    return tagged.join(items(spark, d).select(F.col("item_id").alias("primary"), "part", F.col("section_id").alias("section")), "primary")


def ctes() -> str:
    """SQL views i (items), q (questions), t (line tags with both ranks), r (records), u (uses) and w (shared weights)."""
    return f"""WITH i AS (
    SELECT *, concat(section_id, ':', cluster) AS unit_id, CASE WHEN section_id IN ('PROMO', 'STANDARD') THEN 'GA' ELSE 'DA' END AS part
    FROM (SELECT p_partkey AS item_id, p_name AS label, p_type AS section_id, p_brand AS cluster FROM part UNION ALL
        SELECT s_suppkey + {SUPPLIERS}, s_name, units[s_suppkey % len(units) + 1].t, units[s_suppkey % len(units) + 1].b
        FROM supplier, (SELECT list_sort(list(DISTINCT {{'t': p_type, 'b': p_brand}})) AS units FROM part))),
q AS (
    SELECT o_orderkey AS id, CAST({YEARS[0]} + year(o_orderdate) % {len(YEARS)} AS INTEGER) AS year, o_orderstatus AS type, CASE WHEN o_totalprice >= 150000 THEN 2 ELSE 1 END AS marks, o_orderpriority AS priority
    FROM orders),
l AS (SELECT l_orderkey AS id, l_partkey AS item_id, max(l_extendedprice) AS price, max(l_quantity) AS qty FROM lineitem GROUP BY 1, 2),
t AS (
    SELECT id, item_id, row_number() OVER (PARTITION BY id ORDER BY price DESC, item_id) AS rp, row_number() OVER (PARTITION BY id ORDER BY qty DESC, item_id) AS rq FROM l),
r AS (
    SELECT q.*, p.item_id AS primary_item, g.item_id AS guess_primary, i.part, i.section_id AS section, s.n_tags
    FROM q JOIN t p ON p.id = q.id AND p.rp = 1 JOIN t g ON g.id = q.id AND g.rq = 1 JOIN i ON i.item_id = p.item_id
    JOIN (SELECT id, least(count(*), 4) AS n_tags FROM t GROUP BY id) s ON s.id = q.id),
u AS (SELECT r.id, r.year, r.part, r.marks, r.n_tags, t.item_id, t.rp, CASE WHEN t.rp = 1 THEN 1 ELSE 0 END AS is_primary FROM r JOIN t USING (id) WHERE t.rp <= 4),
w AS (SELECT *, CASE WHEN rp = 1 THEN 120 // (n_tags + 1) ELSE 60 // (n_tags + 1) END AS weight FROM u)
"""
