"""Queries of the layout family. Users' days stand for pages, seconds of the day for heights, signups for anchors."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from tagmill.functions.text import content_words
from tagmill.operators import glyphs as gl
from tagmill.operators import intervals as iv
from tagmill.plans.binding import ctes, items, table

LAST_DAY = 31


def _events(spark, d):
    e = table(spark, d, "events")
    day = F.dayofmonth("ts")
    second = F.hour("ts") * 3600 + F.minute("ts") * 60 + F.second("ts")
    return e.select("event_id", "user_id", "event_type", "value", "ts", day.alias("day"), second.cast("double").alias("top"))


def _anchors(e):
    """One anchor a user and place: the first event of equal ones."""
    return e.filter("event_type = 'signup'").groupBy("user_id", "day", "top").agg(F.min("event_id").alias("anchor_id"))


def boilerplate_signatures(spark, d):
    """Lines that three documents or more hold, and a two-thousandth of all."""
    lines = table(spark, d, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line")).select("doc_id", F.trim("line").alias("line")).filter("line <> ''")
    return iv.frequent_signatures(lines, "line", "doc_id", 3, 0.0005).select(F.md5("line").alias("signature"), "n_pages")


def line_metrics(spark, d):
    """Orders as lines, their lines as glyphs: base size and baseline."""
    g = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"), (F.col("l_quantity") / 8).alias("size"), F.col("l_discount").alias("y"))
    return iv.base_metrics(g, ["id"], "size", "y")


def asof_owner(spark, d):
    """Events with the last signup of their user at or before them; events before the first are dropped."""
    e = table(spark, d, "events").select("event_id", "user_id", "ts")
    signups = table(spark, d, "events").filter("event_type = 'signup'").groupBy("user_id", "ts").agg(F.max("event_id").alias("owner_id"))
    return iv.as_of(e, signups, ["user_id"], "ts", ["owner_id"]).select("event_id", "owner_id")


def asof_owner_nested(spark, d):
    """Views with the label that owns them: of the last day with purchases, the purchase nearest at or left of their value (2 points of slack), else the leftmost."""
    e = _events(spark, d)
    views = e.filter("event_type = 'view'").select("event_id", "user_id", "day", "value")
    labels = e.filter("event_type = 'purchase'").select("user_id", "day", F.col("event_id").alias("label_id"), F.col("value").alias("x"))
    rows = labels.groupBy("user_id", "day").agg(F.array_sort(F.collect_list(F.struct("x", "label_id"))).alias("row"))
    owned = iv.as_of(views, rows, ["user_id"], "day", ["row"])
    left = F.filter("row", lambda r: r["x"] <= F.col("value") + 2)
    label = F.when(F.size(left) > 0, F.element_at(left, -1)).otherwise(F.get("row", F.lit(0)))
    return owned.select("event_id", label["label_id"].alias("label_id"))


def _bands(spark, d):
    return iv.bands(_anchors(_events(spark, d)), ["user_id"], "day", "top", 0.0, 86400.0, F.lit(LAST_DAY))


def question_bands(spark, d):
    return _bands(spark, d).select("anchor_id", "user_id", "page", "band_top", "band_bottom")


def crop_extents(spark, d):
    """Extent of what lies in each band, with a margin of four, cut to the band; what is no higher than two is left out."""
    e = _events(spark, d).filter("event_type <> 'signup'").select("user_id", F.col("day").alias("page"), "top")
    inside = iv.points_in_bands(e, _bands(spark, d), ["user_id", "page"], "top", "band_top", "band_bottom")
    found = inside.groupBy("anchor_id", "page", "band_top", "band_bottom").agg(F.min("top").alias("lo"), F.max("top").alias("hi"))
    return found.select("anchor_id", "page", F.greatest(F.col("band_top") - 4, F.col("lo") - 4).alias("crop_top"), F.least("band_bottom", F.col("hi") + 4).alias("crop_bottom")).filter("crop_bottom - crop_top > 2")


def interval_bands(spark, d):
    """Errors with the bands that hold them."""
    e = _events(spark, d).filter("event_type = 'error'").select("event_id", "user_id", F.col("day").alias("page"), "top")
    return iv.points_in_bands(e, _bands(spark, d), ["user_id", "page"], "top", "band_top", "band_bottom").select("event_id", "anchor_id", "page")


def interval_overlap_pairs(spark, d):
    """Lines of one supplier whose shipping spans overlap by 40 % of the shorter, counted per supplier."""
    lines = table(spark, d, "lineitem").groupBy("l_suppkey", "l_shipdate", "l_quantity").agg(F.min("l_orderkey").alias("i"))
    start = F.datediff(F.col("l_shipdate").cast("date"), F.lit("1995-01-01").cast("date"))
    rows = lines.select(F.col("l_suppkey").alias("supplier"), (F.col("i") * 100 + F.col("l_quantity")).cast("bigint").alias("i"), start.alias("s"), (start + F.col("l_quantity")).alias("e"))
    pairs = iv.overlapping_pairs(rows, ["supplier"], "i", "s", "e", 64.0, 0.4)
    return pairs.groupBy("supplier").agg(F.count(F.lit(1)).alias("pairs"), F.sum("overlap").alias("overlap"))


def level_neighbours(spark, d):
    """Small lines that have a line of their order at another quantity within three."""
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_quantity").alias("q")).distinct()
    return iv.near_levels(lines.filter("q < 10"), lines, ["id"], "q", 3.0).select("id", F.col("q").alias("quantity"))


@F.pandas_udf(IntegerType())
def _changed_words(a: pd.Series, b: pd.Series) -> pd.Series:
    """Words that leave and come between two lists: what they share at both ends is cut off first."""

    def count(x: list[str], y: list[str]) -> int:
        n = 0
        while n < min(len(x), len(y)) and x[n] == y[n]:
            n += 1
        m = 0
        while m < min(len(x), len(y)) - n and x[len(x) - 1 - m] == y[len(y) - 1 - m]:
            m += 1
        diff = difflib.ndiff(list(x[n : len(x) - m]), list(y[n : len(y) - m]))
        return sum(line[:2] in ("+ ", "- ") for line in diff)

    return pd.Series([count(list(x), list(y)) for x, y in zip(a, b, strict=True)])


def edition_diff(spark, d):
    """Documents and a second edition in which every fifth has a word put in front: what differs."""
    docs = table(spark, d, "documents")
    second = F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit("zzz "), "text")).otherwise(F.col("text"))
    rows = docs.select("doc_id", content_words(F.col("text")).alias("a"), content_words(second).alias("b"))
    same = rows.filter("a = b").select("doc_id", F.lit(True).alias("identical"), F.lit(0).alias("changed"))
    unlike = rows.filter("a <> b").select("doc_id", F.lit(False).alias("identical"), _changed_words("a", "b").alias("changed"))
    return same.unionByName(unlike)


def flatten_taxonomy(spark, d):
    """A nested document per section and cluster, flattened to items again."""
    nested = items(spark, d).groupBy("part", "section_id", "cluster").agg(F.collect_list(F.struct("item_id", "label")).alias("items"))
    nested = nested.groupBy("part", "section_id").agg(F.collect_list(F.struct("cluster", "items")).alias("clusters"))
    flat = nested.select("part", "section_id", F.explode("clusters").alias("c")).select("part", "section_id", "c.cluster", F.explode("c.items").alias("i"))
    return flat.select("part", "section_id", "cluster", "i.item_id", "i.label")


def _glyphs(spark, d):
    """Orders as pages; each line of an order is a word of three glyphs, the last one raised or lowered by its flag."""
    l = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("page"), F.col("l_partkey").alias("piece")).agg(F.max("l_quantity").alias("q"), F.max("l_returnflag").alias("f"))
    y = F.floor(F.col("q") / 10) * 14.0
    x = F.col("piece") * 12.0
    size = F.lit(10.0)
    shift = F.when(F.col("f") == "A", -4.0).when(F.col("f") == "R", 4.0).otherwise(0.0)
    glyph = lambda text, k, s, up, font: F.struct(text.alias("text"), (x + k * 4.0).alias("x0"), (y + up).alias("y0"), (x + k * 4.0 + 3.5).alias("x1"), (y + up + s).alias("y1"), (y + up + 8.0).alias("baseline"), s.alias("size"), F.lit(font).alias("font"))
    three = F.array(glyph(F.lit("x"), 0, size, F.lit(0.0), "CMMI10"), glyph(F.lit("("), 1, size, F.lit(0.0), "Times"), glyph(F.col("f"), 2, F.when(F.col("f") == "N", size).otherwise(F.lit(6.0)), shift, "Times"))
    return l.select("page", "piece", F.explode(three).alias("g")).select("page", "piece", "g.*")


def _graphics(spark, d):
    """A rule below every third word, upright ones at every seventh, shapes and images at others."""
    l = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("page"), F.col("l_partkey").alias("piece")).agg(F.max("l_quantity").alias("q"))
    l = l.withColumn("x", F.col("piece") * 12.0).withColumn("y", F.floor(F.col("q") / 10) * 14.0)
    box = lambda kind, x1, y0, y1, thin, curved: F.struct(F.lit(kind).alias("kind"), F.col("x").alias("x0"), y0.alias("y0"), x1.alias("x1"), y1.alias("y1"), F.lit(thin).alias("thin"), curved.alias("curved"))
    no = F.lit(False)
    rule = box("vector", F.col("x") + 11.5, F.col("y") + 11.0, F.col("y") + 11.5, True, no)
    upright = box("vector", F.col("x") + 0.5, F.col("y"), F.col("y") + F.col("q"), True, no)
    shape = box("vector", F.col("x") + F.col("q"), F.col("y"), F.col("y") + 9.0, False, F.col("q") > 45)
    image = box("image", F.col("x") + 9.0, F.col("y"), F.col("y") + 9.0, False, no)
    which = F.when(F.col("piece") % 3 == 0, rule).when(F.col("piece") % 7 == 1, upright).when(F.col("piece") % 5 == 0, shape).when(F.col("piece") % 11 == 0, image)
    return l.withColumn("g", which).filter("g IS NOT NULL").select("page", "g.*", (F.col("page") % 50).alias("paper"))


def line_gaps(spark, d):
    boxes = _glyphs(spark, d).groupBy("page", "piece").agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))
    return gl.line_gaps(boxes, ["page"], "piece")


def text_rebuild(spark, d):
    return gl.rebuild_text(_glyphs(spark, d), ["page"])


def text_features(spark, d):
    graphics = _graphics(spark, d)
    return gl.layout_features(_glyphs(spark, d), graphics, ["page"], gl.frame_columns(graphics, ["paper"], "page"), ["paper"])


_E = "WITH e AS (SELECT event_id, user_id, event_type, value, ts, CAST(day(ts) AS INTEGER) AS day, CAST(hour(ts) * 3600 + minute(ts) * 60 + second(ts) AS DOUBLE) AS top FROM events)"
_B = """, a AS (SELECT user_id, day, top, min(event_id) AS anchor_id FROM e WHERE event_type = 'signup' GROUP BY ALL),
n AS (SELECT *, coalesce(lead(day) OVER w, 31) AS next_day, coalesce(lead(top) OVER w, 86400) AS next_top FROM a WINDOW w AS (PARTITION BY user_id ORDER BY day, top)),
b AS (SELECT * FROM (SELECT anchor_id, user_id, page, CASE WHEN page = day THEN top ELSE 0.0 END AS band_top, CASE WHEN page = next_day THEN next_top ELSE 86400.0 END AS band_bottom FROM (SELECT *, CAST(unnest(range(day, next_day + 1)) AS INTEGER) AS page FROM n)) WHERE band_bottom > band_top)"""

_W = """WITH p AS (SELECT l_orderkey AS page, l_partkey AS piece, max(l_quantity) AS q, max(l_returnflag) AS f FROM lineitem GROUP BY ALL),
w AS (SELECT *, 12.0 * piece AS x, 14.0 * floor(q / 10) AS y, CAST(dense_rank() OVER (PARTITION BY page ORDER BY floor(q / 10)) - 1 AS INTEGER) AS line,
    CASE f WHEN 'A' THEN -4.0 WHEN 'R' THEN 4.0 ELSE 0.0 END AS up, CASE f WHEN 'N' THEN 10.0 ELSE 6.0 END AS s FROM p)"""
_GLYPHS = """, g AS (SELECT *, row_number() OVER () AS glyph FROM (
    SELECT page, line, piece, 'x' AS t, x AS x0, x + 3.5 AS x1, y AS y0, y + 10 AS y1, y + 8 AS b, 10.0 AS s, true AS math FROM w UNION ALL SELECT page, line, piece, '(', x + 4, x + 7.5, y, y + 10, y + 8, 10, false FROM w
    UNION ALL SELECT page, line, piece, f, x + 8, x + 11.5, y + up, y + up + s, y + up + 8, s, false FROM w)),
h AS (SELECT page, page % 50 AS paper, CASE WHEN piece % 3 = 0 THEN 'rule' WHEN piece % 7 = 1 THEN 'upright' WHEN piece % 5 = 0 THEN 'shape' WHEN piece % 11 = 0 THEN 'image' END AS kind, x, y, q, piece FROM w),
fr AS (SELECT paper, x FROM h WHERE kind = 'upright' AND q > 0.5 GROUP BY ALL HAVING count(DISTINCT page) >= 3),
hf AS (SELECT page, count(*) FILTER (kind = 'image') AS image_count, count(*) FILTER (kind = 'shape') AS vector_shape_count,
    count(*) FILTER (kind = 'image') > 0 OR count(*) FILTER (kind = 'shape' AND q > 45) > 0 OR count(*) FILTER (kind = 'shape') >= 3 OR coalesce(sum(q * 9) FILTER (kind = 'shape'), 0) >= 400 AS has_figure,
    count(*) FILTER (kind = 'upright' AND q >= 8 AND fr.x IS NULL) >= 2 AS has_table FROM h LEFT JOIN fr ON fr.paper = h.paper AND fr.x = h.x AND h.kind = 'upright' GROUP BY page),
ru AS (SELECT h.page, h.piece, max(CASE WHEN math AND x1 > x AND x0 < x + 11.5 AND y1 BETWEEN y + 11 - 12 AND y + 12.5 THEN 1 ELSE 0 END) AS above, max(CASE WHEN math AND x1 > x AND x0 < x + 11.5 AND y0 BETWEEN y + 10 AND y + 23.5 THEN 1 ELSE 0 END) AS below,
    max(CASE WHEN NOT math AND x0 >= x - 1 AND x1 <= x + 12.5 AND y1 BETWEEN y + 7 AND y + 12.5 THEN 1 ELSE 0 END) AS under FROM h JOIN g ON g.page = h.page WHERE h.kind = 'rule' GROUP BY ALL),
rf AS (SELECT page, sum(above * below) AS fraction_bars, sum(under) AS underline_rules FROM ru GROUP BY page),
df AS (SELECT page, count(*) AS deep_scripts FROM g WHERE s < 8.5 AND abs(b - (14.0 * round((b - 8) / 14) + 8)) > 6 GROUP BY page),
li AS (SELECT page, line, min(x0) AS x0, max(x1) AS x1, min(y0) AS y0, max(y1) AS y1, max(s) AS s, avg(CASE WHEN math THEN 1.0 ELSE 0 END) AS share FROM g GROUP BY ALL),
ls AS (SELECT *, (x1 - x0) < 0.45 * (max(x1) OVER v - min(x0) OVER v) AND share >= 0.6 AS short FROM li WINDOW v AS (PARTITION BY page)),
st AS (SELECT page, count(*) FILTER (px0 < x1 AND x0 < px1 AND y0 - py1 BETWEEN 0 AND 6) AS stacked_math_lines FROM (SELECT *, lag(x0) OVER v AS px0, lag(x1) OVER v AS px1, lag(y1) OVER v AS py1 FROM ls WHERE short WINDOW v AS (PARTITION BY page ORDER BY line)) GROUP BY page),
mr AS (SELECT a.page, count(DISTINCT a.line) AS matrix_rows FROM ls a JOIN ls c ON a.page = c.page AND a.line <> c.line AND abs((a.y0 + a.y1) / 2 - (c.y0 + c.y1) / 2) BETWEEN 1e-9 AND 1.6 * a.s
    JOIN g ON g.page = c.page AND g.line = c.line AND g.t = '(' AND a.x0 - g.x1 BETWEEN -3 AND 25 WHERE a.short GROUP BY a.page),
sg AS (SELECT page, count(*) AS stacked_glyphs FROM (SELECT DISTINCT a.page, a.glyph, c.glyph AS other FROM g a JOIN g c ON a.page = c.page AND a.glyph < c.glyph AND least(a.x1, c.x1) > greatest(a.x0, c.x0) AND least(a.x1, c.x1) - greatest(a.x0, c.x0) >= 0.4 * least(a.x1 - a.x0, c.x1 - c.x0)
    JOIN g m ON m.page = a.page AND m.s >= 0.85 * greatest(a.s, c.s) AND abs(a.b - c.b) BETWEEN 0.75 * m.s AND 1.6 * m.s AND m.b BETWEEN least(a.b, c.b) + 0.25 * abs(a.b - c.b) AND greatest(a.b, c.b) - 0.25 * abs(a.b - c.b)
    AND m.x1 >= least(a.x0, c.x0) - 40 AND m.x0 <= greatest(a.x1, c.x1) + 40) GROUP BY page)"""

QUERIES = {f.__name__: f for f in (boilerplate_signatures, line_metrics, asof_owner, asof_owner_nested, question_bands, crop_extents, interval_bands, interval_overlap_pairs, level_neighbours, edition_diff, flatten_taxonomy, line_gaps, text_rebuild, text_features)}
ORACLES = {
    "boilerplate_signatures": "SELECT md5(line) AS signature, count(DISTINCT doc_id) AS n_pages FROM (SELECT doc_id, trim(unnest(string_split(text, chr(10)))) AS line FROM documents) WHERE line <> '' GROUP BY line HAVING count(DISTINCT doc_id) >= greatest(3, floor((SELECT count(*) FROM documents) * 0.0005))",
    "line_metrics": """WITH g AS (SELECT l_orderkey AS id, round_even(l_quantity / 8 * 2, 0) / 2 AS size, l_discount AS y FROM lineitem), c AS (SELECT id, size, count(*) AS n, median(y) AS y FROM g GROUP BY ALL)
        SELECT id, size AS base_size, y AS baseline FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY n >= 2 DESC, size DESC) AS k FROM c) WHERE k = 1""",
    "asof_owner": "WITH s AS (SELECT user_id, ts, max(event_id) AS owner_id FROM events WHERE event_type = 'signup' GROUP BY ALL) SELECT e.event_id, s.owner_id FROM events e ASOF JOIN s ON e.user_id = s.user_id AND e.ts >= s.ts",
    "asof_owner_nested": _E + """, l AS (SELECT user_id, day, event_id AS label_id, value AS x FROM e WHERE event_type = 'purchase'), v AS (SELECT event_id, user_id, day, value FROM e WHERE event_type = 'view'),
        o AS (SELECT v.*, (SELECT max(l.day) FROM l WHERE l.user_id = v.user_id AND l.day <= v.day) AS row_day FROM v),
        k AS (SELECT o.event_id, l.label_id, row_number() OVER (PARTITION BY o.event_id ORDER BY l.x <= o.value + 2 DESC, CASE WHEN l.x <= o.value + 2 THEN -l.x ELSE l.x END, CASE WHEN l.x <= o.value + 2 THEN -l.label_id ELSE l.label_id END) AS n FROM o JOIN l ON l.user_id = o.user_id AND l.day = o.row_day)
        SELECT event_id, label_id FROM k WHERE n = 1""",
    "question_bands": _E + _B + " SELECT anchor_id, user_id, page, band_top, band_bottom FROM b",
    "crop_extents": _E + _B + """, i AS (SELECT anchor_id, page, band_top, band_bottom, min(top) AS lo, max(top) AS hi FROM b JOIN e ON e.user_id = b.user_id AND e.day = b.page AND e.event_type <> 'signup' AND top >= band_top - 1 AND top < band_bottom GROUP BY ALL)
        SELECT * FROM (SELECT anchor_id, page, greatest(band_top - 4, lo - 4) AS crop_top, least(band_bottom, hi + 4) AS crop_bottom FROM i) WHERE crop_bottom - crop_top > 2""",
    "interval_bands": _E + _B + " SELECT event_id, anchor_id, page FROM e JOIN b ON e.user_id = b.user_id AND e.day = b.page AND top >= band_top - 1 AND top < band_bottom WHERE event_type = 'error'",
    "interval_overlap_pairs": """WITH r AS (SELECT l_suppkey AS supplier, CAST(min(l_orderkey) * 100 + l_quantity AS BIGINT) AS i, CAST(date_diff('day', DATE '1995-01-01', CAST(l_shipdate AS DATE)) AS DOUBLE) AS s, date_diff('day', DATE '1995-01-01', CAST(l_shipdate AS DATE)) + l_quantity AS e FROM lineitem GROUP BY l_suppkey, l_shipdate, l_quantity)
        SELECT a.supplier, count(*) AS pairs, sum(least(a.e, b.e) - b.s) AS overlap FROM r a JOIN r b ON a.supplier = b.supplier AND (b.s > a.s OR b.s = a.s AND b.i > a.i) AND b.s < a.e WHERE least(a.e, b.e) - b.s >= 0.4 * least(a.e - a.s, b.e - b.s) GROUP BY 1""",
    "level_neighbours": "SELECT DISTINCT l_orderkey AS id, l_quantity AS quantity FROM lineitem a WHERE l_quantity < 10 AND EXISTS (SELECT 1 FROM lineitem b WHERE b.l_orderkey = a.l_orderkey AND b.l_quantity <> a.l_quantity AND abs(b.l_quantity - a.l_quantity) <= 3)",
    "edition_diff": "SELECT doc_id, doc_id % 5 <> 0 AS identical, CASE WHEN doc_id % 5 = 0 THEN 1 ELSE 0 END AS changed FROM documents",
    "line_gaps": _W + """, b AS (SELECT page, piece, line, least(y, y + up) AS y0, greatest(y + 10, y + up + s) AS y1 FROM w), l AS (SELECT page, line, min(y0) - lag(max(y1)) OVER (PARTITION BY page ORDER BY line) AS gap FROM b GROUP BY page, line)
        SELECT page, piece, line, gap FROM b JOIN l USING (page, line)""",
    "text_rebuild": _W + """, t AS (SELECT page, line, piece, CASE WHEN lag(piece) OVER v IS NULL OR piece - lag(piece) OVER v = 1 THEN '' ELSE ' ' END AS sep, CASE f WHEN 'A' THEN '^A' WHEN 'R' THEN '_R' ELSE 'N' END AS f FROM w WINDOW v AS (PARTITION BY page, line ORDER BY piece)),
        l AS (SELECT page, line, string_agg(concat(sep, 'x(', f), '' ORDER BY piece) AS text FROM t GROUP BY ALL)
        SELECT page, CAST(count(*) AS INTEGER) AS n_lines, string_agg(text, chr(10) ORDER BY line) AS text FROM l GROUP BY page""",
    "text_features": _W + _GLYPHS + """ SELECT page, true AS has_math, false AS has_code, CAST(coalesce(image_count, 0) AS INTEGER) AS image_count, CAST(coalesce(vector_shape_count, 0) AS INTEGER) AS vector_shape_count, coalesce(has_figure, false) AS has_figure, coalesce(has_table, false) AS has_table,
        CAST(coalesce(fraction_bars, 0) AS INTEGER) AS fraction_bars, CAST(coalesce(stacked_math_lines, 0) AS INTEGER) AS stacked_math_lines, CAST(coalesce(stacked_glyphs, 0) AS INTEGER) AS stacked_glyphs, CAST(coalesce(matrix_rows, 0) AS INTEGER) AS matrix_rows,
        CAST(coalesce(deep_scripts, 0) AS INTEGER) AS deep_scripts, 0 AS display_math_glyphs, CAST(coalesce(underline_rules, 0) AS INTEGER) AS underline_rules
        FROM (SELECT DISTINCT page FROM w) LEFT JOIN hf USING (page) LEFT JOIN rf USING (page) LEFT JOIN df USING (page) LEFT JOIN st USING (page) LEFT JOIN mr USING (page) LEFT JOIN sg USING (page)""",
    "flatten_taxonomy": ctes() + " SELECT part, section_id, cluster, item_id, label FROM i",
}
