"""Queries of the record, validation and source families."""

from __future__ import annotations

from pyspark.sql import functions as F

from tagmill.functions.text import preview
from tagmill.operators import ordering, textops
from tagmill.operators import quality as q
from tagmill.plans.binding import ctes, items, questions, records, table, tags

C = ctes()


def question_records(spark, d):
    """All questions with their tags; what is untagged has nulls. Penalty: a third of the marks for one type only."""
    rows = questions(spark, d).join(tags(spark, d).select("id", "primary", "secondary"), "id", "left")
    return rows.select("id", "year", "type", "marks", F.when(F.col("type") == "F", F.round(F.col("marks") / 3, 4)).otherwise(0.0).alias("negative_marks"), F.col("primary").alias("primary_item"), F.size(F.coalesce("secondary", F.array().cast("array<bigint>"))).alias("n_secondary"), F.when(F.col("primary").isNull(), "needs_review").otherwise("clean").alias("status"))


def questions_flat(spark, d):
    """Arrays joined, options widened to columns, labels with the id as a fallback."""
    rows = questions(spark, d).join(tags(spark, d).select("id", "primary", "secondary"), "id", "left")
    rows = rows.join(items(spark, d).select(F.col("item_id").alias("primary"), "label"), "primary", "left")
    option = lambda n: F.coalesce(F.get("secondary", F.lit(n)).cast("string"), F.lit(""))
    return rows.select("id", F.coalesce(F.col("primary").cast("string"), F.lit("")).alias("primary_item"), F.coalesce(F.concat_ws(";", F.transform("secondary", lambda x: x.cast("string"))), F.lit("")).alias("secondary_items"), option(0).alias("option_a"), option(1).alias("option_b"), option(2).alias("option_c"), F.coalesce("label", F.col("primary").cast("string"), F.lit("")).alias("title"))


def attach_tags(spark, d):
    return questions(spark, d).join(tags(spark, d).select("id", "primary"), "id", "left").groupBy("year", "type").agg(F.count(F.lit(1)).alias("questions"), F.count("primary").alias("tagged"))


def latest_by_key(spark, d):
    """The last event of each user and type."""
    return ordering.latest(table(spark, d, "events").select("user_id", "event_type", "event_id", "value"), ["user_id", "event_type"], "event_id")


def dq_checks(spark, d):
    orders, lines, customers, parts = (table(spark, d, t) for t in ("orders", "lineitem", "customer", "part"))
    per_order = lines.groupBy("l_orderkey").agg(F.array_sort(F.collect_set("l_linenumber")).alias("numbers"))
    return q.report(
        q.unique(orders, "order ids are unique", "o_orderkey"),
        q.unique(lines, "lines are unique by order and number", "l_orderkey", "l_linenumber"),
        q.missing(orders, lines, "every order has a line", "o_orderkey", "l_orderkey"),
        q.missing(lines, orders, "every line has an order", "l_orderkey", "o_orderkey"),
        q.missing(orders, customers, "every order has a customer", "o_custkey", "c_custkey"),
        q.missing(lines, parts, "every line has a part", "l_partkey", "p_partkey"),
        q.check(per_order, "line numbers run from 1 without gaps", F.col("numbers") != F.sequence(F.lit(1), F.size("numbers"))),
        q.check(orders, "order status is known", ~F.col("o_orderstatus").isin("F", "O", "P")),
        q.check(orders, "total price is positive", F.col("o_totalprice") <= 0),
        q.check(lines, "quantity is from 1 to 50", ~F.col("l_quantity").between(1, 50)),
        q.check(lines, "discount is from 0 to 0.1", ~F.col("l_discount").between(0, 0.1)),
        q.check(lines, "returned lines", F.col("l_returnflag") == "R", "warning"),
    )


def dq_passed(spark, d):
    return q.passed(dq_checks(spark, d))


def tag_problems(spark, d):
    """One row per broken clause of the tag contract."""
    asked, tagged, i = questions(spark, d), tags(spark, d), items(spark, d)
    known = records(spark, d)
    used = known.select("id", "part", F.explode("secondary").alias("item_id")).join(i.select("item_id", F.col("part").alias("own")), "item_id", "left")
    problem = lambda rows, text: rows.select("id", F.lit(text).alias("problem")).distinct()
    return q.problems(
        problem(asked.join(tagged, "id", "left_anti"), "no tags"),
        problem(used.filter("own IS NULL"), "unknown item"),
        problem(used.filter("own <> part"), "item outside its part"),
        problem(known.filter(F.array_contains("secondary", F.col("primary"))), "primary repeated in secondary"),
        problem(known.filter(F.size("ranking") > 4), "more items than a tag takes"),
    )


def validation_summary(spark, d):
    """Per year: questions, marks, counts by type as a sorted text, tagged and untagged."""
    rows = question_records(spark, d)
    kinds = rows.groupBy("year", "type").agg(F.count(F.lit(1)).alias("n")).groupBy("year").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("type", "n"))), lambda x: F.concat_ws("=", x["type"], x["n"].cast("string"))), ",").alias("by_type"))
    return rows.groupBy("year").agg(F.count(F.lit(1)).alias("questions"), F.sum("marks").alias("marks"), F.sum(F.when(F.col("status") == "clean", 1).otherwise(0)).alias("clean"), F.sum(F.when(F.col("status") != "clean", 1).otherwise(0)).alias("flagged")).join(kinds, "year")


def manifest_verify(spark, d):
    """Pages against a copy in which some are gone and some are changed."""
    pages = table(spark, d, "pages")
    manifest = pages.select(F.col("page_id").cast("string").alias("name"), F.sha2("html", 256).alias("sha256"))
    html = F.when(F.col("page_id") % 7 == 2, F.concat("html", F.lit("!"))).otherwise(F.col("html"))
    files = pages.filter("page_id % 10 <> 3").select(F.col("page_id").cast("string").alias("name"), F.sha2(html, 256).alias("sha256"))
    return q.manifest_problems(manifest, files)


def mirror_agreement(spark, d):
    """Copies of one text by different sources; a copy is valid if it starts with a capital letter."""
    docs = table(spark, d, "documents").select(F.md5("text").alias("document"), "source", "doc_id", "text")
    return q.mirror_agreement(docs, "document", "source", "text", F.col("text").rlike("^[A-Z]")).groupBy("copies", "valid", "digests", "agree").agg(F.count(F.lit(1)).alias("documents"))


def source_lookup(spark, d):
    return table(spark, d, "documents").filter((F.col("lang") == "en") & (F.col("source") == "src3")).select("doc_id", "lang", "source", "n_chars")


def profile_checks(spark, d):
    """Customers as profiles: a start, an end, hours a day and days a week, with the rules each breaks."""
    c = table(spark, d, "customer")
    rows = c.select(F.col("c_custkey").alias("profile"), F.date_add(F.lit("2000-01-01").cast("date"), (F.col("c_custkey") % 30).cast("int")).alias("start"), F.date_add(F.lit("2000-01-10").cast("date"), (F.col("c_custkey") % 50).cast("int")).alias("exam"), (F.col("c_custkey") % 18).alias("hours"), (F.col("c_nationkey") % 9).alias("days"))
    broken = textops.review_reasons({"exam must be after start": F.col("exam") <= F.col("start"), "hours must be above 0 and at most 16": ~((F.col("hours") > 0) & (F.col("hours") <= 16)), "days must be from 1 to 7": ~F.col("days").between(1, 7)})
    return rows.select("profile", F.array_join(broken, "; ").alias("problems"), (F.size(broken) == 0).alias("valid"))


def id_roundtrip(spark, d):
    """Readable ids, and their year and number read back from them."""
    rows = questions(spark, d).withColumn("number", F.col("id") % 100)
    name = F.format_string("DA%d-Q%02d", F.col("year"), F.col("number"))
    return rows.select("id", name.alias("name"), F.substring(name, 3, 4).cast("int").alias("year_back"), F.regexp_extract(name, r"-Q(\d+)$", 1).cast("int").alias("number_back"))


def tags_parse(spark, d):
    """Lists written with separators and stray blanks, and read back: trimmed, empty entries gone."""
    written = tags(spark, d).select("id", F.concat(F.concat_ws(" ; ", F.transform("secondary", lambda x: x.cast("string"))), F.lit(" ;; ")).alias("cell"))
    parsed = F.filter(F.transform(F.split("cell", ";"), lambda x: F.trim(x)), lambda x: x != "")
    return written.select("id", F.size(parsed).alias("n"), F.concat_ws(",", parsed).alias("items"))




def _rules():
    return {"short": F.col("n_chars") < 200, "long": F.col("n_chars") > 10000, "license": F.col("text").contains("License"), "contact": F.col("text").rlike(r"[a-z0-9.]+@[a-z0-9.]+"), "bars": F.col("text").contains(" | ")}


def review_reasons(spark, d):
    reasons = textops.review_reasons(_rules())
    return table(spark, d, "documents").select("doc_id", F.array_join(reasons, ";").alias("reasons"), F.when(F.size(reasons) > 0, "needs_review").otherwise("clean").alias("status"))


def needs_review(spark, d):
    """Flagged documents with what to check and a preview."""
    reasons = textops.review_reasons(_rules())
    return table(spark, d, "documents").withColumn("reasons", F.array_join(reasons, " | ")).filter("reasons <> ''").select("doc_id", "lang", "reasons", preview(F.col("text")).alias("stem_preview"))


def faceted_search(spark, d):
    """Records by year, part, section prefix, type, marks and a word in the label of any of their items, in any case."""
    r, i = records(spark, d), items(spark, d)
    r = r.filter((F.col("year") == 1999) & (F.col("part") == "DA") & F.col("section").startswith("E") & (F.col("type") == "F") & (F.col("marks") == 2))
    used = r.select("id", "section", F.explode(F.concat(F.array("primary"), "secondary")).alias("item_id")).join(i.select("item_id", "label"), "item_id")
    return used.filter(F.lower("label").contains("an")).groupBy("id", "section").agg(F.count(F.lit(1)).alias("matching"))


_R = "list_filter([CASE WHEN n_chars < 200 THEN 'short' END, CASE WHEN n_chars > 10000 THEN 'long' END, CASE WHEN contains(text, 'License') THEN 'license' END, CASE WHEN regexp_matches(text, '[a-z0-9.]+@[a-z0-9.]+') THEN 'contact' END, CASE WHEN contains(text, ' | ') THEN 'bars' END], lambda x: x IS NOT NULL)"
_QR = """, x AS (SELECT q.id, q.year, q.type, q.marks, CASE WHEN q.type = 'F' THEN round(q.marks / 3, 4) ELSE 0.0 END AS negative_marks, p.item_id AS primary_item, coalesce(s.n, 0) AS n_secondary,
    CASE WHEN p.item_id IS NULL THEN 'needs_review' ELSE 'clean' END AS status
    FROM q LEFT JOIN t p ON p.id = q.id AND p.rp = 1 LEFT JOIN (SELECT id, count(*) AS n FROM t WHERE rp BETWEEN 2 AND 4 GROUP BY id) s ON s.id = q.id)"""
_DQ = """SELECT name, violations = 0 AS passed, violations, level FROM (
    SELECT 'order ids are unique' AS name, (SELECT count(*) FROM (SELECT 1 FROM orders GROUP BY o_orderkey HAVING count(*) > 1)) AS violations, 'error' AS level
    UNION ALL SELECT 'lines are unique by order and number', (SELECT count(*) FROM (SELECT 1 FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)), 'error'
    UNION ALL SELECT 'every order has a line', (SELECT count(*) FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)), 'error'
    UNION ALL SELECT 'every line has an order', (SELECT count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)), 'error'
    UNION ALL SELECT 'every order has a customer', (SELECT count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)), 'error'
    UNION ALL SELECT 'every line has a part', (SELECT count(*) FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part)), 'error'
    UNION ALL SELECT 'line numbers run from 1 without gaps', (SELECT count(*) FROM (SELECT 1 FROM lineitem GROUP BY l_orderkey HAVING min(l_linenumber) <> 1 OR max(l_linenumber) <> count(DISTINCT l_linenumber))), 'error'
    UNION ALL SELECT 'order status is known', (SELECT count(*) FROM orders WHERE o_orderstatus NOT IN ('F', 'O', 'P')), 'error'
    UNION ALL SELECT 'total price is positive', (SELECT count(*) FROM orders WHERE o_totalprice <= 0), 'error'
    UNION ALL SELECT 'quantity is from 1 to 50', (SELECT count(*) FROM lineitem WHERE l_quantity NOT BETWEEN 1 AND 50), 'error'
    UNION ALL SELECT 'discount is from 0 to 0.1', (SELECT count(*) FROM lineitem WHERE l_discount NOT BETWEEN 0 AND 0.1), 'error'
    UNION ALL SELECT 'returned lines', (SELECT count(*) FROM lineitem WHERE l_returnflag = 'R'), 'warning')"""

QUERIES = {f.__name__: f for f in (question_records, questions_flat, attach_tags, latest_by_key, dq_checks, dq_passed, tag_problems, validation_summary, manifest_verify, mirror_agreement, source_lookup, profile_checks, id_roundtrip, tags_parse, review_reasons, needs_review, faceted_search)}
ORACLES = {
    "question_records": C + _QR + " SELECT * FROM x",
    "questions_flat": C + """, s AS (SELECT id, list(item_id ORDER BY rp) AS l FROM t WHERE rp BETWEEN 2 AND 4 GROUP BY id)
        SELECT q.id, coalesce(CAST(p.item_id AS VARCHAR), '') AS primary_item, coalesce(array_to_string(l, ';'), '') AS secondary_items, coalesce(CAST(l[1] AS VARCHAR), '') AS option_a, coalesce(CAST(l[2] AS VARCHAR), '') AS option_b, coalesce(CAST(l[3] AS VARCHAR), '') AS option_c, coalesce(i.label, '') AS title
        FROM q LEFT JOIN t p ON p.id = q.id AND p.rp = 1 LEFT JOIN s ON s.id = q.id LEFT JOIN i ON i.item_id = p.item_id""",
    "attach_tags": C + _QR + " SELECT year, type, count(*) AS questions, count(primary_item) AS tagged FROM x GROUP BY ALL",
    "latest_by_key": "SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) AS n FROM events) WHERE n = 1",
    "dq_checks": _DQ,
    "dq_passed": "SELECT bool_and(passed OR level <> 'error') AS passed, count(*) AS checks, sum(CASE WHEN passed THEN 0 ELSE 1 END) AS failed FROM (" + _DQ + ")",
    "tag_problems": C + """SELECT id, 'no tags' AS problem FROM q WHERE id NOT IN (SELECT id FROM t)
        UNION ALL SELECT DISTINCT u.id, 'item outside its part' FROM u JOIN i USING (item_id) WHERE u.rp > 1 AND i.part <> u.part
        UNION ALL SELECT DISTINCT u.id, 'unknown item' FROM u WHERE item_id NOT IN (SELECT item_id FROM i)
        UNION ALL SELECT DISTINCT r.id, 'more items than a tag takes' FROM r WHERE (SELECT count(*) FROM t WHERE t.id = r.id) > 4""",
    "validation_summary": C + _QR + ", k AS (SELECT year, string_agg(concat(type, '=', n), ',' ORDER BY type) AS by_type FROM (SELECT year, type, count(*) AS n FROM x GROUP BY ALL) GROUP BY year) SELECT year, count(*) AS questions, sum(marks) AS marks, count(*) FILTER (status = 'clean') AS clean, count(*) FILTER (status <> 'clean') AS flagged, any_value(by_type) AS by_type FROM x JOIN k USING (year) GROUP BY year",
    "manifest_verify": "SELECT CAST(page_id AS VARCHAR) AS name, CASE WHEN page_id % 10 = 3 THEN 'missing' ELSE 'checksum mismatch' END AS problem FROM pages WHERE page_id % 10 = 3 OR page_id % 7 = 2",
    "mirror_agreement": "SELECT copies, valid, digests, digests <= 1 AS agree, count(*) AS documents FROM (SELECT text, count(*) AS copies, count(*) FILTER (regexp_matches(text, '^[A-Z]')) AS valid, CASE WHEN regexp_matches(text, '^[A-Z]') THEN 1 ELSE 0 END AS digests FROM documents GROUP BY text) GROUP BY ALL",
    "source_lookup": "SELECT doc_id, lang, source, n_chars FROM documents WHERE lang = 'en' AND source = 'src3'",
    "profile_checks": """SELECT profile, array_to_string(p, '; ') AS problems, len(p) = 0 AS valid FROM (SELECT c_custkey AS profile, list_filter([
        CASE WHEN 9 + c_custkey % 50 <= c_custkey % 30 THEN 'exam must be after start' END, CASE WHEN NOT (c_custkey % 18 > 0 AND c_custkey % 18 <= 16) THEN 'hours must be above 0 and at most 16' END, CASE WHEN c_nationkey % 9 NOT BETWEEN 1 AND 7 THEN 'days must be from 1 to 7' END], lambda x: x IS NOT NULL) AS p FROM customer)""",
    "id_roundtrip": C + "SELECT id, concat('DA', year, '-Q', lpad(CAST(id % 100 AS VARCHAR), 2, '0')) AS name, year AS year_back, CAST(id % 100 AS INTEGER) AS number_back FROM q",
    "tags_parse": C + "SELECT id, count(*) FILTER (rp BETWEEN 2 AND 4) AS n, coalesce(string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY rp) FILTER (rp BETWEEN 2 AND 4), '') AS items FROM t GROUP BY id",
    "review_reasons": f"SELECT doc_id, array_to_string(p, ';') AS reasons, CASE WHEN len(p) > 0 THEN 'needs_review' ELSE 'clean' END AS status FROM (SELECT doc_id, {_R} AS p FROM documents)",
    "needs_review": f"SELECT doc_id, lang, array_to_string(p, ' | ') AS reasons, substr(trim(regexp_replace(text, '\\s+', ' ', 'g')), 1, 160) AS stem_preview FROM (SELECT *, {_R} AS p FROM documents) WHERE len(p) > 0",
    "faceted_search": C + "SELECT u.id, r.section, count(*) AS matching FROM u JOIN r ON r.id = u.id JOIN i ON i.item_id = u.item_id WHERE r.year = 1999 AND r.part = 'DA' AND r.section LIKE 'E%' AND r.type = 'F' AND r.marks = 2 AND contains(lower(i.label), 'an') GROUP BY ALL",
}
