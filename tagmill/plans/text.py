"""Queries of the text and tagging-helper families."""

from __future__ import annotations

from pyspark.sql import functions as F

from tagmill.functions import text as tx
from tagmill.operators import ordering, textops
from tagmill.plans.binding import ctes, items, questions, records, table

C = ctes()


def normalize_text(spark, d):
    docs = table(spark, d, "documents")
    return docs.select("doc_id", F.md5(tx.normalize(F.col("text"))).alias("digest"), F.length(tx.normalize(F.col("text"))).alias("n"))


def content_words(spark, d):
    words = tx.content_words(F.col("text"))
    return table(spark, d, "documents").select("doc_id", F.size(words).alias("n_words"), F.size(F.array_distinct(words)).alias("n_distinct"), F.coalesce(F.get(words, F.lit(0)), F.lit("")).alias("first_word"))


def question_text(spark, d):
    """Turns of a conversation as one plain line each, in order."""
    turns = table(spark, d, "conversations")
    plain = F.concat_ws(" ", F.concat(F.lit("("), "role", F.lit(")")), tx.plain(F.col("text")))
    return turns.withColumn("line", plain).groupBy("conv_id").agg(F.md5(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "line"))), lambda x: x["line"]), "\n")).alias("digest"), F.count(F.lit(1)).alias("turns"))


def item_text(spark, d):
    return items(spark, d).select("item_id", F.format_string("%s. %s (%s)", "section_id", "label", "cluster").alias("item_text"))


def _key_text(spark, d):
    """An answer key per order, with line breaks anywhere between the fields."""
    lines = table(spark, d, "lineitem")
    kind = F.when(F.col("l_returnflag") == "A", "MCQ").when(F.col("l_returnflag") == "N", "MSQ").otherwise("NAT")
    raw = F.when(F.col("l_returnflag") == "A", "B").when(F.col("l_returnflag") == "N", "A; C").otherwise(F.concat(F.col("l_quantity").cast("int").cast("string"), F.lit(" to "), (F.col("l_quantity").cast("int") + 1).cast("string")))
    row = F.concat_ws("\n", F.col("l_linenumber").cast("string"), F.lit("1"), kind, F.lit("DA"), raw, F.when(F.col("l_quantity") > 25, "2").otherwise("1"))
    return lines.select(F.col("l_orderkey").alias("id"), row.alias("row")).groupBy("id").agg(F.concat_ws("  ", F.collect_list("row")).alias("text"))


def answer_key_parse(spark, d):
    """Rows of the keys, their answers read as options or as a range."""
    rows = _key_text(spark, d).select("id", F.explode(textops.answer_key(F.col("text"))).alias("k")).select("id", "k.*")
    rows = rows.withColumn("answer", textops.answer(F.col("type"), F.col("raw")))
    return rows.select("id", "number", "type", "raw", "marks", F.col("answer.kind").alias("kind"), F.coalesce(F.array_join("answer.options", ","), F.lit("")).alias("options"), F.col("answer.low").alias("low"), F.col("answer.high").alias("high"))


def answer_check(spark, d):
    """Orders as answered questions: marks to all, a range on the price, or the set of return flags."""
    flags = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.array_sort(F.collect_set("l_returnflag")).alias("options"), F.collect_set(F.when(F.col("l_quantity") > 10, F.col("l_returnflag"))).alias("picked"))
    rows = table(spark, d, "orders").join(flags, "o_orderkey")
    kind = F.when(F.col("o_orderstatus") == "P", "mta").when(F.col("o_orderstatus") == "O", "range").otherwise("options")
    typed = F.col("o_totalprice") * (1 + (F.col("o_orderkey") % 5) * 0.03)
    right = textops.answer_check(kind, F.col("options"), F.col("o_totalprice") * 0.95, F.col("o_totalprice") * 1.05, F.col("picked"), typed)
    penalty = F.when(right | (kind != "options"), 0.0).otherwise(F.round(F.lit(1) / 3, 4))
    return rows.select(F.col("o_orderkey").alias("id"), kind.alias("kind"), right.alias("is_right"), penalty.alias("penalty"))


def range_expand(spark, d):
    """Headings that give marks to ranges of numbers, spelt out."""
    heads = questions(spark, d).select("id", F.concat(F.lit("Q."), (F.col("id") % 20 + 1).cast("string"), F.lit(" – Q."), (F.col("id") % 20 + 1 + F.col("id") % 4).cast("string"), F.lit(" Carry "), F.when(F.col("marks") == 1, "ONE mark").otherwise("TWO marks"), F.lit(" Each")).alias("heading"))
    return heads.select("id", F.explode(textops.mark_ranges(F.col("heading"))).alias("r")).select("id", "r.number", "r.marks")


def line_classify(spark, d):
    """Lines of documents and of made-up papers by kind."""
    lines = table(spark, d, "documents").select(F.explode(F.split("text", "\n")).alias("line"))
    paper = F.when(F.col("o_orderkey") % 7 == 0, F.concat(F.lit("Q."), (F.col("o_orderkey") % 65 + 1).cast("string"), F.lit(" What"))).when(F.col("o_orderkey") % 7 == 1, "(B) an option").when(F.col("o_orderkey") % 7 == 2, " C ").when(F.col("o_orderkey") % 7 == 3, "General Aptitude (GA)").when(F.col("o_orderkey") % 7 == 4, F.concat(F.lit("Page "), (F.col("o_orderkey") % 30).cast("string"), F.lit(" of 30"))).when(F.col("o_orderkey") % 7 == 5, "Q.1 – Q.5 carry one mark each").otherwise("some text")
    lines = lines.unionByName(table(spark, d, "orders").select(paper.alias("line")))
    return lines.groupBy(textops.line_kind(F.col("line")).alias("kind")).agg(F.count(F.lit(1)).alias("lines"))


def props_json(spark, d):
    """Properties read from JSON, and written again with the value beside them."""
    rows = table(spark, d, "events").withColumn("p", F.from_json("props", "k INT"))
    back = F.from_json(F.to_json(F.struct(F.col("p.k").alias("k"), F.col("event_type").alias("t"))), "k INT, t STRING")
    return rows.select("event_id", F.col("p.k").alias("k"), back["t"].alias("event_type"))


def parse_secondary(spark, d):
    """What a tagger returned, made valid: the primary out, doubles out, three at most."""
    r = records(spark, d)
    given = F.concat(F.array("guess_primary"), F.array("primary"), "ranking", "secondary")
    return r.select("id", F.array_join(F.transform(textops.secondary_tags(F.col("primary"), given), lambda x: x.cast("string")), ",").alias("secondary"))


def prompt_block(spark, d):
    prompts = textops.prompt_block(items(spark, d), "part", "section_id", "item_id", "label")
    return prompts.select("part", F.md5("prompt").alias("digest"), F.length("prompt").alias("n"))


def batch_assign(spark, d):
    """Tagged questions in batches of ten per part, in order of their ids."""
    return ordering.batches(records(spark, d).select("part", "id"), ["part"], "id", 10)


def cache_todo(spark, d):
    """Questions without a cached result of the present prompt version, the first hundred: the run's own limit."""
    asked = questions(spark, d)
    cached = asked.withColumn("version", F.when(F.col("priority") == "1-URGENT", 2).otherwise(1)).filter("version = 2").select("id")
    return asked.join(cached, "id", "left_anti").orderBy("year", "id").limit(100).select("id", "year")


def usage_cost(spark, d):
    """Totals of a run's usage by kind of call."""
    e = table(spark, d, "events").select("event_type", F.round(F.col("value") * 100).cast("bigint").alias("tokens"))
    return e.groupBy("event_type").agg(F.count(F.lit(1)).alias("calls"), F.sum("tokens").alias("tokens"), F.round(F.sum("tokens") / F.count(F.lit(1)), 2).alias("mean_tokens"))


_TITLES = ["Alpha", "Beta", "Gamma"]


def split_sections(spark, d):
    """Texts made of three titled sections, cut at the titles."""
    rows = items(spark, d).select("item_id", F.concat(F.lit("Alpha: "), "label", F.lit(".\nBeta: "), "cluster", F.lit(" and more. Gamma: "), "section_id", F.lit(" end.")).alias("text"))
    return rows.select("item_id", F.explode(textops.split_sections(F.col("text"), _TITLES)).alias("s")).select("item_id", "s.title", "s.body")


def coverage_cursor(spark, d):
    """Whether parts cover a body in order; some bodies hold a word too many, some lack a part."""
    rows = items(spark, d)
    parts = F.array("section_id", "cluster", "label")
    body = F.when(F.col("item_id") % 5 == 0, F.concat_ws(" extra ", "section_id", "cluster", "label")).when(F.col("item_id") % 5 == 1, F.concat_ws(", ", "section_id", "label")).when(F.col("item_id") % 5 == 2, F.concat(F.concat_ws(" and ", "section_id", "cluster", "label"), F.lit("."))).otherwise(F.concat_ws("; ", "section_id", "cluster", "label"))
    return rows.select("item_id", F.coalesce(textops.coverage_cursor(body, parts), F.lit("covered")).alias("result"))


def unicode_clean(spark, d):
    """Digest of every whole text, after a ligature, an invisible operator and a mathematical letter put in front, cleaned."""
    docs = table(spark, d, "documents").select("doc_id", "text", tx.unicode_clean(F.concat(F.lit("ﬁ ⁡𝑥 "), "text")).alias("clean"))
    return docs.select("doc_id", F.md5("clean").alias("digest"), F.length("clean").alias("n"))


_NORM = "regexp_replace(regexp_replace(regexp_replace(replace(replace(replace(replace(replace(replace(replace(replace(text, 'Ɵ', 'ti'), 'Ʃ', 'tt'), 'ﬁ', 'fi'), 'ﬀ', 'ff'), 'ﬂ', 'fl'), 'ﬃ', 'ffi'), 'ﬄ', 'ffl'), '’', ''''), '-\\s*\\n\\s*', '-', 'g'), '-\\s+([a-z])', '-\\1', 'g'), '\\s+', ' ', 'g')"
_LINE = "CASE WHEN trim(line) = '' THEN 'blank' " + " ".join(f"WHEN regexp_matches(line, '{p}') THEN '{k}'" for k, p in textops.LINE_KINDS) + " ELSE 'content' END"

QUERIES = {f.__name__: f for f in (normalize_text, content_words, question_text, item_text, answer_key_parse, answer_check, range_expand, line_classify, props_json, parse_secondary, prompt_block, batch_assign, cache_todo, usage_cost, split_sections, coverage_cursor, unicode_clean)}
ORACLES = {
    "normalize_text": f"SELECT doc_id, md5(trim({_NORM})) AS digest, length(trim({_NORM})) AS n FROM documents",
    "content_words": "SELECT doc_id, len(w) AS n_words, len(list_distinct(w)) AS n_distinct, coalesce(w[1], '') AS first_word FROM (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM documents)",
    "question_text": "SELECT conv_id, md5(string_agg(concat('(', role, ') ', trim(regexp_replace(regexp_replace(regexp_replace(text, '[\\^_]\\{([^}]*)\\}', '\\1', 'g'), '[\\^_]', '', 'g'), '\\s+', ' ', 'g'))), chr(10) ORDER BY turn)) AS digest, count(*) AS turns FROM conversations GROUP BY conv_id",
    "item_text": C + "SELECT item_id, concat(section_id, '. ', label, ' (', cluster, ')') AS item_text FROM i",
    "answer_key_parse": """SELECT l_orderkey AS id, l_linenumber AS number, CASE l_returnflag WHEN 'A' THEN 'MCQ' WHEN 'N' THEN 'MSQ' ELSE 'NAT' END AS type,
        CASE l_returnflag WHEN 'A' THEN 'B' WHEN 'N' THEN 'A;C' ELSE concat(CAST(l_quantity AS INTEGER), ' to ', CAST(l_quantity AS INTEGER) + 1) END AS raw, CASE WHEN l_quantity > 25 THEN 2 ELSE 1 END AS marks,
        CASE WHEN l_returnflag IN ('A', 'N') THEN 'options' ELSE 'range' END AS kind, CASE l_returnflag WHEN 'A' THEN 'B' WHEN 'N' THEN 'A,C' ELSE '' END AS options,
        CASE WHEN l_returnflag NOT IN ('A', 'N') THEN l_quantity END AS low, CASE WHEN l_returnflag NOT IN ('A', 'N') THEN l_quantity + 1 END AS high FROM lineitem""",
    "answer_check": """WITH f AS (SELECT l_orderkey AS id, list_sort(list_distinct(list(l_returnflag))) AS options, list_sort(list_distinct(list(l_returnflag) FILTER (l_quantity > 10))) AS picked FROM lineitem GROUP BY 1),
        k AS (SELECT o_orderkey AS id, CASE o_orderstatus WHEN 'P' THEN 'mta' WHEN 'O' THEN 'range' ELSE 'options' END AS kind, o_totalprice AS p FROM orders),
        r AS (SELECT id, kind, CASE kind WHEN 'mta' THEN true WHEN 'range' THEN p * (1 + (id % 5) * 0.03) BETWEEN p * 0.95 AND p * 1.05 ELSE coalesce(picked = options, false) END AS is_right FROM k JOIN f USING (id))
        SELECT id, kind, is_right, CASE WHEN is_right OR kind <> 'options' THEN 0.0::DOUBLE ELSE 0.3333::DOUBLE END AS penalty FROM r""",
    "range_expand": C + "SELECT id, CAST(unnest(range(id % 20 + 1, id % 20 + 2 + id % 4)) AS INTEGER) AS number, marks FROM q",
    "line_classify": f"""WITH l AS (SELECT unnest(string_split(text, chr(10))) AS line FROM documents UNION ALL SELECT CASE o_orderkey % 7 WHEN 0 THEN concat('Q.', o_orderkey % 65 + 1, ' What') WHEN 1 THEN '(B) an option' WHEN 2 THEN ' C ' WHEN 3 THEN 'General Aptitude (GA)' WHEN 4 THEN concat('Page ', o_orderkey % 30, ' of 30') WHEN 5 THEN 'Q.1 – Q.5 carry one mark each' ELSE 'some text' END FROM orders)
        SELECT {_LINE} AS kind, count(*) AS lines FROM l GROUP BY 1""",
    "props_json": "SELECT event_id, CAST(regexp_extract(props, '\"k\": *(-?[0-9]+)', 1) AS INTEGER) AS k, event_type FROM events",
    "parse_secondary": C + ", o AS (SELECT r.id, r.primary_item, t.item_id, CASE WHEN rq <= 15 THEN rq ELSE 100 + rp END AS o FROM r JOIN t ON t.id = r.id WHERE t.item_id <> r.primary_item AND (rq <= 15 OR rp <= 4)), n AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY o) AS k FROM o) SELECT r.id, coalesce(string_agg(CAST(n.item_id AS VARCHAR), ',' ORDER BY k) FILTER (k <= 3), '') AS secondary FROM r LEFT JOIN n ON n.id = r.id GROUP BY r.id",
    "prompt_block": C + ", s AS (SELECT part, section_id, string_agg(concat(item_id, ' ', label), chr(10) ORDER BY item_id) AS body FROM i GROUP BY ALL), p AS (SELECT part, string_agg(concat('## ', section_id, chr(10), body), chr(10) ORDER BY section_id) AS prompt FROM s GROUP BY part) SELECT part, md5(prompt) AS digest, length(prompt) AS n FROM p",
    "batch_assign": C + "SELECT part, id, (row_number() OVER (PARTITION BY part ORDER BY id) - 1) // 10 AS batch FROM r",
    "cache_todo": C + "SELECT id, year FROM q WHERE priority <> '1-URGENT' ORDER BY year, id LIMIT 100",
    "usage_cost": "SELECT event_type, count(*) AS calls, sum(t) AS tokens, round(sum(t) / count(*), 2) AS mean_tokens FROM (SELECT event_type, CAST(round(value * 100) AS BIGINT) AS t FROM events) GROUP BY event_type",
    "split_sections": C + "SELECT item_id, unnest(['Alpha', 'Beta', 'Gamma']) AS title, unnest([label, concat(cluster, ' and more'), concat(section_id, ' end')]) AS body FROM i",
    "coverage_cursor": C + "SELECT item_id, CASE item_id % 5 WHEN 0 THEN 'gap' WHEN 1 THEN cluster ELSE 'covered' END AS result FROM i",
    "unicode_clean": "SELECT doc_id, md5(c) AS digest, length(c) AS n FROM (SELECT doc_id, concat('fi x ', nfc_normalize(replace(text, chr(160), ' '))) AS c FROM documents)",
}
