"""License scan by ordered signature rules (operator 10). DataFrame functions only; no shuffle.

A document is looked at closely if its text holds one of the rules' stems (plain string search). Those texts are read in
segments of ``SEGMENT`` characters, each with ``REACH`` more on both sides, which no match is longer than. In a segment every
rule whose keyword occurs is run from the left; each match that starts in the segment itself is a detection with a start, an
end and a priority. So the work grows with a text's length, however many detections it holds. Detections are ordered by start, longer ones first, then by priority and the rules' order, and one that lies inside an
earlier one of the same or a higher priority is suppressed. The labels of what stays are the method's.

Beside that the three base phrases are counted at every place where their words stand consecutively; words are runs of
letters, digits or any non-ASCII characters of the ASCII-lower-cased text. Base labels always stay.

The score is 1, 0.8 or 0.5 for a best detection of priority 3, 2 or 1, at least 0.8 with a base phrase, and 0 without any.
A null text counts as empty: no words, empty labels, null places. Repeated rows give repeated results; an empty table
gives an empty one. A text of any length is scanned whole.
"""

from __future__ import annotations

from functools import reduce
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagmill.llm.common import two_columns
from tagmill.llm.license_rules import RULES, STEMS, Rule

#: Phrase -> base label.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: A word before lower-casing.
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Characters that are scanned at once, and the longest match of a rule.
SEGMENT = 4096
REACH = 256
#: Characters of the pieces that long texts are cut into before that; a multiple of SEGMENT.
CHUNK = 64 * SEGMENT
#: What parts words after it.
NO_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _n_words(clean: Column) -> Column:
    """Words of a string in which single blanks part them."""
    trimmed = F.trim(clean)
    return F.when(trimmed == "", 0).otherwise(F.length(trimmed) - F.length(F.replace(trimmed, F.lit(" "), F.lit(""))) + 1)


def _rules(rules: list[Rule]) -> Column:
    return F.array(*(F.struct(F.lit(r.label).alias("label"), F.lit(r.priority).alias("priority"), F.lit(i).alias("number"), F.lit(r.keyword).alias("keyword"), F.lit(r.pattern).alias("pattern")) for i, r in enumerate(rules)))


def _detections(text: Column, rule: Column, at: Column) -> Column:
    """All matches of one rule in a segment's text, which starts at ``at``: what stands between the matches gives the starts."""
    empty = F.array().cast(_DETECTIONS)

    def walk(parts: Column) -> Column:
        def add(state: Column, i: Column) -> Column:
            start = state["at"] + F.get(parts["between"], i)
            end = start + F.get(parts["sizes"], i)
            one = F.struct(start.alias("start"), (-end).alias("back"), (-rule["priority"]).alias("rank"), rule["number"].alias("number"), rule["label"].alias("label"))
            return F.struct(end.alias("at"), F.concat(state["out"], F.array(one)).alias("out"))

        folded = F.aggregate(F.sequence(F.lit(0), F.size(parts["sizes"]) - 1), F.struct(at.alias("at"), empty.alias("out")), add, lambda s: s["out"])
        return F.when(F.size(parts["sizes"]) > 0, folded).otherwise(empty)

    sizes = F.transform(F.regexp_extract_all(text, rule["pattern"], F.lit(0)), F.length)
    between = F.transform(F.split(text, rule["pattern"], -1), F.length)
    # an array of one: what a lambda gets is computed once, what stands in its body at every step
    return F.flatten(F.transform(F.array(F.struct(between.alias("between"), sizes.alias("sizes"))), walk))


_DETECTIONS = "array<struct<start:int,back:int,rank:int,number:int,label:string>>"


def _cut(text: Column, first: Column, at: Column, size: int) -> Column:
    """The segment that begins at ``first``, of a text that begins at ``at``: first, from (where its own text begins), text."""
    begin = F.greatest(first - REACH, at)
    return F.struct(first.alias("first"), begin.alias("from"), F.substr(text, begin - at + 1, F.lit(size + 2 * REACH)).alias("text"))


def _in_segments(plain: Column, rules: Column) -> Column:
    """Detections of all rules in a text. A segment's own are those that start in it.

    Finding a place in a string takes time in proportion to the place, so long texts are cut twice.
    """
    chunks = F.transform(F.sequence(F.lit(0), F.greatest(F.length(plain) - 1, F.lit(0)), F.lit(CHUNK)), lambda x: _cut(plain, x, F.lit(0), CHUNK))

    def segments(chunk: Column) -> Column:
        stop = F.least(chunk["first"] + CHUNK, chunk["from"] + F.length(chunk["text"]))
        firsts = F.sequence(chunk["first"], F.greatest(stop - 1, chunk["first"]), F.lit(SEGMENT))
        return F.transform(firsts, lambda x: _cut(chunk["text"], x, chunk["from"], SEGMENT))

    def detections(segment: Column) -> Column:
        hits = F.filter(rules, lambda r: F.contains(segment["text"], r["keyword"]))
        found = F.flatten(F.transform(hits, lambda r: _detections(segment["text"], r, segment["from"])))
        return F.filter(found, lambda d: (d["start"] >= segment["first"]) & (d["start"] < segment["first"] + SEGMENT))

    return F.flatten(F.transform(F.flatten(F.transform(chunks, segments)), detections))


def _unsuppressed(ordered: Column) -> Column:
    """Labels and best priority of the detections that no earlier one of their rank contains.

    Every earlier detection starts no later, so it contains the present one if it ends no sooner: one running end for
    each priority is enough.
    """

    def step(state: Column, d: Column) -> Column:
        end, priority = -d["back"], -d["rank"]
        inside = F.when(priority == 3, state["e3"]).when(priority == 2, F.greatest(state["e3"], state["e2"])).otherwise(F.greatest(state["e3"], state["e2"], state["e1"])) >= end
        ends = [F.when(priority == p, F.greatest(state[f"e{p}"], end)).otherwise(state[f"e{p}"]).alias(f"e{p}") for p in (1, 2, 3)]
        labels = F.when(inside, state["labels"]).otherwise(F.array_union(state["labels"], F.array(d["label"])))
        return F.struct(*ends, labels.alias("labels"), F.when(inside, state["best"]).otherwise(F.greatest(state["best"], priority)).alias("best"))

    start = F.struct(*(F.lit(-1).alias(f"e{p}") for p in (1, 2, 3)), F.array().cast("array<string>").alias("labels"), F.lit(0).alias("best"))
    return F.aggregate(ordered, start, step)


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", rules: list[Rule] = RULES, stems: list[str] = STEMS) -> DataFrame:
    """Per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    rows = two_columns(docs, key, text).withColumn("text", F.coalesce("text", F.lit("")))
    rough = F.lower("text")
    rows = rows.select("doc_id", "text", F.regexp_count("text", F.lit(WORD)).cast("bigint").alias("n_words"), rough.alias("rough"))
    gate = reduce(Column.__or__, (F.contains(F.col("rough"), F.lit(s)) for s in stems))
    rows = rows.select("doc_id", "n_words", F.when(gate, F.translate("text", ascii_uppercase, ascii_lowercase)).alias("low"))
    rows = rows.select(
        "doc_id",
        "n_words",
        F.concat(F.lit(" "), F.trim(F.regexp_replace("low", NO_WORD, " ")), F.lit(" ")).alias("words"),
        F.replace(F.regexp_replace("low", r"\s+", " "), F.lit("licence"), F.lit("license")).alias("plain"),
    )
    for i, phrase in enumerate(BASE):
        rows = rows.withColumn(f"p{i}", F.split("words", rf"(?<= ){phrase}(?= )", -1))
    n = [F.coalesce(F.size(f"p{i}") - 1, F.lit(0)) for i in range(len(BASE))]
    n = [F.greatest(x, F.lit(0)) for x in n]  # the size of null is -1
    first = [F.when(n[i] > 0, _n_words(F.get(f"p{i}", F.lit(0)))) for i in range(len(BASE))]
    last = [F.when(n[i] > 0, F.col("n_words") - _n_words(F.element_at(f"p{i}", -1)) - len(p.split())) for i, p in enumerate(BASE)]
    base = F.array_sort(F.filter(F.array(*(F.when(n[i] > 0, F.lit(x)) for i, x in enumerate(BASE.values()))), lambda x: x.isNotNull()))
    rows = rows.select(
        "doc_id", "n_words", sum(n, F.lit(0)).cast("bigint").alias("n_base"), F.least(*first).cast("bigint").alias("first_word"), F.greatest(*last).cast("bigint").alias("last_word"), base.alias("base"), "plain"
    )
    rows = rows.withColumn("detections", F.when(F.col("plain").isNotNull(), F.array_sort(_in_segments(F.col("plain"), _rules(rules)))))
    rows = rows.withColumn("found", _unsuppressed(F.col("detections")))
    labels = F.array_sort(F.array_union("base", F.coalesce("found.labels", F.array().cast("array<string>"))))
    best = F.coalesce("found.best", F.lit(0))
    score = F.greatest(F.when(best == 3, 1.0).when(best == 2, 0.8).when(best == 1, 0.5).otherwise(0.0), F.when(F.col("n_base") > 0, 0.8).otherwise(0.0))
    return rows.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base", ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"), score.alias("score"))
