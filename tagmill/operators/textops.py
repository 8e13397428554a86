"""Parsers and classifiers of semi-structured text."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What is printed on papers and keys.
SESSION_TYPES = ("MCQ", "MSQ", "NAT")
PARTS = ("GA", "DA")
LETTER = "[A-D]"
DASH = "[–-]+"
NUMBER = r"-?\d+(?:\.\d+)?"
HEADINGS = (r"general aptitude(?:\s*\(ga\))?", r"end of (?:the )?question paper.*")
FURNITURE = (r"page \d+ of \d+", r"organi[sz]ing institute\b.*")
COUNTS = {"one": 1, "two": 2}


def _one_of(*forms: str) -> str:
    return "(?:" + "|".join(forms) + ")"


#: Fields of a row of an answer key, in order, parted by single blanks.
KEY_FIELDS = {
    "number": r"\d{1,2}",
    "session": r"\d{1,2}",
    "type": _one_of(*SESSION_TYPES),
    "section": _one_of(*PARTS),
    "raw": _one_of("MTA", f"{NUMBER} ?to ?{NUMBER}", f"{LETTER}(?: ?; ?{LETTER})*"),
    "marks": "[12]",
}
KEY_ROW = "(?:^| )" + " ".join(f"({form})" for form in KEY_FIELDS.values()) + "(?= |$)"


def _question(number: str = r"\d+") -> str:
    return rf"q\.\s?{number}"


def _carries(number: str = r"\d+") -> str:
    """A span of question numbers, as a heading gives it."""
    return rf"{_question(number)}\s*{DASH}\s*{_question(number)}\s+carry"


def _line(*forms: str, whole: bool = True) -> str:
    """A line that is one of the forms, or begins with one as a word of its own."""
    return r"^\s*" + _one_of(*forms) + (r"\s*$" if whole else r"(?:\s|$)")


#: Lines of a paper: kinds in the order in which they are tried; capitals count where only they are printed.
LINE_KINDS: Sequence[tuple[str, str]] = (
    ("anchor", _line(_question(r"\d{1,2}").replace("q", "Q"), whole=False)),
    ("label", _line(rf"\({LETTER}\)", whole=False)),
    ("bare_label", _line(LETTER)),
    ("heading", "(?i)" + _line(*HEADINGS, rf"{_carries()}\b.*")),
    ("furniture", "(?i)" + _line(*FURNITURE)),
)


def answer_key(text: Column) -> Column:
    """Array of (number, session, type, section, raw, marks): the rows of an answer key, wherever line breaks fall."""
    flat = F.trim(F.regexp_replace(text, r"\s+", " "))

    def row(x: Column) -> Column:
        parts = {name: F.regexp_extract(x, KEY_ROW, i) for i, name in enumerate(KEY_FIELDS, 1)}
        parts["raw"] = F.regexp_replace(parts["raw"], r" ?; ?", ";")
        return F.struct(*((v.cast("int") if k in ("number", "session", "marks") else v).alias(k) for k, v in parts.items()))

    return F.transform(F.regexp_extract_all(flat, F.lit(KEY_ROW), F.lit(0)), row)


def answer(kind: Column, raw: Column) -> Column:
    """Struct kind, options, low, high of a raw key."""
    span = rf"^({NUMBER}) ?to ?({NUMBER})$"
    options = F.transform(F.split(raw, ";"), lambda x: F.trim(x))
    is_range = (kind == "NAT") & (raw != "MTA")
    return F.struct(
        F.when(raw == "MTA", "mta").when(kind == "NAT", "range").otherwise("options").alias("kind"),
        F.when((raw != "MTA") & (kind != "NAT"), options).alias("options"),
        F.when(is_range, F.regexp_extract(raw, span, 1).try_cast("double")).alias("low"),
        F.when(is_range, F.regexp_extract(raw, span, 2).try_cast("double")).alias("high"),
    )


def answer_check(answer_kind: Column, options: Column, low: Column, high: Column, picked: Column, typed: Column) -> Column:
    """Whether a reply is right: marks to all always, a range inclusively, options as a set."""
    return F.when(answer_kind == "mta", True).when(answer_kind == "range", F.coalesce(typed.between(low, high), F.lit(False))).otherwise(F.coalesce(F.array_sort(F.array_distinct(picked)) == F.array_sort(options), F.lit(False)))


def mark_ranges(heading: Column) -> Column:
    """Array of (number, marks) that a heading like "Q.11 - Q.35 carry one mark" spells out."""
    pattern = "(?i)" + _carries(r"(\d+)") + rf"\s+({'|'.join(COUNTS)})\s+marks?"
    first, last, word = (F.regexp_extract(heading, pattern, g) for g in (1, 2, 3))
    marks = F.create_map(*(F.lit(x) for pair in COUNTS.items() for x in pair))[F.lower(word)]
    numbers = F.sequence(first.cast("int"), last.cast("int"))
    return F.when((first != "") & (first.try_cast("int") <= last.try_cast("int")), F.transform(numbers, lambda n: F.struct(n.alias("number"), marks.alias("marks"))))


def line_kind(line: Column) -> Column:
    kind = F.when(F.trim(line) == "", "blank")
    for name, pattern in LINE_KINDS:
        kind = kind.when(line.rlike(pattern), name)
    return kind.otherwise("content")


def review_reasons(rules: Mapping[str, Column]) -> Column:
    """Names of the rules that hold, in the rules' order."""
    return F.filter(F.array(*(F.when(F.coalesce(c, F.lit(False)), F.lit(name)) for name, c in rules.items())), lambda x: x.isNotNull())


def secondary_tags(primary: Column, given: Column, allowed: Column | None = None, most: int = 3) -> Column:
    """Secondaries in order, once each, without the primary and what isn't allowed, ``most`` at most (a tag's own limit)."""
    kept = F.filter(F.array_distinct(given), lambda x: x != primary)
    if allowed is not None:
        kept = F.filter(kept, lambda x: F.array_contains(allowed, x))
    return F.slice(kept, 1, most)


def prompt_block(items: DataFrame, group: str, section: str, item_id: str, label: str) -> DataFrame:
    """One text per group: items in order, each section's ones under its header."""
    per_section = items.groupBy(group, section).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(item_id).alias("i"), F.col(label).alias("l")))), lambda x: F.concat_ws(" ", x["i"].cast("string"), x["l"])), "\n").alias("body"))
    blocks = F.transform(F.array_sort(F.collect_list(F.struct(F.col(section).alias("s"), "body"))), lambda x: F.concat(F.lit("## "), x["s"], F.lit("\n"), x["body"]))
    return per_section.groupBy(group).agg(F.array_join(blocks, "\n").alias("prompt"))


def coverage_cursor(body: Column, parts: Column) -> Column:
    """First part that isn't found after the one before it, or 'gap' if words are left between parts; null if all is covered.

    A fold over the parts with a cursor into the body; only separators may stand between parts.
    """
    separators = r"[\s,;:.()–—-]+|\band\b"
    leftover = lambda x: F.regexp_replace(x, separators, "") != ""

    def step(state: Column, part: Column) -> Column:
        found = F.call_function("locate", part, body, state["at"])
        gap = F.substr(body, state["at"], F.greatest(found - state["at"], F.lit(0)))
        fault = F.when(state["fault"].isNotNull(), state["fault"]).when(found == 0, part).when(leftover(gap), F.lit("gap"))
        return F.struct(F.when(found > 0, found + F.length(part)).otherwise(state["at"]).alias("at"), fault.alias("fault"))

    end = F.aggregate(parts, F.struct(F.lit(1).alias("at"), F.lit(None).cast("string").alias("fault")), step)
    return F.when(end["fault"].isNotNull(), end["fault"]).when(leftover(F.substr(body, end["at"], F.length(body))), F.lit("gap"))


def split_sections(text: Column, titles: Sequence[str]) -> Column:
    """Array of (title, body): the text cut at known titles, in order; null if one isn't found after the one before."""

    starts = F.aggregate(
        F.array(*map(F.lit, titles)),
        F.struct(F.lit(1).alias("at"), F.array().cast("array<int>").alias("found")),
        lambda s, t: F.struct((F.call_function("locate", t, text, s["at"]) + F.length(t)).alias("at"), F.concat(s["found"], F.array(F.call_function("locate", t, text, s["at"]))).alias("found")),
        lambda s: s["found"],
    )
    cuts = F.struct(starts.alias("found"))["found"]
    names = F.array(*map(F.lit, titles))
    end = lambda i: F.coalesce(F.get(cuts, i + 1), F.length(text) + 1)
    body = lambda t, i: F.substr(text, F.get(cuts, i) + F.length(t), end(i) - F.get(cuts, i) - F.length(t))
    clean = lambda x: F.trim(F.regexp_replace(x, r"\s+", " "), F.lit(" .:"))
    return F.when(~F.array_contains(cuts, 0), F.transform(names, lambda t, i: F.struct(t.alias("title"), clean(body(t, i)).alias("body"))))
