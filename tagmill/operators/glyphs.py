"""Page text from glyphs: visual lines, rebuilt text, and counts of mathematical layout.

Columns of a glyph: the page's (``by``), piece, text, x0, y0, x1, y1, baseline, size, font; of a graphic: the page's, kind
(image or vector), x0, y0, x1, y1, thin, curved. Everything is relational but the text of a line, which is a walk over its
glyphs. A page is bounded by what is printed on it, so a page's boxes or glyphs may meet in one row.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator, Sequence
from itertools import groupby
from operator import itemgetter
from statistics import median

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tagmill.sources.scratch import written

# Fixed values of the layout rules: shares of a font size or of a page, and points.
LINE_SHARE = 0.45
SCRIPT_SHARE = 0.85
SCRIPT_SHIFT = 1.5
GAP_SHARE = 0.22
ACCENT_REACH = 1.0
DEEP_SHIFT = 0.6
BAR_WIDTH = (3.0, 250.0)
BAR_REACH = 12.0
UNDERLINE_WIDTH = 5.0
UNDERLINE_REACH = 4.0
TOUCH = 1.0
SHORT_SHARE = 0.45
MATH_SHARE = 0.6
STACK_GAP = 6.0
ROW_REACH = 1.6
BRACKET_GAP = (-3.0, 25.0)
STACK_OVERLAP = 0.4
STACK_HEIGHT = (0.75, 1.6)
STACK_MIDDLE = 0.25
STACK_REACH = 40.0
FIGURE_SHAPES = 3
FIGURE_AREA = 400.0
TABLE_RULE = 8.0
TABLE_RULES = 2
FRAME_PAGES = 3
MATH_FONT = r"(?i)cambria\s?math|^cm(mi|sy|ex|r)\d|^msbm|^msam|^symbol"
MONO_FONT = r"(?i)courier|consolas|mono|^cmtt|nimbusmon|menlo|inconsolata"
TALL_FONT = r"(?i)^cmex"
TALL_SIGNS = "[⎛-⎳]"
OPERATORS = "√∑∏∫∮⋃⋂"
BRACKETS = "[({|⌈⌊⟨‖"
SLASH = "̸"

FEATURES = (
    "has_math", "has_code", "image_count", "vector_shape_count", "has_figure", "has_table", "fraction_bars", "stacked_math_lines", "stacked_glyphs", "matrix_rows", "deep_scripts", "display_math_glyphs", "underline_rules",
)


def line_numbers(boxes: DataFrame, by: Sequence[str], id_: str) -> DataFrame:
    """by, id_, line: a box (y0, y1, x0) joins the line whose first box is close to it in height; lines count from 0.

    A fold over the page's boxes in order of their centres, with the head of the present line as its state.
    """
    by, kind = list(by), dict(boxes.dtypes)[id_]
    box = F.struct(((F.col("y0") + F.col("y1")) / 2).alias("centre"), "x0", F.col(id_).alias("id"), (F.col("y1") - F.col("y0")).alias("height"))
    first = F.struct(F.lit(-1).alias("line"), F.lit(0.0).alias("centre"), F.lit(0.0).alias("height"), F.array().cast(f"array<struct<id:{kind},line:int>>").alias("out"))

    def join(state: Column, b: Column) -> Column:
        new = (state["line"] < 0) | (b["centre"] - state["centre"] > LINE_SHARE * F.greatest(state["height"], b["height"]))
        line = F.when(new, state["line"] + 1).otherwise(state["line"])
        head = [F.when(new, b[c]).otherwise(state[c]).alias(c) for c in ("centre", "height")]
        return F.struct(line.alias("line"), *head, F.concat(state["out"], F.array(F.struct(b["id"].alias("id"), line.alias("line")))).alias("out"))

    folded = F.aggregate(F.array_sort(F.collect_list(box)), first, join, lambda s: s["out"])
    return boxes.groupBy(*by).agg(folded.alias("__l")).select(*by, F.explode("__l").alias("__l")).select(*by, F.col("__l.id").alias(id_), F.col("__l.line").alias("line"))


def line_gaps(boxes: DataFrame, by: Sequence[str], id_: str) -> DataFrame:
    """Per box its line, and the gap from the line above (null for the first)."""
    by = list(by)
    rows = boxes.join(line_numbers(boxes, by, id_), [*by, id_])
    lines = rows.groupBy(*by, "line").agg(F.min("y0").alias("__top"), F.max("y1").alias("__end"))
    gap = F.col("__top") - F.lag("__end").over(Window.partitionBy(*by).orderBy("line"))
    return rows.join(lines.select(*by, "line", gap.alias("gap")), [*by, "line"]).select(*by, id_, "line", "gap")


def with_lines(glyphs: DataFrame, by: Sequence[str]) -> DataFrame:
    """Glyphs with their flags and line. Pieces are grouped by the box of their visible glyphs; a piece without any has no line."""
    by = list(by)
    flags = {"math": F.col("font").rlike(MATH_FONT), "mono": F.col("font").rlike(MONO_FONT), "tall": F.col("font").rlike(TALL_FONT) | F.col("text").rlike(f"^{TALL_SIGNS}$"), "blank": ~F.col("text").rlike(r"(?U)\S")}
    rows = glyphs.withColumns({k: F.coalesce(v, F.lit(False)) for k, v in flags.items()})
    boxes = rows.filter("NOT blank").groupBy(*by, "piece").agg(F.min("y0").alias("y0"), F.max("y1").alias("y1"), F.min("x0").alias("x0"))
    return rows.join(line_numbers(boxes, by, "piece"), [*by, "piece"])


def line_bases(lined: DataFrame, by: Sequence[str]) -> DataFrame:
    """by, line, main (the largest size in halves of a point that two glyphs have, else the largest), base (median baseline of that size)."""
    by = [*by, "line"]
    sizes = lined.filter("NOT blank").groupBy(*by, (F.bround(F.col("size") * 2) / 2).alias("main")).agg(F.count(F.lit(1)).alias("n"), F.median("baseline").alias("base"))
    return sizes.groupBy(*by).agg(F.max_by(F.struct("main", "base"), F.struct(F.col("n") >= 2, "main")).alias("b")).select(*by, "b.main", "b.base")


def _accents(marks: list[dict], letters: list[dict]) -> dict[int, str]:
    """Place among the letters -> marks on it: each on the letter that ends before it; a negating slash on the one it precedes."""
    out: dict[int, str] = {}
    for m in marks:
        if m["text"] == SLASH:
            near = next((i for i, c in enumerate(letters) if c["x0"] >= m["x0"] - ACCENT_REACH), None)
        else:
            near = max((i for i, c in enumerate(letters) if c["x1"] <= m["x0"] + ACCENT_REACH), key=lambda i: letters[i]["x1"], default=None)
        if near is not None:
            out[near] = out.get(near, "") + m["text"]
    return out


def line_text(line: list[dict]) -> str:
    """Text of the glyphs of one line in order of x0: blanks at gaps, raised runs as ^{..}, lowered ones as _{..}, a single
    glyph without braces, accents composed."""
    marks = [c for c in line if c["text"] and unicodedata.category(c["text"][0]) == "Mn"]
    rest = [c for c in line if c not in marks] if marks else line
    accents = _accents(marks, [c for c in rest if not c["blank"]])
    spelt: list[tuple[str, str]] = []  # level (base, ^ or _), text
    before, n = None, 0
    for c in rest:
        if c["blank"]:
            spelt.append(("base", " "))
            before = None
            continue
        shift = c["baseline"] - c["base"]
        script = c["size"] < SCRIPT_SHARE * c["main"] and abs(shift) > SCRIPT_SHIFT
        level = ("^" if shift < 0 else "_") if script else "base"
        if before is not None:
            wide = c["x0"] - before["x1"] > GAP_SHARE * min(c["size"], before["size"])
            # after a formula's script a plain word begins
            word = not script and spelt[-1][0] != "base" and before["math"] and not c["math"] and c["text"].isalpha()
            if word or wide and (not script or spelt[-1][0] == level):
                spelt.append((level, " "))
        spelt.append((level, c["text"] + accents.get(n, "")))
        before, n = c, n + 1
    runs = [(level, "".join(t for _, t in run)) for level, run in groupby(spelt, key=itemgetter(0))]
    out = "".join(t if level == "base" else f"{level}{t}" if len(t) == 1 else f"{level}{{{t}}}" for level, t in runs)
    return re.sub(r"[ \t]+", " ", unicodedata.normalize("NFC", out)).strip()


def page_text(page: list[dict]) -> str:
    """Lines of a page, top to bottom, from its glyphs in order of line and x0; with code on it, each keeps its indentation."""
    lines = [(line_text(own), [c["x0"] for c in own if not c["blank"]]) for own in (list(g) for _, g in groupby(page, key=itemgetter("line")))]
    lines = [(t, x) for t, x in lines if t and x]
    code = [c["x1"] - c["x0"] for c in page if c["mono"] and not c["blank"]]
    if not code or not lines:
        return "\n".join(t for t, _ in lines)
    left, unit = min(min(x) for _, x in lines), median(code) or 1.0
    return "\n".join(" " * max(0, round((min(x) - left) / unit)) + t for t, x in lines)


def rebuild_text(glyphs: DataFrame, by: Sequence[str]) -> DataFrame:
    """Per page with a visible glyph: its number of lines, and its text."""
    by = list(by)
    lined = with_lines(glyphs, by)
    # glyphs at one place are in order of their piece and text
    order = ["line", "x0", "piece", "text", "x1", "baseline", "size", "math", "mono", "blank", "main", "base"]
    pages = lined.join(line_bases(lined, by), [*by, "line"]).groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(*order))).alias("__glyphs"))
    kinds = dict(pages.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [page_text(p) for p in batch.column(len(by)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(by)], pa.array([len(t.split("\n")) if t else 0 for t in texts], pa.int32()), pa.array(texts, pa.string())], [*by, "n_lines", "text"])

    return pages.mapInArrow(run, ", ".join(f"{c} {kinds[c]}" for c in by) + ", n_lines int, text string")


def frame_columns(graphics: DataFrame, paper: Sequence[str], page: str) -> DataFrame:
    """paper, x: places of vertical rules that several pages of a paper share; they frame questions and are no tables."""
    upright = graphics.filter("kind = 'vector' AND thin AND y1 - y0 > x1 - x0")
    found = upright.groupBy(*paper, F.bround("x0").alias("x")).agg(F.count_distinct(page).alias("n"))
    return found.filter(F.col("n") >= FRAME_PAGES).select(*paper, "x")


def _in_order(low: Column, x: Column, high: Column) -> Column:
    return (low <= x) & (x <= high)


def _graphic_features(graphics: DataFrame, by: list[str]) -> DataFrame:
    """Counts of images and shapes; ``framed`` marks rules of question frames."""
    width, height = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    count = lambda c: F.sum(F.when(c, 1).otherwise(0)).cast("int")
    image, shape = F.col("kind") == "image", (F.col("kind") == "vector") & ~F.col("thin")
    inner = (F.col("kind") == "vector") & F.col("thin") & (height > width) & (height >= TABLE_RULE) & ~F.col("framed")
    found = graphics.groupBy(*by).agg(count(image).alias("image_count"), count(shape).alias("vector_shape_count"), count(shape & F.col("curved")).alias("curves"), F.sum(F.when(shape, width * height).otherwise(0.0)).alias("area"), count(inner).alias("inner"))
    figure = (F.col("image_count") > 0) | (F.col("curves") > 0) | (F.col("vector_shape_count") >= FIGURE_SHAPES) | (F.col("area") >= FIGURE_AREA)
    return found.select(*by, "image_count", "vector_shape_count", figure.alias("has_figure"), (F.col("inner") >= TABLE_RULES).alias("has_table"))


def _rule_features(visible: DataFrame, graphics: DataFrame, by: list[str]) -> DataFrame:
    """Rules with formula glyphs above and below, and rules close under plain ones: joins of boxes on a page."""
    width = F.col("x1") - F.col("x0")
    flat = graphics.filter(F.col("thin") & (F.col("kind") == "vector") & (width >= F.col("y1") - F.col("y0")))
    flat = flat.select(*by, *(F.col(c).alias(f"r{c}") for c in ("x0", "y0", "x1", "y1")), width.alias("width"), F.monotonically_increasing_id().alias("rule"))
    met = flat.join(visible.select(*by, "x0", "y0", "x1", "y1", "math"), by)
    over = F.col("math") & (F.col("x1") > F.col("rx0")) & (F.col("x0") < F.col("rx1"))
    above = over & _in_order(F.col("ry0") - BAR_REACH, F.col("y1"), F.col("ry1") + TOUCH)
    below = over & _in_order(F.col("ry0") - TOUCH, F.col("y0"), F.col("ry1") + BAR_REACH)
    under = ~F.col("math") & (F.col("x0") >= F.col("rx0") - TOUCH) & (F.col("x1") <= F.col("rx1") + TOUCH) & _in_order(F.col("ry0") - UNDERLINE_REACH, F.col("y1"), F.col("ry1") + TOUCH)
    of_rule = met.groupBy(*by, "rule", "width").agg(F.max(above).alias("above"), F.max(below).alias("below"), F.max(under).alias("under"))
    bar = F.col("above") & F.col("below") & F.col("width").between(*BAR_WIDTH)
    line = F.col("under") & (F.col("width") >= UNDERLINE_WIDTH)
    return of_rule.groupBy(*by).agg(F.sum(bar.cast("int")).cast("int").alias("fraction_bars"), F.sum(line.cast("int")).cast("int").alias("underline_rules"))


def _line_features(lined: DataFrame, visible: DataFrame, by: list[str]) -> list[DataFrame]:
    """Deep scripts; short formula lines close above each other; short lines beside another line's bracket."""
    deep = visible.join(line_bases(lined, by), [*by, "line"]).filter((F.col("size") < SCRIPT_SHARE * F.col("main")) & (F.abs(F.col("baseline") - F.col("base")) > DEEP_SHIFT * F.col("main")))
    deep = deep.groupBy(*by).agg(F.count(F.lit(1)).cast("int").alias("deep_scripts"))
    formula = F.avg((F.col("math") | F.col("text").rlike(r"(?U)^\d+$")).cast("double"))
    brackets = F.collect_list(F.when(F.col("text").isin(*BRACKETS), F.col("x1")))
    lines = visible.groupBy(*by, "line").agg(*(F.min(c).alias(c) for c in ("x0", "y0")), *(F.max(c).alias(c) for c in ("x1", "y1", "size")), formula.alias("share"), brackets.alias("brackets"))
    page = Window.partitionBy(*by)
    width = F.max("x1").over(page) - F.min("x0").over(page)
    lines = lines.withColumn("short", (width > 0) & (F.col("x1") - F.col("x0") < SHORT_SHARE * width) & (F.col("share") >= MATH_SHARE)).withColumn("centre", (F.col("y0") + F.col("y1")) / 2)
    short = lines.filter("short")
    last = Window.partitionBy(*by).orderBy("line")
    gap = F.col("y0") - F.lag("y1").over(last)
    close = (F.lag("x0").over(last) < F.col("x1")) & (F.col("x0") < F.lag("x1").over(last)) & _in_order(F.lit(0.0), gap, F.lit(STACK_GAP))
    stacked = short.withColumn("close", close).filter("close").groupBy(*by).agg(F.count(F.lit(1)).cast("int").alias("stacked_math_lines"))
    other = lines.filter(F.size("brackets") > 0).select(*by, F.col("line").alias("other"), F.col("centre").alias("middle"), F.col("brackets").alias("beside"))
    near = F.exists("beside", lambda x: _in_order(F.lit(BRACKET_GAP[0]), F.col("x0") - x, F.lit(BRACKET_GAP[1])))
    rise = F.abs(F.col("middle") - F.col("centre"))
    rows = short.join(other, by).filter((F.col("line") != F.col("other")) & (rise > 0) & (rise <= ROW_REACH * F.col("size")) & near)
    return [deep, stacked, rows.groupBy(*by).agg(F.count_distinct("line").cast("int").alias("matrix_rows"))]


def _stacked_glyphs(visible: DataFrame, by: list[str]) -> DataFrame:
    """Pairs of glyphs above each other that have a full-size glyph on a baseline between them: a witness for each pair."""
    cut = lambda name: visible.select(*by, *(F.col(c).alias(f"{name}_{c}") for c in ("glyph", "x0", "x1", "baseline", "size")))
    wide = lambda name: F.col(f"{name}_x1") - F.col(f"{name}_x0")
    shared = F.least("a_x1", "b_x1") - F.greatest("a_x0", "b_x0")
    narrow = F.least(wide("a"), wide("b"))
    pairs = cut("a").join(cut("b"), by).filter((F.col("a_glyph") < F.col("b_glyph")) & (narrow > 0) & (shared > 0) & (shared >= STACK_OVERLAP * narrow))
    top, bottom = F.least("a_baseline", "b_baseline"), F.greatest("a_baseline", "b_baseline")
    size, y, gap = F.col("m_size"), F.col("m_baseline"), bottom - top
    full = (size >= SCRIPT_SHARE * F.greatest("a_size", "b_size")) & _in_order(STACK_HEIGHT[0] * size, gap, STACK_HEIGHT[1] * size)
    between = _in_order(top + STACK_MIDDLE * gap, y, bottom - STACK_MIDDLE * gap)
    beside = (F.col("m_x1") >= F.least("a_x0", "b_x0") - STACK_REACH) & (F.col("m_x0") <= F.greatest("a_x1", "b_x1") + STACK_REACH)
    seen = pairs.join(cut("m"), by).filter(full & between & beside).select(*by, "a_glyph", "b_glyph").distinct()
    return seen.groupBy(*by).agg(F.count(F.lit(1)).cast("int").alias("stacked_glyphs"))


def layout_features(glyphs: DataFrame, graphics: DataFrame, by: Sequence[str], frames: DataFrame | None = None, paper: Sequence[str] = ()) -> DataFrame:
    """Per page with a visible glyph the 13 counts and flags of its layout. frames: paper, x of vertical rules that don't count."""
    by = list(by)
    lined = written(with_lines(glyphs, by).withColumn("glyph", F.monotonically_increasing_id()), "lined-glyphs")  # read by every count
    visible = lined.filter("NOT blank")
    graphics = graphics.withColumn("framed", F.lit(False))
    if frames is not None:
        known = frames.select(*paper, F.col("x").alias("__x"), F.lit(True).alias("__framed"))
        graphics = graphics.withColumn("__x", F.bround("x0")).join(known, [*paper, "__x"], "left").withColumn("framed", F.coalesce("__framed", F.lit(False)))
    signs = (F.col("tall") | F.col("text").isin(*OPERATORS)).cast("int")
    out = visible.groupBy(*by).agg(F.max("math").alias("has_math"), F.max("mono").alias("has_code"), F.sum(signs).cast("int").alias("display_math_glyphs"))
    for part in (_graphic_features(graphics, by), _rule_features(visible, graphics, by), *_line_features(lined, visible, by), _stacked_glyphs(visible, by)):
        out = out.join(part, by, "left")
    zero = lambda c: F.coalesce(c, F.lit(False) if c.startswith("has_") else F.lit(0)).alias(c)
    return out.select(*by, *map(zero, FEATURES))
