"""Text and layout features of synthetic glyphs."""

from __future__ import annotations

from tagmill.operators import glyphs as gl

GLYPH = "page INT, piece INT, text STRING, x0 DOUBLE, y0 DOUBLE, x1 DOUBLE, y1 DOUBLE, baseline DOUBLE, size DOUBLE, font STRING"
GRAPHIC = "page INT, kind STRING, x0 DOUBLE, y0 DOUBLE, x1 DOUBLE, y1 DOUBLE, thin BOOLEAN, curved BOOLEAN"


def page(number, *words, font="Times", one=False):
    """words: (text, x, baseline, size) of single runs; each glyph is 5 wide."""
    out = []
    for piece, (text, x, base, size) in enumerate(words):
        for i, c in enumerate(text):
            out.append((number, 0 if one else piece, c, x + 5.0 * i, base - size * 0.8, x + 5.0 * i + 5.0, base + size * 0.2, float(base), float(size), font))
    return out


def test_texts(spark):
    pages = {
        "x^2 + y_{ij}": page(1, ("x", 0, 100, 10), ("2", 5, 95, 6), (" + y", 10, 100, 10), ("ij", 30, 104, 6), one=True),
        "ab cd\nef": page(2, ("ab", 0, 100, 10), ("cd", 30, 100, 10), ("ef", 0, 120, 10)),
        "a ≠ b": page(3, ("a", 0, 100, 10), ("̸", 20, 100, 10), ("=", 20, 100, 10), ("b", 40, 100, 10)),
        "if\n    x": page(4, ("if", 0, 100, 10), ("x", 20, 120, 10), font="Courier"),
        "é": page(5, ("e", 0, 100, 10), ("́", 5, 100, 10)),
    }
    rows = [*(g for p in pages.values() for g in p), *page(6, ("   ", 0, 100, 10))]
    got = {r.page: (r.text, r.n_lines) for r in gl.rebuild_text(spark.createDataFrame(rows, GLYPH), ["page"]).collect()}
    assert got == {i + 1: (t, t.count("\n") + 1) for i, t in enumerate(pages)}


def test_features(spark):
    glyphs = [
        *page(1, ("a", 0, 100, 10), ("b", 0, 115, 10), font="CMMI10"),  # a fraction
        *page(2, ("a", 0, 100, 10)),  # an underlined letter
        *page(3, ("n", 20, 93, 10), ("k", 20, 107, 10), ("=", 40, 100, 10)),  # a binomial
        *page(4, ("∑", 0, 100, 10), ("i", 0, 110, 6), ("xx", 10, 100, 10)),
        *page(5, ("plain", 0, 100, 10), ("text", 0, 115, 10)),
        *page(6, ("12", 0, 100, 10), ("34", 0, 115, 10), ("plain words all over", 0, 140, 10)),  # two short lines
        *page(7, ("(1", 0, 100, 10), ("2", 5, 112, 10), ("plain words all over", 0, 150, 10)),  # a second matrix row
        *page(8, ("x", 0, 100, 10), ("xx", 5, 100, 10), ("0", 5, 90, 6), font="CMMI10", one=True),
    ]
    bar = ("vector", 0.0, 104.0, 6.0, 104.5, True, False)
    upright = [("vector", 10.0 * i, 0.0, 10.0 * i + 0.5, 20.0, True, False) for i in range(3)]
    graphics = [(1, *bar), (2, *bar), *((3, *u) for u in upright), (4, "image", 0.0, 0.0, 9.0, 9.0, False, False), (5, "vector", 0.0, 0.0, 9.0, 9.0, False, False), (6, "vector", 0.0, 0.0, 30.0, 20.0, False, False), (7, "vector", 0.0, 0.0, 2.0, 2.0, False, True), (8, *upright[0])]
    frames = spark.createDataFrame([(0.0,)], "x DOUBLE")
    found = gl.layout_features(spark.createDataFrame(glyphs, GLYPH), spark.createDataFrame(graphics, GRAPHIC), ["page"], frames).collect()
    got = {r.page: {k: v for k, v in r.asDict().items() if v and k != "page"} for r in found}
    assert got == {
        1: {"has_math": True, "fraction_bars": 1},
        2: {"underline_rules": 1},
        3: {"stacked_glyphs": 1, "has_table": True},
        4: {"display_math_glyphs": 1, "image_count": 1, "has_figure": True},
        5: {"vector_shape_count": 1},
        6: {"vector_shape_count": 1, "has_figure": True, "stacked_math_lines": 1},
        7: {"vector_shape_count": 1, "has_figure": True, "matrix_rows": 1},
        8: {"has_math": True, "deep_scripts": 1},
    }


def test_frames(spark):
    upright = lambda p, x: (p, "vector", x, 0.0, x + 0.5, 20.0, True, False)
    rows = [upright(1, 10.2), upright(2, 9.9), upright(3, 10.0), upright(1, 50.0), upright(1, 50.1)]
    found = gl.frame_columns(spark.createDataFrame([(0, *r) for r in rows], "paper INT, " + GRAPHIC), ["paper"], "page").collect()
    assert [(r.paper, r.x) for r in found] == [(0, 10.0)]
