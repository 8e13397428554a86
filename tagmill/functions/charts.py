"""Inputs of charts and pages: axis ticks, routes, geometry flags."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Steps of an axis, times a power of ten.
STEPS = (1.0, 2.0, 2.5, 5.0, 10.0)


def ticks(top: Column, count: int = 5) -> Column:
    """Multiples of a round step from 0 to the first at or above ``top``, about ``count`` of them; only 0 without a positive top."""
    rough = top / count
    power = F.pow(F.lit(10.0), F.floor(F.log10(rough)))
    step = F.lit(STEPS[-1]) * power
    for s in reversed(STEPS[:-1]):
        step = F.when(F.lit(s) * power >= rough * (1 - 1e-9), F.lit(s) * power).otherwise(step)
    n = F.ceil(top / step - 1e-9).cast("int")
    return F.when(top > 0, F.transform(F.sequence(F.lit(0), n), lambda i: i * step)).otherwise(F.array(F.lit(0.0)))


def route(path: Column) -> Column:
    """Struct view, id of a page address such as "#/questions/DA2024-Q07"; unknown ones lead to the map."""
    parts = F.split(F.regexp_replace(path, r"^#?/?", ""), "/")
    view = F.get(parts, F.lit(0))
    known = view.isin("map", "trends", "questions", "planner", "method")
    return F.struct(F.when(known, view).otherwise("map").alias("view"), F.when(known, F.nullif(F.get(parts, F.lit(1)), F.lit(""))).alias("id"))


def in_margin(y0: Column, y1: Column, header: float = 68.0, footer: float = 775.0) -> Column:
    """Whether a line lies in the header or the footer of a page."""
    return (y1 < header) | (y0 > footer)


def rule_kind(x0: Column, y0: Column, x1: Column, y1: Column, thin: float = 2.0) -> Column:
    """horizontal, vertical or none: thin boxes are rules, by their longer side."""
    width, height = x1 - x0, y1 - y0
    return F.when(F.least(width, height) > thin, "none").when(height > width, "vertical").otherwise("horizontal")


def rounded_box(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """Signature of a box: its corners in whole points."""
    return F.concat_ws(",", *(F.bround(c).cast("int").cast("string") for c in (x0, y0, x1, y1)))
