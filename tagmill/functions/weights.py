"""Column functions for attribution, trends and coverage states."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Shared weights are kept as whole parts of this, so that sums don't depend on their order: it is divisible by
#: 1, 1.5, 2 and 2.5, the totals of one primary and up to three half-weight secondaries.
UNIT = 60
#: Marks a year from which a steady series rises or falls, and range from which an unsteady one is mixed.
TREND_SLOPE = 2.0
MIXED_RANGE = 4.0


def attribution(primary: Column, secondary: Column, scheme: str) -> Column:
    """Array of (item, weight in UNIT parts): all on the primary, or a half share for every secondary, normalised."""
    if scheme == "primary":
        return F.array(F.struct(primary.alias("item_id"), F.lit(UNIT).cast("bigint").alias("weight")))
    if scheme != "shared":
        raise ValueError(f"unknown scheme {scheme!r}")
    halves = F.size(secondary) + 2  # the primary counts two halves
    share = (F.lit(2 * UNIT) / halves).cast("bigint")
    return F.concat(
        F.array(F.struct(primary.alias("item_id"), share.alias("weight"))),
        F.transform(secondary, lambda x: F.struct(x.alias("item_id"), (share / 2).cast("bigint").alias("weight"))),
    )


def slope(values: Sequence[Column]) -> Column:
    """Least-squares slope over equally spaced periods, as one expression."""
    n = len(values)
    centre = (n - 1) / 2
    square = sum((i - centre) ** 2 for i in range(n))
    return reduce(Column.__add__, (v * F.lit(i - centre) for i, v in enumerate(values))) / F.lit(square)


def trend(values: Sequence[Column]) -> Column:
    """rising, falling, mixed or stable; the tests are made in this order."""
    steps = [b - a for a, b in zip(values, values[1:], strict=False)]
    up, down = (reduce(Column.__and__, (s >= 0 if sign else s <= 0 for s in steps)) for sign in (True, False))
    gradient = slope(values)
    spread = F.greatest(*values) - F.least(*values)
    return F.when((gradient >= TREND_SLOPE) & up, "rising").when((gradient <= -TREND_SLOPE) & down, "falling").when(spread >= MIXED_RANGE, "mixed").otherwise("stable")


def coverage_status(primary_uses: Column, years_touched: Column) -> Column:
    return F.when(primary_uses > 0, "asked").when(years_touched > 0, "only_secondary").otherwise("never_asked")


def tile_level(marks: Column, touched: Column) -> Column:
    """Shade of a map tile: four levels by marks, then whether it was used at all."""
    return F.when(marks >= 9, "l4").when(marks >= 5, "l3").when(marks >= 3, "l2").when(marks >= 1, "l1").when(touched, "secondary").otherwise("never")
