"""Boxes as struct columns x0, y0, x1, y1 in page fractions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def box(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    return F.struct(x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), y1.alias("y1"))


def from_absolute(x0: Column, y0: Column, x1: Column, y1: Column, width: Column, height: Column) -> Column:
    """Corners in any order, scaled to the page and held inside it."""

    def scaled(v: Column, by: Column) -> Column:
        return F.greatest(F.lit(0.0), F.least(F.lit(1.0), v / by))

    return box(scaled(F.least(x0, x1), width), scaled(F.least(y0, y1), height), scaled(F.greatest(x0, x1), width), scaled(F.greatest(y0, y1), height))


def area(b: Column) -> Column:
    return (b["x1"] - b["x0"]) * (b["y1"] - b["y0"])


def union(a: Column, b: Column) -> Column:
    return box(F.least(a["x0"], b["x0"]), F.least(a["y0"], b["y0"]), F.greatest(a["x1"], b["x1"]), F.greatest(a["y1"], b["y1"]))


def intersection_area(a: Column, b: Column) -> Column:
    wide = F.greatest(F.lit(0.0), F.least(a["x1"], b["x1"]) - F.greatest(a["x0"], b["x0"]))
    high = F.greatest(F.lit(0.0), F.least(a["y1"], b["y1"]) - F.greatest(a["y0"], b["y0"]))
    return wide * high


def iou(a: Column, b: Column) -> Column:
    common = intersection_area(a, b)
    total = area(a) + area(b) - common
    return F.when(total > 0, common / total).otherwise(0.0)


def contains(outer: Column, inner: Column, tolerance: float = 0.0) -> Column:
    return (inner["x0"] >= outer["x0"] - tolerance) & (inner["y0"] >= outer["y0"] - tolerance) & (inner["x1"] <= outer["x1"] + tolerance) & (inner["y1"] <= outer["y1"] + tolerance)


def vertical_gap(a: Column, b: Column) -> Column:
    """0 where the boxes share a height."""
    return F.greatest(F.lit(0.0), b["y0"] - a["y1"], a["y0"] - b["y1"])


def horizontal_gap(a: Column, b: Column) -> Column:
    return F.greatest(F.lit(0.0), b["x0"] - a["x1"], a["x0"] - b["x1"])


def horizontal_overlap(a: Column, b: Column) -> Column:
    """Shared width as a fraction of the narrower box."""
    shared = F.greatest(F.lit(0.0), F.least(a["x1"], b["x1"]) - F.greatest(a["x0"], b["x0"]))
    narrow = F.least(a["x1"] - a["x0"], b["x1"] - b["x0"])
    return F.when(narrow > 0, shared / narrow).otherwise(0.0)


def within_gap(a: Column, b: Column, gap: float) -> Column:
    return (vertical_gap(a, b) <= gap) & (horizontal_gap(a, b) <= gap)


def contained_share(inner: Column, outer: Column) -> Column:
    """How much of inner lies in outer."""
    return F.when(area(inner) > 0, intersection_area(inner, outer) / area(inner)).otherwise(0.0)


def reading_order_keys(column: Column, b: Column) -> list[Column]:
    """Sort keys: column, hundredth of the height (half to even), left edge."""
    return [column, F.bround(b["y0"] / 0.01), b["x0"]]
