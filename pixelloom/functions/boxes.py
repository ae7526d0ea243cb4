"""Bounding boxes of whole pixels as columns: x_min, x_max, y_min, y_max, half open. A box without a pixel is null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EDGES = ("x_min", "x_max", "y_min", "y_max")


def box(x_min: Column, x_max: Column, y_min: Column, y_max: Column) -> Column:
    """A box as a struct; null where it would be empty or turned."""
    made = F.struct(*(c.cast("int").alias(n) for n, c in zip(EDGES, (x_min, x_max, y_min, y_max), strict=True)))
    return F.when((x_max > x_min) & (y_max > y_min), made)


def from_float(x_min: Column, x_max: Column, y_min: Column, y_max: Column) -> Column:
    """The smallest box that holds a rectangle in pixel coordinates, where pixel centres are whole numbers."""
    low, high = (lambda c: F.floor(c + 0.5)), (lambda c: F.ceil(c + 0.5))
    return box(low(x_min), high(x_max), low(y_min), high(y_max))


def union(a: Column, b: Column) -> Column:
    """The smallest box around both."""
    return box(F.least(a["x_min"], b["x_min"]), F.greatest(a["x_max"], b["x_max"]), F.least(a["y_min"], b["y_min"]), F.greatest(a["y_max"], b["y_max"]))


def intersection(a: Column, b: Column) -> Column:
    """What both share; null if nothing."""
    return box(F.greatest(a["x_min"], b["x_min"]), F.least(a["x_max"], b["x_max"]), F.greatest(a["y_min"], b["y_min"]), F.least(a["y_max"], b["y_max"]))


def shape(a: Column) -> Column:
    """(height, width)."""
    return F.struct((a["y_max"] - a["y_min"]).alias("height"), (a["x_max"] - a["x_min"]).alias("width"))


def centre(a: Column) -> Column:
    return F.struct(((a["y_min"] + a["y_max"] - 1) / 2).alias("y"), ((a["x_min"] + a["x_max"] - 1) / 2).alias("x"))


def extent(a: Column) -> Column:
    """The box's outer edges in pixel coordinates."""
    return F.struct(*((a[n] - 0.5).alias(n) for n in EDGES))


def overlap(a: Column, height: Column, width: Column) -> tuple[Column, Column]:
    """The parts of an image of that size and of the box itself that lie over each other; null if none do."""
    large = intersection(a, box(F.lit(0), width, F.lit(0), height))
    small = F.when(large.isNotNull(), F.struct(*((large[n] - a["x_min" if n[0] == "x" else "y_min"]).alias(n) for n in EDGES)))
    return large, small
