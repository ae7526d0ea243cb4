"""Column expressions that several operators share. Undefined results are null; nothing raises on a zero divisor."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def fdiv(a, b) -> Column:
    """a / b, null where b is 0."""
    return F.try_divide(a, b)


def root(a) -> Column:
    """Square root, null below 0."""
    return F.when(a >= 0, F.sqrt(F.greatest(a, F.lit(0.0))))


def finite(a) -> Column:
    """Whether a value counts: neither null, NaN nor infinite."""
    return a.isNotNull() & ~F.isnan(a) & (F.abs(a) < F.lit(float("inf")))


def pixel_index(a) -> Column:
    """The pixel in which a coordinate lies: pixel centres are whole numbers."""
    return F.floor(a + 0.5).cast("int")


def quarter_area(x: Column, y: Column, r: Column) -> Column:
    """Signed area of the disc of radius r around 0 within the rectangle from 0 to (x, y)."""
    u, v = F.least(F.abs(x), r), F.least(F.abs(y), r)
    edge = F.sqrt(F.greatest(r * r - v * v, F.lit(0.0)))
    primitive = lambda t: (t * F.sqrt(F.greatest(r * r - t * t, F.lit(0.0))) + r * r * F.asin(F.least(t / r, F.lit(1.0)))) / 2
    area = F.when(u <= edge, u * v).otherwise(v * edge + primitive(u) - primitive(edge))
    return F.signum(x) * F.signum(y) * area


def disc_overlap(dx: Column, dy: Column, r: Column) -> Column:
    """Exact part of the unit pixel centred at (dx, dy) that the disc of radius r around 0 covers."""
    x1, x2, y1, y2 = dx - 0.5, dx + 0.5, dy - 0.5, dy + 0.5
    return quarter_area(x2, y2, r) - quarter_area(x1, y2, r) - quarter_area(x2, y1, r) + quarter_area(x1, y1, r)
