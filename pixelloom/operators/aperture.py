"""Aperture photometry: sources join the pixels of their apertures, weights are column expressions.

A source's bounding box is expanded to pixel coordinates first, so that the join with the image is an equi-join on
(y, x) and only covered pixels move; sums are then one grouped aggregate with partial sums. Method "center" counts
a pixel whose centre lies inside, "subpixel" counts sub-pixels, "exact" takes the covered area (discs,
rings, and axis-aligned ellipses as columns; turned ellipses, rectangles and polygons by a NumPy kernel in exact_weights).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from math import cos, pi, sin

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixelloom.functions.columns import disc_overlap
from pixelloom.functions.geometry import ellipse_area, polygon_area_in_pixels


@dataclass(frozen=True)
class Shape:
    """An aperture's outline around its centre. kind: circle (r), ellipse (a, b, theta), rectangle (w, h, theta), polygon (vertices as offsets)."""

    kind: str
    size: tuple[float, ...] = ()
    theta: float = 0.0
    vertices: tuple[tuple[float, float], ...] = ()

    def extent(self) -> tuple[float, float]:
        """Half width and half height of the outline's box."""
        c, s = cos(self.theta), sin(self.theta)
        if self.kind == "circle":
            return self.size[0], self.size[0]
        if self.kind == "ellipse":
            a, b = self.size
            return ((a * c) ** 2 + (b * s) ** 2) ** 0.5, ((a * s) ** 2 + (b * c) ** 2) ** 0.5
        if self.kind == "rectangle":
            w, h = self.size[0] / 2, self.size[1] / 2
            return abs(w * c) + abs(h * s), abs(w * s) + abs(h * c)
        return max(abs(v[0]) for v in self.vertices), max(abs(v[1]) for v in self.vertices)

    def area(self) -> float:
        if self.kind == "circle":
            return pi * self.size[0] ** 2
        if self.kind == "ellipse":
            return pi * self.size[0] * self.size[1]
        if self.kind == "rectangle":
            return self.size[0] * self.size[1]
        v = np.array(self.vertices)
        return abs(float((v[:, 0] * np.roll(v[:, 1], -1) - np.roll(v[:, 0], -1) * v[:, 1]).sum())) / 2

    def to_polygon(self, corners: int = 100) -> Shape:
        """The outline as a polygon: of a circle or ellipse with that many corners on it, of a rectangle its own four."""
        c, s = cos(self.theta), sin(self.theta)
        if self.kind == "polygon":
            return self
        if self.kind == "rectangle":
            w, h = self.size[0] / 2, self.size[1] / 2
            flat = [(-w, -h), (w, -h), (w, h), (-w, h)]
        else:
            a, b = self.size if self.kind == "ellipse" else self.size * 2
            flat = [(a * cos(2 * pi * k / corners), b * sin(2 * pi * k / corners)) for k in range(corners)]
        return polygon([(x * c - y * s, x * s + y * c) for x, y in flat])

    def perimeter(self) -> float:
        """Length of the outline; of an ellipse that of a polygon of 100,000 corners on it."""
        if self.kind == "circle":
            return 2 * pi * self.size[0]
        v = np.array(self.to_polygon(100_000 if self.kind == "ellipse" else 4).vertices)
        return float(np.hypot(*(np.roll(v, -1, axis=0) - v).T).sum())

    def is_regular(self, within: float = 1e-9) -> bool:
        """Whether a polygon's corners lie on a circle around their mean, at equal distances."""
        v = np.array(self.to_polygon().vertices)
        v = v - v.mean(axis=0)
        radius, side = np.hypot(*v.T), np.hypot(*(np.roll(v, -1, axis=0) - v).T)
        return bool(np.ptp(radius) <= within * radius.max() and np.ptp(side) <= within * side.max())

    def is_simple(self) -> bool:
        """Whether no two sides of a polygon that aren't neighbours meet."""
        v = np.array(self.to_polygon().vertices)
        n, w = len(v), np.roll(v, -1, axis=0)
        turn = lambda p, q, r: np.sign((q[0] - p[0]) * (r[1] - p[1]) - (q[1] - p[1]) * (r[0] - p[0]))
        for i in range(n):
            for j in range(i + 2, n - (i == 0)):
                if turn(v[i], w[i], v[j]) != turn(v[i], w[i], w[j]) and turn(v[j], w[j], v[i]) != turn(v[j], w[j], w[i]):
                    return False
        return True

    def inside(self, dx: Column, dy: Column) -> Column:
        """Whether the point (dx, dy) from the centre lies inside the outline."""
        c, s = F.lit(cos(self.theta)), F.lit(sin(self.theta))
        u, v = dx * c + dy * s, dy * c - dx * s
        if self.kind == "circle":
            return dx * dx + dy * dy < self.size[0] ** 2
        if self.kind == "ellipse":
            return (u / self.size[0]) * (u / self.size[0]) + (v / self.size[1]) * (v / self.size[1]) < 1
        if self.kind == "rectangle":
            return (F.abs(u) < self.size[0] / 2) & (F.abs(v) < self.size[1] / 2)
        odd = F.lit(False)
        for (x1, y1), (x2, y2) in zip(self.vertices, (*self.vertices[1:], self.vertices[0]), strict=True):
            if y1 != y2:
                crossed = ((F.lit(y1) > dy) != (F.lit(y2) > dy)) & (dx < (dy - y1) * ((x2 - x1) / (y2 - y1)) + x1)
                odd = odd != crossed
        return odd

    def weight(self, dx: Column, dy: Column, method: str, subpixels: int = 5) -> Column:
        """The weight of the pixel centred at (dx, dy) from the source."""
        if method == "center":
            return F.when(self.inside(dx, dy), 1.0).otherwise(0.0)
        if method == "subpixel":
            steps = [(i + 0.5) / subpixels - 0.5 for i in range(subpixels)]
            return sum((F.when(self.inside(dx + i, dy + j), 1.0).otherwise(0.0) for i in steps for j in steps), F.lit(0.0)) / float(subpixels**2)
        if self.kind == "circle":
            return disc_overlap(dx, dy, F.lit(float(self.size[0])))
        raise ValueError("exact weights of this outline come from exact_weights")

    def exact_kernel(self) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
        if self.kind == "circle":
            return lambda dx, dy: ellipse_area(dx, dy, self.size[0], self.size[0], 0.0)
        if self.kind == "ellipse":
            return lambda dx, dy: ellipse_area(dx, dy, *self.size, self.theta)
        if self.kind == "rectangle":
            c, s, w, h = cos(self.theta), sin(self.theta), self.size[0] / 2, self.size[1] / 2
            corners = [(x * c - y * s, x * s + y * c) for x, y in ((-w, -h), (w, -h), (w, h), (-w, h))]
            return lambda dx, dy: polygon_area_in_pixels(corners, dx, dy)
        return lambda dx, dy: polygon_area_in_pixels(self.vertices, dx, dy)


def circle(r: float) -> Shape:
    return Shape("circle", (float(r),))


def ellipse(a: float, b: float, theta: float = 0.0) -> Shape:
    return Shape("ellipse", (float(a), float(b)), theta)


def rectangle(w: float, h: float, theta: float = 0.0) -> Shape:
    return Shape("rectangle", (float(w), float(h)), theta)


def polygon(vertices: list[tuple[float, float]]) -> Shape:
    """A simple polygon; fewer than three corners or no area are refused (is_simple() tells whether sides cross)."""
    shape = Shape("polygon", (), 0.0, tuple((float(x), float(y)) for x, y in vertices))
    if len(vertices) < 3 or shape.area() == 0:
        raise ValueError("a polygon needs three corners and an area")
    return shape


def regular_polygon(corners: int, radius: float, theta: float = 0.0) -> Shape:
    """The first corner lies straight above the centre, turned by theta."""
    turns = [pi / 2 + theta + 2 * pi * k / corners for k in range(corners)]
    return polygon([(radius * cos(t), radius * sin(t)) for t in turns])


def box(sources: DataFrame, shape: Shape) -> DataFrame:
    """sources with the half-open box of pixels their aperture can touch: x_min, x_max, y_min, y_max."""
    ex, ey = shape.extent()
    edge = lambda c, e, up: (F.ceil(F.col(c) + e + 0.5) if up else F.floor(F.col(c) - e + 0.5)).cast("int")
    return sources.withColumns({"x_min": edge("x", ex, False), "x_max": edge("x", ex, True), "y_min": edge("y", ey, False), "y_max": edge("y", ey, True)})


def named(sources: DataFrame) -> list[str]:
    """What names a source: its id, and its image where the table says so."""
    return [c for c in ("image_id", "id") if c in sources.columns]


def footprint(sources: DataFrame, shape: Shape, hole: Shape | None = None, method: str = "exact", subpixels: int = 5) -> DataFrame:
    """(image_id if sources have one, id, x, y, px, py, w) for every pixel with weight, inside the image or not. hole: an inner outline that is cut out, for rings."""
    span, own = box(sources, shape), named(sources)
    cells = span.select(*own, "x", "y", F.explode(F.sequence("y_min", F.col("y_max") - 1)).alias("py"), "x_min", "x_max").select(*own, "x", "y", "py", F.explode(F.sequence("x_min", F.col("x_max") - 1)).alias("px"))
    dx, dy = F.col("px") - F.col("x"), F.col("py") - F.col("y")
    if method == "exact" and any(s.kind != "circle" for s in (shape, hole) if s):
        return exact_weights(cells, shape, hole)
    w = shape.weight(dx, dy, method, subpixels)
    w = w - hole.weight(dx, dy, method, subpixels) if hole else w
    return cells.withColumn("w", w).where("w > 0")


def exact_weights(cells: DataFrame, shape: Shape, hole: Shape | None) -> DataFrame:
    """Weights by covered area for any outline, in Arrow batches."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        outer, inner = shape.exact_kernel(), hole.exact_kernel() if hole else None
        for rows in batches:
            dx, dy = (rows.px - rows.x).to_numpy(float), (rows.py - rows.y).to_numpy(float)
            w = outer(dx, dy) - (inner(dx, dy) if inner else 0)
            yield rows.assign(w=w)[w > 1e-15]

    return cells.mapInPandas(run, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in cells.schema) + ", w double")


def covered(pixels: DataFrame, feet: DataFrame) -> DataFrame:
    """The image's pixels under the footprints, with (id, w); of every image, or of the footprint's own where it names one."""
    # small tables of sources are broadcast by Catalyst itself, by their size
    own = [c for c in ("image_id",) if c in feet.columns]
    return pixels.join(feet.select(*own, "id", F.col("x").alias("x0"), F.col("y").alias("y0"), F.col("py").alias("y"), F.col("px").alias("x"), "w"), [*own, "y", "x"])


#: The quality flags of apertures by bit.
FLAGS = {
    1: "no_overlap", 2: "partial_overlap", 4: "no_pixels", 8: "masked_pixels", 16: "all_masked", 32: "non_finite_data", 64: "non_finite_error",
    128: "neighbor_pixels", 256: "uncorrected_pixels", 512: "sigma_clipped", 1024: "all_clipped", 2048: "too_few_pixels", 4096: "undefined_shape", 8192: "singular_covariance",
}


def flag_bits(conditions: dict[str, Column]) -> Column:
    """The sum of the bits whose condition holds."""
    bits = {name: bit for bit, name in FLAGS.items()}
    return sum((F.when(c, bits[name]).otherwise(0) for name, c in conditions.items()), F.lit(0)).cast("int")


def on_images(pixels: DataFrame, sources: DataFrame) -> DataFrame:
    """Sources with the bounds of their image (y_end, x_end). A list without image_id stands for each image: images are few against pixels."""
    bounds = pixels.groupBy("image_id").agg(F.max("y").alias("y_end"), F.max("x").alias("x_end"))
    return sources.join(bounds, "image_id") if "image_id" in sources.columns else sources.join(bounds)


def photometry(pixels: DataFrame, sources: DataFrame, shape: Shape, hole: Shape | None = None, method: str = "exact", subpixels: int = 5, suffix: str = "") -> DataFrame:
    """(image_id, id, flux, flux_err, area, flags) for each image and source, or for each source in its image where sources have an image_id; masked or non-finite pixels are left out. flags: as FLAGS has them, up to non_finite_error."""
    feet = footprint(sources, shape, hole, method, subpixels)
    rows = covered(pixels, feet)
    masked = F.coalesce("mask", F.lit(False))
    bad = F.isnan("value") | F.col("value").isNull() | (F.abs("value") == F.lit(float("inf")))
    wrong = F.coalesce(F.isnan("error") | (F.abs("error") == F.lit(float("inf"))), F.lit(False))
    used, number = ~masked & ~bad, lambda c: F.sum(F.when(c, 1).otherwise(0))
    sums = rows.groupBy("image_id", "id").agg(
        F.sum(F.when(used, F.col("w") * F.col("value"))).alias("flux"),
        F.sqrt(F.sum(F.when(used, F.pow(F.col("w") * F.col("error"), F.lit(2.0))))).alias("flux_err"),
        F.sum(F.when(used, F.col("w"))).alias("area"),
        F.count("*").alias("inside"), number(masked).alias("masked"), number(used).alias("valid"), number(~masked & bad).alias("broken"), number(~masked & wrong).alias("wrong"),
    )
    whole = feet.groupBy(*named(sources)).agg(F.count("*").alias("cells"))
    every = box(on_images(pixels, sources), shape).withColumn("apart", (F.col("x_max") <= 0) | (F.col("y_max") <= 0) | (F.col("x_min") > F.col("x_end")) | (F.col("y_min") > F.col("y_end")))
    out = every.select("image_id", "id", "apart").join(sums, ["image_id", "id"], "left").join(whole, named(sources), "left")
    n = {c: F.coalesce(c, F.lit(0)) for c in ("inside", "cells", "masked", "valid", "broken", "wrong")}
    outside = n["cells"] > n["inside"]
    flags = flag_bits({
        "no_overlap": F.col("apart") | ((n["inside"] == 0) & outside), "partial_overlap": (n["inside"] > 0) & outside, "no_pixels": n["inside"] == 0, "masked_pixels": n["masked"] > 0,
        "all_masked": (n["inside"] > 0) & (n["valid"] == 0), "non_finite_data": n["broken"] > 0, "non_finite_error": n["wrong"] > 0,
    })
    return out.select("image_id", "id", F.col("flux").alias(f"flux{suffix}"), F.col("flux_err").alias(f"flux_err{suffix}"), F.col("area").alias(f"area{suffix}"), flags.alias(f"flags{suffix}"))


def decode_flags(flags: Column, names: dict[int, str] | None = None) -> Column:
    """The names of the flag bits set."""
    return F.filter(F.array(*[F.when(flags.bitwiseAND(bit) != 0, F.lit(name)) for bit, name in (names or FLAGS).items()]), lambda n: n.isNotNull())


def corrected_neighbours(pixels: DataFrame, segments: DataFrame, sources: DataFrame, shape: Shape, how: str = "mask", method: str = "center") -> DataFrame:
    """Sums with other sources' pixels left out ("mask"), with only the own segment ("source_only"), or with a neighbour's pixel replaced by the one mirrored at the centre ("correct"). flags: neighbor_pixels, uncorrected_pixels.

    sources: id, x, y, label, and image_id where a source belongs to one image; without it, it stands for each.
    """
    own = named(sources)
    rows = covered(pixels, footprint(sources.select(*own, "x", "y"), shape, method=method)).join(sources.select(*own, "label"), own)
    rows = rows.join(segments.select("image_id", "y", "x", F.col("label").alias("there")), ["image_id", "y", "x"], "left")
    other = F.col("there").isNotNull() & (F.col("there") != F.col("label"))
    rows = rows.withColumn("left_out", ~F.coalesce(F.col("there") == F.col("label"), F.lit(False)) if how == "source_only" else other)
    if how == "correct":
        mirror = pixels.select("image_id", F.col("y").alias("my"), F.col("x").alias("mx"), F.col("value").alias("mirrored"))
        foreign = segments.select("image_id", F.col("y").alias("my"), F.col("x").alias("mx"), F.col("label").alias("mlabel"))
        rows = rows.withColumn("my", (F.round(F.col("y0")) * 2 - F.col("y")).cast("int")).withColumn("mx", (F.round(F.col("x0")) * 2 - F.col("x")).cast("int"))
        rows = rows.join(mirror, ["image_id", "my", "mx"], "left").join(foreign, ["image_id", "my", "mx"], "left")
        usable = F.col("mirrored").isNotNull() & (F.col("mlabel").isNull() | (F.col("mlabel") == F.col("label")))
        rows = rows.withColumn("value", F.when(~other, F.col("value")).when(usable, F.col("mirrored"))).withColumn("left_out", F.col("value").isNull()).withColumn("touched", other)
    else:
        rows = rows.withColumn("touched", F.col("left_out"))
    used = ~F.col("left_out")
    sums = rows.groupBy("image_id", "id").agg(F.sum(F.when(used, F.col("w") * F.col("value"))).alias("flux"), F.coalesce(F.sum(F.when(used, F.col("w"))), F.lit(0.0)).alias("area"), F.max("touched").alias("touched"), F.max("left_out").alias("left_out"))
    return sums.select("image_id", "id", "flux", "area", flag_bits({"neighbor_pixels": F.col("touched"), "uncorrected_pixels": F.col("left_out") & F.lit(how == "correct")}).alias("flags"))
