"""Backgrounds: statistics of boxes, mesh filters and fills, and their interpolation back to pixels."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pixelloom.functions.columns import fdiv
from pixelloom.functions.tables import kept
from pixelloom.operators import stats
from pixelloom.operators.aperture import Shape, covered, footprint


def mesh(pixels: DataFrame, size: int, estimator: str = "sextractor", exclude: float = 10.0, rounds: int = 10) -> DataFrame:
    """(image_id, box_y, box_x, background, rms, n) of boxes of size x size. Masked pixels are left out; a box is null when less than 100 - exclude percent of a whole box is left, so partial boxes at the edge mostly are."""
    rows = pixels.where(~F.coalesce("mask", F.lit(False))).select("image_id", F.floor(F.col("y") / size).cast("int").alias("box_y"), F.floor(F.col("x") / size).cast("int").alias("box_x"), "value")
    keys = ["image_id", "box_y", "box_x"]
    found = stats.estimate(stats.sigma_clip(rows, keys, rounds=rounds), keys, (estimator, "std") if estimator != "std" else ("std",))
    boxes = pixels.select("image_id", F.floor(F.col("y") / size).cast("int").alias("box_y"), F.floor(F.col("x") / size).cast("int").alias("box_x")).distinct()
    enough = F.coalesce("n", F.lit(0)) >= F.greatest(F.lit(1.0), F.lit((1 - exclude / 100) * size * size))
    return boxes.join(found, keys, "left").select(*keys, F.when(enough, F.col(estimator)).alias("background"), F.when(enough, F.col("std")).alias("rms"), F.coalesce("n", F.lit(0)).alias("n"))


def median_filter(boxes: DataFrame, half: int = 1, threshold: float | None = None) -> DataFrame:
    """The mesh with each box replaced by the median of its (2 half + 1)^2 neighbours; with a threshold only boxes above it."""
    steps = F.array([F.lit(i) for i in range(-half, half + 1)])
    spread = boxes.select("image_id", "background", "box_y", "box_x", F.explode(steps).alias("i")).select("image_id", "background", (F.col("box_y") + F.col("i")).alias("box_y"), "box_x", F.explode(steps).alias("j"))
    near = spread.select("image_id", "box_y", (F.col("box_x") + F.col("j")).alias("box_x"), "background").groupBy("image_id", "box_y", "box_x").agg(F.median("background").alias("filtered"))
    out = boxes.join(near, ["image_id", "box_y", "box_x"])
    value = F.col("filtered") if threshold is None else F.when(F.col("background") > threshold, F.col("filtered")).otherwise(F.col("background"))
    return out.select("image_id", "box_y", "box_x", value.alias("background"))


def fill_holes(boxes: DataFrame, neighbours: int = 10, power: float = 1.0) -> DataFrame:
    """Null boxes from the nearest boxes of the image, weighted by inverse distance. The mesh is small: one box for size x size pixels."""
    holes, known = boxes.where("background is null"), boxes.where("background is not null")
    k = known.select("image_id", F.col("box_y").alias("ky"), F.col("box_x").alias("kx"), F.col("background").alias("known"))
    pairs = holes.select("image_id", "box_y", "box_x").join(k, "image_id").withColumn("d", F.hypot(F.col("box_y") - F.col("ky"), F.col("box_x") - F.col("kx")))
    near = pairs.withColumn("rank", F.row_number().over(Window.partitionBy("image_id", "box_y", "box_x").orderBy("d", "ky", "kx"))).where(F.col("rank") <= neighbours)
    w = 1 / F.pow("d", F.lit(power))
    filled = near.groupBy("image_id", "box_y", "box_x").agg(fdiv(F.sum(w * F.col("known")), F.sum(w)).alias("background"))
    return known.select("image_id", "box_y", "box_x", "background").unionByName(filled)


def interpolate_idw(points: DataFrame, targets: DataFrame, neighbours: int = 10, power: float = 1.0, regular: float = 0.0, same: float = 1e-12) -> DataFrame:
    """(id, value) at targets (id, x, y) from points (x, y, value): mean of the nearest points by 1 / (distance^power + regular); a point's own value where they coincide."""
    p = points.select(F.col("x").alias("px"), F.col("y").alias("py"), F.col("value").alias("v"))
    pairs = targets.crossJoin(F.broadcast(p)).withColumn("d", F.hypot(F.col("x") - F.col("px"), F.col("y") - F.col("py")))
    near = pairs.withColumn("rank", F.row_number().over(Window.partitionBy("id").orderBy("d", "px", "py"))).where(F.col("rank") <= neighbours)
    w = F.when(F.col("d") > same, 1 / (F.pow(F.greatest("d", F.lit(same)), F.lit(power)) + regular))
    return near.groupBy("id").agg(F.coalesce(F.max(F.when(F.col("d") <= same, F.col("v"))), fdiv(F.sum(w * F.col("v")), F.sum(w))).alias("value"))


def to_pixels(pixels: DataFrame, boxes: DataFrame, size: int) -> DataFrame:
    """Bilinear background at each pixel from a mesh without holes, clipped by construction to the mesh's range; the mesh's edge goes on outward."""
    edge = boxes.groupBy("image_id").agg(F.max("box_y").alias("top"), F.max("box_x").alias("right"))
    place = lambda c: (F.col(c) + 0.5) / size - 0.5
    rows = pixels.select("image_id", "y", "x", "value").join(edge, "image_id").withColumns({"v": F.least(F.greatest(place("y"), F.lit(0.0)), F.col("top").cast("double")), "u": F.least(F.greatest(place("x"), F.lit(0.0)), F.col("right").cast("double"))})
    rows = rows.withColumns({"j": F.floor("v").cast("int"), "i": F.floor("u").cast("int")}).withColumns({"fv": F.col("v") - F.col("j"), "fu": F.col("u") - F.col("i")})
    corner = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (0, 1) for b in (0, 1)]))
    rows = rows.withColumn("c", corner).withColumn("w", F.when(F.col("c.a") == 1, F.col("fv")).otherwise(1 - F.col("fv")) * F.when(F.col("c.b") == 1, F.col("fu")).otherwise(1 - F.col("fu"))).where("w > 0")
    rows = rows.withColumns({"box_y": F.col("j") + F.col("c.a"), "box_x": F.col("i") + F.col("c.b")})
    met = rows.join(boxes.select("image_id", "box_y", "box_x", "background"), ["image_id", "box_y", "box_x"])
    return met.groupBy("image_id", "y", "x").agg(F.max("value").alias("value"), F.sum(F.col("w") * F.col("background")).alias("background"))


def local(pixels: DataFrame, sources: DataFrame, inner: Shape, outer: Shape, estimator: str = "median") -> DataFrame:
    """(image_id, id, background) from the pixels of a ring around each source."""
    rows = covered(pixels, footprint(sources, outer, inner, "center")).where(~F.coalesce("mask", F.lit(False)))
    return stats.estimate(rows, ["image_id", "id"], (estimator,)).select("image_id", "id", F.col(estimator).alias("background"))


def spline_weights(boxes: int, size: int, length: int) -> np.ndarray:
    """Weights (length x boxes) that take a line of boxes to pixels: interpolating cubic B-spline through the boxes' centres, mirrored at the ends."""

    def basis(at: np.ndarray) -> np.ndarray:
        out, low = np.zeros((len(at), boxes)), np.floor(at).astype(int)
        t = at - low
        parts = ((1 - t) ** 3 / 6, (3 * t**3 - 6 * t**2 + 4) / 6, (-3 * t**3 + 3 * t**2 + 3 * t + 1) / 6, t**3 / 6)
        for k, w in enumerate(parts):
            place = np.mod(low + k - 1, 2 * boxes)
            np.add.at(out, (np.arange(len(at)), np.where(place >= boxes, 2 * boxes - 1 - place, place)), w)
        return out

    return basis((np.arange(length) + 0.5) / size - 0.5) @ np.linalg.inv(basis(np.arange(boxes, dtype=float)))


def to_pixels_spline(pixels: DataFrame, boxes: DataFrame, size: int, reach: int = 16) -> DataFrame:
    """Cubic-spline background at each pixel, clipped to the mesh's range. An image is worked in strips of one box row; a strip gets the mesh rows within `reach`, beyond which weights are below 1e-9."""
    ends = pixels.groupBy("image_id").agg(F.max("y").alias("y_end"), F.max("x").alias("x_end"))
    span = boxes.groupBy("image_id").agg(F.max("box_y").alias("rows"), F.max("box_x").alias("columns"), F.min("background").alias("low"), F.max("background").alias("high"))
    strips = pixels.select("image_id", "y", "x", "value", F.floor(F.col("y") / size).cast("int").alias("strip"))
    sent = boxes.select("image_id", "box_y", "box_x", "background").join(ends.join(span, "image_id"), "image_id")
    steps = F.sequence(F.greatest(F.col("box_y") - reach, F.lit(0)), F.least(F.col("box_y") + reach, F.col("rows")))
    sent = sent.withColumn("of", F.explode(steps)).withColumnRenamed("image_id", "image")
    kind = pixels.schema["image_id"].dataType.simpleString()

    def fill(own: pd.DataFrame, mesh: pd.DataFrame) -> pd.DataFrame:
        if own.empty or mesh.empty:
            return pd.DataFrame(columns=["image_id", "y", "x", "value", "background"])
        one = mesh.iloc[0]
        rows, columns = int(one.rows) + 1, int(one["columns"]) + 1
        plane = np.zeros((rows, columns))
        plane[mesh.box_y, mesh.box_x] = mesh.background
        wy, wx = spline_weights(rows, size, int(one.y_end) + 1), spline_weights(columns, size, int(one.x_end) + 1)
        value = np.einsum("nb,nb->n", wy[own.y] @ plane, wx[own.x])
        return own[["image_id", "y", "x", "value"]].assign(background=np.clip(value, one.low, one.high))

    return strips.groupBy("image_id", "strip").cogroup(sent.groupBy("image", "of")).applyInPandas(fill, f"image_id {kind}, y int, x int, value double, background double")


def n_pixels_map(pixels: DataFrame, boxes: DataFrame, size: int) -> DataFrame:
    """(image_id, y, x, n): at each pixel the number of pixels that its box's statistics were made from."""
    rows = pixels.select("image_id", "y", "x", F.floor(F.col("y") / size).cast("int").alias("box_y"), F.floor(F.col("x") / size).cast("int").alias("box_x"))
    return rows.join(boxes.select("image_id", "box_y", "box_x", "n"), ["image_id", "box_y", "box_x"]).select("image_id", "y", "x", "n")


def rms_to_pixels(pixels: DataFrame, boxes: DataFrame, size: int) -> DataFrame:
    """(image_id, y, x, rms): the boxes' deviations taken to the pixels as the background is; holes are filled first."""
    mesh = fill_holes(boxes.select("image_id", "box_y", "box_x", F.col("rms").alias("background")))
    return to_pixels(pixels, mesh, size).select("image_id", "y", "x", F.col("background").alias("rms"))


def medians(boxes: DataFrame) -> DataFrame:
    """(image_id, background_median, rms_median) of an image's mesh."""
    return boxes.groupBy("image_id").agg(F.median("background").alias("background_median"), F.median("rms").alias("rms_median"))


def nearest_boxes(cells: DataFrame, boxes: DataFrame, neighbours: int) -> DataFrame:
    """For each cell (image_id, by, bx) the boxes (cy, cx, v) among which are the nearest ones of any place in it, however wide the mesh's holes are.

    Rounds look twice as far each, by joins on coarse places, for the cells still open: a cell is done when its last neighbour,
    seen from its middle, is nearer than the reach by a cell's diagonal, or the reach holds the whole mesh.
    """
    known = boxes.select("image_id", F.col("box_y").alias("cy"), F.col("box_x").alias("cx"), F.col("background").alias("v"))
    size = cells.agg(F.max(F.greatest("by", "bx"))).first()[0] or 0
    widest = max(size, known.agg(F.max(F.greatest("cy", "cx"))).first()[0] or 0) * 2**0.5 + 1
    around = F.explode(F.array(*[F.struct(F.lit(j).alias("j"), F.lit(i).alias("i")) for j in (-1, 0, 1) for i in (-1, 0, 1)]))
    keys, reach, out, diagonal = ["image_id", "by", "bx"], int(neighbours**0.5) + 2, None, 2**0.5
    while True:
        place = lambda c: F.floor(F.col(c) / reach)  # noqa: B023, E731
        sent = cells.select("*", around.alias("s")).select(*keys, (place("by") + F.col("s.j")).alias("py"), (place("bx") + F.col("s.i")).alias("px"))
        met = sent.join(known.withColumns({"py": place("cy"), "px": place("cx")}), ["image_id", "py", "px"]).withColumn("d", F.hypot(F.col("by") - F.col("cy"), F.col("bx") - F.col("cx"))).where(F.col("d") <= reach).drop("py", "px")
        met = kept(met.withColumn("far", F.get(F.array_sort(F.collect_list("d").over(Window.partitionBy(*keys))), F.lit(neighbours - 1))), "near")
        last = reach >= widest
        done = met if last else met.where(F.col("far") + diagonal <= reach)
        done = done.where(F.coalesce(F.col("d") <= F.col("far") + diagonal, F.lit(True))).select(*keys, "cy", "cx", "v")
        out = done if out is None else out.unionByName(done)
        if last:
            return out
        cells = kept(cells.join(done.select(*keys).distinct(), keys, "left_anti"), "open")
        if cells.isEmpty():
            return out
        reach *= 2


def idw_to_pixels(pixels: DataFrame, boxes: DataFrame, size: int, neighbours: int = 10, power: float = 1.0) -> DataFrame:
    """(image_id, y, x, background): at each pixel the mean of the nearest boxes' centres by inverse distance. Boxes that are missing or null are passed over; a pixel of an image without any box stays, with null."""
    rows = pixels.select("image_id", "y", "x", F.floor(F.col("y") / size).cast("int").alias("by"), F.floor(F.col("x") / size).cast("int").alias("bx"))
    cells = kept(rows.select("image_id", "by", "bx").distinct(), "cells")
    sent = nearest_boxes(cells, boxes.where("background is not null"), neighbours)
    centre = lambda c: (F.col(c) + 0.5) * size - 0.5
    met = rows.join(sent, ["image_id", "by", "bx"], "left").withColumn("d", F.hypot(F.col("y") - centre("cy"), F.col("x") - centre("cx")))
    near = met.withColumn("rank", F.row_number().over(Window.partitionBy("image_id", "y", "x").orderBy("d", "cy", "cx"))).where(F.col("rank") <= neighbours)
    w = F.when(F.col("d") > 0, 1 / F.pow(F.greatest("d", F.lit(1e-12)), F.lit(power)))
    return near.groupBy("image_id", "y", "x").agg(F.coalesce(F.max(F.when(F.col("d") == 0, F.col("v"))), fdiv(F.sum(w * F.col("v")), F.sum(w))).alias("background"))
