"""Aperture masks as tables of weights (id, py, px, w): cut-outs, products and images of them, by equi-joins on pixels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixelloom.operators.aperture import Shape, covered, footprint, named


def weights(sources: DataFrame, shape: Shape, hole: Shape | None = None, method: str = "exact") -> DataFrame:
    """The masks of apertures at sources: (image_id if there is one, id, py, px, w)."""
    return footprint(sources, shape, hole, method).select(*named(sources), "py", "px", "w")


def to_image(mask: DataFrame, height: int, width: int) -> DataFrame:
    """(id, y, x, w): the weights that lie in an image of that size."""
    own = [c for c in mask.columns if c in ("image_id", "id")]
    return mask.where((F.col("py") >= 0) & (F.col("py") < height) & (F.col("px") >= 0) & (F.col("px") < width)).select(*own, F.col("py").alias("y"), F.col("px").alias("x"), "w")


def cutout(pixels: DataFrame, mask: DataFrame, fill: float | None = 0.0) -> DataFrame:
    """(id, py, px, value): the image under each mask's box; places beyond the image have `fill`."""
    own = [c for c in mask.columns if c in ("image_id", "id")]
    ends = mask.groupBy(*own).agg(F.min("py").alias("a"), F.max("py").alias("b"), F.min("px").alias("c"), F.max("px").alias("d"))
    cells = ends.withColumn("py", F.explode(F.sequence("a", "b"))).withColumn("px", F.explode(F.sequence("c", "d"))).select(*own, "py", "px")
    keys = [c for c in ("image_id",) if c in own]
    light = pixels.select(*keys, F.col("y").alias("py"), F.col("x").alias("px"), "value")
    value: Column = F.coalesce("value", F.lit(fill)) if fill is not None else F.col("value")
    return cells.join(light, [*keys, "py", "px"], "left").select(*own, "py", "px", value.alias("value"))


def multiply(pixels: DataFrame, mask: DataFrame, fill: float = 0.0) -> DataFrame:
    """(id, py, px, value): the cut-out times the weights; `fill` where the weight is 0 or the image ends."""
    own = [c for c in mask.columns if c in ("image_id", "id")]
    both = cutout(pixels, mask, None).join(mask, [*own, "py", "px"], "left")
    return both.select(*own, "py", "px", F.coalesce(F.col("value") * F.col("w"), F.lit(fill)).alias("value"))


def values(pixels: DataFrame, sources: DataFrame, shape: Shape, method: str = "exact") -> DataFrame:
    """(image_id, id, y, x, value): weighted values of the unmasked pixels with weight."""
    rows = covered(pixels, footprint(sources, shape, method=method)).where(~F.coalesce("mask", F.lit(False)))
    return rows.select("image_id", "id", "y", "x", (F.col("w") * F.col("value")).alias("value"))
