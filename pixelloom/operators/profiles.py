"""Radial profiles and curves of growth: all radii at once, by exact disc areas as columns."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pixelloom.functions.columns import disc_overlap, fdiv
from pixelloom.functions.geometry import ellipse_area
from pixelloom.operators.aperture import covered, ellipse, footprint, named
from pixelloom.operators.psf import least_squares


def square_overlap(dx: Column, dy: Column, half: Column) -> Column:
    """Exact part of the unit pixel centred at (dx, dy) that the upright square of that half side around 0 covers."""
    side = lambda d: F.greatest(F.least(d + 0.5, half) - F.greatest(d - 0.5, -half), F.lit(0.0))
    return side(dx) * side(dy)


def growth(pixels: DataFrame, sources: DataFrame, radii: list[float], outline: str = "circle") -> DataFrame:
    """(image_id, id, step, radius, flux, area, flux_err) within each radius, or within the square of that half side; one row a source and radius. A pixel is joined once and expanded over the radii that reach it. Sources with an image_id are measured there alone."""
    most = max(radii)
    edge = lambda c, up: (F.ceil(F.col(c) + most + 0.5) if up else F.floor(F.col(c) - most + 0.5)).cast("int")
    own = named(sources)
    cells = sources.select(*own, F.col("x").alias("x0"), F.col("y").alias("y0"), F.explode(F.sequence(edge("y", False), edge("y", True))).alias("y"), edge("x", False).alias("a"), edge("x", True).alias("b"))
    cells = cells.select(*own, "x0", "y0", "y", F.explode(F.sequence("a", "b")).alias("x"))
    rows = pixels.where(~F.coalesce("mask", F.lit(False))).join(cells, [*(c for c in own if c == "image_id"), "y", "x"])
    steps = F.array(*[F.struct(F.lit(k).alias("step"), F.lit(float(r)).alias("radius")) for k, r in enumerate(radii)])
    rows = rows.select("image_id", "id", "value", "error", (F.col("x") - F.col("x0")).alias("dx"), (F.col("y") - F.col("y0")).alias("dy"), F.explode(steps).alias("s"))
    over = square_overlap if outline == "square" else disc_overlap
    rows = rows.withColumn("w", F.when(F.col("s.radius") > 0, over(F.col("dx"), F.col("dy"), F.col("s.radius"))).otherwise(0.0))
    return rows.groupBy("image_id", "id", F.col("s.step").alias("step"), F.col("s.radius").alias("radius")).agg(F.sum(F.col("w") * F.col("value")).alias("flux"), F.sum("w").alias("area"), F.sqrt(F.sum(F.pow(F.col("w") * F.col("error"), F.lit(2.0)))).alias("flux_err"))


def radial(pixels: DataFrame, sources: DataFrame, edges: list[float]) -> DataFrame:
    """(image_id, id, step, radius, profile, profile_err, area): mean brightness of the rings between edges, from differences of the curve of growth."""
    before = Window.partitionBy("image_id", "id").orderBy("step")
    g = growth(pixels, sources, edges)
    for c in ("flux", "area", "radius"):
        g = g.withColumn(f"d_{c}", F.col(c) - F.lag(c).over(before))
    var = F.col("flux_err") * F.col("flux_err")
    g = g.withColumn("d_var", var - F.lag(var).over(before))
    return g.where("d_flux is not null").select("image_id", "id", F.col("step"), (F.col("radius") - F.col("d_radius") / 2).alias("radius"), fdiv(F.col("d_flux"), F.col("d_area")).alias("profile"), fdiv(F.sqrt(F.greatest("d_var", F.lit(0.0))), F.col("d_area")).alias("profile_err"), F.col("d_area").alias("area"))


def normalised(profile: DataFrame, column: str) -> DataFrame:
    """The profile over its maximum."""
    return profile.withColumn(column, fdiv(F.col(column), F.max(column).over(Window.partitionBy("image_id", "id"))))


def radius_of(curve: DataFrame, share: float) -> DataFrame:
    """(image_id, id, radius) at which a rising curve reaches that share of its last value, between steps by straight lines."""
    order = Window.partitionBy("image_id", "id").orderBy("step")
    last = F.last("flux").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    rows = curve.withColumn("share", fdiv(F.col("flux"), last)).withColumn("before", F.lag("share").over(order)).withColumn("inner", F.lag("radius").over(order))
    hit = rows.where((F.col("share") >= share) & (F.col("before") < share))
    at = F.col("inner") + (share - F.col("before")) * fdiv(F.col("radius") - F.col("inner"), F.col("share") - F.col("before"))
    return hit.groupBy("image_id", "id").agg(F.min(at).alias("radius"))


def growth_elliptical(pixels: DataFrame, sources: DataFrame, radii: list[float], ratio: float, theta: float = 0.0) -> DataFrame:
    """The curve of growth in exact ellipses: radii are semimajor axes, the semiminor ones `ratio` times them. Areas by a NumPy kernel over batches of pixels."""
    steps = [(k, float(r)) for k, r in enumerate(radii) if r > 0]
    feet = footprint(sources, ellipse(max(radii), ratio * max(radii), theta)).drop("w")
    rows = covered(pixels.where(~F.coalesce("mask", F.lit(False))), feet.withColumn("w", F.lit(1.0)))
    rows = rows.select("image_id", "id", (F.col("x") - F.col("x0")).alias("dx"), (F.col("y") - F.col("y0")).alias("dy"), F.col("value").cast("double").alias("value"), F.col("error").cast("double").alias("error"))
    kind = rows.schema["image_id"].dataType.simpleString()

    def weigh(batches):
        for part in batches:
            for k, r in steps:
                w = ellipse_area(part.dx.to_numpy(float), part.dy.to_numpy(float), r, ratio * r, theta)
                yield part[["image_id", "id", "value", "error"]].assign(step=k, radius=r, w=w)[w > 1e-15]

    found = rows.mapInPandas(weigh, f"image_id {kind}, id long, value double, error double, step int, radius double, w double")
    return found.groupBy("image_id", "id", "step", "radius").agg(F.sum(F.col("w") * F.col("value")).alias("flux"), F.sum("w").alias("area"), F.sqrt(F.sum(F.pow(F.col("w") * F.col("error"), F.lit(2.0)))).alias("flux_err"))


def data_profile(pixels: DataFrame, sources: DataFrame, most: float) -> DataFrame:
    """(image_id, id, radius, value): the unmasked pixels around each source by their distance from it."""
    place = lambda c, up: (F.floor(F.col(c) + most) if up else F.ceil(F.col(c) - most)).cast("int")
    own = named(sources)
    cells = sources.select(*own, F.col("x").alias("x0"), F.col("y").alias("y0"), F.explode(F.sequence(place("y", False), place("y", True))).alias("y"), place("x", False).alias("a"), place("x", True).alias("b"))
    cells = cells.select(*own, "x0", "y0", "y", F.explode(F.sequence("a", "b")).alias("x"))
    rows = pixels.where(~F.coalesce("mask", F.lit(False))).join(cells, [*(c for c in own if c == "image_id"), "y", "x"])
    r = F.hypot(F.col("x") - F.col("x0"), F.col("y") - F.col("y0"))
    return rows.select("image_id", "id", r.alias("radius"), "value").where(F.col("radius") <= most)


def unnormalised(profile: DataFrame, column: str, scale: str) -> DataFrame:
    """The profile times the maximum that it was divided by (a column)."""
    return profile.withColumn(column, F.col(column) * F.col(scale))


def monotone(curve: DataFrame, column: str = "flux") -> DataFrame:
    """The curve up to its first step that doesn't rise, from its first step on."""
    order = Window.partitionBy("image_id", "id").orderBy("step")
    falls = F.coalesce(F.col(column) <= F.lag(column).over(order), F.lit(False)).cast("int")
    return curve.withColumn("falls_", falls).withColumn("fallen_", F.sum("falls_").over(order)).where("fallen_ = 0").drop("falls_", "fallen_")


def fitted(profile: DataFrame, model: str = "gaussian") -> DataFrame:
    """(image_id, id, amplitude, width, exponent, fwhm): a Gaussian (width: sigma) or Moffat (width: gamma, exponent: alpha) around 0 fitted to each source's radial profile, by its errors where all are positive; null with fewer steps than parameters. A profile is a few rows."""
    kind = profile.schema["image_id"].dataType.simpleString()

    def solve(group: pd.DataFrame) -> pd.DataFrame:
        r, v, e = (group[c].to_numpy(float) for c in ("radius", "profile", "profile_err"))
        good = np.isfinite(v)
        r, v, e = r[good], v[good], e[good]
        weight = 1 / e if len(e) and np.isfinite(e).all() and (e > 0).all() else np.ones(len(v))
        out = [np.nan] * 4
        if len(v) >= (2 if model == "gaussian" else 3) and v.max() > 0:
            sigma = max(0.5, float(np.sqrt(abs((v * r * r * r).sum()) / max(abs((v * r).sum()), 1e-30) / 2)))
            if model == "gaussian":
                p, _, _ = least_squares(lambda q: q[0] * np.exp(-r * r / (2 * q[1] ** 2)), np.array([v.max(), sigma]), v, weight)
                out = [p[0], abs(p[1]), np.nan, abs(p[1]) * 2 * np.sqrt(2 * np.log(2))]
            else:
                p, _, _ = least_squares(lambda q: q[0] * (1 + r * r / q[1] ** 2) ** -abs(q[2]), np.array([v.max(), 2 * sigma, 2.5]), v, weight)
                out = [p[0], abs(p[1]), abs(p[2]), 2 * abs(p[1]) * np.sqrt(2 ** (1 / max(abs(p[2]), 1e-9)) - 1)]
        made = pd.DataFrame({"image_id": group.image_id.iloc[:1], "id": group.id.iloc[:1]})
        for name, x in zip(("amplitude", "width", "exponent", "fwhm"), out, strict=True):
            made[name] = [None if not np.isfinite(x) else float(x)]
        return made

    return profile.groupBy("image_id", "id").applyInPandas(solve, f"image_id {kind}, id long, amplitude double, width double, exponent double, fwhm double")
