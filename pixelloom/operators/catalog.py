"""Catalogues: measurements of each label from one join of segments and pixels."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixelloom.functions.columns import finite, fdiv, root
from pixelloom.functions.geometry import ellipse_area
from pixelloom.operators import aperture, segmentation, stats

KEYS = ["image_id", "label"]


def measured(pixels: DataFrame, segments: DataFrame) -> DataFrame:
    """One row a label: sums with errors, extremes and where they lie (first in raster order), area, box."""
    rows = pixels.join(segments, ["image_id", "y", "x"])
    place = F.struct("y", "x")
    low = F.min(F.struct("value", place.alias("at")))
    high = F.max(F.struct("value", F.struct((-F.col("y")).alias("y"), (-F.col("x")).alias("x")).alias("at")))
    sums = rows.groupBy(*KEYS).agg(
        F.count("*").alias("area"), F.sum("value").alias("segment_flux"), F.sqrt(F.sum(F.col("error") * F.col("error"))).alias("segment_flux_err"),
        low.alias("low"), high.alias("high"), F.min("x").alias("x_min"), F.max("x").alias("x_max"), F.min("y").alias("y_min"), F.max("y").alias("y_max"),
    )
    return sums.select(
        *KEYS, "area", "segment_flux", "segment_flux_err", F.col("low.value").alias("min_value"), F.col("high.value").alias("max_value"),
        F.col("low.at.y").alias("min_y"), F.col("low.at.x").alias("min_x"), (-F.col("high.at.y")).alias("max_y"), (-F.col("high.at.x")).alias("max_x"),
        "x_min", "x_max", "y_min", "y_max", F.sqrt(F.col("area") / F.lit(3.141592653589793)).alias("equivalent_radius"),
    )


def shapes(pixels: DataFrame, segments: DataFrame) -> DataFrame:
    return stats.shape(pixels.join(segments, ["image_id", "y", "x"]), KEYS)


def source_list(pixels: DataFrame, segments: DataFrame) -> DataFrame:
    """Labels as sources (image_id, id, x, y) at their centroids, for the aperture operators."""
    return stats.centroid(pixels.join(segments, ["image_id", "y", "x"]), KEYS).select("image_id", F.col("label").cast("long").alias("id"), F.col("x_centroid").alias("x"), F.col("y_centroid").alias("y")).where("x is not null and y is not null")


def tensors(pixels: DataFrame, segments: DataFrame) -> DataFrame:
    """(image_id, label, inertia_xx, inertia_xy, inertia_yy, eigenvalue_1, eigenvalue_2): the inertia tensor about the centroid, and the eigenvalues of the covariance, the larger first."""
    rows = pixels.join(segments, ["image_id", "y", "x"])
    m = stats.central_moments(rows, KEYS).select(*KEYS, F.col("mu02").alias("inertia_xx"), (-F.col("mu11")).alias("inertia_xy"), F.col("mu20").alias("inertia_yy"))
    s = stats.shape(rows, KEYS).select(*KEYS, (F.col("semimajor_axis") * F.col("semimajor_axis")).alias("eigenvalue_1"), (F.col("semiminor_axis") * F.col("semiminor_axis")).alias("eigenvalue_2"))
    return m.join(s, KEYS, "left")


def centroid_errors(pixels: DataFrame, segments: DataFrame) -> DataFrame:
    """(image_id, label, x_err, y_err, xy_cov): errors of the centroid from the pixels' errors. A label narrower than a pixel, whose error covariance is nearly singular too, gets the variance of a pixel's width on both."""
    rows = stats.good(pixels.join(segments, ["image_id", "y", "x"]))
    m = stats.central_moments(rows, KEYS)
    xx, yy, xy = (fdiv(F.col(c), F.col("mu00")) for c in ("mu02", "mu20", "mu11"))
    m = m.select(*KEYS, "x_centroid", "y_centroid", "mu00", (xx * yy - xy * xy < 1 / 144).alias("narrow"))
    e2, dx, dy = F.col("error") * F.col("error"), F.col("x") - F.col("x_centroid"), F.col("y") - F.col("y_centroid")
    sums = rows.join(m, KEYS).groupBy(*KEYS).agg(F.max("mu00").alias("f"), F.max("narrow").alias("narrow"), F.sum(e2 * dx * dx).alias("sxx"), F.sum(e2 * dy * dy).alias("syy"), F.sum(e2 * dx * dy).alias("sxy"), F.sum(e2).alias("s"))
    over = lambda c: fdiv(F.col(c), F.col("f") * F.col("f"))
    sums = sums.select(*KEYS, "narrow", over("sxx").alias("vx"), over("syy").alias("vy"), over("sxy").alias("xy_cov"), (over("s") / 12).alias("floor"))
    add = F.when(F.col("narrow") & (F.col("vx") * F.col("vy") - F.col("xy_cov") * F.col("xy_cov") < F.col("floor") * F.col("floor")), F.col("floor")).otherwise(0.0)
    return sums.select(*KEYS, F.sqrt(F.col("vx") + add).alias("x_err"), F.sqrt(F.col("vy") + add).alias("y_err"), "xy_cov")


def backgrounds(pixels: DataFrame, segments: DataFrame, background: DataFrame) -> DataFrame:
    """(image_id, label, background_sum, background_mean, background_centroid) from a background at each pixel (image_id, y, x, background); at the centroid it is bilinear between pixels."""
    rows = pixels.join(segments, ["image_id", "y", "x"]).join(background.select("image_id", "y", "x", "background"), ["image_id", "y", "x"])
    rows = stats.good(rows)
    sums = rows.groupBy(*KEYS).agg(F.sum("background").alias("background_sum"), F.avg("background").alias("background_mean"))
    at = stats.centroid(rows, KEYS)
    corner = F.explode(F.array(*[F.struct(F.lit(j).alias("j"), F.lit(i).alias("i")) for j in (0, 1) for i in (0, 1)]))
    cells = at.select(*KEYS, "x_centroid", "y_centroid", corner.alias("c")).withColumns({"x": (F.floor("x_centroid") + F.col("c.i")).cast("int"), "y": (F.floor("y_centroid") + F.col("c.j")).cast("int")})
    w = (1 - F.abs(F.col("x") - F.col("x_centroid"))) * (1 - F.abs(F.col("y") - F.col("y_centroid")))
    near = cells.withColumn("w", w).join(background.select("image_id", "y", "x", "background"), ["image_id", "y", "x"])
    near = near.groupBy(*KEYS).agg(fdiv(F.sum(F.col("w") * F.col("background")), F.sum("w")).alias("background_centroid"))
    return sums.join(near, KEYS, "left")


def gini(pixels: DataFrame, segments: DataFrame) -> DataFrame:
    return stats.gini(pixels.join(segments, ["image_id", "y", "x"]), KEYS)


def circular_photometry(pixels: DataFrame, segments: DataFrame, radius: float) -> DataFrame:
    """(image_id, label, flux, flux_err) in exact circles around the centroids."""
    found = aperture.photometry(pixels, source_list(pixels, segments), aperture.circle(radius))
    return found.select("image_id", F.col("id").cast("int").alias("label"), "flux", "flux_err")


def around(pixels: DataFrame, segments: DataFrame, ellipses: DataFrame, neighbours: str) -> DataFrame:
    """The good pixels in the box of each label's ellipse (KEYS, x_centroid, y_centroid, reach, ...), other labels' pixels mirrored at the centroid ("correct"), left out ("mask") or as they are ("none"). An ellipse is small against an image; the join is on (image_id, y, x)."""
    place = lambda c: F.floor(F.col(c) + 0.5).cast("int")
    half = F.ceil(F.col("reach") + 1).cast("int")
    cells = ellipses.where("reach is not null").withColumns({"x0": place("x_centroid"), "y0": place("y_centroid")}).withColumn("y", F.explode(F.sequence(F.col("y0") - half, F.col("y0") + half)))
    cells = cells.withColumn("x", F.explode(F.sequence(F.col("x0") - half, F.col("x0") + half)))
    own = segments.select("image_id", "y", "x", F.col("label").alias("there"))
    light = pixels.select("image_id", "y", "x", "value", "error", F.coalesce("mask", F.lit(False)).alias("mask"))
    rows = cells.join(light, ["image_id", "y", "x"])
    if neighbours != "none":
        rows = rows.join(own, ["image_id", "y", "x"], "left").withColumn("other", F.coalesce(F.col("there") != F.col("label"), F.lit(False)))
        if neighbours == "mask":
            rows = rows.where(~F.col("other"))
        else:
            mirror = [light.select("image_id", F.col("y").alias("my"), F.col("x").alias("mx"), F.col("value").alias("mvalue"), F.col("error").alias("merror"), F.col("mask").alias("mmask")), own.select("image_id", F.col("y").alias("my"), F.col("x").alias("mx"), F.col("there").alias("mthere"))]
            rows = rows.withColumns({"my": 2 * F.col("y0") - F.col("y"), "mx": 2 * F.col("x0") - F.col("x")})
            for table in mirror:
                rows = rows.join(table, ["image_id", "my", "mx"], "left")
            usable = F.col("mvalue").isNotNull() & ~F.coalesce("mmask", F.lit(True)) & F.coalesce(F.col("mthere") == F.col("label"), F.lit(True))
            rows = rows.withColumns({"value": F.when(~F.col("other"), F.col("value")).when(usable, F.col("mvalue")), "error": F.when(~F.col("other"), F.col("error")).when(usable, F.col("merror"))})
    return rows.where(~F.col("mask") & finite(F.col("value")))


def kron_radii(pixels: DataFrame, segments: DataFrame, scale: float = 2.5, least: float = 1.4, least_circle: float = 0.0, reach: float = 6.0, neighbours: str = "correct") -> DataFrame:
    """(KEYS, centroid, axes, orientation, kron_radius): the light-weighted elliptical radius within `reach` times a label's ellipse, at least `least`; null if it is larger than `reach` or not defined, 0 if the scaled circle would be below least_circle."""
    s = shapes(pixels, segments).withColumn("reach", F.col("semimajor_axis") * reach)
    rows = around(pixels, segments, s.select(*KEYS, "x_centroid", "y_centroid", "reach", "ellipse_cxx", "ellipse_cyy", "ellipse_cxy"), neighbours)
    dx, dy = F.col("x") - F.col("x_centroid"), F.col("y") - F.col("y_centroid")
    rows = rows.withColumn("r", F.sqrt(F.greatest(F.col("ellipse_cxx") * dx * dx + F.col("ellipse_cyy") * dy * dy + F.col("ellipse_cxy") * dx * dy, F.lit(0.0)))).where(F.col("r") < reach)
    sums = rows.groupBy(*KEYS).agg(F.sum(F.col("r") * F.col("value")).alias("num"), F.sum("value").alias("den"))
    raw = F.when((F.col("num") > 0) & (F.col("den") > 0), F.col("num") / F.col("den"))
    k = F.when(raw <= reach, F.greatest(raw, F.lit(least)))
    out = s.select(*KEYS, "x_centroid", "y_centroid", "semimajor_axis", "semiminor_axis", F.radians("orientation").alias("theta")).join(sums, KEYS, "left").withColumn("kron_radius", k)
    small = scale * F.col("kron_radius") * F.sqrt(F.col("semimajor_axis") * F.col("semiminor_axis")) <= least_circle
    return out.withColumn("kron_radius", F.when(small & F.lit(least_circle > 0), 0.0).otherwise(F.col("kron_radius"))).drop("num", "den")


def kron_ellipses(radii: DataFrame, scale: float = 2.5, least_circle: float = 0.0) -> DataFrame:
    """The labels' Kron apertures: KEYS, x_centroid, y_centroid, a, b, theta; circles of least_circle where the radius is 0."""
    axis = lambda c: F.when(F.col("kron_radius") == 0, F.lit(least_circle)).otherwise(scale * F.col("kron_radius") * F.col(c))
    return radii.select(*KEYS, "x_centroid", "y_centroid", axis("semimajor_axis").alias("a"), axis("semiminor_axis").alias("b"), "theta")


def elliptical_photometry(pixels: DataFrame, segments: DataFrame, ellipses: DataFrame, neighbours: str = "correct") -> DataFrame:
    """(KEYS, flux, flux_err) in exact ellipses (KEYS, x_centroid, y_centroid, a, b, theta) of any size and turn: areas by a NumPy kernel on batches of pixels, sums by Spark."""
    rows = around(pixels, segments, ellipses.withColumn("reach", F.col("a")), neighbours).select(*KEYS, (F.col("x") - F.col("x_centroid")).alias("dx"), (F.col("y") - F.col("y_centroid")).alias("dy"), "a", "b", "theta", F.col("value").cast("double").alias("value"), F.col("error").cast("double").alias("error"))

    def weigh(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            w = ellipse_area(*(part[c].to_numpy(float) for c in ("dx", "dy", "a", "b", "theta")))
            yield part[[*KEYS, "value", "error"]].assign(w=w)[w > 1e-15]

    kind = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.select(*KEYS).schema)
    weighed = rows.mapInPandas(weigh, f"{kind}, value double, error double, w double")
    return weighed.groupBy(*KEYS).agg(F.sum(F.col("w") * F.col("value")).alias("flux"), F.sqrt(F.sum(F.pow(F.col("w") * F.col("error"), F.lit(2.0)))).alias("flux_err"))


def kron(pixels: DataFrame, segments: DataFrame, scale: float = 2.5, least: float = 1.4, least_circle: float = 0.0, neighbours: str = "correct") -> DataFrame:
    """(image_id, label, kron_radius, kron_flux, kron_flux_err): sums in the exact ellipse of `scale` Kron radii."""
    radii = segmentation.kept(kron_radii(pixels, segments, scale, least, least_circle, neighbours=neighbours), "kron")
    flux = elliptical_photometry(pixels, segments, kron_ellipses(radii, scale, least_circle), neighbours)
    return radii.select(*KEYS, "kron_radius").join(flux, KEYS, "left").select(*KEYS, "kron_radius", F.col("flux").alias("kron_flux"), F.col("flux_err").alias("kron_flux_err"))


def on_bands(table: DataFrame, bands: DataFrame) -> DataFrame:
    """What a table says of detection images, for each band's image (bands: image_id, detection)."""
    names = bands.select("image_id", F.col("detection").alias("_of"))
    return table.withColumnRenamed("image_id", "_of").join(names, "_of").select(*table.columns)


def by_detection(pixels: DataFrame, segments: DataFrame, bands: DataFrame, scale: float = 2.5, least: float = 1.4, least_circle: float = 0.0, radius: float = 3.0, neighbours: str = "correct") -> DataFrame:
    """Each label of a detection image measured on all its bands by the detection's geometry: (KEYS, x_centroid, y_centroid, kron_radius, segment_flux, segment_flux_err, kron_flux, kron_flux_err, circle_flux, circle_flux_err).

    bands: (image_id, detection), the detection image that each image's labels, centroids, Kron ellipses and circles come from; it may be its own. Labels,
    shapes and radii are made once a detection image; a band's pixels meet each aperture in one join, whatever the number of bands. A band without
    pixels under a label has null fluxes there; images that bands doesn't name are left out.
    """
    there = bands.select(F.col("detection").alias("image_id")).distinct()
    source, shape = pixels.join(there, "image_id", "left_semi"), segments.join(there, "image_id", "left_semi")
    radii = segmentation.kept(kron_radii(source, shape, scale, least, least_circle, neighbours=neighbours), "kron")
    own, mapped = on_bands(shape, bands), segmentation.kept(on_bands(radii, bands), "bands")
    sums = pixels.join(own, ["image_id", "y", "x"]).groupBy(*KEYS).agg(F.sum("value").alias("segment_flux"), F.sqrt(F.sum(F.col("error") * F.col("error"))).alias("segment_flux_err"))
    ellipses = kron_ellipses(mapped, scale, least_circle)
    circles = mapped.select(*KEYS, "x_centroid", "y_centroid", F.lit(float(radius)).alias("a"), F.lit(float(radius)).alias("b"), F.lit(0.0).alias("theta"))
    out = mapped.select(*KEYS, "x_centroid", "y_centroid", "kron_radius").join(sums, KEYS, "left")
    for table, name in ((ellipses, "kron"), (circles, "circle")):
        flux = elliptical_photometry(pixels, own, table, neighbours)
        out = out.join(flux.select(*KEYS, F.col("flux").alias(f"{name}_flux"), F.col("flux_err").alias(f"{name}_flux_err")), KEYS, "left")
    return out


def flux_radius(pixels: DataFrame, segments: DataFrame, share: float = 0.5, scale: float = 2.5, neighbours: str = "correct") -> DataFrame:
    """(image_id, label, flux_radius): the radius of the exact circle around the centroid that holds that share of the Kron flux, between 0.1 and the Kron ellipse's semimajor axis; where the flux falls again the outer bound is drawn in by tenths, and without a solution the radius is null. A label's pixels meet in one call, as they are few."""
    if not 0 < share <= 1:
        raise ValueError("share lies above 0 and up to 1")
    radii = segmentation.kept(kron_radii(pixels, segments, scale, neighbours=neighbours), "kron")
    ellipses = kron_ellipses(radii, scale)
    flux = elliptical_photometry(pixels, segments, ellipses, neighbours).select(*KEYS, "flux")
    rows = around(pixels, segments, ellipses.withColumn("reach", F.col("a")).join(flux, KEYS), neighbours)
    rows = rows.select(*KEYS, (F.col("x") - F.col("x_centroid")).alias("dx"), (F.col("y") - F.col("y_centroid")).alias("dy"), "value", "flux", F.col("a").alias("most"))

    def solve(group: pd.DataFrame) -> pd.DataFrame:
        dx, dy, v = (group[c].to_numpy(float) for c in ("dx", "dy", "value"))
        target, most = share * group.flux.iloc[0], group.most.iloc[0]
        lack = lambda r: 1 - (ellipse_area(dx, dy, r, r, 0.0) * v).sum() / target
        low, high, step, found = 0.1, most, 0.1 * most, np.nan
        if np.isfinite(target) and target != 0:
            first = lack(low)
            while high > low and first * lack(high) > 0:
                high -= step
            if high > low:
                for _ in range(60):
                    mid = (low + high) / 2
                    low, high = (mid, high) if lack(mid) * first > 0 else (low, mid)
                found = (low + high) / 2
        return group.iloc[:1][KEYS].assign(flux_radius=found if np.isfinite(found) else None)

    kind = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.select(*KEYS).schema)
    found = rows.groupBy(*KEYS).applyInPandas(solve, f"{kind}, flux_radius double")
    return radii.select(*KEYS).join(found, KEYS, "left")


#: The quality flags of labels by bit.
FLAGS = {
    1: "masked_pixels", 2: "non_finite_data", 4: "non_finite_error", 8: "all_masked", 16: "edge_touch", 32: "deblended", 64: "deblend_nonposmin", 128: "deblend_n_markers", 256: "undefined_shape",
    512: "singular_covariance", 1024: "centroid_win_fallback", 2048: "centroid_quad_failed", 4096: "kron_undefined", 8192: "kron_minimum_radius", 16384: "kron_no_overlap",
    32768: "kron_partial_overlap", 65536: "kron_masked_pixels", 131072: "kron_neighbor_pixels", 262144: "kron_uncorrected_pixels",
}


def flags(pixels: DataFrame, segments: DataFrame, parents: DataFrame | None = None) -> DataFrame:
    """(image_id, label, flags): what the pixels, the image's edge, the shape and, with parents (image_id, label, parent), deblending say; FLAGS names the bits. decode with aperture.decode_flags(column, FLAGS)."""
    rows = pixels.join(segments, ["image_id", "y", "x"])
    masked, bad = F.coalesce("mask", F.lit(False)), ~finite(F.col("value"))
    wrong = F.coalesce(~finite(F.col("error")), F.lit(False)) & F.col("error").isNotNull()
    ends = pixels.groupBy("image_id").agg(F.max("y").alias("y_end"), F.max("x").alias("x_end"))
    edge = (F.col("y") == 0) | (F.col("x") == 0) | (F.col("y") == F.col("y_end")) | (F.col("x") == F.col("x_end"))
    seen = rows.join(ends, "image_id").groupBy(*KEYS).agg(F.max(masked).alias("masked"), F.max(~masked & bad).alias("bad"), F.max(~masked & wrong).alias("wrong"), F.min(masked | bad).alias("none"), F.max(edge).alias("edge"), F.sum(F.when(~masked & ~bad, F.col("value"))).alias("light"))
    good = pixels.where(~masked)
    shape = stats.central_moments(good.join(segments, ["image_id", "y", "x"]), KEYS)
    xx, yy, xy = (fdiv(F.col(c), F.col("mu00")) for c in ("mu02", "mu20", "mu11"))
    least = (xx + yy) / 2 - F.sqrt((xx - yy) * (xx - yy) / 4 + xy * xy)
    seen = seen.join(shape.select(*KEYS, (least < 1 / 12).alias("thin")), KEYS, "left")
    if parents is not None:
        split = parents.select(*KEYS, "parent").distinct().groupBy("image_id", "parent").agg(F.count("*").alias("n"), F.collect_set("label").alias("labels")).where("n > 1").select("image_id", F.explode("labels").alias("label"), F.lit(True).alias("split"))
        seen = seen.join(split, KEYS, "left")
    bits = {"masked_pixels": F.col("masked"), "non_finite_data": F.col("bad"), "non_finite_error": F.col("wrong"), "all_masked": F.col("none"), "edge_touch": F.col("edge"), "undefined_shape": F.coalesce(F.col("light") <= 0, F.lit(True)), "singular_covariance": F.coalesce(F.col("thin"), F.lit(False))}
    if parents is not None:
        bits["deblended"] = F.coalesce("split", F.lit(False))
    number = {name: bit for bit, name in FLAGS.items()}
    return seen.select(*KEYS, sum((F.when(c, number[n]).otherwise(0) for n, c in bits.items()), F.lit(0)).cast("int").alias("flags"))


def kron_flags(pixels: DataFrame, segments: DataFrame, radii: DataFrame, scale: float = 2.5, least: float = 1.4) -> DataFrame:
    """(image_id, label, flags): the Kron bits of FLAGS that follow from the radius and from where the ellipse's box lies."""
    ends = pixels.groupBy("image_id").agg(F.max("y").alias("y_end"), F.max("x").alias("x_end"))
    e = kron_ellipses(radii, scale).join(radii.select(*KEYS, "kron_radius"), KEYS).join(ends, "image_id")
    c, s = F.cos("theta"), F.sin("theta")
    wide, high = F.sqrt(F.pow(F.col("a") * c, F.lit(2.0)) + F.pow(F.col("b") * s, F.lit(2.0))), F.sqrt(F.pow(F.col("a") * s, F.lit(2.0)) + F.pow(F.col("b") * c, F.lit(2.0)))
    left, right, low, top = F.col("x_centroid") - wide, F.col("x_centroid") + wide, F.col("y_centroid") - high, F.col("y_centroid") + high
    apart = (right <= -0.5) | (top <= -0.5) | (left >= F.col("x_end") + 0.5) | (low >= F.col("y_end") + 0.5)
    partly = ~apart & ((left < -0.5) | (low < -0.5) | (right > F.col("x_end") + 0.5) | (top > F.col("y_end") + 0.5))
    bits = {"kron_undefined": F.col("kron_radius").isNull(), "kron_minimum_radius": F.col("kron_radius") <= least, "kron_no_overlap": apart, "kron_partial_overlap": partly}
    number = {name: bit for bit, name in FLAGS.items()}
    return e.select(*KEYS, sum((F.when(F.coalesce(v, F.lit(False)), number[n]).otherwise(0) for n, v in bits.items()), F.lit(0)).cast("int").alias("flags"))


def cutouts(pixels: DataFrame, sources: DataFrame, height: int, width: int, fill: float | None = None) -> DataFrame:
    """(image_id, id, y_min, x_min, data): the values around each source (image_id, id, x, y) as an array of rows; places beyond the image are `fill`. One row holds one cut-out, height x width."""
    low = lambda c, n: F.ceil(F.col(c) - n / 2).cast("int")
    boxes = sources.select("image_id", "id", low("y", height).alias("y_min"), low("x", width).alias("x_min"))
    cells = boxes.withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(height - 1)))).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(width - 1))))
    cells = cells.withColumns({"y": F.col("y_min") + F.col("j"), "x": F.col("x_min") + F.col("i")}).join(pixels.select("image_id", "y", "x", "value"), ["image_id", "y", "x"], "left")
    value = F.coalesce("value", F.lit(fill)) if fill is not None else F.col("value")
    lines = cells.groupBy("image_id", "id", "y_min", "x_min", "j").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", value.alias("v")))), lambda s: s["v"]).alias("line"))
    return lines.groupBy("image_id", "id", "y_min", "x_min").agg(F.transform(F.array_sort(F.collect_list(F.struct("j", "line"))), lambda s: s["line"]).alias("data"))


def select_labels(table: DataFrame, labels: list[int]) -> DataFrame:
    """The catalogue's rows of these labels; labels that it lacks are refused."""
    out = table.where(F.col("label").isin([int(v) for v in labels]))
    lacking = set(labels) - {r["label"] for r in out.select("label").distinct().collect()}
    if lacking:
        raise ValueError(f"labels not in the catalogue: {sorted(lacking)}")
    return out


def with_property(table: DataFrame, name: str, value: Column, overwrite: bool = False) -> DataFrame:
    """The catalogue with one more column; one that is there is only replaced if asked for."""
    if name in table.columns and not overwrite:
        raise ValueError(f"{name} is there already")
    return table.withColumn(name, value)


def catalog(pixels: DataFrame, segments: DataFrame) -> DataFrame:
    return measured(pixels, segments).join(shapes(pixels, segments), KEYS, "left").join(segmentation.perimeter(segments), KEYS, "left")
