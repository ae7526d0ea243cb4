"""Finders that chain steps: IRAF-like stars, detection with deblending, and repeated PSF photometry on residuals."""

from __future__ import annotations

from math import log, sqrt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixelloom.functions.columns import fdiv, root
from pixelloom.operators import deblend, psf, segmentation
from pixelloom.operators.detection import convolve, cut_outs, find_peaks, numbered, star_kernel, top_by_flux


def iraf_find(pixels: DataFrame, threshold: float, fwhm: float, sharp: tuple[float, float] = (0.5, 2.0), rounds: tuple[float, float] = (0.0, 0.2), brightest: int | None = None) -> DataFrame:
    """Stars by image moments: the sky is the mean of a star's pixels outside the kernel, what lies below it counts as 0."""
    k = star_kernel(fwhm)
    hy, hx = (n // 2 for n in k["kernel"].shape)
    seen = convolve(pixels, k["kernel"])
    found = numbered(find_peaks(seen.select("image_id", "y", "x", F.col("convolved").alias("value")), threshold * k["rel_err"], 2 * max(hx, int(2.5 * fwhm)) + 1))
    inside = F.array(*[F.lit(f"{j - hy}:{i - hx}") for j in range(2 * hy + 1) for i in range(2 * hx + 1) if k["mask"][j, i]])
    cells = cut_outs(pixels, found, hy, hx, ["value"]).withColumn("in", F.array_contains(inside, F.concat_ws(":", "j", "i")))
    sky = cells.groupBy("image_id", "id").agg(F.coalesce(F.avg(F.when(~F.col("in"), F.col("value"))), F.lit(0.0)).alias("sky"))
    rows = cells.where("in").join(sky, ["image_id", "id"]).withColumn("v", F.greatest(F.col("value") - F.col("sky"), F.lit(0.0)))
    sums = rows.groupBy("image_id", "id").agg(
        F.max("sky").alias("sky"), F.max("v").alias("peak"), F.sum("v").alias("flux"), F.sum(F.when(F.col("v") > 0, 1).otherwise(0)).alias("n_pixels"),
        F.sum(F.col("v") * F.col("x")).alias("mx"), F.sum(F.col("v") * F.col("y")).alias("my"), F.sum(F.col("v") * F.col("x") * F.col("x")).alias("mxx"), F.sum(F.col("v") * F.col("y") * F.col("y")).alias("myy"), F.sum(F.col("v") * F.col("x") * F.col("y")).alias("mxy"),
    )
    cx, cy = fdiv(F.col("mx"), F.col("flux")), fdiv(F.col("my"), F.col("flux"))
    stars = sums.select("image_id", "id", "sky", "peak", "flux", "n_pixels", cx.alias("x_centroid"), cy.alias("y_centroid"), (fdiv(F.col("mxx"), F.col("flux")) - cx * cx).alias("vx"), (fdiv(F.col("myy"), F.col("flux")) - cy * cy).alias("vy"), (fdiv(F.col("mxy"), F.col("flux")) - cx * cy).alias("vxy"))
    total, diff = F.col("vx") + F.col("vy"), F.col("vx") - F.col("vy")
    width = 2 * root(F.lit(log(2)) * total)
    out = stars.select("image_id", "id", "x_centroid", "y_centroid", width.alias("fwhm"), (width / fwhm).alias("sharpness"), fdiv(F.sqrt(diff * diff + 4 * F.col("vxy") * F.col("vxy")), total).alias("roundness"), F.degrees(F.atan2(2 * F.col("vxy"), diff) / 2).alias("orientation"), "n_pixels", "sky", "peak", "flux", F.when(F.col("flux") > 0, -2.5 * F.log10("flux")).alias("mag"))
    out = out.where(F.col("n_pixels") > 1).where(F.col("sharpness").between(*sharp) & F.col("roundness").between(*rounds))
    return out if brightest is None else top_by_flux(out, brightest)


def find_sources(pixels: DataFrame, over: Column, n_pixels: int, split: bool = True, **options) -> DataFrame:
    """segments of the pixels where `over` holds, deblended if asked for."""
    segments = segmentation.label(pixels, over, n_pixels)
    return deblend.deblend(pixels, segments, n_pixels, **options).select("image_id", "y", "x", "label") if split else segments


def repeated_photometry(pixels: DataFrame, threshold: float, sigma: float, rounds: int = 2, half: int = 2, separation: float = 3.0) -> DataFrame:
    """(image_id, id, round, x_fit, y_fit, flux_fit): stars are found, fitted in their groups and taken away, and the residual image is searched again. For tables of one image."""
    left, out = pixels, None
    kernel_fwhm = sigma * 2 * sqrt(2 * log(2))
    for turn in range(1, rounds + 1):
        seen = convolve(left, star_kernel(kernel_fwhm)["kernel"])
        peaks = numbered(find_peaks(seen.select("image_id", "y", "x", F.col("convolved").alias("value")), threshold, 2 * half + 1))
        stars = segmentation.kept(peaks.select("id", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), (F.col("peak") * 2 * 3.141592653589793 * sigma * sigma).alias("flux")), "stars")
        if stars.isEmpty():
            break
        grouped = stars.join(psf.groups(stars, separation), "id")
        fits = segmentation.kept(psf.fit(left, grouped, sigma, half).select("image_id", "id", F.lit(turn).alias("round"), "x_fit", "y_fit", "flux_fit"), "fits")
        out = fits if out is None else out.unionByName(fits)
        left = segmentation.kept(psf.residual(left, fits.select("id", F.col("x_fit").alias("x"), F.col("y_fit").alias("y"), F.col("flux_fit").alias("flux")), sigma, 4 * int(sigma + 1)), "residual")
    return out
