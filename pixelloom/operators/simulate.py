"""Simulated images: sources from lists, noise by seed, total errors, limiting depths."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixelloom.operators.aperture import Shape, photometry
from pixelloom.sources.images import grid


def blank(spark, height: int, width: int, level: float = 0.0) -> DataFrame:
    return grid(spark, height, width).select(F.lit("all").alias("image_id"), "y", "x", F.lit(float(level)).alias("value"), F.lit(1.0).alias("error"), F.lit(False).alias("mask"))


def elliptical_gaussian(dx: Column, dy: Column, amplitude: Column, sx: Column, sy: Column, theta: Column) -> Column:
    """Brightness at an offset from the centre of a turned Gaussian."""
    u, v = dx * F.cos(theta) + dy * F.sin(theta), dy * F.cos(theta) - dx * F.sin(theta)
    return amplitude * F.exp(-(u * u / (2 * sx * sx) + v * v / (2 * sy * sy)))


def add_gaussians(pixels: DataFrame, sources: DataFrame, factor: float = 6.0) -> DataFrame:
    """pixels plus turned Gaussians (x, y, amplitude, sx, sy, theta), each within factor times its larger width."""
    reach = F.ceil(F.greatest("sx", "sy") * factor).cast("int")
    rows = sources.withColumn("j", F.explode(F.sequence(-reach, reach))).withColumn("i", F.explode(F.sequence(-reach, reach)))
    rows = rows.withColumn("py", (F.floor(F.col("y") + 0.5) + F.col("j")).cast("int")).withColumn("px", (F.floor(F.col("x") + 0.5) + F.col("i")).cast("int"))
    light = elliptical_gaussian(F.col("px") - F.col("x"), F.col("py") - F.col("y"), F.col("amplitude"), F.col("sx"), F.col("sy"), F.col("theta"))
    sums = rows.select("py", "px", light.alias("light")).groupBy(F.col("py").alias("y"), F.col("px").alias("x")).agg(F.sum("light").alias("light"))
    return pixels.join(sums, ["y", "x"], "left").withColumn("value", F.col("value") + F.coalesce("light", F.lit(0.0))).drop("light")


def add_noise(pixels: DataFrame, sigma: float, seed: int = 0) -> DataFrame:
    """Gaussian noise that depends on seed and place alone, however the rows are partitioned (Box-Muller on hashes)."""
    dice = [(F.pmod(F.xxhash64("image_id", "y", "x", F.lit(seed), F.lit(k)), F.lit(1 << 40)) + 0.5) / float(1 << 40) for k in (0, 1)]
    return pixels.withColumn("value", F.col("value") + sigma * F.sqrt(-2 * F.log(dice[0])) * F.cos(2 * np.pi * dice[1]))


def total_error(value: Column, background: Column, gain: Column) -> Column:
    """Background noise and the sources' counting noise; without gain only the first."""
    return F.sqrt(background * background + F.when(gain > 0, F.greatest(F.try_divide(value, gain), F.lit(0.0))).otherwise(0.0))


def depth(pixels: DataFrame, spots: DataFrame, shape: Shape, n_sigma: float = 5.0, zero_point: float = 23.9) -> DataFrame:
    """(image_id, flux_limit, mag_limit): scatter of sums at empty spots (id, x, y) times n_sigma; spots that are masked or partly outside don't count."""
    sums = photometry(pixels, spots, shape).where("flags = 0")
    found = sums.groupBy("image_id").agg((n_sigma * F.stddev_pop("flux")).alias("flux_limit"))
    return found.withColumn("mag_limit", F.when(F.col("flux_limit") > 0, -2.5 * F.log10("flux_limit") + zero_point))
