"""Centroids of the light around sources."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelloom.functions.columns import fdiv
from pixelloom.operators import stats
from pixelloom.operators.detection import cut_outs
from pixelloom.operators.psf import least_squares


def around(pixels: DataFrame, sources: DataFrame, half: int) -> DataFrame:
    """The pixels of the box around each source (image_id, id, x, y), with offsets (j, i)."""
    near = sources.select("image_id", "id", F.floor(F.col("y") + 0.5).cast("int").alias("y"), F.floor(F.col("x") + 0.5).cast("int").alias("x"))
    return cut_outs(pixels.where(~F.coalesce("mask", F.lit(False))), near, half, half, ["value"])


def centre_of_mass(pixels: DataFrame, sources: DataFrame, half: int = 5) -> DataFrame:
    return stats.centroid(around(pixels, sources, half), ["image_id", "id"])


def quadratic(pixels: DataFrame, sources: DataFrame, half: int = 2) -> DataFrame:
    """Maximum of the quadratic surface fitted to the box around each source. On a full square the normal equations are sums; a box cut by the edge, a saddle or a minimum gives null."""
    rows = around(pixels, sources, half)
    n = (2 * half + 1) ** 2
    s2 = sum(i * i for i in range(-half, half + 1)) * (2 * half + 1)
    s4 = sum(i**4 for i in range(-half, half + 1)) * (2 * half + 1)
    s22 = sum(i * i for i in range(-half, half + 1)) ** 2
    v, i, j = F.col("value"), F.col("i"), F.col("j")
    sums = rows.groupBy("image_id", "id").agg(F.count("*").alias("n"), F.max("x0").alias("x0"), F.max("y0").alias("y0"), F.sum(v).alias("s"), F.sum(v * i).alias("si"), F.sum(v * j).alias("sj"), F.sum(v * i * j).alias("sij"), F.sum(v * i * i).alias("sii"), F.sum(v * j * j).alias("sjj"))
    # value = c00 + c10 i + c01 j + c11 i j + c20 i^2 + c02 j^2; the three even terms hang together
    det = (s4 - s22) * (n * (s4 + s22) - 2 * s2 * s2)
    c20 = (F.col("sii") * (n * s4 - s2 * s2) + F.col("sjj") * (s2 * s2 - n * s22) - F.col("s") * s2 * (s4 - s22)) / det
    c02 = (F.col("sjj") * (n * s4 - s2 * s2) + F.col("sii") * (s2 * s2 - n * s22) - F.col("s") * s2 * (s4 - s22)) / det
    fit = sums.select("image_id", "id", "n", "x0", "y0", (F.col("si") / s2).alias("c10"), (F.col("sj") / s2).alias("c01"), (F.col("sij") / s22).alias("c11"), c20.alias("c20"), c02.alias("c02"))
    d = 4 * F.col("c20") * F.col("c02") - F.col("c11") * F.col("c11")
    fine = (F.col("n") == n) & (d > 0) & (F.col("c20") <= 0)
    x = F.col("x0") + fdiv(F.col("c01") * F.col("c11") - 2 * F.col("c02") * F.col("c10"), d)
    y = F.col("y0") + fdiv(F.col("c10") * F.col("c11") - 2 * F.col("c20") * F.col("c01"), d)
    return fit.select("image_id", "id", F.when(fine, x).alias("x_centroid"), F.when(fine, y).alias("y_centroid"))


def windowed(pixels: DataFrame, sources: DataFrame, sigma: float, rounds: int = 10) -> DataFrame:
    """Centroids under a round Gaussian weight that follows them: each round moves by twice the weighted offset. A fixed number of rounds in one kernel per source, whose pixels are few."""
    half = int(4 * sigma + 1)
    rows = around(pixels, sources, half).join(sources.select("image_id", "id", F.col("x").alias("sx"), F.col("y").alias("sy")), ["image_id", "id"])
    kind = pixels.schema["image_id"].dataType.simpleString()

    def move(group: pd.DataFrame) -> pd.DataFrame:
        x, y, v = group.x.to_numpy(float), group.y.to_numpy(float), group.value.to_numpy(float)
        cx, cy = float(group.sx.iloc[0]), float(group.sy.iloc[0])
        for _ in range(rounds):
            w = np.exp(-((x - cx) ** 2 + (y - cy) ** 2) / (2 * sigma * sigma)) * v
            if not np.isfinite(w.sum()) or w.sum() <= 0:
                cx = cy = np.nan
                break
            dx, dy = (w * (x - cx)).sum() / w.sum(), (w * (y - cy)).sum() / w.sum()
            cx, cy = cx + 2 * dx, cy + 2 * dy
            if dx * dx + dy * dy < 1e-8:
                break
        return pd.DataFrame({"image_id": group.image_id.iloc[:1], "id": group.id.iloc[:1], "x_centroid": [cx], "y_centroid": [cy]})

    return rows.groupBy("image_id", "id").applyInPandas(move, f"image_id {kind}, id long, x_centroid double, y_centroid double")


def gaussian_fit(pixels: DataFrame, sources: DataFrame, half: int = 5) -> DataFrame:
    """Centres and widths of a turned Gaussian on a level, fitted to the box around each source; null with fewer than seven pixels."""
    rows = around(pixels, sources, half)
    kind = pixels.schema["image_id"].dataType.simpleString()

    def solve(group: pd.DataFrame) -> pd.DataFrame:
        x, y, v = group.x.to_numpy(float), group.y.to_numpy(float), group.value.to_numpy(float)
        good = np.isfinite(v)
        x, y, v = x[good], y[good], v[good]
        p = np.full(7, np.nan)
        if len(v) >= 7 and v.max() > v.min():
            w = v - v.min()
            cx, cy = (w * x).sum() / w.sum(), (w * y).sum() / w.sum()
            sx, sy = (max(0.5, ((w * d * d).sum() / w.sum()) ** 0.5) for d in (x - cx, y - cy))

            def model(q):
                u, t = (x - q[1]) * np.cos(q[5]) + (y - q[2]) * np.sin(q[5]), (y - q[2]) * np.cos(q[5]) - (x - q[1]) * np.sin(q[5])
                return q[0] * np.exp(-(u * u / (2 * q[3] ** 2) + t * t / (2 * q[4] ** 2))) + q[6]

            p, _, _ = least_squares(model, np.array([v.max() - v.min(), cx, cy, sx, sy, 0.1, v.min()]), v, np.ones(len(v)))
        return pd.DataFrame({"image_id": group.image_id.iloc[:1], "id": group.id.iloc[:1], "x_centroid": [p[1]], "y_centroid": [p[2]], "x_sigma": [abs(p[3])], "y_sigma": [abs(p[4])], "level": [p[6]]})

    return rows.groupBy("image_id", "id").applyInPandas(solve, f"image_id {kind}, id long, x_centroid double, y_centroid double, x_sigma double, y_sigma double, level double")
