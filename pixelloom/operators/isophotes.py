"""Elliptical isophotes: brightness along ellipses is sampled in batches, harmonics are solved from grouped sums."""

from __future__ import annotations

from math import cos, pi, sin

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def ellipse_samples(pixels: DataFrame, x0: float, y0: float, semimajor: list[float], ellipticity: float, angle: float, points: int = 64) -> DataFrame:
    """(image_id, sma, phi, value): brightness at even angles of ellipses, bilinear between pixels. Sample points join the four pixels around them."""
    spark = pixels.sparkSession
    rows = []
    for a in semimajor:
        for k in range(points):
            phi = 2 * pi * k / points
            r = a * (1 - ellipticity) / ((((1 - ellipticity) * cos(phi)) ** 2 + sin(phi) ** 2) ** 0.5)
            x, y = x0 + r * cos(phi + angle), y0 + r * sin(phi + angle)
            i, j = int(np.floor(x)), int(np.floor(y))
            rows += [(float(a), k, phi, j + dj, i + di, (abs(1 - dj - (y - j))) * (abs(1 - di - (x - i)))) for dj in (0, 1) for di in (0, 1)]
    at = spark.createDataFrame(rows, "sma double, k int, phi double, y int, x int, w double")
    met = pixels.select("image_id", "y", "x", "value").join(at, ["y", "x"])
    return met.groupBy("image_id", "sma", "k", "phi").agg(F.sum(F.col("w") * F.col("value")).alias("value"), F.sum("w").alias("w")).where("w > 0.999999").drop("w", "k")


def harmonics(samples: DataFrame) -> DataFrame:
    """(image_id, sma, intensity, s1, c1, s2, c2): mean brightness and its first two harmonics; even angles make them sums."""
    term = lambda f, n: 2 * F.avg(F.col("value") * f(F.col("phi") * n))
    return samples.groupBy("image_id", "sma").agg(F.avg("value").alias("intensity"), term(F.sin, 1).alias("s1"), term(F.cos, 1).alias("c1"), term(F.sin, 2).alias("s2"), term(F.cos, 2).alias("c2"), F.count("*").alias("n"))


def fit_ellipse(pixels: DataFrame, x0: float, y0: float, sma: float, ellipticity: float = 0.2, angle: float = 0.0, rounds: int = 50, converged: float = 0.05) -> DataFrame:
    """The ellipse of one semimajor axis fitted in each image: its largest harmonic is taken away by shifting, flattening or turning, until it is small against the scatter. An image's pixels within reach meet in one task."""
    reach = 2 * sma + 3
    near = pixels.where((F.abs(F.col("x") - x0) <= reach) & (F.abs(F.col("y") - y0) <= reach)).select("image_id", "y", "x", "value")
    kind = pixels.schema["image_id"].dataType.simpleString()

    def solve(group: pd.DataFrame) -> pd.DataFrame:
        y_low, x_low = int(group.y.min()), int(group.x.min())
        plane = np.full((int(group.y.max()) - y_low + 1, int(group.x.max()) - x_low + 1), np.nan)
        plane[group.y - y_low, group.x - x_low] = group.value

        def sample(cx, cy, a, e, t):
            phi = np.linspace(0, 2 * np.pi, 64, endpoint=False)
            r = a * (1 - e) / np.sqrt(((1 - e) * np.cos(phi)) ** 2 + np.sin(phi) ** 2)
            x, y = cx + r * np.cos(phi + t) - x_low, cy + r * np.sin(phi + t) - y_low
            i, j = np.floor(x).astype(int), np.floor(y).astype(int)
            inside = (i >= 0) & (j >= 0) & (i < plane.shape[1] - 1) & (j < plane.shape[0] - 1)
            i, j, x, y, phi = i[inside], j[inside], x[inside], y[inside], phi[inside]
            v = plane[j, i] * (j + 1 - y) * (i + 1 - x) + plane[j + 1, i] * (y - j) * (i + 1 - x) + plane[j, i + 1] * (j + 1 - y) * (x - i) + plane[j + 1, i + 1] * (y - j) * (x - i)
            good = np.isfinite(v)
            return phi[good], v[good]

        cx, cy, e, t, stop, done, mean = x0, y0, ellipticity, angle, 2, 0, None
        for done in range(1, rounds + 1):
            phi, v = sample(cx, cy, sma, e, t)
            if len(v) < 8:
                stop = 3
                break
            base = np.stack([np.ones_like(phi), np.sin(phi), np.cos(phi), np.sin(2 * phi), np.cos(2 * phi)], axis=1)
            c = np.linalg.lstsq(base, v, rcond=None)[0]
            mean, scatter = c[0], (v - base @ c).std()
            _, outer = sample(cx, cy, sma * 1.1, e, t)
            slope = (outer.mean() - mean) / (0.1 * sma) if len(outer) else 0.0
            k = int(np.abs(c[1:]).argmax())
            if abs(c[1 + k]) <= converged * scatter or slope == 0:
                stop = 0
                break
            if k == 0:
                d = -c[1] * (1 - e) / slope
                cx, cy = cx - d * np.sin(t), cy + d * np.cos(t)
            elif k == 1:
                d = -c[2] / slope
                cx, cy = cx + d * np.cos(t), cy + d * np.sin(t)
            elif k == 2:
                t = t + c[3] * 2 * (1 - e) / (sma * slope * ((1 - e) ** 2 - 1)) if e > 1e-6 else t
            else:
                e = float(np.clip(e - c[4] * 2 * (1 - e) / (sma * slope), 0.0, 0.95))
        return pd.DataFrame({"image_id": group.image_id.iloc[:1], "x0": [cx], "y0": [cy], "sma": [sma], "ellipticity": [e], "angle": [t % np.pi], "intensity": [mean], "stop_code": [stop], "rounds": [done]})

    return near.groupBy("image_id").applyInPandas(solve, f"image_id {kind}, x0 double, y0 double, sma double, ellipticity double, angle double, intensity double, stop_code int, rounds int")
