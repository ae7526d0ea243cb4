"""Sectors of ellipses, models with harmonics, and bands measured by a detection image."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from pixelloom.operators import catalog, ellipses

GEOMETRY = "image_id string, sma double, axis double, x0 double, y0 double, eps double, pa double"


def plane(spark, name, v):
    rows = [(name, int(j), int(i), float(v[j, i]), 1.0, False) for j in range(v.shape[0]) for i in range(v.shape[1])]
    return spark.createDataFrame(rows, "image_id string, y int, x int, value double, error double, mask boolean")


@pytest.mark.parametrize("how", ["mean", "median"])
def test_sectors_by_brute_force(spark, how):
    rng = np.random.default_rng(2)
    v = rng.normal(size=(61, 61))
    v[4, 7] = np.nan
    rings = [("a", s, s, 30.2, 29.7, eps, pa) for s, eps, pa in ((1.5, 0.2, 0.3), (5.0, 0.9, 2.9), (12.0, 0.6, -1.2), (20.0, 0.95, 1.5708), (26.0, 0.0, 7.0))]
    got = {(r.sma, r.k): (r.n, r.value) for r in ellipses.sectors(plane(spark, "a", v), spark.createDataFrame(rings, GEOMETRY).withColumn("outer", F.lit(False)), 0.3, how).collect()}
    y, x = np.mgrid[:61, :61]
    want = {}
    for _, sma, _, x0, y0, eps, pa in rings:
        n = max(24, int(np.ceil(2 * np.pi * sma)))
        phi = np.mod(np.arctan2(y - y0, x - x0) - pa, 2 * np.pi)
        a = (x - x0) * np.cos(pa) + (y - y0) * np.sin(pa)
        b = ((y - y0) * np.cos(pa) - (x - x0) * np.sin(pa)) / (1 - eps)
        e, k = np.hypot(a, b), np.floor(phi * n / (2 * np.pi) + 0.5).astype(int) % n
        for m in range(n):
            own = v[(k == m) & (e >= sma * 0.85) & (e < sma * 1.15) & np.isfinite(v)]
            if len(own):
                want[sma, m] = len(own), getattr(np, how)(own)
    assert got.keys() == want.keys() and len(want) > 150
    assert all(got[k][0] == want[k][0] and got[k][1] == pytest.approx(want[k][1]) for k in want)


def galaxy(size, x0, y0, eps, pa, power, scale=9.0):
    y, x = np.mgrid[:size, :size]
    a = (x - x0) * np.cos(pa) + (y - y0) * np.sin(pa)
    b = ((y - y0) * np.cos(pa) - (x - x0) * np.sin(pa)) / (1 - eps)
    return 1000 * np.exp(-((np.abs(a) ** power + np.abs(b) ** power) ** (1 / power)) / scale)


@pytest.mark.parametrize("mode", ["bilinear", "mean", "median"])
def test_model_of_a_boxy_galaxy(spark, mode):
    v = galaxy(91, 45.0, 45.0, 0.0, 0.6, 2.3)
    pixels = plane(spark, "g", v)
    start = ellipses.starts(pixels, ellipses.axes(3.0, 34.0, 0.1), 45.0, 45.0, 0.0, 0.6)
    found = ellipses.fit(pixels, start, fix=("centre", "eps", "pa"), mode=mode).cache()
    boxy = found.where("sma > 10").agg(F.avg("b4")).first()[0]
    assert abs(boxy) > 0.005
    model = ellipses.harmonic_image(pixels, found)
    y, x = np.mgrid[:91, :91]
    r = np.hypot(x - 45, y - 45)
    rows = model.collect()
    off = [abs(m.model / v[m.y, m.x] - 1) for m in rows if 6 < r[m.y, m.x] < 20]
    assert len(rows) == 91 * 91 and np.median(off) < 0.005 and np.percentile(off, 95) < (0.01 if mode == "bilinear" else 0.02)
    flat = ellipses.harmonic_image(pixels, found.drop("a3", "b3", "a4", "b4")).collect()
    plain = [abs(m.model / v[m.y, m.x] - 1) for m in flat if 6 < r[m.y, m.x] < 20]
    assert np.percentile(plain, 95) > 1.2 * np.percentile(off, 95)
    assert ellipses.harmonic_image(pixels, found.limit(0), fill=-1.0).where("model <> -1").count() == 0


def test_bands_by_detection(spark):
    y, x = np.mgrid[:41, :41]
    shape = 100 * np.exp(-((x - 20) ** 2 + (y - 19) ** 2) / 18)
    pixels = plane(spark, "d", shape).union(plane(spark, "r", 3 * shape)).union(plane(spark, "far", np.ones((5, 5)))).union(plane(spark, "e", shape[:, ::-1])).union(plane(spark, "not named", shape))
    segments = pixels.where("image_id in ('d', 'e') and value > 5").select("image_id", "y", "x", F.lit(4).alias("label"))
    bands = spark.createDataFrame([("d", "d"), ("r", "d"), ("far", "d"), ("e", "e")], "image_id string, detection string")
    got = {r.image_id: r for r in catalog.by_detection(pixels, segments, bands).collect()}
    assert got.keys() == {"d", "r", "far", "e"}
    alone = catalog.kron(pixels.where("image_id = 'd'"), segments.where("image_id = 'd'")).first()
    assert (got["d"].kron_radius, got["d"].kron_flux) == (pytest.approx(alone.kron_radius), pytest.approx(alone.kron_flux))
    for flux in ("segment_flux", "kron_flux", "circle_flux"):
        assert got["r"][flux] == pytest.approx(3 * got["d"][flux]) and got["far"][flux] is None
    assert got["r"].x_centroid == got["d"].x_centroid and got["e"].x_centroid == pytest.approx(40 - got["d"].x_centroid)
    assert catalog.by_detection(pixels, segments.limit(0), bands).count() == 0
