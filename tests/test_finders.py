"""Finders, centroid fits and PSF tables on rendered stars."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from pixelloom.operators import centroids, finders, psf
from pixelloom.sources.images import positions

SPOTS = [(12.2, 10.1), (35.4, 14.8), (22.0, 36.3)]


@pytest.fixture(scope="module")
def field(spark):
    y, x = np.mgrid[:50, :50].astype(float)
    v = sum(psf.gaussian_prf(x - a, y - b, 1000.0, 1.2) for a, b in SPOTS)
    rows = [("a", j, i, float(v[j, i]), 1.0, False) for j in range(50) for i in range(50)]
    return spark.createDataFrame(rows, "image_id string, y int, x int, value double, error double, mask boolean").cache()


def near(rows, x, y, within):
    got = sorted((r[x], r[y]) for r in rows)
    assert len(got) == 3
    for (a, b), (c, d) in zip(got, sorted(SPOTS), strict=True):
        assert abs(a - c) < within and abs(b - d) < within


def test_iraf(field):
    near(finders.iraf_find(field, 10, 2.8, rounds=(0.0, 0.5)).collect(), "x_centroid", "y_centroid", 0.3)


def test_repeated(field):
    near([r for r in finders.repeated_photometry(field, 5.0, 1.2, 2).collect() if r.flux_fit > 500], "x_fit", "y_fit", 0.01)


def test_find_sources(field):
    assert finders.find_sources(field, F.col("value") > 5, 5).select("label").distinct().count() == 3


def test_centroid_fits(spark, field):
    stars = positions(spark, [(k, round(a) + 0.0, round(b) + 0.0) for k, (a, b) in enumerate(SPOTS)]).withColumn("image_id", F.lit("a"))
    near(centroids.windowed(field, stars, 1.5).collect(), "x_centroid", "y_centroid", 0.05)
    near(centroids.gaussian_fit(field, stars).collect(), "x_centroid", "y_centroid", 0.02)


def test_stack_and_grid(spark, field):
    stars = positions(spark, [(k, a, b) for k, (a, b) in enumerate(SPOTS)]).withColumn("image_id", F.lit("a"))
    shape = {(r.j, r.i): r.value for r in psf.stacked_psf(field, stars, 5).collect()}
    assert max(shape, key=shape.get) in {(j, i) for j in (-1, 0, 1) for i in (-1, 0, 1)}
    nodes = spark.createDataFrame([(float(gx), float(gy), 0, 0, float(gx + 10 * gy)) for gx in (0, 10) for gy in (0, 20)], "gx double, gy double, j int, i int, value double")
    got = {r.id: r.value for r in psf.gridded(nodes, positions(spark, [(1, 2.5, 5.0), (2, 10.0, 20.0), (3, -5.0, 50.0)])).collect()}
    assert got == pytest.approx({1: 52.5, 2: 210.0, 3: 200.0})


def test_tapers():
    for kind in ("hanning", "tukey", "cosine", "split", "tophat"):
        w = psf.taper(kind, 31)
        assert w[15, 15] == 1 and w[0, 0] == 0 and (np.diff(w[15, 15:]) <= 1e-12).all()
