"""Several images at once, and meshes with wide holes."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from pixelloom.operators import aperture, background, psf


def planes(spark, **values):
    rows = [(n, y, x, float(v[y, x]), 1.0, False) for n, v in values.items() for y in range(v.shape[0]) for x in range(v.shape[1])]
    return spark.createDataFrame(rows, "image_id string, y int, x int, value double, error double, mask boolean")


def test_corrected_neighbours_own_image(spark):
    pixels = planes(spark, a=np.ones((11, 11)), b=2 * np.ones((11, 11)))
    segments = spark.createDataFrame([("a", 5, 5, 1), ("b", 5, 6, 2)], "image_id string, y int, x int, label int")
    sources = spark.createDataFrame([("a", 1, 5.0, 5.0, 1)], "image_id string, id long, x double, y double, label int")
    (row,) = aperture.corrected_neighbours(pixels, segments, sources, aperture.circle(2)).collect()
    assert (row.image_id, row.area, row.flux) == ("a", row.area, row.area)
    assert aperture.corrected_neighbours(pixels, segments, sources.drop("image_id"), aperture.circle(2)).count() == 2


def test_render_and_fit_own_image(spark):
    flat = planes(spark, a=np.zeros((15, 15)), b=np.zeros((15, 15)))
    sources = spark.createDataFrame([("a", 1, 1, 6.2, 7.1, 50.0), ("b", 1, 1, 8.4, 6.3, 90.0)], "image_id string, id long, group_id long, x double, y double, flux double")
    model = psf.render(flat, sources, 1.2, 6)
    total = {r.image_id: r.s for r in model.groupBy("image_id").agg(F.sum("model").alias("s")).collect()}
    assert total == {"a": pytest.approx(50, rel=1e-3), "b": pytest.approx(90, rel=1e-3)}
    y, x = np.mgrid[:15, :15]
    shine = {n: psf.gaussian_prf((x - cx).ravel(), (y - cy).ravel(), f, 1.2).reshape(15, 15) for n, cx, cy, f in (("a", 6.2, 7.1, 50.0), ("b", 8.4, 6.3, 90.0))}
    fits = {r.image_id: (r.x_fit, r.y_fit, r.flux_fit) for r in psf.fit(planes(spark, **shine), sources, 1.2).collect()}
    assert fits["a"] == pytest.approx((6.2, 7.1, 50.0), abs=1e-4) and fits["b"] == pytest.approx((8.4, 6.3, 90.0), abs=1e-4) and len(fits) == 2


@pytest.mark.parametrize("known", [[], [(0, 0)], [(0, 0), (0, 19), (3, 3), (19, 0), (19, 19)], [(9, k) for k in range(20)]])
def test_inverse_distances_over_holes(spark, known):
    n, size, k = 20, 4, 3
    pixels = planes(spark, a=np.zeros((n * size, n * size)), b=np.zeros((6, 6)))
    rows = [("a", j, i, float(j * 31 + i)) for j, i in known] + [("a", 5, 5, None)]
    boxes = spark.createDataFrame(rows, "image_id string, box_y int, box_x int, background double")
    got = {(r.image_id, r.y, r.x): r.background for r in background.idw_to_pixels(pixels, boxes, size, k).collect()}
    assert len(got) == (n * size) ** 2 + 36 and all(got["b", y, x] is None for y in range(6) for x in range(6))
    middle = np.array([((j + 0.5) * size - 0.5, (i + 0.5) * size - 0.5, j, i) for j, i in known])
    for y in range(0, n * size, 7):
        for x in range(0, n * size, 5):
            if not known:
                assert got["a", y, x] is None
                continue
            d = np.hypot(middle[:, 0] - y, middle[:, 1] - x)
            best = sorted(range(len(known)), key=lambda m: (d[m], middle[m, 2], middle[m, 3]))[:k]
            v = [middle[m, 2] * 31 + middle[m, 3] for m in best]
            w = [1 / d[m] for m in best]
            assert got["a", y, x] == pytest.approx(np.dot(v, w) / sum(w))
