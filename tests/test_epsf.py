"""Effective PSFs: splines and their slopes, smoothing, cell sums, and a known shape found again from shifted stars."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from pixelloom.functions.sampled import Sampled, filled, smoothed, smoothing
from pixelloom.operators import epsf
from pixelloom.operators.psf import gaussian_prf


def test_splines_and_slopes():
    rng = np.random.default_rng(1)
    grid = rng.normal(size=(21, 25))
    s = Sampled(grid, 4)
    j, i = np.indices(grid.shape)
    assert np.allclose(s((i - 12) / 4, (j - 10) / 4)[0], grid, atol=1e-12)
    dx, dy, h = rng.uniform(-2.5, 2.5, 300), rng.uniform(-2.2, 2.2, 300), 1e-6
    v, vx, vy = s(dx, dy)
    assert np.allclose(vx, (s(dx + h, dy)[0] - s(dx - h, dy)[0]) / (2 * h), atol=1e-6) and np.allclose(vy, (s(dx, dy + h)[0] - s(dx, dy - h)[0]) / (2 * h), atol=1e-6)
    assert s(np.array([9.0]), np.array([0.0]))[0][0] == 0


@pytest.mark.parametrize("degree", [2, 4])
def test_smoothing_keeps_polynomials(degree):
    j, i = (g.astype(float) for g in np.indices((12, 12)))
    p = 3 + i - 2 * j + 0.3 * i * j + (0.01 * i**2 * j**2 if degree == 4 else 0)
    assert np.allclose(smoothed(p, smoothing(degree))[2:-2, 2:-2], p[2:-2, 2:-2])
    assert smoothing(degree).sum() == pytest.approx(1)
    holes = p.copy()
    holes[4:6, 4:9] = np.nan
    assert np.isfinite(filled(holes)).all() and (filled(np.full((3, 3), np.nan)) == 0).all()


def field(n: int, sigma: float, half: int, noise: float = 0.0, seed: int = 3):
    rng = np.random.default_rng(seed)
    pixels, stars, truth = [], [], {}
    for k in range(n):
        x, y, flux = 10 + rng.uniform(-0.5, 0.5), 10 + rng.uniform(-0.5, 0.5), rng.uniform(500, 700)
        j, i = (g.ravel() for g in np.indices((21, 21)))
        v = gaussian_prf(i - x, j - y, flux, sigma) + noise * rng.normal(size=441)
        pixels += [(f"s{k}", int(b), int(a), float(c), False) for b, a, c in zip(j, i, v, strict=True)]
        stars.append((f"s{k}", k, x + 0.1 * rng.normal(), y + 0.1 * rng.normal()))
        truth[k] = x, y, flux
    return pixels, [(n, k, float(x), float(y)) for n, k, x, y in stars], truth


PIXELS, STARS = "image_id string, y int, x int, value double, mask boolean", "image_id string, id long, x double, y double"


def test_known_shape_is_found(spark):
    pixels, stars, truth = field(200, 1.3, 7)
    grid, found = epsf.build(spark.createDataFrame(pixels, PIXELS), spark.createDataFrame(stars, STARS), 7, over=4)
    side = grid.shape[0]
    j, i = np.indices(grid.shape)
    want = gaussian_prf(((i - side // 2) / 4).ravel(), ((j - side // 2) / 4).ravel(), 1.0, 1.3).reshape(grid.shape)
    assert np.abs(grid - want).max() < 0.01 * want.max()
    rows = found.collect()
    assert len(rows) == 200
    assert max(np.hypot(r.x - truth[r.id][0], r.y - truth[r.id][1]) for r in rows) < 0.01
    assert max(abs(r.flux / truth[r.id][2] - 1) for r in rows) < 0.01


def test_outlying_pixels_are_clipped_and_masked_ones_left_out(spark):
    pixels, stars, _ = field(120, 1.3, 6, seed=5)
    rng = np.random.default_rng(2)
    broken = [(n, y, x, 1e4 if k % 2 else float("nan"), k % 2 == 1) if hit else (n, y, x, v, m) for k, ((n, y, x, v, m), hit) in enumerate(zip(pixels, rng.random(len(pixels)) < 0.01, strict=True))]
    grid, _ = epsf.build(spark.createDataFrame(broken, PIXELS), spark.createDataFrame(stars, STARS), 6, over=2, rounds=6)
    side = grid.shape[0]
    j, i = np.indices(grid.shape)
    want = gaussian_prf(((i - side // 2) / 2).ravel(), ((j - side // 2) / 2).ravel(), 1.0, 1.3).reshape(grid.shape)
    assert np.abs(grid - want).max() < 0.03 * want.max()


def test_no_stars_and_stars_of_all_images(spark):
    pixels, stars, _ = field(3, 1.3, 5)
    table = spark.createDataFrame(pixels, PIXELS)
    grid, found = epsf.build(table, spark.createDataFrame([], STARS), 5)
    assert not grid.any() and found.count() == 0
    far = spark.createDataFrame([(1, 500.0, 500.0)], "id long, x double, y double")
    assert epsf.build(table, far, 5)[1].count() == 0
    every = epsf.cut_outs(table, spark.createDataFrame([(1, 10.0, 10.0)], "id long, x double, y double"), 3)
    assert every.count() == 3 and every.agg(F.min(F.size("value"))).first()[0] == 49
    assert epsf.as_table(spark, np.eye(3), 2).where("value = 1").count() == 3
