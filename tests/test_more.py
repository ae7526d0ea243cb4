"""Files, sky positions, splines, noise, Kron apertures, star centres, windows, flags, outlines and profiles."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from pixelloom.functions import models
from pixelloom.functions.wcs import Tan
from pixelloom.operators import aperture, background, catalog, detection, ellipses, photometry, profiles, psf, simulate
from pixelloom.sources import fits
from pixelloom.sources.images import positions
from pixelloom.streaming import frames


def test_fits_round_trip(spark, tmp_path):
    plane = np.arange(600, dtype=float).reshape(20, 30)
    plane[3, 4] = np.nan
    (tmp_path / "a.fits").write_bytes(fits.to_fits(plane, {"OBJECT": "x"}))
    got = np.full(plane.shape, -1.0)
    for r in fits.read_fits(spark, str(tmp_path)).collect():
        got[r.y, r.x] = r.value
    assert np.array_equal(got, plane, equal_nan=True)
    assert fits.read_headers(spark, str(tmp_path)).first().cards["OBJECT"] == "x"


def test_sky_round_trip(spark):
    wcs = Tan(50.0, 50.0, 359.99, -40.0, ((-0.001, 0.0003), (0.0002, 0.0011)))
    rows = positions(spark, [(1, 3.0, 90.0), (2, 50.0, 50.0)])
    lon, lat = wcs.to_sky(F.col("x"), F.col("y"))
    back = rows.select("id", "x", "y", lon.alias("lon"), lat.alias("lat")).select("id", "x", "y", "lon", "lat", *(c.alias(n) for c, n in zip(wcs.to_pixel(F.col("lon") - F.when(F.col("lon") < 180, 0).otherwise(0), F.col("lat")), ("u", "v"), strict=True))).collect()
    for r in back:
        assert (r.u, r.v) == pytest.approx((r.x, r.y), abs=1e-6)
    assert (back[1].lon, back[1].lat) == pytest.approx((359.99, -40.0))


def test_spline_weights():
    w = background.spline_weights(7, 8, 56)
    assert w.sum(axis=1) == pytest.approx(np.ones(56))
    assert background.spline_weights(5, 1, 5) == pytest.approx(np.eye(5), abs=1e-12)


def test_noise_is_fixed(spark):
    a, b = (simulate.add_noise(simulate.blank(spark, 60, 60, 1.0).repartition(n), 3.0, 5).orderBy("y", "x").toPandas().value.to_numpy() for n in (2, 5))
    assert (a == b).all() and a.std() == pytest.approx(3, rel=0.05) and a.mean() == pytest.approx(1, abs=0.2)


def test_stream(spark, tmp_path):
    pixels = simulate.blank(spark, 4, 4, 2.0)
    pixels.write.parquet(str(tmp_path / "in"))
    feed = spark.readStream.schema(pixels.schema).parquet(str(tmp_path / "in"))
    frames.each_batch(feed, lambda d: d.groupBy("image_id").agg(F.sum("value").alias("s")), str(tmp_path / "out"), str(tmp_path / "state")).processAllAvailable()
    assert spark.read.parquet(str(tmp_path / "out")).first().s == 32
    for q in spark.streams.active:
        q.stop()


def light(spark, value: np.ndarray, error: float = 1.0):
    rows = [("a", int(y), int(x), float(value[y, x]), error, False) for y in range(value.shape[0]) for x in range(value.shape[1])]
    return spark.createDataFrame(rows, "image_id string, y int, x int, value double, error double, mask boolean")


def blob(size: int, cx: float, cy: float, a: float, b: float, theta: float, flux: float = 1000.0) -> np.ndarray:
    y, x = np.mgrid[:size, :size]
    u, v = (x - cx) * np.cos(theta) + (y - cy) * np.sin(theta), (y - cy) * np.cos(theta) - (x - cx) * np.sin(theta)
    return flux / (2 * np.pi * a * b) * np.exp(-(u * u / a**2 + v * v / b**2) / 2)


def sampled(value: np.ndarray, cx: float, cy: float, a: float, b: float, theta: float, n: int = 20) -> float:
    """A sum within an ellipse by n x n points a pixel."""
    at = (np.arange(n) + 0.5) / n - 0.5
    y, x = np.mgrid[: value.shape[0], : value.shape[1]]
    dx, dy = x[..., None, None] + at[None, :] - cx, y[..., None, None] + at[:, None] - cy
    u, v = dx * np.cos(theta) + dy * np.sin(theta), dy * np.cos(theta) - dx * np.sin(theta)
    return float((((u / a) ** 2 + (v / b) ** 2 <= 1).mean(axis=(2, 3)) * value).sum())


def test_kron_and_flux_radius(spark):
    value = blob(61, 30.2, 29.7, 4.0, 2.5, 0.5)
    pixels = light(spark, value)
    segments = pixels.where("value > 0.2").selectExpr("image_id", "y", "x", "1 as label").withColumn("label", F.col("label").cast("int"))
    radii = catalog.kron_radii(pixels, segments).first()
    y, x = np.mgrid[:61, :61]
    r = np.hypot(((x - radii.x_centroid) * np.cos(radii.theta) + (y - radii.y_centroid) * np.sin(radii.theta)) / radii.semimajor_axis, ((y - radii.y_centroid) * np.cos(radii.theta) - (x - radii.x_centroid) * np.sin(radii.theta)) / radii.semiminor_axis)
    near = r < 6
    assert radii.kron_radius == pytest.approx(max(1.4, (r * value)[near].sum() / value[near].sum()), rel=1e-6)
    found = catalog.kron(pixels, segments).first()
    a, b = (2.5 * found.kron_radius * s for s in (radii.semimajor_axis, radii.semiminor_axis))
    assert found.kron_flux == pytest.approx(sampled(value, radii.x_centroid, radii.y_centroid, a, b, radii.theta), rel=1e-3)
    assert found.kron_flux_err == pytest.approx(np.sqrt(np.pi * a * b), rel=0.02)
    half = catalog.flux_radius(pixels, segments, 0.5).first().flux_radius
    assert sampled(value, radii.x_centroid, radii.y_centroid, half, half, 0.0) == pytest.approx(found.kron_flux / 2, rel=2e-3)
    with pytest.raises(ValueError):
        catalog.flux_radius(pixels, segments, 0.0)


def test_kron_neighbours(spark):
    """A neighbour's pixels are mirrored at the source's centre, left out, or counted."""
    value = blob(51, 20, 25, 2.0, 2.0, 0.0) + blob(51, 29, 25, 2.0, 2.0, 0.0, 5000.0)
    pixels = light(spark, value)
    bright = pixels.where("value > 1")
    segments = bright.select("image_id", "y", "x", F.when(F.col("x") < 24, 1).otherwise(2).alias("label"))
    got = {how: {r.label: r.kron_flux for r in catalog.kron(pixels, segments, neighbours=how).collect()} for how in ("none", "mask", "correct")}
    assert got["none"][1] > 1.5 * got["correct"][1] and got["correct"][1] == pytest.approx(1000, rel=0.1)


def test_marginal_fit_finds_centres(spark):
    value = sum(blob(48, x, y, 1.3, 1.3, 0.0) for x, y in ((12.3, 14.1), (33.8, 30.4)))
    got = sorted((r.x_centroid, r.y_centroid, r.roundness2) for r in detection.dao_find(light(spark, value), 1.0, 3.06).collect())
    assert len(got) == 2
    for (x, y, round2), (wx, wy) in zip(got, ((12.3, 14.1), (33.8, 30.4)), strict=True):
        assert x == pytest.approx(wx, abs=0.05) and y == pytest.approx(wy, abs=0.05) and abs(round2) < 0.1


def test_windows():
    """Windows by distance: the cosine bell falls from the centre on, the Tukey window over the outer part, on any shape."""
    assert psf.taper("cosine", 101, 0.3)[50, 50] == 1 and psf.taper("cosine", 101, 0.3)[50, 51] < 1 and psf.taper("cosine", 101, 0.3)[50, 66] == 0
    assert psf.taper("tukey", 101, 0.4)[50, 79] == 1 and psf.taper("tukey", 101, 0.4)[50, 90] < 1
    assert psf.taper("hanning", (5, 9)).shape == (5, 9) and psf.taper("hanning", (5, 9))[2, 4] == 1


def test_flags(spark):
    v = np.ones((25, 25))
    pixels = light(spark, v).withColumn("mask", (F.col("x") == 3) & (F.col("y") == 3)).withColumn("error", F.when((F.col("x") == 20) & (F.col("y") == 20), F.lit(float("nan"))).otherwise(F.col("error")))
    at = spark.createDataFrame([(1, 12.0, 12.0, 2.0), (2, 0.0, 12.0, 2.0), (3, -50.0, 12.0, 2.0), (4, 3.0, 3.0, 2.0), (5, 20.0, 20.0, 2.0)], "id long, x double, y double, r double")
    got = {r.id: r.flags for r in aperture.photometry(pixels, at, aperture.circle(2), method="center").collect()}
    assert got == {1: 0, 2: 2, 3: 1 + 4, 4: 8, 5: 64}
    tiny = aperture.photometry(pixels, spark.createDataFrame([(1, 3.0, 3.0), (2, 5.5, 5.5)], "id long, x double, y double"), aperture.circle(0.4), method="center")
    assert {r.id: r.flags for r in tiny.collect()} == {1: 8 + 16, 2: 4}
    names = tiny.select(aperture.decode_flags(F.lit(24)).alias("n")).first().n
    assert names == ["masked_pixels", "all_masked"]


def test_outlines():
    square = aperture.rectangle(4, 4, 0.3)
    assert square.to_polygon().is_regular() and square.perimeter() == pytest.approx(16) and square.to_polygon().is_simple()
    assert aperture.circle(3).to_polygon(400).area() == pytest.approx(np.pi * 9, rel=1e-3) and aperture.ellipse(3, 3).perimeter() == pytest.approx(6 * np.pi, rel=1e-6)
    assert not aperture.Shape("polygon", vertices=((0.0, 0.0), (2.0, 2.0), (2.0, 0.0), (0.0, 1.0))).is_simple()
    assert not aperture.rectangle(4, 2).to_polygon().is_regular()


def test_profile_fit(spark):
    value = blob(41, 20.0, 20.0, 2.5, 2.5, 0.0)
    source = spark.createDataFrame([(1, 20.0, 20.0)], "id long, x double, y double")
    got = profiles.fitted(profiles.radial(light(spark, value), source, [float(k) for k in range(12)]), "gaussian").first()
    assert got.fwhm == pytest.approx(2.5 * 2.3548, rel=0.05)
    curve = profiles.growth(light(spark, value - 0.2), source, [float(k) for k in range(1, 20)])
    kept = profiles.monotone(curve).orderBy("step").collect()
    flux = [r.flux for r in kept]
    assert flux == sorted(flux) and len(flux) < 19
    wide = profiles.growth_elliptical(light(spark, value), source, [4.0], 0.5, 0.7).first()
    assert wide.area == pytest.approx(np.pi * 4 * 2) and wide.flux == pytest.approx(sampled(value, 20, 20, 4.0, 2.0, 0.7), rel=2e-3)


@pytest.mark.parametrize(("kind", "params"), [("gaussian", (1.5,)), ("gaussian", (2.0, 1.2, 0.4)), ("gaussian_prf", (1.3,)), ("gaussian_prf", (1.8, 1.1, 0.7)), ("moffat", (2.0, 3.5)), ("airy", (3.0,))])
def test_models_have_unit_light(kind, params):
    y, x = np.mgrid[-60:61, -60:61].astype(float)
    whole = models.Model(kind, params).unit(x - 0.3, y + 0.2).sum()
    assert whole == pytest.approx(1, abs=0.05 if kind == "airy" else 5e-3)
    if len(params) == 1:
        m = models.Model(kind, params)
        r = models.fwhm(m) / 2
        if kind != "gaussian_prf":
            assert m.unit(np.array([r]), np.zeros(1))[0] == pytest.approx(m.unit(np.zeros(1), np.zeros(1))[0] / 2, rel=1e-6)


def test_psf_photometry(spark):
    model = models.Model("gaussian_prf", (1.4,))
    y, x = np.mgrid[:40, :40].astype(float)
    truth = {1: (10.3, 12.1, 500.0), 2: (13.2, 12.6, 800.0), 3: (30.1, 28.4, 300.0)}
    value = 5.0 + sum(f * model.unit(x - a, y - b) for a, b, f in truth.values())
    pixels = light(spark, value)
    start = spark.createDataFrame([("a", i, a + 0.3, b - 0.2) for i, (a, b, _) in truth.items()] + [("a", 4, 100.0, 5.0)], "image_id string, id long, x double, y double")
    got = {r.id: r for r in photometry.fit(pixels, start, model, 3, 6.0, 3.0, (8.0, 12.0)).collect()}
    assert {i: r.group_id for i, r in got.items()} == {1: 1, 2: 1, 3: 3, 4: 4} and got[1].group_size == 2
    for i, (a, b, f) in truth.items():
        assert (got[i].x_fit, got[i].y_fit) == pytest.approx((a, b), abs=0.03) and got[i].flux_fit == pytest.approx(f, rel=0.05) and got[i].flags == 0
    assert got[4].x_fit is None and got[4].flags == 1 + 64 + 512 + 1024 + 2048
    left = photometry.residual_image(pixels, photometry.to_start(photometry.fit(pixels, start.where("id < 4"), model, 3, 6.0, 3.0, (8.0, 12.0))), model, 6)
    assert left.agg(F.max(F.abs(F.col("value") - 5))).first()[0] < 2
    wide = photometry.fit_fwhm(pixels.withColumn("value", F.col("value") - 5), start.where("id = 3")).first()
    assert wide.fwhm == pytest.approx(1.4 * models.FWHM, rel=0.02)
    bound = photometry.fit(pixels, start.where("id = 3"), model, 3, within=0.1).first()
    assert abs(bound.x_fit - bound.x_init) <= 0.1 + 1e-9 and bound.flags & 32


def galaxy(size: int, x0: float, y0: float, eps: float, pa: float) -> np.ndarray:
    y, x = np.mgrid[:size, :size]
    u, v = (x - x0) * np.cos(pa) + (y - y0) * np.sin(pa), (y - y0) * np.cos(pa) - (x - x0) * np.sin(pa)
    return 100 * np.exp(-np.sqrt(u * u + (v / (1 - eps)) ** 2) / 12)


def test_ellipses(spark):
    value = galaxy(81, 40.4, 39.3, 0.4, 0.9)
    pixels = light(spark, value)
    found = ellipses.fit(pixels, ellipses.starts(pixels, [8.0, 14.0, 20.0], 41.0, 39.0, 0.2, 0.5), rounds=25, least=2)
    got = sorted(found.collect(), key=lambda r: r.sma)
    for r in got:
        assert r.stop_code == 0 and (r.x0, r.y0) == pytest.approx((40.4, 39.3), abs=0.15) and r.eps == pytest.approx(0.4, abs=0.02) and r.pa == pytest.approx(0.9, abs=0.03)
        assert r.intensity == pytest.approx(100 * np.exp(-r.sma / 12), rel=0.02) and r.gradient < 0 and max(abs(r.a3), abs(r.b3), abs(r.a4), abs(r.b4)) < 0.02
    far = ellipses.fit(pixels, ellipses.starts(pixels, [70.0], 40.0, 39.0), rounds=3).first()
    assert far.stop_code in (1, 5)
    made = ellipses.model_image(pixels, found).collect()
    between = [(r.model, r.value) for r in made if 100 * np.exp(-19 / 12) < r.value < 100 * np.exp(-9 / 12)]
    assert len(between) > 100 and np.mean([abs(m / v - 1) for m, v in between]) < 0.1
    sums = ellipses.growth(pixels, found).where("sma = 14").first()
    y, x = np.mgrid[:81, :81]
    assert sums.n_circle == pytest.approx(np.pi * 14**2, rel=0.03) and sums.n_ellipse == pytest.approx(np.pi * 14**2 * 0.6, rel=0.05)
    assert ellipses.central(pixels, 40.4, 39.3).first().intensity == pytest.approx(value[39, 40])
    assert ellipses.axes(1, 2, 0.5) == [1, 1.5] and ellipses.axes(1, 2, 0.5, linear=True) == [1, 1.5, 2]
