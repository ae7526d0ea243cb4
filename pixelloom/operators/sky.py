"""Positions, apertures and catalogues on the sky: all by column expressions of a tangent-plane projection."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelloom.functions.wcs import Tan, to_pixel_shape, to_sky_shape
from pixelloom.operators import aperture


def with_sky(table: DataFrame, wcs: Tan, x: str = "x", y: str = "y", lon: str = "lon", lat: str = "lat") -> DataFrame:
    """table with the position of (x, y) in degrees."""
    a, b = wcs.to_sky(F.col(x), F.col(y))
    return table.withColumns({lon: a, lat: b})


def with_pixel(table: DataFrame, wcs: Tan, lon: str = "lon", lat: str = "lat", x: str = "x", y: str = "y") -> DataFrame:
    """table with the pixel of a position in degrees."""
    a, b = wcs.to_pixel(F.col(lon), F.col(lat))
    return table.withColumns({x: a, y: b})


def circles_to_pixel(table: DataFrame, wcs: Tan, radius: str = "radius") -> DataFrame:
    """Circles on the sky (lon, lat, radius in arcseconds) with x, y and r in pixels, by the local mean scale."""
    rows = with_pixel(table, wcs)
    return rows.withColumn("r", F.col(radius) / wcs.mean_scale(F.col("x"), F.col("y")))


def circles_to_sky(table: DataFrame, wcs: Tan, r: str = "r") -> DataFrame:
    """Circles in pixels (x, y, r) with lon, lat and radius in arcseconds."""
    return with_sky(table, wcs).withColumn("radius", F.col(r) * wcs.mean_scale(F.col("x"), F.col("y")))


def ellipses_to_pixel(table: DataFrame, wcs: Tan) -> DataFrame:
    """Ellipses on the sky (lon, lat, major, minor in arcseconds, angle in radians from east towards north) with x, y, a, b and theta in pixels."""
    rows = with_pixel(table, wcs)
    a, b, theta = to_pixel_shape(wcs, F.col("x"), F.col("y"), F.col("major"), F.col("minor"), F.col("angle"))
    return rows.withColumns({"a": a, "b": b, "theta": theta})


def ellipses_to_sky(table: DataFrame, wcs: Tan) -> DataFrame:
    """Ellipses in pixels (x, y, a, b, theta) with lon, lat, major, minor and angle on the sky."""
    rows = with_sky(table, wcs)
    major, minor, angle = to_sky_shape(wcs, F.col("x"), F.col("y"), F.col("a"), F.col("b"), F.col("theta"))
    return rows.withColumns({"major": major, "minor": minor, "angle": angle})


def rectangles_to_pixel(table: DataFrame, wcs: Tan) -> DataFrame:
    """Rectangles on the sky (lon, lat, width and height in arcseconds, angle) with x, y, w, h and theta in pixels, sides scaled as the axes of the ellipse within."""
    rows = table.withColumns({"major": F.col("width") / 2, "minor": F.col("height") / 2})
    return ellipses_to_pixel(rows, wcs).withColumns({"w": 2 * F.col("a"), "h": 2 * F.col("b")}).drop("a", "b", "major", "minor")


def sky_photometry(pixels: DataFrame, targets: DataFrame, wcs: Tan, radius: float, method: str = "exact") -> DataFrame:
    """Aperture photometry in circles on the sky (id, lon, lat) of one radius in arcseconds: x, y and the sums beside the position. The radius in pixels is that at the reference position, as one aperture has one shape."""
    sources = with_pixel(targets, wcs)
    found = aperture.photometry(pixels, sources.select(*aperture.named(sources), "x", "y"), aperture.circle(radius / (wcs.scale() * 3600)), method=method)
    return found.join(sources.select(*aperture.named(sources), "lon", "lat", "x", "y"), aperture.named(sources))


def sky_boxes(boxes: DataFrame, wcs: Tan) -> DataFrame:
    """Bounding boxes (x_min, x_max, y_min, y_max, inclusive) with the positions of their outer corners: lower left, upper left, lower right, upper right."""
    edge = {"ll": ("x_min", -0.5, "y_min", -0.5), "ul": ("x_min", -0.5, "y_max", 0.5), "lr": ("x_max", 0.5, "y_min", -0.5), "ur": ("x_max", 0.5, "y_max", 0.5)}
    made = {}
    for name, (x, dx, y, dy) in edge.items():
        made[f"lon_{name}"], made[f"lat_{name}"] = wcs.to_sky(F.col(x) + dx, F.col(y) + dy)
    return boxes.withColumns(made)


def sky_errors(table: DataFrame, wcs: Tan) -> DataFrame:
    """Positions (x_centroid, y_centroid) with pixel errors (x_err, y_err, xy_cov) with east_err and north_err in arcseconds, by the local Jacobian."""
    a, b, c, d = wcs.jacobian(F.col("x_centroid"), F.col("y_centroid"))
    vx, vy, v = F.col("x_err") * F.col("x_err"), F.col("y_err") * F.col("y_err"), F.col("xy_cov")
    var = lambda p, q: F.sqrt(p * p * vx + 2 * p * q * v + q * q * vy)
    return table.withColumns({"east_err": var(a, b), "north_err": var(c, d)})
