"""World coordinates by the tangent-plane projection, as column expressions."""

from __future__ import annotations

from dataclasses import dataclass
from math import cos, radians, sin

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Tan:
    """Reference pixel (from 0), reference position and scale matrix, in degrees."""

    x_ref: float
    y_ref: float
    lon_ref: float
    lat_ref: float
    cd: tuple[tuple[float, float], tuple[float, float]]

    def to_sky(self, x: Column, y: Column) -> tuple[Column, Column]:
        """Longitude (0 to 360) and latitude of a pixel."""
        (a, b), (c, d) = self.cd
        u, v = F.radians((x - self.x_ref) * a + (y - self.y_ref) * b), F.radians((x - self.x_ref) * c + (y - self.y_ref) * d)
        s, k = sin(radians(self.lat_ref)), cos(radians(self.lat_ref))
        low = k - v * s
        lon = F.degrees(F.atan2(u, low)) + self.lon_ref
        lat = F.degrees(F.atan2(s + v * k, F.sqrt(u * u + low * low)))
        return F.pmod(lon, F.lit(360.0)), lat

    def to_pixel(self, lon: Column, lat: Column) -> tuple[Column, Column]:
        """Pixel of a position; null beyond 90 degrees from the reference."""
        (a, b), (c, d) = self.cd
        s, k = sin(radians(self.lat_ref)), cos(radians(self.lat_ref))
        turn, up = F.radians(lon - self.lon_ref), F.radians(lat)
        depth = F.sin(up) * s + F.cos(up) * k * F.cos(turn)
        ahead = F.when(depth > 0, depth)
        u, v = F.degrees(F.try_divide(F.cos(up) * F.sin(turn), ahead)), F.degrees(F.try_divide(F.sin(up) * k - F.cos(up) * s * F.cos(turn), ahead))
        det = a * d - b * c
        return (u * d - v * b) / det + self.x_ref, (v * a - u * c) / det + self.y_ref

    def scale(self) -> float:
        """Degrees a pixel: root of the matrix' determinant. Sky apertures become pixel apertures by it."""
        (a, b), (c, d) = self.cd
        return abs(a * d - b * c) ** 0.5


    def jacobian(self, x: Column, y: Column, step: float = 0.5) -> tuple[Column, Column, Column, Column]:
        """Local derivatives in arcseconds a pixel: east by x, east by y, north by x, north by y, from central differences of `step` pixels on the tangent plane at the pixel."""
        _, here = self.to_sky(x, y)
        out = []
        for dx, dy in ((step, 0.0), (0.0, step)):
            (lon2, lat2), (lon1, lat1) = self.to_sky(x + dx, y + dy), self.to_sky(x - dx, y - dy)
            turn = F.pmod(lon2 - lon1 + 180.0, F.lit(360.0)) - 180.0
            out.append((turn * F.cos(F.radians(here)) * 3600.0 / (2 * step), (lat2 - lat1) * 3600.0 / (2 * step)))
        return out[0][0], out[1][0], out[0][1], out[1][1]

    def mean_scale(self, x: Column, y: Column) -> Column:
        """Arcseconds a pixel: root of the local area of a pixel."""
        a, b, c, d = self.jacobian(x, y)
        return F.sqrt(F.abs(a * d - b * c))

    def scale_and_angle(self, x: Column, y: Column) -> tuple[Column, Column]:
        """Arcseconds a pixel along north, and the angle of north from the x axis in degrees."""
        a, b, c, d = self.jacobian(x, y)
        det = a * d - b * c
        # the step in pixels that goes one arcsecond north
        nx, ny = F.try_divide(-b, det), F.try_divide(a, det)
        return F.try_divide(F.lit(1.0), F.hypot(nx, ny)), F.degrees(F.atan2(ny, nx))


def shape_axes(a: Column, b: Column, c: Column, d: Column, major: Column, minor: Column, theta: Column) -> tuple[Column, Column, Column]:
    """Semi-axes and turn (radians) of an ellipse (major, minor, theta) taken through the linear map ((a, b), (c, d)): the singular values and left vector of the map times the axes."""
    p, q = a * F.cos(theta) + b * F.sin(theta), c * F.cos(theta) + d * F.sin(theta)
    r, s = b * F.cos(theta) - a * F.sin(theta), d * F.cos(theta) - c * F.sin(theta)
    p, q, r, s = p * major, q * major, r * minor, s * minor
    xx, yy, xy = p * p + r * r, q * q + s * s, p * q + r * s
    half, turn = (xx + yy) / 2, F.sqrt((xx - yy) * (xx - yy) / 4 + xy * xy)
    return F.sqrt(half + turn), F.sqrt(F.greatest(half - turn, F.lit(0.0))), F.atan2(2 * xy, xx - yy) / 2


def to_pixel_shape(wcs: Tan, x: Column, y: Column, major: Column, minor: Column, theta: Column) -> tuple[Column, Column, Column]:
    """An ellipse on the sky (arcseconds; theta from east towards north) as one in pixels, at a pixel."""
    a, b, c, d = wcs.jacobian(x, y)
    det = a * d - b * c
    return shape_axes(d / det, -b / det, -c / det, a / det, major, minor, theta)


def to_sky_shape(wcs: Tan, x: Column, y: Column, major: Column, minor: Column, theta: Column) -> tuple[Column, Column, Column]:
    """An ellipse in pixels as one on the sky: arcseconds, and theta from east towards north."""
    return shape_axes(*wcs.jacobian(x, y), major, minor, theta)
