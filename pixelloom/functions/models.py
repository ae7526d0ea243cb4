"""Shapes of point sources as NumPy functions of offsets from the centre, each of unit light before it is scaled."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from math import erf, pi, sqrt

import numpy as np

_erf = np.vectorize(erf, otypes=[float])
#: Fixed value: the first zero of an Airy pattern over pi.
FIRST_ZERO = 1.2196698912665045
FWHM = 2 * sqrt(2 * np.log(2))


@dataclass(frozen=True)
class Model:
    """kind, the parameters beside position and flux, and which of them are fitted as well."""

    kind: str
    params: tuple[float, ...] = ()
    free: tuple[int, ...] = ()
    grid: np.ndarray | None = field(default=None, compare=False)
    oversampling: int = 1

    def unit(self, dx: np.ndarray, dy: np.ndarray, params: np.ndarray | None = None) -> np.ndarray:
        """Brightness at offsets, of a source of flux 1."""
        p = self.params if params is None else tuple(params)
        return KINDS[self.kind](dx, dy, p) if self.kind != "image" else self._image(dx, dy)

    def _image(self, dx: np.ndarray, dy: np.ndarray) -> np.ndarray:
        """A sampled source, its centre in the middle of the grid: bilinear between samples, 0 beyond."""
        n, m = self.grid.shape
        v, u = dy * self.oversampling + (n - 1) / 2, dx * self.oversampling + (m - 1) / 2
        inside = (v >= 0) & (v <= n - 1) & (u >= 0) & (u <= m - 1)
        j, i = np.clip(np.floor(v).astype(int), 0, max(n - 2, 0)), np.clip(np.floor(u).astype(int), 0, max(m - 2, 0))
        a, b = v - j, u - i
        k, q = np.minimum(j + 1, n - 1), np.minimum(i + 1, m - 1)
        g = self.grid
        return np.where(inside, g[j, i] * (1 - a) * (1 - b) + g[j, q] * (1 - a) * b + g[k, i] * a * (1 - b) + g[k, q] * a * b, 0.0)


def turned(dx, dy, theta):
    return dx * np.cos(theta) + dy * np.sin(theta), dy * np.cos(theta) - dx * np.sin(theta)


def gaussian(dx, dy, p):
    """p: sigma; or sigma along and across, and the turn."""
    a, b, theta = p if len(p) == 3 else (p[0], p[0], 0.0)
    u, v = turned(dx, dy, theta)
    return np.exp(-(u * u / a**2 + v * v / b**2) / 2) / (2 * pi * a * b)


def gaussian_prf(dx, dy, p):
    """The light of a Gaussian within each pixel. p: sigma; or sigma in x and y; or both and a turn, then by 9 x 9 points of a Gauss rule in each pixel."""
    if len(p) < 3:
        side = lambda d, s: (_erf((d + 0.5) / (sqrt(2) * s)) - _erf((d - 0.5) / (sqrt(2) * s))) / 2
        return side(dx, p[0]) * side(dy, p[-1])
    at, w = np.polynomial.legendre.leggauss(9)
    return sum(wi * wj / 4 * gaussian(dx + xi / 2, dy + xj / 2, p) for xi, wi in zip(at, w, strict=True) for xj, wj in zip(at, w, strict=True))


def moffat(dx, dy, p):
    """p: gamma, alpha."""
    return (p[1] - 1) / (pi * p[0] ** 2) * (1 + (dx * dx + dy * dy) / p[0] ** 2) ** -p[1]


def bessel1(x):
    """J1, by the trapezoid rule over its integral, which is exact to the last digits for a period."""
    t = (np.arange(256) + 0.5) * pi / 256
    return np.cos(t - np.asarray(x)[..., None] * np.sin(t)).mean(axis=-1)


def airy(dx, dy, p):
    """p: radius of the first dark ring."""
    r = np.hypot(dx, dy) * pi * FIRST_ZERO / p[0]
    z = np.where(r > 1e-8, r, 1.0)
    return np.where(r > 1e-8, (2 * bessel1(z) / z) ** 2, 1.0) * pi * FIRST_ZERO**2 / (4 * p[0] ** 2)


KINDS: dict[str, Callable] = {"gaussian": gaussian, "gaussian_prf": gaussian_prf, "moffat": moffat, "airy": airy}


def fwhm(model: Model) -> float:
    """Full width at half maximum of a round model; of an elliptical one along its first axis."""
    p = model.params
    if model.kind in ("gaussian", "gaussian_prf"):
        return p[0] * FWHM
    if model.kind == "moffat":
        return 2 * p[0] * sqrt(2 ** (1 / p[1]) - 1)
    if model.kind == "airy":
        return 0.8436659602162364 * p[0]
    raise ValueError("a sampled source has no width of its own")
