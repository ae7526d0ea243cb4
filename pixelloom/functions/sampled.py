"""Images of a point source on a finer grid, evaluated between its cells by cubic splines, with their slopes."""

from __future__ import annotations

import numpy as np


def spline_parts(t: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """The four cubic B-splines over a place t (0 to 1) between knots, and their slopes."""
    s = 1 - t
    value = [s**3 / 6, (3 * t**3 - 6 * t**2 + 4) / 6, (3 * s**3 - 6 * s**2 + 4) / 6, t**3 / 6]
    slope = [-(s**2) / 2, (3 * t**2 - 4 * t) / 2, -(3 * s**2 - 4 * s) / 2, t**2 / 2]
    return value, slope


def coefficients(line: np.ndarray) -> np.ndarray:
    """Spline coefficients along the first axis that reproduce the samples, zero beyond both ends."""
    n = len(line)
    matrix = np.diag(np.full(n, 4 / 6)) + np.diag(np.full(n - 1, 1 / 6), 1) + np.diag(np.full(n - 1, 1 / 6), -1)
    return np.linalg.solve(matrix, line)


class Sampled:
    """A point source's brightness a pixel, for unit flux, from samples grid[j, i] at offsets ((i - middle) / over, (j - middle) / over) from its centre; 0 beyond the grid."""

    def __init__(self, grid: np.ndarray, over: int):
        self.grid, self.over = np.asarray(grid, float), over
        self.middle = (self.grid.shape[0] - 1) / 2, (self.grid.shape[1] - 1) / 2
        self.bent = np.pad(coefficients(coefficients(self.grid).T).T, 2)

    def __call__(self, dx: np.ndarray, dy: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Value, and its slopes in dx and dy."""
        u, v = dx * self.over + self.middle[1], dy * self.over + self.middle[0]
        inside = (u >= 0) & (v >= 0) & (u <= self.grid.shape[1] - 1) & (v <= self.grid.shape[0] - 1)
        i, j = (np.clip(np.floor(w), 0, n - 1).astype(int) for w, n in ((u, self.grid.shape[1]), (v, self.grid.shape[0])))
        (a, da), (b, db) = spline_parts(np.where(inside, u - i, 0.0)), spline_parts(np.where(inside, v - j, 0.0))
        out = np.zeros((3, *np.shape(u)))
        for q in range(4):
            for p in range(4):
                c = self.bent[j + q + 1, i + p + 1]
                out += c * np.stack([b[q] * a[p], self.over * b[q] * da[p], self.over * db[q] * a[p]])
        return tuple(np.where(inside, w, 0.0) for w in out)

    def moved(self, x: float, y: float) -> np.ndarray:
        """The samples of the source when its centre lies (x, y) pixels on."""
        j, i = np.indices(self.grid.shape)
        return self((i - self.middle[1]) / self.over + x, (j - self.middle[0]) / self.over + y)[0]


def smoothing(degree: int, size: int = 5) -> np.ndarray:
    """The weights whose sum over size x size cells is the middle value of the least-squares polynomial of that degree."""
    j, i = (g.ravel() - size // 2 for g in np.indices((size, size)))
    terms = np.stack([i**a * j**b for a in range(degree + 1) for b in range(degree + 1 - a)], axis=1).astype(float)
    return np.linalg.pinv(terms)[0].reshape(size, size)


def smoothed(grid: np.ndarray, kernel: np.ndarray) -> np.ndarray:
    """grid under the kernel; its edge cells go on outward."""
    h, w = kernel.shape[0] // 2, kernel.shape[1] // 2
    wide = np.pad(grid, ((h, h), (w, w)), mode="edge")
    return sum(kernel[b, a] * wide[b : b + grid.shape[0], a : a + grid.shape[1]] for b in range(kernel.shape[0]) for a in range(kernel.shape[1]))


def filled(grid: np.ndarray) -> np.ndarray:
    """NaN cells from the mean of their known neighbours, ring by ring; 0 where nothing is known."""
    out = grid.copy()
    while np.isnan(out).any() and not np.isnan(out).all():
        wide = np.pad(out, 1, constant_values=np.nan)
        near = np.stack([wide[b : b + grid.shape[0], a : a + grid.shape[1]] for b in range(3) for a in range(3)])
        known = ~np.isnan(near)
        mean = np.where(known.any(axis=0), np.where(known, near, 0).sum(axis=0) / np.maximum(known.sum(axis=0), 1), np.nan)
        out = np.where(np.isnan(out), mean, out)
    return np.nan_to_num(out)
