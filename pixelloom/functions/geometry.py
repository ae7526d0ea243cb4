"""Areas that outlines share with unit pixels, for arrays of pixels."""

from __future__ import annotations

import numpy as np


def ellipse_area(dx: np.ndarray, dy: np.ndarray, a: float, b: float, theta: float) -> np.ndarray:
    """Area of the unit pixels centred at (dx, dy) within an ellipse around 0: in the frame where the ellipse is the unit circle, a pixel is a parallelogram, whose edges each add a sector or triangle."""
    c, s = np.cos(theta), np.sin(theta)
    corners = [(-0.5, -0.5), (0.5, -0.5), (0.5, 0.5), (-0.5, 0.5)]
    x = np.stack([dx + u for u, _ in corners])
    y = np.stack([dy + v for _, v in corners])
    px, py = (x * c + y * s) / a, (y * c - x * s) / b
    total = np.zeros(len(dx))
    for k in range(4):
        total += edge_area(px[k], py[k], px[(k + 1) % 4], py[(k + 1) % 4])
    return np.abs(total) * a * b


def edge_area(x1, y1, x2, y2) -> np.ndarray:
    """Signed area between the origin and an edge, within the unit circle."""
    ex, ey = x2 - x1, y2 - y1
    aa, bb, cc = ex * ex + ey * ey, x1 * ex + y1 * ey, x1 * x1 + y1 * y1 - 1
    disc = bb * bb - aa * cc
    rootd = np.sqrt(np.maximum(disc, 0))
    with np.errstate(all="ignore"):
        t1, t2 = np.clip((-bb - rootd) / aa, 0, 1), np.clip((-bb + rootd) / aa, 0, 1)
    t1, t2 = np.where(disc > 0, t1, 0), np.where(disc > 0, t2, 0)
    ax, ay, bx, by = x1 + t1 * ex, y1 + t1 * ey, x1 + t2 * ex, y1 + t2 * ey
    turn = lambda px, py, qx, qy: np.arctan2(px * qy - py * qx, px * qx + py * qy)
    chord = (ax * by - ay * bx) / 2
    return turn(x1, y1, ax, ay) / 2 + chord + turn(bx, by, x2, y2) / 2


def polygon_area_in_pixels(vertices, dx: np.ndarray, dy: np.ndarray) -> np.ndarray:
    """Area of a simple polygon (offsets from 0) within each unit pixel centred at (dx, dy), by clipping at the pixel's four sides."""
    out = np.zeros(len(dx))
    base = np.asarray(vertices, float)
    for i, (x, y) in enumerate(zip(dx, dy, strict=True)):
        shape = base - (x, y)
        for axis, sign in ((0, 1), (0, -1), (1, 1), (1, -1)):
            if not len(shape):
                break
            keep = 0.5 - sign * shape[:, axis]
            after, kept = np.roll(shape, -1, axis=0), np.roll(keep, -1)
            crossing = (keep >= 0) != (kept >= 0)
            with np.errstate(all="ignore"):
                t = keep / (keep - kept)
            cut = shape + np.where(crossing, t, 0)[:, None] * (after - shape)
            rows = np.stack([shape, cut], axis=1).reshape(-1, 2)
            shape = rows[np.stack([keep >= 0, crossing], axis=1).ravel()]
        if len(shape) > 2:
            u, v = shape.T
            out[i] = abs((u * np.roll(v, -1) - np.roll(u, -1) * v).sum()) / 2
    return out
