"""Outlines of labels: rings by pointers against areas, corners in order, pixels that touch by a corner."""

from __future__ import annotations

import numpy as np
import pytest

from pixelloom.operators import outlines


def table(spark, image: np.ndarray, name="a"):
    rows = [(name, int(y), int(x), int(image[y, x])) for y, x in zip(*np.nonzero(image), strict=True)]
    return spark.createDataFrame(rows, "image_id string, y int, x int, label int")


def corners_of(rows):
    found = {}
    for r in rows:
        found.setdefault((r.image_id, r.label, r.ring), []).append(r)
    return {k: sorted(v, key=lambda r: r.place) for k, v in found.items()}


@pytest.mark.parametrize("connectivity", [4, 8])
def test_random_labels(spark, connectivity):
    image = np.random.default_rng(5).integers(0, 4, (17, 23))
    segments = table(spark, image).union(table(spark, image * (image == 2), "b"))
    polygons = outlines.polygons(segments.union(segments.limit(9)), connectivity).collect()
    for ring in corners_of(polygons).values():
        assert [r.place for r in ring] == list(range(len(ring))) and len(ring) >= 4
        assert all((a.x_next, a.y_next) == (b.x, b.y) for a, b in zip(ring, [*ring[1:], ring[0]], strict=True))
        assert all((a.x == a.x_next) != (b.x == b.x_next) for a, b in zip(ring, [*ring[1:], ring[0]], strict=True))  # every corner turns
    whole = {(r.image_id, r.label): r for r in outlines.outlines(outlines.polygons(segments, connectivity)).collect()}
    assert len(whole) == 4
    for (name, label), r in whole.items():
        assert r.area == (image == label).sum()
        inside = np.pad(image == label, 1).astype(int)
        assert r.length == np.abs(np.diff(inside, axis=0)).sum() + np.abs(np.diff(inside, axis=1)).sum()
    assert whole["a", 2][2:] == whole["b", 2][2:]


def test_hole_and_corner(spark):
    image = np.zeros((6, 9), int)
    image[0:5, 0:5] = 1
    image[2, 2] = 0
    image[0, 7] = image[1, 8] = 2
    segments = table(spark, image)
    for connectivity, pieces in ((8, 1), (4, 2)):
        polygons = outlines.polygons(segments, connectivity)
        rings = outlines.rings(polygons).collect()
        assert sorted((r.label, r.area, r.is_hole) for r in rings if r.label == 1) == [(1, -1.0, True), (1, 25.0, False)]
        assert sorted(r.area for r in rings if r.label == 2) == ([2.0] if pieces == 1 else [1.0, 1.0])
    outer = [(r.x, r.y) for r in polygons.where("label = 1").orderBy("ring", "place").collect()]
    assert outer[:4] == [(-0.5, -0.5), (4.5, -0.5), (4.5, 4.5), (-0.5, 4.5)]


def test_spiral(spark):
    """One long ring."""
    image = np.zeros((31, 31), int)
    y = x = 0
    dy, dx = 0, 1
    image[0, 0] = 1
    for length in [30, 30, 30, *(n for k in range(28, 1, -2) for n in (k, k))]:
        for _ in range(length):
            y, x = y + dy, x + dx
            image[y, x] = 1
        dy, dx = dx, -dy
    (ring,) = corners_of(outlines.polygons(table(spark, image), 4).collect()).values()
    assert sum(a.x * a.y_next - a.x_next * a.y for a in ring) / 2 == image.sum()


def test_nothing(spark):
    assert outlines.polygons(table(spark, np.zeros((2, 2), int))).count() == 0
