"""Deblending over tiles against a plain version that grows one tree at a time."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from pixelloom.operators import deblend, segmentation


def steps(connectivity):
    return [(j, i) for j in (-1, 0, 1) for i in (-1, 0, 1) if (j or i) and (connectivity == 8 or not (j and i))]


def parts_of(on, connectivity, least):
    out, left = [], set(on)
    while left:
        stack, own = [left.pop()], set()
        while stack:
            p = stack.pop()
            own.add(p)
            for j, i in steps(connectivity):
                q = p[0] + j, p[1] + i
                if q in left:
                    left.remove(q)
                    stack.append(q)
        if len(own) >= least:
            out.append(own)
    return out


def plain(light, n_pixels, levels, contrast, mode, connectivity):
    """Part of each pixel of one label."""
    low, high = min(light.values()), max(light.values())
    t = np.arange(1, levels + 1) / (levels + 1)
    t = np.sinh(t / 0.25) / np.sinh(1 / 0.25) if mode == "sinh" else t
    cuts = low * (high / low) ** t if mode == "exponential" and low > 0 else low + (high - low) * t
    marks = [set(light)]
    if len(light) >= 2 * n_pixels and high > low:
        for cut in cuts:
            for m in list(marks):
                inner = parts_of({p for p in m if light[p] > cut}, connectivity, n_pixels)
                if len(inner) > 1:
                    marks.remove(m)
                    marks += inner
    code = lambda p: (p[0] << 32) + p[1]
    edges = sorted(((min(light[p], light[q]), max(light[p], light[q]), -min(code(p), code(q)), -max(code(p), code(q))), p, q) for p in light for j, i in steps(connectivity) if (q := (p[0] + j, p[1] + i)) in light and code(p) < code(q))
    marks.sort(key=min)
    while True:
        if len(marks) == 1:
            return dict.fromkeys(light, 0)
        top = {p: p for p in light}

        def head(p):
            while top[p] != p:
                p = top[p]
            return p

        root = {}
        for m in marks:
            for p in m:
                top[p] = min(m)
            root[min(m)] = True
        for _, p, q in reversed(edges):  # Kruskal: trees with a marker don't join
            a, b = head(p), head(q)
            if a != b and not (root.get(a) and root.get(b)):
                if root.get(b):
                    a, b = b, a
                top[b] = a
        owner = {p: head(p) if root.get(head(p)) else None for p in light}
        flux = {min(m): 0.0 for m in marks}
        for p, k in owner.items():
            if k:
                flux[k] += light[p]
        worst = min(flux, key=lambda k: (flux[k], k))
        if sum(light.values()) <= 0 or flux[worst] / sum(light.values()) >= contrast:
            number = {k: n for n, k in enumerate(sorted(flux))}
            return {p: number.get(k, 0) for p, k in owner.items()}
        marks = [m for m in marks if min(m) != worst]


def scene(seed, size=22, images=2):
    rng = np.random.default_rng(seed)
    y, x = np.mgrid[:size, :size]
    rows, labels = [], []
    for n in range(images):
        v = sum(rng.integers(20, 60) * np.exp(-((x - rng.uniform(2, size - 2)) ** 2 + (y - rng.uniform(2, size - 2)) ** 2) / rng.uniform(3, 12)) for _ in range(7)) + rng.uniform(0, 4, (size, size))
        v = np.round(v) + 1 if seed % 2 else v + 1  # whole numbers tie
        rows += [(f"i{n}", int(j), int(i), float(v[j, i])) for j in range(size) for i in range(size)]
        labels += [(f"i{n}", int(j), int(i), 5 if i < size - 5 else 7) for j in range(size) for i in range(size) if v[j, i] > 3]
    return rows, labels


@pytest.mark.parametrize(("seed", "connectivity", "mode", "contrast"), [(1, 8, "exponential", 0.02), (4, 4, "sinh", 0.1)])
def test_equal_to_plain(spark, seed, connectivity, mode, contrast):
    rows, labels = scene(seed)
    pixels = spark.createDataFrame(rows, "image_id string, y int, x int, value double")
    segments = spark.createDataFrame(labels, "image_id string, y int, x int, label int")
    got = deblend.deblend(pixels, segments, 3, 8, contrast, mode, connectivity, side=4).collect()
    value, groups = {r[:3]: r[3] for r in rows}, {}
    for n, j, i, k in labels:
        groups.setdefault((n, k), {})[j, i] = value[n, j, i]
    want, number = {}, {}
    for n, k in sorted(groups):
        part = plain(groups[n, k], 3, 8, contrast, mode, connectivity)
        first = number.get(n, 0)
        number[n] = first + max(part.values()) + 1
        want |= {(n, *p): (first + v + 1, k) for p, v in part.items()}
    assert {(r.image_id, r.y, r.x): (r.label, r.parent) for r in got} == want
    assert max(number.values()) > 2


def test_one_label_over_many_tiles(spark):
    """A label over the whole image: tiles contract nearly all of it, and the parts are the two peaks' sides."""
    size = 40
    y, x = np.mgrid[:size, :size]
    v = 1 + 100 * np.exp(-((x - 8) ** 2 + (y - 18) ** 2) / 80) + 90 * np.exp(-((x - 32) ** 2 + (y - 21) ** 2) / 80)
    pixels = spark.createDataFrame([("a", int(j), int(i), float(v[j, i])) for j in range(size) for i in range(size)], "image_id string, y int, x int, value double")
    segments = pixels.select("image_id", "y", "x", F.lit(1).alias("label"))
    rows = deblend.lit(pixels, segments)
    found = deblend.markers(rows, 5, 8, "exponential", 8)
    roots = found.select("image_id", "label", deblend.code().alias("node"), "seed")
    first = deblend.renamed(deblend.edges_of(rows, 8).select("image_id", "label", F.col("u").alias("a"), F.col("v").alias("b"), F.lit(False).alias("ra"), F.lit(False).alias("rb"), "u", "v", "lo", "hi"), roots.select("image_id", "label", "node", F.col("seed").alias("comp"), F.lit(True).alias("rooted")))
    assert first.count() > 4_000
    split = deblend.deblend(pixels, segments, 5, 8, side=8)
    assert split.count() == size * size and sorted(r.label for r in split.select("label").distinct().collect()) == [1, 2]
    assert split.where("x < 16").select("label").distinct().count() == split.where("x > 24").select("label").distinct().count() == 1


def test_odd_values(spark):
    pixels = spark.createDataFrame([("a", 0, i, v) for i, v in enumerate([5.0, 9.0, 5.0, None, float("nan"), 5.0, 9.0, 5.0])], "image_id string, y int, x int, value double")
    segments = pixels.select("image_id", "y", "x", F.lit(3).alias("label"))
    got = {r.x: r.label for r in deblend.deblend(pixels, segments, 1, 4, 0.0, "linear").collect()}
    assert got[0] == got[1] == 1 and got[6] == got[7] == 2 and len(got) == 8
    assert deblend.deblend(pixels, segments.limit(0), 1).count() == 0
    whole = deblend.deblend(pixels, segments, 9)
    assert {r.label for r in whole.collect()} == {1} and whole.count() == 8
