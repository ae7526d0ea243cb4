"""Effective point-spread functions from stars, by rounds, after Anderson and King (2000).

A star is one row with its small cut-out. A round sends each star's residuals against the present model to the cells of a finer grid, as
counts and sums a batch of stars that then add up by cell, leaves out what lies too far from a cell's mean, adds
the means to the model, smooths and centres it, and fits every star's centre and flux anew with the model's slopes. What the driver holds is
the grid alone, whose size is that of a cut-out; stars never meet in a task but batch by batch, and what a round
makes of them is written, so that a lost executor costs a round at most.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelloom.functions.sampled import Sampled, filled, smoothed, smoothing
from pixelloom.functions.tables import kept

STAR = "id long, x double, y double, flux double, x0 int, y0 int, dx array<int>, dy array<int>, value array<double>"


def cut_outs(pixels: DataFrame, stars: DataFrame, half: int) -> DataFrame:
    """image_id and STAR: each star (id, x, y; image_id where it belongs to one image) with the pixels up to `half` from its nearest one.

    Masked pixels and those that are not finite are left out. flux: the sum of the values, or the star's own `flux` if stars have one. Stars without a pixel, or whose flux isn't above 0, are dropped.
    """
    on = [c for c in ("image_id",) if c in stars.columns]
    span = F.sequence(F.lit(-half), F.lit(half))
    own = [c for c in ("flux",) if c in stars.columns]
    near = stars.select(*on, "id", F.col("x").alias("sx"), F.col("y").alias("sy"), *(F.col(c).alias("given") for c in own), F.floor(F.col("x") + 0.5).cast("int").alias("x0"), F.floor(F.col("y") + 0.5).cast("int").alias("y0"))
    cells = near.withColumn("dy", F.explode(span)).withColumn("dx", F.explode(span)).withColumns({"y": F.col("y0") + F.col("dy"), "x": F.col("x0") + F.col("dx")})
    good = pixels.where(~F.coalesce(F.col("mask"), F.lit(False)) & F.col("value").isNotNull() & ~F.isnan("value") & (F.abs("value") < float("inf"))) if "mask" in pixels.columns else pixels.where(F.abs("value") < float("inf"))
    rows = cells.join(good.select("image_id", "y", "x", "value"), [*on, "y", "x"])
    names = ["image_id", "id", "sx", "sy", "x0", "y0", *(["given"] if own else [])]
    found = rows.groupBy(*names).agg(F.array_sort(F.collect_list(F.struct("dy", "dx", "value"))).alias("p"))
    flux = F.col("given") if own else F.aggregate("p.value", F.lit(0.0), lambda s, v: s + v)
    out = found.select("image_id", "id", F.col("sx").alias("x"), F.col("sy").alias("y"), flux.cast("double").alias("flux"), "x0", "y0", F.col("p.dx").alias("dx"), F.col("p.dy").alias("dy"), F.col("p.value").alias("value"))
    return out.where("flux > 0")


def shape_of(half: int, over: int) -> int:
    """Cells a side of the grid: of all offsets within a cut-out, with half a pixel more for the centre's place in its own."""
    return 2 * (half * over + (over + 1) // 2) + 1


def offsets(stars: pd.DataFrame) -> tuple[np.ndarray, ...]:
    """Of all pixels of a batch of stars: the star's number, the offset from its centre, and the value for unit flux."""
    count = stars.value.map(len).to_numpy()
    who = np.repeat(np.arange(len(stars)), count)
    flat = {c: np.concatenate(stars[c].to_numpy()) if len(stars) else np.zeros(0) for c in ("dx", "dy", "value")}
    dx = flat["dx"] + (stars.x0 - stars.x).to_numpy()[who]
    dy = flat["dy"] + (stars.y0 - stars.y).to_numpy()[who]
    return who, dx, dy, flat["value"] / stars.flux.to_numpy()[who]


def cell_sums(stars: DataFrame, grid: np.ndarray, over: int, centre: np.ndarray | None = None, spread: np.ndarray | None = None) -> DataFrame:
    """(j, i, n, total, squares): by cell of the grid the number, sum and squares of the stars' residuals against it. With centre and spread only of those at most `spread` from the cell's centre."""
    shared = stars.sparkSession.sparkContext.broadcast((grid, centre, spread))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        grid, centre, spread = shared.value
        model, side = Sampled(grid, over), grid.shape[0]
        for rows in batches:
            _, dx, dy, value = offsets(rows)
            j, i = (np.floor(d * over + side // 2 + 0.5).astype(int) for d in (dy, dx))
            good = (j >= 0) & (i >= 0) & (j < side) & (i < side)
            j, i = j[good], i[good]
            rest = value[good] - model((i - side // 2) / over, (j - side // 2) / over)[0]
            if centre is not None:
                near = np.abs(rest - centre[j, i]) <= spread[j, i]
                j, i, rest = j[near], i[near], rest[near]
            cell = j * side + i
            n, total, squares = (np.bincount(cell, w, side * side) for w in (None, rest, rest * rest))
            some = np.flatnonzero(n)
            yield pd.DataFrame({"j": some // side, "i": some % side, "n": n[some], "total": total[some], "squares": squares[some]})

    parts = stars.select("x", "y", "flux", "x0", "y0", "dx", "dy", "value").mapInPandas(run, "j int, i int, n long, total double, squares double")
    return parts.groupBy("j", "i").agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.sum("squares").alias("squares"))


def refitted(stars: DataFrame, grid: np.ndarray, over: int, half: float, rounds: int = 8) -> DataFrame:
    """The stars with centre and flux fitted anew to the pixels within `half` of their centre, by Gauss-Newton steps with the grid's slopes, and `moved`, how far the centre went. A star that a fit throws out of its cut-out keeps its centre."""
    shared = stars.sparkSession.sparkContext.broadcast(grid)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = Sampled(shared.value, over)
        for rows in batches:
            rows = rows.reset_index(drop=True)
            n, now = len(rows), rows[["x", "y", "flux"]].to_numpy(float)
            start, reach = now.copy(), rows.dx.map(lambda d: max(1, int(np.abs(d).max()))).to_numpy()
            for _ in range(rounds):
                at = rows.assign(x=now[:, 0], y=now[:, 1], flux=1.0)
                who, dx, dy, value = offsets(at)
                m, mx, my = model(dx, dy)
                flux = now[who, 2]
                w = (np.maximum(np.abs(dx), np.abs(dy)) <= half).astype(float)
                slopes = np.stack([-flux * mx, -flux * my, m])  # by x, y and flux
                left = value - flux * m
                sums = lambda v: np.bincount(who, v * w, n)  # noqa: B023, E731
                a = np.array([[sums(p * q) for q in slopes] for p in slopes]).transpose(2, 0, 1)
                g = np.array([sums(p * left) for p in slopes]).T
                scale = np.sqrt(np.maximum(np.einsum("kii->ki", a), 1e-300))
                step = np.linalg.solve(a / scale[:, :, None] / scale[:, None, :] + 1e-10 * np.eye(3), (g / scale)[:, :, None])[:, :, 0] / scale
                step[:, :2] = np.clip(step[:, :2], -0.5, 0.5)
                now = now + step
            lost = ~np.isfinite(now).all(axis=1) | (now[:, 2] <= 0) | (np.abs(now[:, :2] - rows[["x0", "y0"]].to_numpy(float)).max(axis=1) > reach)
            now[lost] = start[lost]
            yield rows.assign(x=now[:, 0], y=now[:, 1], flux=now[:, 2], moved=np.hypot(*(now - start)[:, :2].T))

    kind = stars.schema["image_id"].dataType.simpleString()
    return stars.select("image_id", *(c.split()[0] for c in STAR.split(", "))).mapInPandas(run, f"image_id {kind}, {STAR}, moved double")


def as_grid(cells: list, side: int) -> np.ndarray:
    """n, total and squares as planes."""
    out = np.zeros((3, side, side))
    for r in cells:
        out[:, r["j"], r["i"]] = r["n"], r["total"], r["squares"]
    return out


def centroid(grid: np.ndarray, over: int, half: float) -> tuple[float, float]:
    """Offset of the centre of mass, in pixels, of the cells within `half` pixels of the middle."""
    j, i = np.indices(grid.shape)
    j, i = (j - grid.shape[0] // 2) / over, (i - grid.shape[1] // 2) / over
    w = np.where((np.abs(j) <= half) & (np.abs(i) <= half), np.maximum(grid, 0), 0)
    return ((w * i).sum() / w.sum(), (w * j).sum() / w.sum()) if w.sum() > 0 else (0.0, 0.0)


def improved(stars: DataFrame, grid: np.ndarray, over: int, clip: float = 3.0, clips: int = 2, degree: int | None = 4, window: int | None = None, box: float = 2.0) -> np.ndarray:
    """The grid after one round: mean residuals by cell, clipped, added; smoothed by local polynomials of that degree over window x window cells (two pixels if not said, so that all places of a centre within its pixel count for a cell, without which errors of centres stay in the grid); brought to its middle and unit sum a pixel."""
    side = grid.shape[0]
    n, total, squares = as_grid(cell_sums(stars, grid, over).collect(), side)
    for _ in range(clips):
        mean = total / np.maximum(n, 1)
        spread = clip * np.sqrt(np.maximum(squares / np.maximum(n, 1) - mean**2, 0)) + 1e-12
        n, total, squares = as_grid(cell_sums(stars, grid, over, mean, spread).collect(), side)
    new = grid + filled(np.where(n > 0, total / np.maximum(n, 1), np.nan))
    new = new if degree is None else smoothed(new, smoothing(degree, window or 2 * over + 1))
    for _ in range(10):
        x, y = centroid(new, over, box)
        if np.hypot(x, y) < 1e-4:
            break
        new = Sampled(new, over).moved(x, y)
    return new / new.sum() * over**2 if new.sum() > 0 else new


def build(pixels: DataFrame, stars: DataFrame, half: int, over: int = 4, rounds: int = 10, accuracy: float = 1e-3, fit_half: float = 2.5, **options) -> tuple[np.ndarray, DataFrame]:
    """The grid (brightness a pixel for unit flux, `over` cells a pixel) and the stars with their last centres and fluxes, after so many rounds, or once no star moves by `accuracy` pixels.

    Without a usable star the grid is 0 and the table empty.
    """
    grid = np.zeros((shape_of(half, over),) * 2)
    found = kept(cut_outs(pixels, stars, half), "stars")
    if found.isEmpty():
        return grid, found
    for _ in range(rounds):
        grid = improved(found, grid, over, **options)
        found = kept(refitted(found, grid, over, fit_half), "stars")
        if (found.agg(F.max("moved")).first()[0] or 0) < accuracy:
            break
    return grid, found.drop("moved")


def as_table(spark, grid: np.ndarray, over: int) -> DataFrame:
    """(j, i, dy, dx, value): a grid's cells, their offsets from the centre in pixels, and values."""
    side = grid.shape[0]
    rows = [(j, i, (j - side // 2) / over, (i - side // 2) / over, float(grid[j, i])) for j in range(side) for i in range(side)]
    return spark.createDataFrame(rows, "j int, i int, dy double, dx double, value double")
