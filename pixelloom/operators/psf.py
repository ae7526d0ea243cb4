"""Point-spread functions: rendering, grouping, fits by least squares, residuals, and matching kernels."""

from __future__ import annotations

from math import erf, sqrt

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pixelloom.functions.tables import kept

_erf = np.vectorize(erf, otypes=[float])


def gaussian(dx: Column, dy: Column, flux: Column, sigma: Column) -> Column:
    """Brightness of a round Gaussian source at an offset."""
    return flux / (2 * np.pi * sigma * sigma) * F.exp(-(dx * dx + dy * dy) / (2 * sigma * sigma))


def moffat(dx: Column, dy: Column, flux: Column, gamma: Column, alpha: Column) -> Column:
    return flux * (alpha - 1) / (np.pi * gamma * gamma) * F.pow(1 + (dx * dx + dy * dy) / (gamma * gamma), -alpha)


def gaussian_prf(dx: np.ndarray, dy: np.ndarray, flux: float, sigma: float) -> np.ndarray:
    """The light of a Gaussian within each pixel."""
    side = lambda d: (_erf((d + 0.5) / (sqrt(2) * sigma)) - _erf((d - 0.5) / (sqrt(2) * sigma))) / 2
    return flux * side(dx) * side(dy)


def render(pixels: DataFrame, sources: DataFrame, sigma: float, reach: int) -> DataFrame:
    """pixels with `model`, the sum of Gaussian sources (id, x, y, flux) within `reach` pixels of each; sources with an image_id shine on that image, others on all."""
    span = F.sequence(F.lit(-reach), F.lit(reach))
    on = [c for c in ("image_id",) if c in sources.columns]
    cells = sources.select(*on, "x", "y", "flux", F.explode(span).alias("j")).select(*on, "x", "y", "flux", (F.floor(F.col("y") + 0.5) + F.col("j")).cast("int").alias("py"), F.explode(span).alias("i"))
    cells = cells.select(*on, "py", (F.floor(F.col("x") + 0.5) + F.col("i")).cast("int").alias("px"), "x", "y", "flux")
    light = cells.select(*on, F.col("py").alias("y_"), F.col("px").alias("x_"), gaussian(F.col("px") - F.col("x"), F.col("py") - F.col("y"), F.col("flux"), F.lit(float(sigma))).alias("light")).groupBy(*on, "y_", "x_").agg(F.sum("light").alias("model"))
    light = light.withColumnsRenamed({"y_": "y", "x_": "x"})
    return pixels.join(light, [*on, "y", "x"], "left").select(*pixels.columns, F.coalesce("model", F.lit(0.0)).alias("model"))


def residual(pixels: DataFrame, sources: DataFrame, sigma: float, reach: int) -> DataFrame:
    return render(pixels, sources, sigma, reach).withColumn("value", F.col("value") - F.col("model")).drop("model")


def cell_links(places: DataFrame, separation: float) -> DataFrame:
    """(a, b): names of neighbouring cells that hold points at most `separation` apart. places: cx, cy, name, x, y of the distinct points; cells have sides of 0.7 times the
    separation. The outermost points of cells in eight directions are compared first; whole cells only where these leave it open and the cells' bounding boxes are near enough."""
    ways = [F.struct((i * F.col("x") + j * F.col("y")).alias("far"), "x", "y") for i in (-1, 0, 1) for j in (-1, 0, 1) if i or j]
    cells = places.groupBy("cx", "cy", "name").agg(F.array_distinct(F.array(*[F.max(w) for w in ways])).alias("tips"), F.count("*").alias("n"), *[f(c).alias(f"{n}_{c}") for n, f in (("low", F.min), ("high", F.max)) for c in ("x", "y")])
    cells = cells.withColumn("tips", F.array_distinct(F.transform("tips", lambda t: F.struct(t["x"].alias("x"), t["y"].alias("y")))))
    steps = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (0, 1, 2) for j in range(-2, 3) if i or j > 0])
    other = cells.select(*[F.col(c).alias(f"b_{c}") for c in cells.columns], F.explode(steps).alias("s")).withColumns({"cx": F.col("b_cx") - F.col("s.i"), "cy": F.col("b_cy") - F.col("s.j")}).drop("s")
    gap = lambda c: F.greatest(F.col(f"b_low_{c}") - F.col(f"high_{c}"), F.col(f"low_{c}") - F.col(f"b_high_{c}"), F.lit(0.0))
    met = cells.hint("merge").join(other.hint("merge"), ["cx", "cy"]).where(F.hypot(gap("x"), gap("y")) <= separation)
    met = met.withColumn("near", F.exists("tips", lambda p: F.exists("b_tips", lambda q: F.hypot(p["x"] - q["x"], p["y"] - q["y"]) <= separation)))
    met = kept(met.withColumn("open", ~F.col("near") & ((F.col("n") > F.size("tips")) | (F.col("b_n") > F.size("b_tips")))).where("near or open").drop("tips", "b_tips"), "cells")
    reach = lambda side: F.hypot(*(F.greatest(F.col(f"{side}low_{c}") - F.col(c), F.col(c) - F.col(f"{side}high_{c}"), F.lit(0.0)) for c in ("x", "y"))) <= separation
    left = met.where("open").hint("merge").join(places.select("cx", "cy", "x", "y").hint("merge"), ["cx", "cy"]).where(reach("b_")).select("cx", "cy", "b_cx", "b_cy", "name", F.col("x").alias("ax"), F.col("y").alias("ay"))
    right = met.where("open").hint("merge").join(places.select(F.col("cx").alias("b_cx"), F.col("cy").alias("b_cy"), "x", "y").hint("merge"), ["b_cx", "b_cy"]).where(reach("")).select("cx", "cy", "b_cx", "b_cy", "b_name", "x", "y")
    exact = left.hint("merge").join(right.hint("merge"), ["cx", "cy", "b_cx", "b_cy"]).where(F.hypot(F.col("ax") - F.col("x"), F.col("ay") - F.col("y")) <= separation)
    return met.where("near").select(F.col("name").alias("a"), F.col("b_name").alias("b")).union(exact.select("name", "b_name").distinct())


def groups(sources: DataFrame, separation: float) -> DataFrame:
    """(id, group_id): sources linked by chains of pairs at most `separation` apart; the group's least id. Pairs are not listed: points of one cell of 0.7 times the separation
    are one group, and links are between cells, some two dozen a cell at most. Names of cells, their least ids, spread over links by joins until nothing changes. Joins are by sort and merge, as
    tables that are small on disk would else be broadcast from the driver's memory. Sources without a finite position, or beyond 1e13 separations from the origin, are groups of their own."""
    side = 0.7 * separation
    cell = lambda c: F.floor(F.col(c) / side).cast("long")
    placed = kept(sources.where(F.col("id").isNotNull() & (F.abs("x") < 1e13 * separation) & (F.abs("y") < 1e13 * separation)).select("id", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), cell("x").alias("cx"), cell("y").alias("cy")), "placed")
    least = placed.groupBy("cx", "cy").agg(F.min("id").alias("name"))
    places = kept(placed.select("cx", "cy", "x", "y").distinct().hint("merge").join(least.hint("merge"), ["cx", "cy"]), "places")
    named = kept(placed.hint("merge").join(least.hint("merge"), ["cx", "cy"]).select("id", "name").distinct(), "named")
    again = named.withColumn("first", F.min("name").over(Window.partitionBy("id"))).where("first <> name").select("first", "name")  # an id at several places links them
    pairs = cell_links(places, separation).where("a <> b").union(again)
    both = kept(pairs.union(pairs.select("b", "a")).distinct(), "pairs")
    names = kept(named.select(F.col("name").alias("id"), F.col("name").alias("group_id")).distinct(), "groups")
    while True:
        low = both.hint("merge").join(names, both["b"] == names["id"]).groupBy("a").agg(F.min("group_id").alias("low"))
        new = names.hint("merge").join(low, names["id"] == low["a"], "left").select("id", F.least("group_id", "low").alias("group_id"))
        new = kept(new.hint("merge").join(new.select(F.col("id").alias("group_id"), F.col("group_id").alias("further")), "group_id", "left").select("id", F.least("group_id", "further").alias("group_id")), "groups")
        done = new.hint("merge").join(names.withColumnRenamed("group_id", "was"), "id").where("group_id <> was").isEmpty()
        names = new
        if done:
            break
    found = named.hint("merge").join(names.withColumnRenamed("id", "name"), "name").groupBy("id").agg(F.min("group_id").alias("group_id"))
    return sources.select("id").hint("merge").join(found.hint("merge"), "id", "left").select("id", F.coalesce("group_id", "id").alias("group_id"))


def least_squares(model, start: np.ndarray, value: np.ndarray, weight: np.ndarray, rounds: int = 100) -> tuple[np.ndarray, np.ndarray, int]:
    """Levenberg-Marquardt with numeric derivatives: parameters, their covariance, rounds used."""
    p, damping = start.astype(float), 1e-3
    r = (value - model(p)) * weight
    turn = 0
    for turn in range(1, rounds + 1):
        steps = 1e-6 * np.maximum(np.abs(p), 1.0)
        j = np.stack([(model(p + np.eye(len(p))[k] * steps[k]) - model(p)) / steps[k] * weight for k in range(len(p))], axis=1)
        a, g = j.T @ j, j.T @ r
        new = p + np.linalg.lstsq(a + damping * np.diag(np.diag(a) + 1e-12), g, rcond=None)[0]
        after = (value - model(new)) * weight
        if after @ after < r @ r:
            small = np.abs(new - p).max() < 1e-10 * max(1.0, np.abs(p).max())
            p, r, damping = new, after, damping / 10
            if small:
                break
        else:
            damping *= 10
            if damping > 1e10:
                break
    return p, np.linalg.pinv(a), turn


def fit(pixels: DataFrame, sources: DataFrame, sigma: float, half: int = 2) -> DataFrame:
    """Gaussian PRF fits of sources (id, group_id, x, y, flux; image_id where they belong to one image) with their group's members at once: (image_id, id, x_fit, y_fit, flux_fit, their errors, qfit, cfit, reduced_chi2, n_pixels, rounds).

    A group is small against an image: only its pixels and sources meet in a task.
    """
    span = F.sequence(F.lit(-half), F.lit(half))
    on = [c for c in ("image_id",) if c in sources.columns]
    cells = sources.select(*on, "id", "group_id", F.col("x").alias("x0"), F.col("y").alias("y0"), "flux", F.explode(span).alias("j")).select("*", F.explode(span).alias("i"))
    cells = cells.withColumn("y", (F.floor(F.col("y0") + 0.5) + F.col("j")).cast("int")).withColumn("x", (F.floor(F.col("x0") + 0.5) + F.col("i")).cast("int"))
    rows = cells.join(pixels.where(~F.coalesce("mask", F.lit(False))).select("image_id", "y", "x", "value", "error"), [*on, "y", "x"]).drop("i", "j")
    kind = pixels.schema["image_id"].dataType.simpleString()

    def solve(group: pd.DataFrame) -> pd.DataFrame:
        stars = group.drop_duplicates("id").sort_values("id")
        px = group.drop_duplicates(["y", "x"])
        x, y, v = px.x.to_numpy(float), px.y.to_numpy(float), px.value.to_numpy(float)
        e = px.error.to_numpy(float)
        w = np.where(np.isfinite(e) & (e > 0), 1 / np.where(e > 0, e, 1), 1.0)
        model = lambda p: sum(gaussian_prf(x - p[3 * k], y - p[3 * k + 1], p[3 * k + 2], sigma) for k in range(len(stars)))
        p, cov, turn = least_squares(model, stars[["x0", "y0", "flux"]].to_numpy(float).ravel(), v, w)
        left, err = v - model(p), np.sqrt(np.maximum(np.diag(cov), 0))
        out = []
        for k, (_, star) in enumerate(stars.iterrows()):
            own = (np.abs(x - np.floor(star.x0 + 0.5)) <= half) & (np.abs(y - np.floor(star.y0 + 0.5)) <= half)
            mid = (x == np.floor(p[3 * k] + 0.5)) & (y == np.floor(p[3 * k + 1] + 0.5))
            flux = p[3 * k + 2]
            free = max(1, int(own.sum()) - 3)
            out.append((star.image_id, int(star.id), *p[3 * k : 3 * k + 3], *err[3 * k : 3 * k + 3], np.abs(left[own]).sum() / flux if flux else None, -left[mid].sum() / flux if flux else None, ((left * w)[own] ** 2).sum() / free, int(own.sum()), turn))
        return pd.DataFrame(out, columns=["image_id", "id", "x_fit", "y_fit", "flux_fit", "x_err", "y_err", "flux_err", "qfit", "cfit", "reduced_chi2", "n_pixels", "rounds"])

    return rows.groupBy("image_id", "group_id").applyInPandas(solve, f"image_id {kind}, id long, x_fit double, y_fit double, flux_fit double, x_err double, y_err double, flux_err double, qfit double, cfit double, reduced_chi2 double, n_pixels int, rounds int")


def matching_kernel(source: np.ndarray, target: np.ndarray, regular: float = 1e-4, window: np.ndarray | None = None) -> np.ndarray:
    """The kernel that turns one PSF into another, by the ratio of transforms where the source's is large enough, brought to unit sum."""
    s, t = (np.fft.fftshift(np.fft.fft2(p / p.sum())) for p in (source, target))
    ratio = np.where(np.abs(s) > regular * np.abs(s).max(), t / np.where(s == 0, 1, s), 0)
    ratio = ratio if window is None else ratio * window
    kernel = np.real(np.fft.fftshift(np.fft.ifft2(np.fft.ifftshift(ratio))))
    return kernel / kernel.sum()


def taper(kind: str, size: int | tuple[int, int], alpha: float = 0.5, beta: float = 0.5) -> np.ndarray:
    """Windows for matching kernels, by distance from the centre as a share r of the half of the shorter side: hanning, tukey (falls over the outer alpha), cosine (falls from the centre on over alpha), split (flat within beta, falling over alpha) and tophat (beta)."""
    height, width = (size, size) if isinstance(size, int) else size
    y, x = np.mgrid[:height, :width].astype(float)
    half = (min(height, width) - 1) / 2
    r = np.hypot(y - (height - 1) / 2, x - (width - 1) / 2) / half if half else np.zeros((height, width))
    alpha, beta = {"hanning": (1.0, 0.0), "tukey": (alpha, 1 - alpha), "cosine": (alpha, 0.0), "split": (alpha, beta), "tophat": (0.0, beta)}[kind]
    if alpha == 0:
        return (r <= beta).astype(float)
    fall = 0.5 * (1 + np.cos(np.pi * (r - beta) / alpha))
    return np.where(r <= beta, 1.0, np.where(r < beta + alpha, fall, 0.0))


def stacked_psf(pixels: DataFrame, stars: DataFrame, half: int, oversampling: int = 2) -> DataFrame:
    """(j, i, value): the mean shape of stars (image_id, id, x, y) on a finer grid. Each star's pixels are scaled to unit sum, put on the grid by their offset from its centre, and each cell takes the median over stars."""
    from pixelloom.operators.detection import cut_outs

    near = stars.select("image_id", "id", F.floor(F.col("y") + 0.5).cast("int").alias("y"), F.floor(F.col("x") + 0.5).cast("int").alias("x"))
    rows = cut_outs(pixels, near, half, half, ["value"]).join(stars.select("image_id", "id", F.col("x").alias("sx"), F.col("y").alias("sy")), ["image_id", "id"])
    total = rows.groupBy("image_id", "id").agg(F.sum("value").alias("total"), F.count("*").alias("n")).where(F.col("n") == (2 * half + 1) ** 2)
    rows = rows.join(total, ["image_id", "id"]).where("total > 0")
    place = lambda a, b: F.round((F.col(a) - F.col(b)) * oversampling).cast("int")
    return rows.groupBy(place("y", "sy").alias("j"), place("x", "sx").alias("i")).agg(F.median(F.col("value") / F.col("total")).alias("value"))


def gridded(nodes: DataFrame, at: DataFrame) -> DataFrame:
    """(id, j, i, value): the PSF at positions (id, x, y) between the nodes (gx, gy, j, i, value) of a rectangular grid, bilinear in the four nodes around; outside the grid the nearest edge."""
    lines = nodes.select("gx", "gy").distinct()
    xs, ys = lines.agg(F.array_sort(F.collect_set("gx")).alias("xs")), lines.agg(F.array_sort(F.collect_set("gy")).alias("ys"))
    rows = at.crossJoin(F.broadcast(xs)).crossJoin(F.broadcast(ys))
    for c, grid in (("x", "xs"), ("y", "ys")):
        inside = F.least(F.greatest(F.col(c), F.element_at(grid, 1)), F.element_at(grid, -1))
        rows = rows.withColumn(f"{c}0", F.array_max(F.expr(f"filter({grid}, g -> g <= least(greatest({c}, element_at({grid}, 1)), element_at({grid}, -1)))")))
        rows = rows.withColumn(f"{c}1", F.coalesce(F.array_min(F.expr(f"filter({grid}, g -> g > {c}0)")), F.col(f"{c}0")))
        rows = rows.withColumn(f"t{c}", F.coalesce(F.try_divide(inside - F.col(f"{c}0"), F.col(f"{c}1") - F.col(f"{c}0")), F.lit(0.0)))
    corner = F.array(*[F.struct(F.col(f"x{a}").alias("gx"), F.col(f"y{b}").alias("gy"), ((F.col("tx") if a else 1 - F.col("tx")) * (F.col("ty") if b else 1 - F.col("ty"))).alias("w")) for a in (0, 1) for b in (0, 1)])
    sent = rows.select("id", F.explode(corner).alias("c")).select("id", F.col("c.gx").alias("gx"), F.col("c.gy").alias("gy"), F.col("c.w").alias("w")).where("w > 0")
    return sent.join(nodes, ["gx", "gy"]).groupBy("id", "j", "i").agg(F.sum(F.col("w") * F.col("value")).alias("value"))
