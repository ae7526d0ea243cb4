"""Peaks and star finders. Neighbourhoods are window frames along rows and columns, or equi-joins on shifted pixels."""

from __future__ import annotations

from math import cos, exp, log, sin, sqrt

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pixelloom.functions.columns import fdiv, root


def box_maximum(pixels: DataFrame, half: int) -> DataFrame:
    """pixels with `highest`, the maximum of the (2 half + 1)^2 box around each: one window along rows, one along columns."""
    along = Window.partitionBy("image_id", "y").orderBy("x").rangeBetween(-half, half)
    across = Window.partitionBy("image_id", "x").orderBy("y").rangeBetween(-half, half)
    return pixels.withColumn("row_highest", F.max("value").over(along)).withColumn("highest", F.max("row_highest").over(across)).drop("row_highest")


def find_peaks(pixels: DataFrame, threshold: float | Column, box: int = 3, border: int = 0, most: int | None = None, masked: bool = False) -> DataFrame:
    """(image_id, y, x, peak) of pixels above threshold that are highest in their box. most: the brightest so many of each image, ties by place."""
    rows = pixels.where(~F.coalesce("mask", F.lit(False))) if masked else pixels
    found = box_maximum(rows, box // 2).where((F.col("value") == F.col("highest")) & (F.col("value") > threshold))
    if border:
        size = pixels.groupBy("image_id").agg(F.max("y").alias("y_end"), F.max("x").alias("x_end"))
        found = found.join(size, "image_id").where((F.col("y") >= border) & (F.col("x") >= border) & (F.col("y") <= F.col("y_end") - border) & (F.col("x") <= F.col("x_end") - border))
    found = found.select("image_id", "y", "x", F.col("value").alias("peak"))
    if most is None:
        return found
    order = Window.partitionBy("image_id").orderBy(F.desc("peak"), "y", "x")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most).drop("rank")


def round_peaks(pixels: DataFrame, threshold: float, radius: float) -> DataFrame:
    """Peaks that are highest within a disc: the inscribed box leaves few candidates, which are then held against the disc."""
    half = int(radius / sqrt(2))
    found = find_peaks(pixels, threshold, 2 * half + 1)
    reach = int(radius)
    steps = [(i, j) for i in range(-reach, reach + 1) for j in range(-reach, reach + 1) if i * i + j * j <= radius * radius]
    shifts = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in steps])
    near = found.select("image_id", F.col("y").alias("py"), F.col("x").alias("px"), "peak", F.explode(shifts).alias("s")).select("image_id", "py", "px", "peak", (F.col("py") + F.col("s.i")).alias("y"), (F.col("px") + F.col("s.j")).alias("x"))
    over = near.join(pixels.select("image_id", "y", "x", "value"), ["image_id", "y", "x"]).groupBy("image_id", "py", "px", "peak").agg(F.max("value").alias("highest")).where("highest <= peak")
    return over.select("image_id", F.col("py").alias("y"), F.col("px").alias("x"), "peak")


def convolve(pixels: DataFrame, kernel: np.ndarray) -> DataFrame:
    """pixels with `convolved`: sums over the kernel's cells, pixels beyond the edge as 0. Each pixel is sent to the cells it adds to, with partial sums before the shuffle."""
    hy, hx = kernel.shape[0] // 2, kernel.shape[1] // 2
    cells = [(i - hy, j - hx, float(kernel[i, j])) for i in range(kernel.shape[0]) for j in range(kernel.shape[1]) if kernel[i, j] != 0]
    steps = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.lit(k).alias("k")) for i, j, k in cells])
    sent = pixels.select("image_id", "y", "x", "value", F.explode(steps).alias("s"))
    sums = sent.groupBy("image_id", (F.col("y") - F.col("s.i")).alias("y"), (F.col("x") - F.col("s.j")).alias("x")).agg(F.sum(F.col("value") * F.col("s.k")).alias("convolved"))
    return pixels.join(sums, ["image_id", "y", "x"])


def star_kernel(fwhm: float, ratio: float = 1.0, theta: float = 0.0, sigma_radius: float = 1.5) -> dict:
    """Truncated elliptical Gaussian of zero sum, the cells it covers, its peak form and its relative error."""
    sx = fwhm / (2 * sqrt(2 * log(2)))
    sy = ratio * sx
    c, s = cos(theta), sin(theta)
    a = (c * c / sx**2 + s * s / sy**2) / 2
    b = c * s * (1 / sx**2 - 1 / sy**2)
    q = (s * s / sx**2 + c * c / sy**2) / 2
    reach = sigma_radius**2 / 2
    den = 4 * a * q - b * b
    nx, ny = (2 * int(max(2, sqrt(2 * reach * k * 2 / den))) + 1 for k in (q, a))
    y, x = np.mgrid[:ny, :nx].astype(float)
    x, y = x - nx // 2, y - ny // 2
    form = a * x * x + b * x * y + q * y * y
    mask = (form <= reach) | (np.hypot(x, y) <= 2)
    peak = np.exp(-form)
    own = peak * mask
    n = mask.sum()
    scatter = (own**2).sum() - own.sum() ** 2 / n
    return {"kernel": (own - own.sum() / n * mask) / scatter, "mask": mask, "gauss": peak, "rel_err": 1 / sqrt(scatter), "sigma": sx, "n": int(n)}


def cut_outs(pixels: DataFrame, stars: DataFrame, half_y: int, half_x: int, columns: list[str]) -> DataFrame:
    """The pixels around each star (image_id, id, y, x) with their offsets (j, i); places beyond the image are absent."""
    cells = F.array(*[F.struct(F.lit(j).alias("j"), F.lit(i).alias("i")) for j in range(-half_y, half_y + 1) for i in range(-half_x, half_x + 1)])
    wide = stars.select("image_id", "id", F.col("y").alias("y0"), F.col("x").alias("x0"), F.explode(cells).alias("c"))
    wide = wide.select("image_id", "id", "y0", "x0", F.col("c.j").alias("j"), F.col("c.i").alias("i"), (F.col("y0") + F.col("c.j")).alias("y"), (F.col("x0") + F.col("c.i")).alias("x"))
    return wide.join(pixels.select("image_id", "y", "x", *columns), ["image_id", "y", "x"])


def numbered(peaks: DataFrame) -> DataFrame:
    """Peaks with an id from 1 in each image, in order of place."""
    return peaks.withColumn("id", F.row_number().over(Window.partitionBy("image_id").orderBy("y", "x")).cast("long"))


def marginal(kernel: np.ndarray, sigma: float, along_x: bool) -> tuple[dict[str, np.ndarray], dict[str, float]]:
    """The weights of a cut-out's pixels in the sums of a marginal Gaussian fit, and the kernel's own sums. Both marginals are weighted by triangles that fall from the centre."""
    hy, hx = (n // 2 for n in kernel.shape)
    wx, wy = (h + 1.0 - np.abs(np.arange(-h, h + 1)) for h in (hx, hy))
    line, across, place = (wx, wy[:, None], np.arange(-hx, hx + 1)) if along_x else (wy, wx[None, :], np.arange(-hy, hy + 1))
    g = (kernel * across).sum(axis=0 if along_x else 1)
    slope = -g * place
    spread = lambda v: np.broadcast_to(across, kernel.shape) * (v[None, :] if along_x else v[:, None])
    sums = {"d": spread(line), "dk": spread(line * g), "ds": spread(line * slope), "dx": spread(line * (-place if along_x else place))}
    own = {"w": line.sum(), "k": (g * line).sum(), "kk": (g * g * line).sum(), "s": (slope * line).sum(), "ss": (slope * slope * line).sum(), "ks": (g * slope * line).sum(), "sigma": sigma, "size": float(len(line))}
    return sums, own


def marginal_fit(name: str, own: dict[str, float]) -> tuple[Column, Column]:
    """Shift and height of the fit from a star's sums (columns name_d, name_dk, ...); null where the height isn't positive. A shift beyond the cut-out is replaced by that of the weighted mean, or 0."""
    d, dk, ds, dx = (F.col(f"{name}_{c}") for c in ("d", "dk", "ds", "dx"))
    top, low = dk - d * own["k"] / own["w"], own["kk"] - own["k"] ** 2 / own["w"]
    height = F.when((top > 0) & F.lit(low > 0), top / (low or 1.0))
    shift = fdiv(F.lit(own["ks"]) - (ds - own["s"] * d), height * (own["ss"] / own["sigma"] ** 2))
    half = own["size"] / 2
    mean = F.coalesce(fdiv(dx, d), F.lit(0.0))
    shift = F.when(F.abs(shift) > half, F.when(F.abs(mean) > half, 0.0).otherwise(mean)).otherwise(shift)
    return F.when(height.isNotNull(), shift), height


def dao_find(pixels: DataFrame, threshold: float, fwhm: float, sharp: tuple[float, float] = (0.2, 1.0), rounds: tuple[float, float] = (-1.0, 1.0), brightest: int | None = None) -> DataFrame:
    """Stars where the zero-sum convolution peaks: sharpness, roundness by quadrants and by the heights of Gaussians fitted to the marginal sums, and centres shifted by those fits."""
    k = star_kernel(fwhm)
    hy, hx = (n // 2 for n in k["kernel"].shape)
    seen = convolve(pixels, k["kernel"])
    limit = threshold * k["rel_err"]
    found = numbered(find_peaks(seen.select("image_id", "y", "x", F.col("convolved").alias("value")), limit, 2 * max(hx, int(2.5 * fwhm)) + 1).join(seen.select("image_id", "y", "x", "value"), ["image_id", "y", "x"]))
    cells = cut_outs(seen, found, hy, hx, ["value", "convolved"]).withColumn("at", (F.col("j") + hy) * (2 * hx + 1) + F.col("i") + hx + 1)
    table = lambda m: F.element_at(F.array(*[F.lit(float(v)) for v in np.asarray(m).ravel()]), F.col("at"))
    quarter = F.when((F.col("j") == 0) & (F.col("i") == 0), 0).when((F.col("i") > 0) & (F.col("j") >= 0), -1).when((F.col("i") <= 0) & (F.col("j") > 0), 1).when((F.col("i") < 0) & (F.col("j") <= 0), -1).otherwise(1)
    sides = {"x": marginal(k["gauss"], k["sigma"], True), "y": marginal(k["gauss"], k["sigma"], False)}
    sums = cells.groupBy("image_id", "id").agg(
        F.sum(F.when((table(k["mask"]) > 0) & ~((F.col("i") == 0) & (F.col("j") == 0)), F.col("value"))).alias("rest"),
        F.sum(quarter * F.col("convolved")).alias("turned"), F.sum(F.abs("convolved")).alias("whole"), F.sum("value").alias("flux"),
        *(F.sum(F.col("value") * table(m)).alias(f"{n}_{c}") for n, (weights, _) in sides.items() for c, m in weights.items()),
    )
    (shift_x, high_x), (shift_y, high_y) = (marginal_fit(n, own) for n, (_, own) in sides.items())
    stars = found.join(sums, ["image_id", "id"])
    stars = stars.withColumns({
        "sharpness": fdiv(F.col("value") - F.col("rest") / (k["n"] - 1), F.col("peak")),
        "roundness1": fdiv(2 * F.col("turned"), F.col("whole")),
        "roundness2": fdiv(2 * (high_x - high_y), high_x + high_y),
        "x_centroid": F.col("x") + shift_x, "y_centroid": F.col("y") + shift_y,
        "daofind_mag": -2.5 * F.log10(F.col("peak") / limit),
    })
    stars = stars.where(F.col("sharpness").between(*sharp) & F.col("roundness1").between(*rounds) & F.col("roundness2").between(*rounds))
    out = stars.select("image_id", "id", "x_centroid", "y_centroid", "sharpness", "roundness1", "roundness2", F.col("value").alias("peak"), "flux", "daofind_mag", F.lit(k["n"]).alias("n_pixels"))
    return out if brightest is None else top_by_flux(out, brightest)


def star_find(pixels: DataFrame, threshold: float, kernel: np.ndarray, brightest: int | None = None) -> DataFrame:
    """Stars by a kernel of one's own, brought to zero sum: centroid, shape and flux from each star's cut-out."""
    kernel = kernel / kernel.sum()
    mask = kernel != 0
    zero = np.where(mask, kernel - kernel[mask].mean(), 0)
    zero = zero / (zero * zero).sum()
    seen = convolve(pixels, zero)
    hy, hx = kernel.shape[0] // 2, kernel.shape[1] // 2
    found = numbered(find_peaks(seen.select("image_id", "y", "x", F.col("convolved").alias("value")), threshold, 2 * max(hx, hy) + 1))
    cells = cut_outs(pixels, found, hy, hx, ["value"])
    light = F.greatest("value", F.lit(0.0))
    sums = cells.groupBy("image_id", "id").agg(F.sum("value").alias("flux"), F.max("value").alias("max_value"), F.sum(light).alias("m"), F.sum(light * F.col("x")).alias("mx"), F.sum(light * F.col("y")).alias("my"), F.sum(light * F.col("x") * F.col("x")).alias("mxx"), F.sum(light * F.col("y") * F.col("y")).alias("myy"), F.sum(light * F.col("x") * F.col("y")).alias("mxy"))
    cx, cy = fdiv(F.col("mx"), F.col("m")), fdiv(F.col("my"), F.col("m"))
    sums = sums.withColumns({"x_centroid": cx, "y_centroid": cy, "vx": fdiv(F.col("mxx"), F.col("m")) - cx * cx, "vy": fdiv(F.col("myy"), F.col("m")) - cy * cy, "vxy": fdiv(F.col("mxy"), F.col("m")) - cx * cy})
    total, diff = F.col("vx") + F.col("vy"), F.col("vx") - F.col("vy")
    out = sums.select("image_id", "id", "x_centroid", "y_centroid", (2 * root(F.lit(log(2)) * total)).alias("fwhm"), fdiv(F.sqrt(diff * diff + 4 * F.col("vxy") * F.col("vxy")), total).alias("roundness"), F.degrees(F.atan2(2 * F.col("vxy"), diff) / 2).alias("orientation"), "max_value", "flux", F.when(F.col("flux") > 0, -2.5 * F.log10("flux")).alias("mag"))
    return out if brightest is None else top_by_flux(out, brightest)


def top_by_flux(stars: DataFrame, n: int) -> DataFrame:
    return stars.withColumn("rank", F.row_number().over(Window.partitionBy("image_id").orderBy(F.desc("flux"), "id"))).where(F.col("rank") <= n).drop("rank")


def close_pairs(points: DataFrame, distance: float) -> DataFrame:
    """(a, b, d) of points (id, x, y) at most that far apart, a < b: by grid cells of that size, each against its half of the neighbours. Cells meet by a
    sort-merge join: Spark takes the copies of points for neighbours to be as few as the points, and so would broadcast them from the driver's memory."""
    cell = lambda c: F.floor(F.col(c) / distance).cast("long")
    rows = points.select("id", "x", "y", cell("x").alias("cx"), cell("y").alias("cy"))
    steps = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in ((0, 0), (0, 1), (1, -1), (1, 0), (1, 1))])
    near = rows.select(F.col("id").alias("b"), F.col("x").alias("bx"), F.col("y").alias("by"), "cx", "cy", F.explode(steps).alias("s")).select("b", "bx", "by", (F.col("cx") + F.col("s.i")).alias("cx"), (F.col("cy") + F.col("s.j")).alias("cy"), ((F.col("s.i") == 0) & (F.col("s.j") == 0)).alias("own"))
    pairs = rows.hint("merge").join(near.hint("merge"), ["cx", "cy"]).where("id < b or (not own and id > b)").withColumn("d", F.hypot(F.col("x") - F.col("bx"), F.col("y") - F.col("by")))
    return pairs.where(F.col("d") <= distance).select(F.least("id", "b").alias("a"), F.greatest("id", "b").alias("b"), "d")


def gaussian_kernel(fwhm: float, size: int, oversampling: int = 10) -> np.ndarray:
    """Normalised Gaussian, averaged over sub-pixels."""
    sigma, half = fwhm / (2 * sqrt(2 * log(2))), size // 2
    at = (np.arange(size * oversampling) + 0.5) / oversampling - 0.5 - half
    line = np.array([exp(-(v * v) / (2 * sigma * sigma)) for v in at]).reshape(size, oversampling).mean(axis=1)
    kernel = np.outer(line, line)
    return kernel / kernel.sum()
