"""PSF photometry: initial values from apertures, grouped fits with bounds, result flags, model and residual images.

Groups of close sources are small against an image; only a group's pixels and sources meet in a task.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelloom.functions.columns import finite
from pixelloom.functions.models import Model
from pixelloom.functions.tables import kept
from pixelloom.operators import aperture, background, psf

#: The quality flags of fits by bit.
FLAGS = {
    1: "n_pixels_fit_partial", 2: "outside_bounds", 4: "negative_flux", 8: "no_convergence", 16: "no_covariance", 32: "near_bound", 64: "no_overlap", 128: "fully_masked",
    256: "too_few_pixels", 512: "non_finite_position", 1024: "non_finite_flux", 2048: "non_finite_localbkg",
}
RESULT = "x_fit double, y_fit double, flux_fit double, x_err double, y_err double, flux_err double, params array<double>, qfit double, cfit double, reduced_chi2 double, n_pixels_fit int, rounds int, flags int"


def initial(pixels: DataFrame, sources: DataFrame, radius: float, ring: tuple[float, float] | None = None) -> DataFrame:
    """sources (image_id, id, x, y) with local_bkg, the median of a ring around each (0 without), and flux, the sum within a circle above it."""
    flux = aperture.photometry(pixels, sources, aperture.circle(radius)).select("image_id", "id", F.col("flux").alias("sum_"), "area")
    out = sources.join(flux, ["image_id", "id"], "left")
    if ring:
        level = background.local(pixels, sources, aperture.circle(ring[0]), aperture.circle(ring[1])).select("image_id", "id", F.col("background").alias("local_bkg"))
        out = out.join(level, ["image_id", "id"], "left")
    else:
        out = out.withColumn("local_bkg", F.lit(0.0))
    given = [F.col("flux")] if "flux" in sources.columns else []
    return out.withColumn("flux", F.coalesce(*given, F.col("sum_") - F.col("area") * F.coalesce("local_bkg", F.lit(0.0)), F.lit(0.0))).drop("sum_", "area")


def grouped(sources: DataFrame, separation: float | None) -> DataFrame:
    """sources with group_id: of sources closer than `separation`, hand in hand, in one image, the least id; without a separation each its own."""
    if separation is None:
        return sources.withColumn("group_id", F.col("id"))
    # images side by side, far from each other
    images = sources.groupBy("image_id").agg(F.min("x").alias("low"), F.max("x").alias("high"))
    from pyspark.sql import Window

    before = Window.orderBy("image_id").rowsBetween(Window.unboundedPreceding, -1)
    images = images.withColumn("shift", F.coalesce(F.sum(F.col("high") - F.col("low") + 2 * separation + 1).over(before), F.lit(0.0)) - F.col("low"))  # one row an image
    apart = sources.join(F.broadcast(images.select("image_id", "shift")), "image_id").withColumn("key", F.xxhash64("image_id", "id"))
    named = psf.groups(apart.select(F.col("key").alias("id"), (F.col("x") + F.col("shift")).alias("x"), "y"), separation)
    found = apart.join(named.withColumnRenamed("id", "key"), "key").select(*sources.columns, F.col("group_id").alias("g"))
    least = found.groupBy("g").agg(F.min("id").alias("group_id"))
    return found.join(least, "g").drop("g")


def fit(pixels: DataFrame, sources: DataFrame, model: Model, half: int = 2, separation: float | None = None, radius: float | None = None, ring: tuple[float, float] | None = None, within: float | None = None, rounds: int = 100) -> DataFrame:
    """One row a source (image_id, id, x, y and flux or a radius to find it with): initial values, RESULT, group_id, group_size and local_bkg.

    within: how far a fitted position may lie from the initial one, in x and in y. Masked and non-finite pixels are left out; a source without
    pixels, or a group with fewer of them than parameters, keeps null results and says so in its flags.
    """
    start = kept(grouped(initial(pixels, sources, radius or half + 0.5, ring), separation), "start")
    kind, extra = pixels.schema["image_id"].dataType.simpleString(), len(model.free)
    bounds = pixels.groupBy("image_id").agg(F.max("y").alias("y_end"), F.max("x").alias("x_end"))
    span = F.sequence(F.lit(-half), F.lit(half))
    cells = start.join(bounds, "image_id", "left").select("image_id", "id", "group_id", F.col("x").alias("x0"), F.col("y").alias("y0"), "flux", "local_bkg", "x_end", "y_end", F.explode(span).alias("j")).select("*", F.explode(span).alias("i"))
    cells = cells.withColumns({"y": (F.floor(F.col("y0") + 0.5) + F.col("j")).cast("int"), "x": (F.floor(F.col("x0") + 0.5) + F.col("i")).cast("int")}).drop("i", "j")
    light = pixels.select("image_id", "y", "x", F.col("value").cast("double").alias("value"), F.col("error").cast("double").alias("error"), (~F.coalesce("mask", F.lit(False)) & finite(F.col("value"))).alias("good"))
    rows = cells.join(light, ["image_id", "y", "x"], "left")

    def solve(group: pd.DataFrame) -> pd.DataFrame:
        stars = group.drop_duplicates("id").sort_values("id").reset_index(drop=True)
        good = group.good.eq(True).to_numpy(bool)
        px = group[good].drop_duplicates(["y", "x"])
        x, y = px.x.to_numpy(float), px.y.to_numpy(float)
        level = float(np.nan_to_num(stars.local_bkg.fillna(0.0).to_numpy(float)).mean()) if len(stars) else 0.0
        v, e = px.value.to_numpy(float) - level, px.error.to_numpy(float)
        w = np.where(np.isfinite(e) & (e > 0), 1 / np.where(e > 0, e, 1), 1.0)
        n, each = len(stars), 3 + extra
        first = np.column_stack([stars[["x0", "y0", "flux"]].to_numpy(float), *(np.full(n, model.params[k]) for k in model.free)])
        sizes = [(group.id == i).to_numpy() for i in stars.id]
        usable = len(px) >= n * each and np.isfinite(first).all()
        p, cov, turn, failed = np.full(n * each, np.nan), None, 0, False
        if usable:

            def value(q):
                out = np.zeros(len(x))
                for k in range(n):
                    own = list(model.params)
                    for place, f in enumerate(model.free):
                        own[f] = q[k * each + 3 + place]
                    px_, py_ = q[k * each], q[k * each + 1]
                    if within is not None:
                        px_, py_ = np.clip(px_, first[k, 0] - within, first[k, 0] + within), np.clip(py_, first[k, 1] - within, first[k, 1] + within)
                    out = out + q[k * each + 2] * model.unit(x - px_, y - py_, own)
                return out

            try:
                p, cov, turn = psf.least_squares(value, first.ravel(), v, w, rounds)
            except (np.linalg.LinAlgError, FloatingPointError):
                failed = True
            if within is not None:
                for k in range(n):
                    for c in (0, 1):
                        p[k * each + c] = np.clip(p[k * each + c], first[k, c] - within, first[k, c] + within)
        left = v - value(p) if usable and not failed else None
        err = np.sqrt(np.maximum(np.diag(cov), 0)) if cov is not None else np.full(n * each, np.nan)
        out = []
        for k, star in stars.iterrows():
            q, q_err = p[k * each : (k + 1) * each], err[k * each : (k + 1) * each]
            own, here = sizes[k], sizes[k] & good
            inside = own & group.value.notna().to_numpy()
            touch = (np.abs(x - np.floor(star.x0 + 0.5)) <= half) & (np.abs(y - np.floor(star.y0 + 0.5)) <= half)
            flux, free = q[2], max(1, int(touch.sum()) - each)
            ok = left is not None and np.isfinite(flux) and flux != 0
            mid = (x == np.floor(q[0] + 0.5)) & (y == np.floor(q[1] + 0.5)) if ok else np.zeros(len(x), bool)
            bits = {
                1: here.sum() < (2 * half + 1) ** 2, 2: np.isfinite(q[:2]).all() and not (-0.5 <= q[0] <= star.x_end + 0.5 and -0.5 <= q[1] <= star.y_end + 0.5),
                4: np.isfinite(flux) and flux <= 0, 8: left is not None and turn >= rounds, 16: usable and (cov is None or not np.isfinite(err).all()),
                32: within is not None and np.isfinite(q[:2]).all() and (np.abs(np.abs(q[:2] - first[k, :2]) - within) < 0.01 * within).any(),
                64: not inside.any(), 128: inside.any() and not here.any(), 256: here.any() and not usable,
                512: not np.isfinite(q[:2]).all(), 1024: not np.isfinite(flux), 2048: not np.isfinite(star.local_bkg if star.local_bkg is not None else np.nan),
            }
            out.append((star.image_id, int(star.id), *q[:3], *q_err[:3], list(q[3:]), np.abs(left[touch]).sum() / flux if ok else np.nan, -left[mid].sum() / flux if ok else np.nan, ((left * w)[touch] ** 2).sum() / free if ok else np.nan, int(here.sum()), turn, sum(b for b, on in bits.items() if on)))
        made = pd.DataFrame(out, columns=["image_id", "id", *(c.split()[0] for c in RESULT.split(", "))])
        return made.astype(object).where(made.notna(), None)

    found = rows.groupBy("image_id", "group_id").applyInPandas(solve, f"image_id {kind}, id long, {RESULT}")
    sizes = start.groupBy("image_id", "group_id").agg(F.count("*").alias("group_size"))
    named = start.select("image_id", "id", "group_id", "local_bkg", F.col("x").alias("x_init"), F.col("y").alias("y_init"), F.col("flux").alias("flux_init"))
    return named.join(found, ["image_id", "id"], "left").join(sizes, ["image_id", "group_id"])


def to_start(result: DataFrame, fitted: bool = True) -> DataFrame:
    """A result's positions and fluxes as sources for another fit or a model image; without finite values, the initial ones."""
    pick = lambda c: F.coalesce(F.col(f"{c}_fit"), F.col(f"{c}_init")) if fitted else F.col(f"{c}_init")
    return result.select("image_id", "id", *(pick(c).alias(c) for c in ("x", "y", "flux")), "local_bkg")


def model_image(pixels: DataFrame, sources: DataFrame, model: Model, half: int = 5, with_background: bool = False) -> DataFrame:
    """(image_id, y, x, value, model): the light of sources (image_id, id, x, y, flux, local_bkg) within `half` pixels of each, summed at each pixel."""
    span = F.sequence(F.lit(-half), F.lit(half))
    cells = sources.where("x is not null and y is not null and flux is not null").select("image_id", "x", "y", "flux", F.coalesce("local_bkg", F.lit(0.0)).alias("local_bkg"), F.explode(span).alias("j")).select("*", F.explode(span).alias("i"))
    cells = cells.select("image_id", (F.floor(F.col("y") + 0.5) + F.col("j")).cast("int").alias("py"), (F.floor(F.col("x") + 0.5) + F.col("i")).cast("int").alias("px"), F.col("x").cast("double"), F.col("y").cast("double"), F.col("flux").cast("double"), F.col("local_bkg").cast("double"))
    kind = pixels.schema["image_id"].dataType.simpleString()

    def shine(batches):
        for part in batches:
            light = part.flux.to_numpy(float) * model.unit((part.px - part.x).to_numpy(float), (part.py - part.y).to_numpy(float))
            yield pd.DataFrame({"image_id": part.image_id, "y": part.py, "x": part.px, "light": light + (part.local_bkg.to_numpy(float) if with_background else 0)})

    sums = cells.mapInPandas(shine, f"image_id {kind}, y int, x int, light double").groupBy("image_id", "y", "x").agg(F.sum("light").alias("model"))
    return pixels.join(sums, ["image_id", "y", "x"], "left").select("image_id", "y", "x", "value", F.coalesce("model", F.lit(0.0)).alias("model"))


def residual_image(pixels: DataFrame, sources: DataFrame, model: Model, half: int = 5) -> DataFrame:
    """(image_id, y, x, value): the image without the sources' light."""
    return model_image(pixels, sources, model, half).select("image_id", "y", "x", (F.col("value") - F.col("model")).alias("value"))


def fit_fwhm(pixels: DataFrame, sources: DataFrame, sigma: float = 1.5, half: int = 3) -> DataFrame:
    """(image_id, id, fwhm): width of a round Gaussian fitted to each source with its position and flux."""
    found = fit(pixels, sources, Model("gaussian_prf", (sigma,), (0,)), half)
    return found.select("image_id", "id", (F.abs(F.get("params", F.lit(0))) * 2.3548200450309493).alias("fwhm"))
