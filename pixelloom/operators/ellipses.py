"""Isophotes of all semimajor axes and images at once: a round samples every ellipse by one join, solves each one's harmonics, and moves its geometry.

Geometry rows: image_id, sma, x0, y0, eps, pa (radians). A sample is bilinear between four pixels ("bilinear"), the pixel that holds the point
("nearest"), or the mean or median of the pixels in the sector around it ("mean", "median"); `clip` rounds drop samples beyond 3 deviations. The corrections are Jedrzejewski's (1987). An ellipse's samples are some hundreds
of rows, so its harmonics are solved in one call; no task sees an image.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pixelloom.functions.tables import kept

GEOMETRY = ["x0", "y0", "eps", "pa"]
FOUND = "sma double, x0 double, y0 double, eps double, pa double, intensity double, intensity_err double, rms double, gradient double, x0_err double, y0_err double, eps_err double, pa_err double, a3 double, b3 double, a4 double, b4 double, n_data int, n_flag int, worst double, rounds int, stop_code int, done boolean"


def radius_at(phi: Column, sma: Column, eps: Column) -> Column:
    """Distance from the centre of the ellipse's point at an angle from its major axis."""
    flat = 1 - eps
    return sma * flat / F.sqrt(F.pow(flat * F.cos(phi), F.lit(2.0)) + F.pow(F.sin(phi), F.lit(2.0)))


def to_polar(x: Column, y: Column, x0: Column, y0: Column, pa: Column) -> tuple[Column, Column]:
    """Distance of a point from the centre, and its angle from the major axis, from 0 to 2 pi."""
    r = F.hypot(x - x0, y - y0)
    return r, F.pmod(F.atan2(y - y0, x - x0) - pa, F.lit(2 * np.pi))


def elliptical_radius(x: Column, y: Column, x0: Column, y0: Column, eps: Column, pa: Column) -> Column:
    """Semimajor axis of the ellipse of that geometry through a point."""
    u = (x - x0) * F.cos(pa) + (y - y0) * F.sin(pa)
    v = (y - y0) * F.cos(pa) - (x - x0) * F.sin(pa)
    return F.sqrt(u * u + F.pow(v / (1 - eps), F.lit(2.0)))


def axes(low: float, high: float, step: float = 0.1, linear: bool = False) -> list[float]:
    """Semimajor axes from low to high, each larger by the factor 1 + step, or by step."""
    out = [low]
    while (nxt := out[-1] + step if linear else out[-1] * (1 + step)) <= high:
        out.append(nxt)
    return out


def starts(images: DataFrame, semimajor: list[float], x0: float, y0: float, eps: float = 0.2, pa: float = 0.0) -> DataFrame:
    """The same geometry at each axis, in each image (image_id)."""
    rows = images.select("image_id").distinct()
    return rows.select("image_id", F.explode(F.array(*[F.lit(float(a)) for a in semimajor])).alias("sma"), *(F.lit(float(v)).alias(n) for n, v in zip(GEOMETRY, (x0, y0, eps, pa), strict=True)))


def samples(pixels: DataFrame, geometry: DataFrame, step: float = 0.1, mode: str = "bilinear") -> DataFrame:
    """(image_id, sma, outer, phi, value): brightness at even angles of each ellipse and of one larger by `step`, for the gradient. Points without all their pixels, masked or non-finite ones are left out. Sectors of fewer than SECTOR pixels take the bilinear value."""
    if mode in ("mean", "median"):
        inner = geometry.select("image_id", "sma", *GEOMETRY, F.lit(False).alias("outer"), F.col("sma").alias("axis"))
        both = inner.unionByName(inner.withColumns({"outer": F.lit(True), "axis": F.col("sma") * (1 + step)}))
        found = sectors(pixels, both, step, mode).where(F.col("n") >= SECTOR).select("image_id", "sma", "outer", "k", F.col("value").alias("whole"))
        n = F.greatest(F.lit(24), F.ceil(2 * np.pi * F.col("sma")))
        point = samples(pixels, geometry, step).withColumn("k", F.round(F.col("phi") * n / (2 * np.pi)).cast("int"))
        met = point.join(found, ["image_id", "sma", "outer", "k"], "full")
        return met.select("image_id", "sma", "outer", F.coalesce("phi", 2 * np.pi * F.col("k") / n).alias("phi"), F.coalesce("whole", "value").alias("value"))
    n = F.greatest(F.lit(24), F.ceil(2 * np.pi * F.col("sma"))).cast("int")
    rows = geometry.select("image_id", "sma", *GEOMETRY, n.alias("n"), F.explode(F.array(F.lit(False), F.lit(True))).alias("outer"))
    rows = rows.withColumn("k", F.explode(F.sequence(F.lit(0), F.col("n") - 1))).withColumn("phi", 2 * np.pi * F.col("k") / F.col("n"))
    r = radius_at(F.col("phi"), F.col("sma") * F.when(F.col("outer"), 1 + step).otherwise(1.0), F.col("eps"))
    rows = rows.withColumns({"px": F.col("x0") + r * F.cos(F.col("phi") + F.col("pa")), "py": F.col("y0") + r * F.sin(F.col("phi") + F.col("pa"))})
    light = pixels.where(~F.coalesce("mask", F.lit(False)) & F.col("value").isNotNull() & ~F.isnan("value")).select("image_id", "y", "x", "value")
    if mode == "nearest":
        at = rows.withColumns({"x": F.floor(F.col("px") + 0.5).cast("int"), "y": F.floor(F.col("py") + 0.5).cast("int")})
        return at.join(light, ["image_id", "y", "x"]).select("image_id", "sma", "outer", "phi", "value")
    corner = F.array(*[F.struct(F.lit(j).alias("j"), F.lit(i).alias("i")) for j in (0, 1) for i in (0, 1)])
    at = rows.withColumn("c", F.explode(corner)).withColumns({"x": (F.floor("px") + F.col("c.i")).cast("int"), "y": (F.floor("py") + F.col("c.j")).cast("int")})
    w = (1 - F.abs(F.col("x") - F.col("px"))) * (1 - F.abs(F.col("y") - F.col("py")))
    met = at.withColumn("w", w).join(light, ["image_id", "y", "x"])
    return met.groupBy("image_id", "sma", "outer", "phi").agg(F.sum(F.col("w") * F.col("value")).alias("value"), F.sum("w").alias("w")).where("w > 0.999999").drop("w")


#: So many pixels make a sector.
SECTOR = 4


def turn_bounds(low: Column, high: Column) -> tuple[Column, Column]:
    """Least and largest cosine of the angles from low to high."""
    holds = lambda at: F.floor((high - at) / (2 * np.pi)) > F.floor((low - at) / (2 * np.pi)) - F.when(F.pmod(low - at, F.lit(2 * np.pi)) == 0, 1).otherwise(0)
    least = F.when(holds(np.pi), -1.0).otherwise(F.least(F.cos(low), F.cos(high)))
    return least, F.when(holds(0.0), 1.0).otherwise(F.greatest(F.cos(low), F.cos(high)))


def sectors(pixels: DataFrame, geometry: DataFrame, step: float = 0.1, how: str = "mean") -> DataFrame:
    """(image_id, sma, outer, k, n, value): the number and the mean or median of the good pixels in each sector of the ellipses (image_id, sma, outer, axis, GEOMETRY).

    There are as many sectors as samples() has angles for sma; sector k lies within half of one of angle k, and between axis times 1 - step / 2 and 1 + step / 2.
    A sector is opened to the pixels of its bounding box, from the bounds of its angle and radius, and these meet the image by place; so no
    ellipse is opened to the box around all of it.
    """
    n = F.greatest(F.lit(24), F.ceil(2 * np.pi * F.col("sma"))).cast("int")
    rows = geometry.select("image_id", "sma", "outer", "axis", *GEOMETRY, n.alias("of")).withColumn("k", F.explode(F.sequence(F.lit(0), F.col("of") - 1)))
    width = 2 * np.pi / F.col("of")
    rows = rows.withColumns({"from": (F.col("k") - 0.5) * width, "to": (F.col("k") + 0.5) * width})
    ends = [radius_at(F.col(c), F.lit(1.0), F.col("eps")) for c in ("from", "to")]
    # the radius is largest on the major axis and least on the minor one, between them it goes one way
    along, across = (turn_bounds(2 * F.col("from") - at, 2 * F.col("to") - at)[1] == 1.0 for at in (0.0, np.pi))
    near = F.col("axis") * (1 - step / 2) * F.when(across, 1 - F.col("eps")).otherwise(F.least(*ends))
    far = F.col("axis") * (1 + step / 2) * F.when(along, 1.0).otherwise(F.greatest(*ends))
    rows = rows.withColumns({"near": near, "far": far})
    for c, turn in (("x", 0.0), ("y", np.pi / 2)):
        least, most = turn_bounds(F.col("from") + F.col("pa") - turn, F.col("to") + F.col("pa") - turn)
        low = F.col(f"{c}0") + F.least(least * F.col("near"), least * F.col("far"))
        high = F.col(f"{c}0") + F.greatest(most * F.col("near"), most * F.col("far"))
        rows = rows.withColumn(f"{c}_cells", F.sequence(F.floor(low).cast("int"), F.ceil(high).cast("int")))
    cells = rows.withColumn("x", F.explode("x_cells")).withColumn("y", F.explode("y_cells")).drop("x_cells", "y_cells")
    r, phi = to_polar(F.col("x"), F.col("y"), F.col("x0"), F.col("y0"), F.col("pa"))
    ring = elliptical_radius(F.col("x"), F.col("y"), F.col("x0"), F.col("y0"), F.col("eps"), F.col("pa"))
    own = F.pmod(F.floor(phi * F.col("of") / (2 * np.pi) + 0.5), F.col("of")) == F.col("k")
    inside = cells.where(own & (ring >= F.col("axis") * (1 - step / 2)) & (ring < F.col("axis") * (1 + step / 2)) & (r > 0))
    light = pixels.where(~F.coalesce("mask", F.lit(False)) & F.col("value").isNotNull() & ~F.isnan("value")).select("image_id", "y", "x", "value")
    met = inside.select("image_id", "sma", "outer", "k", "y", "x").join(light, ["image_id", "y", "x"])
    return met.groupBy("image_id", "sma", "outer", "k").agg(F.count("*").alias("n"), (F.median("value") if how == "median" else F.avg("value")).alias("value"))


def solved(phi: np.ndarray, value: np.ndarray, orders: tuple[int, ...], clip: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Mean, sine and cosine amplitudes of the orders, their errors, and which samples were used."""
    used = np.isfinite(value)
    base = np.column_stack([np.ones(len(phi)), *(f(k * phi) for k in orders for f in (np.sin, np.cos))])
    for turn in range(clip + 1):
        fit = np.linalg.lstsq(base[used], value[used], rcond=None)[0]
        left = value - base @ fit
        spread = left[used].std()
        near = used & (np.abs(left) <= 3 * spread)
        if turn == clip or near.sum() == used.sum() or near.sum() < 2 * base.shape[1]:
            break
        used = near
    free = max(1, used.sum() - base.shape[1])
    cov = np.linalg.pinv(base[used].T @ base[used]) * (left[used] ** 2).sum() / free
    return fit, np.sqrt(np.maximum(np.diag(cov), 0)), used


def fit(pixels: DataFrame, start: DataFrame, rounds: int = 50, least: int = 10, converged: float = 0.05, step: float = 0.1, clip: int = 0, fix: tuple[str, ...] = (), enough: float = 0.7, mode: str = "bilinear") -> DataFrame:
    """One row an ellipse (image_id, FOUND): the geometry whose largest harmonic was least, its brightness with errors, gradient, residual harmonics 3 and 4, samples used and flagged, rounds and stop code.

    Stop codes: 0 converged (the largest harmonic is below `converged` times the scatter, or 0.0003 of the brightness), 1 too many samples missing, 2 rounds used up, 4 no gradient inwards, 5 no samples. fix: "centre", "eps" or "pa" that stay as they are. Each
    round is one job over the ellipses not done yet, written down; at least `least` rounds are made.
    """
    kind = pixels.schema["image_id"].dataType.simpleString()

    def move(own: pd.DataFrame, sample: pd.DataFrame) -> pd.DataFrame:
        g = own.iloc[0]
        out = g.to_dict()
        inner, outer = sample[~sample.outer], sample[sample.outer]
        expected = max(24, int(np.ceil(2 * np.pi * g.sma)))
        out["rounds"] = int(g.rounds) + 1
        if len(inner) < 6 or len(inner) < enough * expected:
            out.update(done=True, stop_code=5 if not len(inner) else 1, n_data=len(inner), n_flag=expected - len(inner))
            return pd.DataFrame([out])[own.columns]
        phi, v = inner.phi.to_numpy(float), inner.value.to_numpy(float)
        p, err, used = solved(phi, v, (1, 2), clip)
        a1, b1, a2, b2 = p[1:]
        rest = v - p[0] - a1 * np.sin(phi) - b1 * np.cos(phi) - a2 * np.sin(2 * phi) - b2 * np.cos(2 * phi)
        rms, mean = rest[used].std(), v[used].mean()
        slope = (outer.value.mean() - mean) / (step * g.sma) if len(outer) else np.nan
        free = {"centre": (a1, b1), "eps": (b2,), "pa": (a2,)}
        moves = [(abs(x), n, k) for n, xs in free.items() if n not in fix for k, x in enumerate(xs)]
        worst, name, which = max(moves, default=(0.0, "", 0))
        if not np.isfinite(g.worst) or worst < g.worst:
            q, q_err, _ = solved(phi, rest, (3, 4), 0)
            size = g.sma * abs(slope) if np.isfinite(slope) and slope != 0 else np.nan
            flat = 1 - g.eps
            turn = abs(flat * flat - 1) or np.nan
            out.update(intensity=mean, intensity_err=v[used].std() / max(1, used.sum()) ** 0.5, rms=v[used].std(), gradient=slope, a3=q[1] / size, b3=q[2] / size, a4=q[3] / size, b4=q[4] / size, n_data=int(used.sum()), n_flag=expected - int(used.sum()), worst=worst)
            along, across = err[2] / abs(slope), err[1] * flat / abs(slope)
            out.update(x0_err=np.hypot(along * np.cos(g.pa), across * np.sin(g.pa)), y0_err=np.hypot(along * np.sin(g.pa), across * np.cos(g.pa)), eps_err=2 * err[4] * flat / size, pa_err=2 * err[3] * flat / (size * turn))
            out.update(best_x0=g.x0, best_y0=g.y0, best_eps=g.eps, best_pa=g.pa)
        if worst <= max(converged * rms, 3e-4 * abs(mean)) and out["rounds"] >= least or not moves:
            out.update(done=True, stop_code=0)
        elif not np.isfinite(slope) or slope >= 0:
            out.update(done=True, stop_code=4)
        elif out["rounds"] >= rounds:
            out.update(done=True, stop_code=2)
        else:
            flat = 1 - g.eps
            if name == "centre" and which == 1:
                d = -b1 / slope
                out.update(x0=g.x0 + d * np.cos(g.pa), y0=g.y0 + d * np.sin(g.pa))
            elif name == "centre":
                d = -a1 * flat / slope
                out.update(x0=g.x0 - d * np.sin(g.pa), y0=g.y0 + d * np.cos(g.pa))
            elif name == "eps":
                eps = g.eps - 2 * b2 * flat / (g.sma * slope)
                if eps < 0:  # flat the other way round
                    out["pa"] = (g.pa + np.pi / 2) % np.pi
                out["eps"] = float(np.clip(abs(eps), 0.01, 0.95))
            else:
                # far from the solution a whole turn overshoots where the ellipse is rounder than the light
                d = 0.6 * 2 * a2 * flat / (g.sma * slope * (flat * flat - 1)) if g.eps > 1e-3 else 0.0
                out["pa"] = (g.pa + d) % np.pi
        return pd.DataFrame([out])[own.columns]

    fields = [f"image_id {kind}", FOUND, *(f"best_{n} double" for n in GEOMETRY)]
    names = [c.split()[0] for c in ", ".join(fields).split(", ")]
    here = set(start.columns)
    blank = {"done": F.lit(False), "rounds": F.lit(0), "stop_code": F.lit(None).cast("int"), "n_data": F.lit(0), "n_flag": F.lit(0)} | {f"best_{n}": F.col(n) for n in GEOMETRY}
    state = kept(start.select(*(F.col(n) if n in here else blank.get(n, F.lit(None).cast("double")).alias(n) for n in names)), "ellipses")
    for _ in range(rounds):
        left = state.where("not done")
        if left.isEmpty():
            break
        own = left.groupBy("image_id", "sma")
        moved = own.cogroup(samples(pixels, left, step, mode).toDF("image", "axis", "outer", "phi", "value").groupBy("image", "axis")).applyInPandas(move, ", ".join(fields))
        state = kept(state.where("done").unionByName(moved), "ellipses")
    best = [F.coalesce(f"best_{n}", n).alias(n) for n in GEOMETRY]
    return state.select("image_id", "sma", *best, *(n for n in names if n not in (*GEOMETRY, "image_id", "sma", "worst", "done") and not n.startswith("best_")))


def central(pixels: DataFrame, x0: float, y0: float) -> DataFrame:
    """(image_id, sma, intensity): the pixel at the centre, as the isophote of axis 0."""
    at = pixels.where((F.col("x") == int(np.floor(x0 + 0.5))) & (F.col("y") == int(np.floor(y0 + 0.5))))
    return at.select("image_id", F.lit(0.0).alias("sma"), F.col("value").alias("intensity"))


def growth(pixels: DataFrame, isophotes: DataFrame) -> DataFrame:
    """(image_id, sma, flux_ellipse, flux_circle, n_ellipse, n_circle): sums of the pixels whose centres lie within each ellipse, and within the circle of its axis. Ellipses are expanded to the pixels of their boxes, joined on places."""
    reach = F.ceil("sma").cast("int") + 1
    rows = isophotes.select("image_id", "sma", *GEOMETRY, reach.alias("reach"))
    cells = rows.withColumn("y", F.explode(F.sequence((F.floor("y0") - F.col("reach")).cast("int"), (F.ceil("y0") + F.col("reach")).cast("int"))))
    cells = cells.withColumn("x", F.explode(F.sequence((F.floor("x0") - F.col("reach")).cast("int"), (F.ceil("x0") + F.col("reach")).cast("int"))))
    met = cells.join(pixels.where(~F.coalesce("mask", F.lit(False))).select("image_id", "y", "x", "value"), ["image_id", "y", "x"])
    inside = elliptical_radius(F.col("x"), F.col("y"), F.col("x0"), F.col("y0"), F.col("eps"), F.col("pa")) <= F.col("sma")
    circle = F.hypot(F.col("x") - F.col("x0"), F.col("y") - F.col("y0")) <= F.col("sma")
    return met.groupBy("image_id", "sma").agg(F.sum(F.when(inside, F.col("value"))).alias("flux_ellipse"), F.sum(F.when(circle, F.col("value"))).alias("flux_circle"), F.count(F.when(inside, 1)).alias("n_ellipse"), F.count(F.when(circle, 1)).alias("n_circle"))


def model_image(pixels: DataFrame, isophotes: DataFrame, fill: float = 0.0) -> DataFrame:
    """(image_id, y, x, value, model): each pixel's brightness between the two ellipses it lies between, by straight lines in axis; `fill` beyond the last, the innermost brightness within the first. An image's ellipses, some dozens, go along as one array."""
    line = F.struct(F.col("sma"), *GEOMETRY, "intensity")
    lists = isophotes.where("intensity is not null").groupBy("image_id").agg(F.array_sort(F.collect_list(line)).alias("lines"))
    rows = pixels.select("image_id", "y", "x", "value").join(F.broadcast(lists), "image_id", "left")
    radius = lambda e: elliptical_radius(F.col("x"), F.col("y"), e["x0"], e["y0"], e["eps"], e["pa"])
    rows = rows.withColumn("at", F.transform("lines", lambda e: F.struct(e["sma"].alias("sma"), radius(e).alias("r"), e["intensity"].alias("v"))))
    low = F.element_at(F.filter("at", lambda e: e["r"] >= e["sma"]), -1)
    high = F.get(F.filter("at", lambda e: e["r"] < e["sma"]), F.lit(0))
    rows = rows.withColumns({"low": F.when(F.exists("at", lambda e: e["r"] >= e["sma"]), low), "high": high})
    a, b = F.col("low.r") - F.col("low.sma"), F.col("high.sma") - F.col("high.r")
    between = (F.col("low.v") * b + F.col("high.v") * a) / (a + b)
    model = F.when(F.col("high").isNull(), F.lit(fill)).when(F.col("low").isNull(), F.col("high.v")).when(a + b > 0, between).otherwise(F.col("low.v"))
    return rows.select("image_id", "y", "x", "value", F.coalesce(model, F.lit(fill)).alias("model"))


def finely(isophotes: DataFrame, density: float = 2.0) -> DataFrame:
    """(image_id, sma, GEOMETRY, intensity, p3, q3, p4, q4): ellipses between each two of an image, `density` of them a pixel; p and q are the sine and cosine amplitudes of brightness.

    Geometry and amplitudes go along straight lines in axis, turns the shorter way round, brightness along a straight line of its logarithm where it is
    positive. Within the innermost ellipse its shape stays, without harmonics at the centre.
    """
    size = F.col("sma") * F.abs("gradient")
    have = [n if n in isophotes.columns else None for n in ("a3", "b3", "a4", "b4")]
    amplitude = [(F.coalesce(F.col(c) * size, F.lit(0.0)) if c and "gradient" in isophotes.columns else F.lit(0.0)).alias(n) for c, n in zip(have, ("p3", "q3", "p4", "q4"), strict=True)]
    known = isophotes.where("intensity is not null").select("image_id", "sma", *GEOMETRY, "intensity", *amplitude)
    least = known.groupBy("image_id").agg(F.min_by(F.struct(*known.columns), "sma").alias("e")).where("e.sma > 0").select("image_id", F.lit(0.0).alias("sma"), *(f"e.{c}" for c in (*GEOMETRY, "intensity")), *(F.lit(0.0).alias(c) for c in ("p3", "q3", "p4", "q4")))
    own = [c for c in known.columns if c != "image_id"]
    image = Window.partitionBy("image_id").orderBy("sma")  # some dozens of ellipses an image
    pairs = known.unionByName(least).withColumn("next", F.lead(F.struct(*own)).over(image)).where("next is not null")
    steps = F.greatest(F.ceil((F.col("next.sma") - F.col("sma")) * density), F.lit(1)).cast("int")
    rows = pairs.withColumn("steps", steps).withColumn("step", F.explode(F.sequence(F.lit(0), F.col("steps") - 1))).withColumn("t", F.col("step") / F.col("steps"))
    line = lambda c, to: F.col(c) + F.col("t") * (to - F.col(c))
    new = {c: line(c, F.col(f"next.{c}")) for c in own}
    new["pa"] = F.col("pa") + F.col("t") * (F.pmod(F.col("next.pa") - F.col("pa") + np.pi / 2, F.lit(np.pi)) - np.pi / 2)
    positive = (F.col("intensity") > 0) & (F.col("next.intensity") > 0)
    new["intensity"] = F.when(positive, F.col("intensity") * F.pow(F.col("next.intensity") / F.when(positive, F.col("intensity")), F.col("t"))).otherwise(new["intensity"])
    last = known.groupBy("image_id").agg(F.max_by(F.struct(*known.columns), "sma").alias("e")).select("e.*")
    return rows.select("image_id", *(v.alias(c) for c, v in new.items())).unionByName(last)


def harmonic_image(pixels: DataFrame, isophotes: DataFrame, fill: float = 0.0, density: float = 2.0) -> DataFrame:
    """(image_id, y, x, value, model): the light of all ellipses with their third and fourth harmonics (a3 to b4 and gradient, as fit() gives them), scattered to pixels.

    Each ellipse throws its brightness at angles `density` a pixel apart onto the four pixels around, by bilinear weights; a pixel takes the weighted mean, `fill`
    where no light falls. What is thrown adds up by pixel before it is shuffled; no task sees an image.
    """
    n = F.ceil(2 * np.pi * F.greatest(F.col("sma"), F.lit(1.0)) * density).cast("int")
    rows = finely(isophotes, density).withColumn("of", n).withColumn("phi", F.explode(F.transform(F.sequence(F.lit(0), F.col("of") - 1), lambda k: 2 * np.pi * k / F.col("of"))))
    phi, r = F.col("phi"), radius_at(F.col("phi"), F.col("sma"), F.col("eps"))
    light = F.col("intensity") + F.col("p3") * F.sin(3 * phi) + F.col("q3") * F.cos(3 * phi) + F.col("p4") * F.sin(4 * phi) + F.col("q4") * F.cos(4 * phi)
    at = rows.select("image_id", light.alias("light"), (F.col("x0") + r * F.cos(phi + F.col("pa"))).alias("px"), (F.col("y0") + r * F.sin(phi + F.col("pa"))).alias("py"))
    corner = F.explode(F.array(*[F.struct(F.lit(j).alias("j"), F.lit(i).alias("i")) for j in (0, 1) for i in (0, 1)]))
    at = at.withColumn("c", corner).withColumns({"x": (F.floor("px") + F.col("c.i")).cast("int"), "y": (F.floor("py") + F.col("c.j")).cast("int")})
    at = at.withColumn("w", (1 - F.abs(F.col("x") - F.col("px"))) * (1 - F.abs(F.col("y") - F.col("py")))).where("w > 0")
    thrown = at.groupBy("image_id", "y", "x").agg((F.sum(F.col("w") * F.col("light")) / F.sum("w")).alias("model"))
    return pixels.select("image_id", "y", "x", "value").join(thrown, ["image_id", "y", "x"], "left").withColumn("model", F.coalesce("model", F.lit(float(fill))))
