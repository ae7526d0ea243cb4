"""Statistics of grouped values: one aggregate each, a second pass where a centre is needed first.

Rows are (keys..., value) with x, y for moments. Values that are null, NaN or infinite are left out.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pixelloom.functions.columns import fdiv, finite, root
from pixelloom.functions.tables import kept

MAD = 1.482602218505602


def good(rows: DataFrame) -> DataFrame:
    return rows.where(finite(F.col("value")))


def basic(rows: DataFrame, keys: list[str], ddof: int = 0) -> DataFrame:
    """n, min, max, mean, median, mode (3 median - 2 mean), std, var and the errors of mean and median."""
    var = F.var_pop("value") if ddof == 0 else F.var_samp("value")
    found = good(rows).groupBy(*keys).agg(
        F.count("*").alias("n"), F.min("value").alias("min"), F.max("value").alias("max"), F.avg("value").alias("mean"), F.median("value").alias("median"), var.alias("var"), F.var_pop("value").alias("spread"),
    )
    error = F.when(F.col("n") > 1, F.sqrt(F.col("spread") / F.greatest(F.col("n") - 1, F.lit(1))))
    return found.select(*keys, "n", "min", "max", "mean", "median", (3 * F.col("median") - 2 * F.col("mean")).alias("mode"), F.sqrt("var").alias("std"), "var", error.alias("mean_err"), (error * F.sqrt(F.lit(np.pi / 2))).alias("median_err"))


def with_median(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Each row with its group's median and median absolute deviation."""
    rows = good(rows)
    mid = rows.groupBy(*keys).agg(F.median("value").alias("mid"))
    both = rows.join(mid, keys)
    return both.join(both.groupBy(*keys).agg(F.median(F.abs(F.col("value") - F.col("mid"))).alias("mad")), keys)


def mad_std(rows: DataFrame, keys: list[str]) -> DataFrame:
    return with_median(rows, keys).groupBy(*keys).agg((F.max("mad") * MAD).alias("mad_std"))


def biweight(rows: DataFrame, keys: list[str], c_location: float = 6.0, c_scale: float = 9.0) -> DataFrame:
    """Biweight location and midvariance; with no deviation the median and 0."""
    rows = with_median(rows, keys)
    d = F.col("value") - F.col("mid")
    u, v = (fdiv(d, F.lit(c) * F.col("mad")) for c in (c_location, c_scale))
    near = lambda q, x: F.when(F.abs(q) < 1, x).otherwise(F.lit(0.0))
    rest, left = 1 - u * u, 1 - v * v
    sums = rows.groupBy(*keys).agg(
        F.max("mid").alias("mid"), F.max("mad").alias("mad"), F.count("*").alias("n"),
        F.sum(near(u, d * rest * rest)).alias("a"), F.sum(near(u, rest * rest)).alias("b"),
        F.sum(near(v, d * d * left * left * left * left)).alias("e"), F.sum(near(v, left * (1 - 5 * v * v))).alias("f"),
    )
    location = F.when(F.col("mad") == 0, F.col("mid")).otherwise(F.col("mid") + fdiv(F.col("a"), F.col("b")))
    variance = F.when(F.col("mad") == 0, 0.0).otherwise(fdiv(F.col("n") * F.col("e"), F.col("f") * F.col("f")))
    return sums.select(*keys, location.alias("biweight_location"), variance.alias("biweight_midvariance"))


def gini(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Gini index of the absolute values; 0 for one value."""
    rows = good(rows).withColumn("size", F.abs("value"))
    ranked = rows.withColumn("i", F.row_number().over(Window.partitionBy(*keys).orderBy("size"))).withColumn("n", F.count("*").over(Window.partitionBy(*keys)))
    sums = ranked.groupBy(*keys).agg(F.sum((2 * F.col("i") - F.col("n") - 1) * F.col("size")).alias("s"), F.avg("size").alias("mean"), F.count("*").alias("n"))
    return sums.select(*keys, F.when(F.col("n") == 1, 0.0).otherwise(fdiv(F.col("s"), F.col("mean") * F.col("n") * (F.col("n") - 1))).alias("gini"))


def moments(rows: DataFrame, keys: list[str], order: int = 3) -> DataFrame:
    """Raw moments m_ij: sums of y^i value x^j."""
    term = lambda i, j: F.sum(F.pow(F.col("y").cast("double"), F.lit(float(i))) * F.col("value") * F.pow(F.col("x").cast("double"), F.lit(float(j))))
    return good(rows).groupBy(*keys).agg(*[term(i, j).alias(f"m{i}{j}") for i in range(order + 1) for j in range(order + 1)])


def centroid(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Centre of mass; null without weight."""
    sums = good(rows).groupBy(*keys).agg(F.sum("value").alias("s"), F.sum(F.col("x") * F.col("value")).alias("sx"), F.sum(F.col("y") * F.col("value")).alias("sy"))
    some = F.abs("s") >= 1e-30
    return sums.select(*keys, F.when(some, fdiv(F.col("sx"), F.col("s"))).alias("x_centroid"), F.when(some, fdiv(F.col("sy"), F.col("s"))).alias("y_centroid"))


def central_moments(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Moments about the centroid: mu20 is the y part, mu02 the x part, as in moments()."""
    both = good(rows).join(centroid(rows, keys), keys)
    dx, dy, v = F.col("x") - F.col("x_centroid"), F.col("y") - F.col("y_centroid"), F.col("value")
    return both.groupBy(*keys).agg(F.max("x_centroid").alias("x_centroid"), F.max("y_centroid").alias("y_centroid"), F.sum(v).alias("mu00"), F.sum(v * dx * dx).alias("mu02"), F.sum(v * dy * dy).alias("mu20"), F.sum(v * dx * dy).alias("mu11"))


def shape(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Shape of the light: covariance and what follows from it. A covariance smaller than a pixel's own gets 1/12 on its diagonal; an impossible one is null."""
    found = central_moments(rows, keys)
    xx, yy, xy = (fdiv(F.col(m), F.col("mu00")) for m in ("mu02", "mu20", "mu11"))
    found = found.withColumns({"sxx": xx, "syy": yy, "sxy": xy}).withColumn("det", F.col("sxx") * F.col("syy") - F.col("sxy") * F.col("sxy"))
    fine = (F.col("det") >= 0) & (F.col("sxx") + F.col("syy") >= 0)
    floor = F.when(F.col("det") < 1 / 144, 1 / 12).otherwise(0.0)
    found = found.withColumns({"cxx_": F.when(fine, F.col("sxx") + floor), "cyy_": F.when(fine, F.col("syy") + floor), "cxy_": F.when(fine, F.col("sxy"))})
    half, diff = (F.col("cxx_") + F.col("cyy_")) / 2, (F.col("cxx_") - F.col("cyy_")) / 2
    turn = F.sqrt(diff * diff + F.col("cxy_") * F.col("cxy_"))
    found = found.withColumns({"l1": half + turn, "l2": half - turn}).withColumns({"semimajor": root(F.col("l1")), "semiminor": root(F.col("l2"))})
    det = F.col("cxx_") * F.col("cyy_") - F.col("cxy_") * F.col("cxy_")
    out = {
        "semimajor_axis": F.col("semimajor"), "semiminor_axis": F.col("semiminor"),
        "fwhm": 2 * F.sqrt(F.log(F.lit(2.0)) * (F.col("l1") + F.col("l2"))),
        "orientation": F.degrees(F.atan2(2 * F.col("cxy_"), F.col("cxx_") - F.col("cyy_")) / 2),
        "eccentricity": root(1 - fdiv(F.col("l2"), F.col("l1"))),
        "elongation": fdiv(F.col("semimajor"), F.col("semiminor")), "ellipticity": 1 - fdiv(F.col("semiminor"), F.col("semimajor")),
        "covariance_xx": F.col("cxx_"), "covariance_yy": F.col("cyy_"), "covariance_xy": F.col("cxy_"),
        "ellipse_cxx": fdiv(F.col("cyy_"), det), "ellipse_cyy": fdiv(F.col("cxx_"), det), "ellipse_cxy": fdiv(-2 * F.col("cxy_"), det),
    }
    return found.select(*keys, "x_centroid", "y_centroid", *(c.alias(n) for n, c in out.items()))


def sigma_clip(rows: DataFrame, keys: list[str], sigma: float = 3.0, rounds: int = 3, centre: str = "median", scale: str = "std") -> DataFrame:
    """The rows left after up to `rounds` rounds of clipping. What survives lies in the intersection of all rounds' intervals, so a round keeps one interval a group, written down, and rows are only read again; rounds end once no interval moves."""
    rows, state = good(rows), None
    for _ in range(rounds):
        inside = rows if state is None else rows.join(state, keys).where(F.col("value").between(F.col("low_"), F.col("high_"))).drop("low_", "high_")
        base = with_median(inside, keys) if scale == "mad_std" else inside
        mid = F.median("value") if centre == "median" else F.avg("value")
        spread = sigma * (F.max("mad") * MAD if scale == "mad_std" else F.stddev_pop("value"))
        new = base.groupBy(*keys).agg(mid.alias("mid_"), spread.alias("spread_")).select(*keys, (F.col("mid_") - F.col("spread_")).alias("low_"), (F.col("mid_") + F.col("spread_")).alias("high_"))
        if state is not None:
            new = new.join(state.toDF(*keys, "was_low", "was_high"), keys).select(*keys, F.greatest("low_", "was_low").alias("low_"), F.least("high_", "was_high").alias("high_"), ((F.col("low_") > F.col("was_low")) | (F.col("high_") < F.col("was_high"))).alias("moved_"))
            new = kept(new, "clip")
            moved, new = not new.where("moved_").isEmpty(), new.drop("moved_")
        else:
            new, moved = kept(new, "clip"), True
        state = new
        if not moved:
            break
    return rows if state is None else rows.join(state, keys).where(F.col("value").between(F.col("low_"), F.col("high_"))).drop("low_", "high_")


def clipped(values: np.ndarray, sigma: float = 3.0, most: int = 10) -> np.ndarray:
    """The values left by clipping about the median until nothing changes or `most` rounds have passed."""
    values = values[np.isfinite(values)]
    for _ in range(most):
        if not len(values):
            break
        keep = np.abs(values - np.median(values)) <= sigma * values.std()
        if keep.all():
            break
        values = values[keep]
    return values


def sigma_clip_groups(rows: DataFrame, keys: list[str], sigma: float = 3.0, most: int = 10) -> DataFrame:
    """Clipped n, mean, median and std of groups that fit in a task, such as boxes or apertures, until convergence."""
    fields = [f for f in rows.schema if f.name in keys]
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in fields)

    def run(group: pd.DataFrame) -> pd.DataFrame:
        v = clipped(group.value.to_numpy(float), sigma, most)
        n = len(v)
        return group.iloc[:1][[f.name for f in fields]].assign(n=n, mean=v.mean() if n else None, median=np.median(v) if n else None, std=v.std() if n else None)

    return rows.groupBy(*keys).applyInPandas(run, f"{kinds}, n long, mean double, median double, std double")


def estimate(rows: DataFrame, keys: list[str], kinds: Iterable[str] = ("mean", "median", "mmm", "sextractor")) -> DataFrame:
    """Background estimates of groups. sextractor: the mean without spread, the median if mean and median are far apart, else 2.5 median - 1.5 mean."""
    found = good(rows).groupBy(*keys).agg(F.avg("value").alias("mean_"), F.median("value").alias("median_"), F.stddev_pop("value").alias("std_"), F.count("*").alias("n"))
    far = F.coalesce(fdiv(F.abs(F.col("mean_") - F.col("median_")), F.col("std_")) >= 0.3, F.lit(False))
    made: dict[str, Column] = {
        "mean": F.col("mean_"), "median": F.col("median_"), "std": F.col("std_"), "mmm": 3 * F.col("median_") - 2 * F.col("mean_"),
        "sextractor": F.when(F.col("std_") == 0, F.col("mean_")).when(far, F.col("median_")).otherwise(2.5 * F.col("median_") - 1.5 * F.col("mean_")),
    }
    return found.select(*keys, "n", *(made[k].alias(k) for k in kinds))
