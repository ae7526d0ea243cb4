"""Registered queries of the image operators, each with SQL that says the same on the tables.

Images are lineitem's prices on a grid, sources come from lists, and results are rounded, as sums of floating-point
numbers depend on their order.
"""

from __future__ import annotations


import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelloom.functions import boxes
from pixelloom.functions.models import Model
from pixelloom.functions.wcs import Tan
from pixelloom.operators import aperture, background, catalog, centroids, deblend, detection, ellipses, epsf, finders, isophotes as harmonic, masks, outlines, photometry, profiles, psf, segmentation, simulate, sky, stats
from pixelloom.sources import psf_grids
from pixelloom.sources.images import image, positions, stamps
from pixelloom.streaming import frames

STARS = [(1, 8.3, 9.7), (2, 16.0, 15.0), (3, 22.45, 7.2), (4, 30.6, 30.1), (5, 1.2, 20.9)]
VALUES = ", ".join(f"({i}::bigint, {x}::double, {y}::double)" for i, x, y in STARS)
FAR = "(select max(value) * 0.8 from img)"


def img_sql(width: int = 32, height: int = 32, by: str | None = None) -> str:
    name = by or "'all'"
    return f"""img as (
  select i.image_id, g.y, g.x, coalesce(v.value, 0) as value, sqrt(abs(coalesce(v.value, 0))) as error, (g.x * 7 + g.y * 13) % 29 = 0 as mask
  from (select distinct {name} as image_id from lineitem) i
  cross join (select a.y::int as y, b.x::int as x from (select unnest(range({height})) as y) a cross join (select unnest(range({width})) as x) b) g
  left join (select {name} as image_id, l_partkey % {height} as y, l_orderkey % {width} as x, sum(cast(round(l_extendedprice * 100) as bigint)) / 131072.0 as value from lineitem group by 1, 2, 3) v
    on v.image_id = i.image_id and v.y = g.y and v.x = g.x)"""


IMG = img_sql()
SRC = f"src as (select * from (values {VALUES}) t(id, x, y))"


def rounded(df: DataFrame, digits: int = 4) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def rounds(columns: str, digits: int = 4) -> str:
    return ", ".join(f"round({c}, {digits}) as {c}" for c in columns.split())


def stars(spark: SparkSession) -> DataFrame:
    return positions(spark, STARS)


Q: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def sums_sql(weight: str, suffix: str = "") -> str:
    return f"""with {IMG}, {SRC},
w as (select s.id, i.*, {weight} as w from src s join img i on abs(i.x - s.x) < 12 and abs(i.y - s.y) < 12)
select 'all' as image_id, id, {rounds('flux flux_err area')} from (
  select id, sum(w * value) as flux, sqrt(sum(w * error * w * error)) as flux_err, sum(w) as area from w where w > 0 and not mask group by id)"""


def photo(spark, sf_dir, shape, **options) -> DataFrame:
    return rounded(aperture.photometry(image(spark, sf_dir), stars(spark), shape, **options).select("image_id", "id", "flux", "flux_err", "area"))


@query(sums_sql("case when (i.x - s.x) * (i.x - s.x) + (i.y - s.y) * (i.y - s.y) < 16.0 then 1.0 else 0.0 end"))
def aperture_circle_center(spark, sf_dir):
    return photo(spark, sf_dir, aperture.circle(4), method="center")


SUB = "(select unnest([-0.4, -0.2, 0.0, 0.2, 0.4]) as v)"


@query(sums_sql(f"(select count(*) from {SUB} a, {SUB} b where (i.x - s.x + a.v) * (i.x - s.x + a.v) + (i.y - s.y + b.v) * (i.y - s.y + b.v) < 12.25) / 25.0"))
def aperture_circle_subpixel(spark, sf_dir):
    return photo(spark, sf_dir, aperture.circle(3.5), method="subpixel")


def quarter_sql(x: str, y: str, r: str) -> str:
    u, v = f"least(abs({x}), {r})", f"least(abs({y}), {r})"
    edge = f"sqrt(greatest({r} * {r} - {v} * {v}, 0.0))"
    prim = lambda t: f"(({t}) * sqrt(greatest({r} * {r} - ({t}) * ({t}), 0.0)) + {r} * {r} * asin(least(({t}) / {r}, 1.0))) / 2"
    return f"(sign({x}) * sign({y}) * (case when {u} <= {edge} then {u} * {v} else {v} * {edge} + {prim(u)} - {prim(edge)} end))"


def disc_sql(dx: str, dy: str, r: str) -> str:
    p = lambda a, b: quarter_sql(f"(({dx}) {a} 0.5)", f"(({dy}) {b} 0.5)", r)
    return f"({p('+', '+')} - {p('-', '+')} - {p('+', '-')} + {p('-', '-')})"


EXACT = disc_sql("i.x - s.x", "i.y - s.y", "4.0::double")


@query(sums_sql(f"case when {EXACT} > 0 then {EXACT} else 0 end"))
def aperture_circle_exact(spark, sf_dir):
    return photo(spark, sf_dir, aperture.circle(4), method="exact")


@query(sums_sql("case when (i.x - s.x) ** 2 + (i.y - s.y) ** 2 < 49.0 then 1.0 else 0.0 end - case when (i.x - s.x) ** 2 + (i.y - s.y) ** 2 < 20.25 then 1.0 else 0.0 end"))
def aperture_ring_center(spark, sf_dir):
    return photo(spark, sf_dir, aperture.circle(7), hole=aperture.circle(4.5), method="center")


TURN = 0.5
U, V = f"((i.x - s.x) * cos({TURN}) + (i.y - s.y) * sin({TURN}))", f"((i.y - s.y) * cos({TURN}) - (i.x - s.x) * sin({TURN}))"


@query(sums_sql(f"case when ({U} / 6.0) ** 2 + ({V} / 3.0) ** 2 < 1 then 1.0 else 0.0 end"))
def aperture_ellipse_center(spark, sf_dir):
    return photo(spark, sf_dir, aperture.ellipse(6, 3, TURN), method="center")


@query(sums_sql(f"case when abs({U}) < 4.15 and abs({V}) < 2.35 then 1.0 else 0.0 end"))
def aperture_rectangle_center(spark, sf_dir):
    return photo(spark, sf_dir, aperture.rectangle(8.3, 4.7, TURN), method="center")


@query()
def aperture_ellipse_exact(spark, sf_dir):
    return photo(spark, sf_dir, aperture.ellipse(5, 3, 0.7), method="exact")


@query()
def aperture_polygon_exact(spark, sf_dir):
    return photo(spark, sf_dir, aperture.regular_polygon(5, 4.0, 0.2), method="exact")


@query(f"""with {img_sql(by='l_returnflag')}, {SRC}, feet as (select s.id, i.image_id, i.value, i.mask from src s join img i on (i.x - s.x) ** 2 + (i.y - s.y) ** 2 < 9.0)
select image_id, id, round(sum(value) filter (not mask), 4) as flux, count(*) filter (not mask)::double as area,
  (case when count(*) < (select count(*) from (select unnest(range(-10, 50)) as y) a, (select unnest(range(-10, 50)) as x) b, src q where q.id = feet.id and (b.x - q.x) ** 2 + (a.y - q.y) ** 2 < 9.0) then 2 else 0 end + case when bool_or(mask) then 8 else 0 end + case when bool_and(mask) then 16 else 0 end)::int as flags
from feet group by image_id, id""")
def aperture_flags_by_image(spark, sf_dir):
    found = aperture.photometry(image(spark, sf_dir, by="l_returnflag"), stars(spark), aperture.circle(3), method="center")
    return rounded(found.select("image_id", "id", "flux", "area", "flags"))


CELLS = f"""{IMG}, {SRC}, cells as (select s.id, i.x, i.y, i.value from src s join img i on (i.x - s.x) ** 2 + (i.y - s.y) ** 2 < 25.0)"""


def cells(spark, sf_dir) -> DataFrame:
    return aperture.covered(image(spark, sf_dir), aperture.footprint(stars(spark), aperture.circle(5), method="center")).select("id", "x", "y", "value")


@query(f"""with {CELLS} select id, n, {rounds('min max mean median mode std var mean_err median_err')} from (
select id, count(*) as n, min(value) as min, max(value) as max, avg(value) as mean, median(value) as median, 3 * median(value) - 2 * avg(value) as mode, stddev_pop(value) as std, var_pop(value) as var,
  case when count(*) > 1 then sqrt(var_pop(value) / (count(*) - 1)) end as mean_err, case when count(*) > 1 then sqrt(var_pop(value) / (count(*) - 1)) * sqrt(pi() / 2) end as median_err from cells group by id)""")
def aperture_statistics(spark, sf_dir):
    return rounded(stats.basic(cells(spark, sf_dir), ["id"]))


MADS = f"{CELLS}, m as (select id, median(value) as mid from cells group by id), d as (select c.*, m.mid from cells c join m using (id)), a as (select d.*, q.mad from d join (select id, median(abs(value - mid)) as mad from d group by id) q using (id))"


@query(f"with {MADS} select id, round(max(mad) * {stats.MAD}, 4) as mad_std from a group by id")
def aperture_mad_std(spark, sf_dir):
    return rounded(stats.mad_std(cells(spark, sf_dir), ["id"]))


@query(f"""with {MADS}, u as (select *, (value - mid) as d, (value - mid) / (6 * mad) as u, (value - mid) / (9 * mad) as v from a)
select id, round(max(mid) + sum(case when abs(u) < 1 then d * (1 - u * u) ** 2 else 0 end) / sum(case when abs(u) < 1 then (1 - u * u) ** 2 else 0 end), 4) as biweight_location,
  round(count(*) * sum(case when abs(v) < 1 then d * d * (1 - v * v) ** 4 else 0 end) / sum(case when abs(v) < 1 then (1 - v * v) * (1 - 5 * v * v) else 0 end) ** 2, 4) as biweight_midvariance
from u group by id""")
def aperture_biweight(spark, sf_dir):
    return rounded(stats.biweight(cells(spark, sf_dir), ["id"]))


@query(f"""with {CELLS}, r as (select id, abs(value) as v, row_number() over (partition by id order by abs(value)) as i, count(*) over (partition by id) as n from cells)
select id, round(sum((2 * i - n - 1) * v) / (avg(v) * max(n) * (max(n) - 1)), 6) as gini from r group by id""")
def aperture_gini(spark, sf_dir):
    return rounded(stats.gini(cells(spark, sf_dir), ["id"]), 6)


@query(f"with {CELLS} select id, " + ", ".join(f"round(sum(y ** {i} * value * x ** {j}), 2) as m{i}{j}" for i in range(3) for j in range(3)) + " from cells group by id")
def aperture_moments(spark, sf_dir):
    return rounded(stats.moments(cells(spark, sf_dir), ["id"], 2), 2)


def shape_sql(source: str, keys: str) -> str:
    return f"""c as (select {keys}, sum(x * value) / sum(value) as x_centroid, sum(y * value) / sum(value) as y_centroid from {source} group by {keys}),
m as (select {keys}, any_value(x_centroid) as x_centroid, any_value(y_centroid) as y_centroid, sum(value * (x - x_centroid) ** 2) / sum(value) as xx0, sum(value * (y - y_centroid) ** 2) / sum(value) as yy0, sum(value * (x - x_centroid) * (y - y_centroid)) / sum(value) as xy
  from {source} join c using ({keys}) group by {keys}),
f as (select *, case when xx0 * yy0 - xy * xy < 1.0 / 144 then 1.0 / 12 else 0 end as add_ from m),
k as (select *, xx0 + add_ as xx, yy0 + add_ as yy from f where xx0 * yy0 - xy * xy >= 0 and xx0 + yy0 >= 0),
l as (select *, (xx + yy) / 2 + sqrt(((xx - yy) / 2) ** 2 + xy * xy) as l1, (xx + yy) / 2 - sqrt(((xx - yy) / 2) ** 2 + xy * xy) as l2 from k),
shapes as (select {keys}, x_centroid, y_centroid, sqrt(l1) as semimajor_axis, sqrt(l2) as semiminor_axis, 2 * sqrt(ln(2.0::double) * (l1 + l2)) as fwhm, degrees(atan2(2 * xy, xx - yy) / 2) as orientation,
  sqrt(1 - l2 / l1) as eccentricity, sqrt(l1) / sqrt(l2) as elongation, 1 - sqrt(l2) / sqrt(l1) as ellipticity, xx as covariance_xx, yy as covariance_yy, xy as covariance_xy,
  yy / (xx * yy - xy * xy) as ellipse_cxx, xx / (xx * yy - xy * xy) as ellipse_cyy, -2 * xy / (xx * yy - xy * xy) as ellipse_cxy from l)"""


SHAPE = "x_centroid y_centroid semimajor_axis semiminor_axis fwhm orientation eccentricity elongation ellipticity covariance_xx covariance_yy covariance_xy ellipse_cxx ellipse_cyy ellipse_cxy"


@query(f"with {CELLS}, {shape_sql('cells', 'id')} select id, {rounds(SHAPE, 5)} from shapes")
def aperture_shape(spark, sf_dir):
    return rounded(stats.shape(cells(spark, sf_dir), ["id"]), 5)


CLIP = ", ".join(f"k{n + 1} as (select c.* from k{n} c join (select id, median(value) as m, stddev_pop(value) as s from k{n} group by id) b using (id) where abs(value - m) <= 2 * s)" for n in range(3))


@query(f"with {CELLS}, k0 as (select * from cells), {CLIP} select id, count(*) as n, round(avg(value), 4) as mean, round(median(value), 4) as median from k3 group by id")
def sigma_clip_rounds(spark, sf_dir):
    rest = stats.sigma_clip(cells(spark, sf_dir), ["id"], sigma=2.0, rounds=3)
    return rounded(rest.groupBy("id").agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.median("value").alias("median")))


@query()
def sigma_clip_converged(spark, sf_dir):
    return rounded(stats.sigma_clip_groups(cells(spark, sf_dir), ["id"], 2.0))


ROUNDS = ", ".join(f"b{n + 1} as materialized (select c.* from b{n} c join (select box_y, box_x, median(value) as m, stddev_pop(value) as s from b{n} group by 1, 2) b using (box_y, box_x) where abs(value - m) <= 3 * s)" for n in range(10))
BOXES = f"""{img_sql(64, 64)}, b0 as (select image_id, y // 8 as box_y, x // 8 as box_x, value from img where not mask), {ROUNDS},
mesh as (select image_id, box_y::int as box_y, box_x::int as box_x, case when stddev_pop(value) = 0 then avg(value) when abs(avg(value) - median(value)) / stddev_pop(value) >= 0.3 then median(value) else 2.5 * median(value) - 1.5 * avg(value) end as background, stddev_pop(value) as rms, count(*) as n
  from b10 group by 1, 2, 3)"""
MESH = "(select image_id, box_y, box_x, case when n >= 57.6 then background end as background, case when n >= 57.6 then rms end as rms, n from mesh)"


@query(f"with {BOXES} select image_id, box_y, box_x, round(background, 4) as background, round(rms, 4) as rms, n from {MESH}")
def background_mesh(spark, sf_dir):
    return rounded(background.mesh(image(spark, sf_dir, 64, 64), 8))


@query(f"with {BOXES}, k as (select * from {MESH}) select a.image_id, a.box_y, a.box_x, round(median(b.background), 4) as background from k a join k b on abs(a.box_y - b.box_y) <= 1 and abs(a.box_x - b.box_x) <= 1 group by 1, 2, 3")
def background_mesh_filtered(spark, sf_dir):
    return rounded(background.median_filter(background.mesh(image(spark, sf_dir, 64, 64), 8)))


@query(f"""with {BOXES}, k as (select image_id, box_y, box_x, case when (box_y * 3 + box_x) % 7 <> 0 then background end as background from {MESH}), p as (
  select a.box_y, a.box_x, b.background as v, sqrt((a.box_y - b.box_y) ** 2 + (a.box_x - b.box_x) ** 2) as d, row_number() over (partition by a.box_y, a.box_x order by sqrt((a.box_y - b.box_y) ** 2 + (a.box_x - b.box_x) ** 2), b.box_y, b.box_x) as r
  from k a join k b on a.background is null and b.background is not null)
select 'all' as image_id, box_y, box_x, round(sum(v / d) / sum(1 / d), 4) as background from p where r <= 10 group by 2, 3
union all select image_id, box_y, box_x, round(background, 4) from k where background is not null""")
def background_fill_holes(spark, sf_dir):
    mesh = background.mesh(image(spark, sf_dir, 64, 64), 8)
    return rounded(background.fill_holes(mesh.withColumn("background", F.when((F.col("box_y") * 3 + F.col("box_x")) % 7 != 0, F.col("background")))))


def map_sql(column: str, name: str) -> str:
    """Holes of the mesh filled from their nearest boxes, then bilinear between boxes' centres."""
    return f"""with {BOXES}, k as (select image_id, box_y, box_x, {column} as v from {MESH}), p as (
  select a.box_y, a.box_x, b.v, sqrt((a.box_y - b.box_y) ** 2 + (a.box_x - b.box_x) ** 2) as d, row_number() over (partition by a.box_y, a.box_x order by sqrt((a.box_y - b.box_y) ** 2 + (a.box_x - b.box_x) ** 2), b.box_y, b.box_x) as r from k a join k b on a.v is null and b.v is not null),
full_ as (select box_y, box_x, sum(v / d) / sum(1 / d) as v from p where r <= 10 group by 1, 2 union all select box_y, box_x, v from k where v is not null),
spot as (select image_id, y, x, value, least(greatest((y + 0.5) / 8 - 0.5, 0), 7) as q, least(greatest((x + 0.5) / 8 - 0.5, 0), 7) as u from img),
w as (select spot.*, f.v * (1 - abs(f.box_y - q)) * (1 - abs(f.box_x - u)) as part from spot join full_ f on abs(f.box_y - q) < 1 and abs(f.box_x - u) < 1)
select image_id, y, x, {'round(any_value(value), 4) as value, ' if name == 'background' else ''}round(sum(part), 4) as {name} from w group by 1, 2, 3"""


@query(map_sql("background", "background"))
def background_to_pixels(spark, sf_dir):
    pixels = image(spark, sf_dir, 64, 64)
    return rounded(background.to_pixels(pixels, background.fill_holes(background.mesh(pixels, 8)), 8))


@query()
def background_spline(spark, sf_dir):
    pixels = image(spark, sf_dir, 64, 64)
    return rounded(background.to_pixels_spline(pixels, background.fill_holes(background.mesh(pixels, 8)), 8))


@query(f"""with {IMG}, {SRC} select 'all' as image_id, s.id, round(median(i.value), 4) as background from src s join img i on (i.x - s.x) ** 2 + (i.y - s.y) ** 2 < 64 and (i.x - s.x) ** 2 + (i.y - s.y) ** 2 >= 25 where not mask group by 2""")
def background_local(spark, sf_dir):
    return rounded(background.local(image(spark, sf_dir), stars(spark), aperture.circle(5), aperture.circle(8)))


@query(f"""with {IMG}, p as (select x, y, value as v from img where (x * 5 + y * 3) % 41 = 0), d as (select s.id, p.v, sqrt((s.x - p.x) ** 2 + (s.y - p.y) ** 2) as d, row_number() over (partition by s.id order by sqrt((s.x - p.x) ** 2 + (s.y - p.y) ** 2), p.x, p.y) as r from src s, p), {SRC}
select id, round(sum(v / d) / sum(1 / d), 4) as value from d where r <= 8 group by id""".replace(f", d as", f", {SRC}, d as").replace(f"), {SRC}\nselect", ")\nselect"))
def interpolate_idw(spark, sf_dir):
    points = image(spark, sf_dir).where((F.col("x") * 5 + F.col("y") * 3) % 41 == 0)
    return rounded(background.interpolate_idw(points, stars(spark), 8))


PEAKS = "p as (select a.image_id, a.y, a.x, any_value(a.value) as peak from img a join img b on a.image_id = b.image_id and abs(a.y - b.y) <= {h} and abs(a.x - b.x) <= {h} group by 1, 2, 3 having any_value(a.value) = max(b.value) and any_value(a.value) > (select avg(value) from img))"


@query(f"with {img_sql(64, 64)}, {PEAKS.format(h=1)} select image_id, y, x, round(peak, 4) as peak from p")
def find_peaks_box(spark, sf_dir):
    pixels = image(spark, sf_dir, 64, 64)
    mean = pixels.agg(F.avg("value")).first()[0]
    return rounded(detection.find_peaks(pixels, mean))


@query(f"with {img_sql(64, 64)}, {PEAKS.format(h=2)} select image_id, y, x, round(peak, 4) as peak from p where y >= 4 and x >= 4 and y <= 59 and x <= 59 order by peak desc, y, x limit 10")
def find_peaks_brightest(spark, sf_dir):
    pixels = image(spark, sf_dir, 64, 64)
    mean = pixels.agg(F.avg("value")).first()[0]
    return rounded(detection.find_peaks(pixels, mean, 5, 4, 10))


@query(f"with {img_sql(64, 64)} select a.image_id, a.y, a.x, round(any_value(a.value), 4) as peak from img a join img b on (a.y - b.y) ** 2 + (a.x - b.x) ** 2 <= 12.25 group by 1, 2, 3 having any_value(a.value) = max(b.value) and any_value(a.value) > (select avg(value) from img)")
def find_peaks_round(spark, sf_dir):
    pixels = image(spark, sf_dir, 64, 64)
    mean = pixels.agg(F.avg("value")).first()[0]
    return rounded(detection.round_peaks(pixels, mean, 3.5))


KERNEL = np.array([[1.0, 2.0, 1.0], [2.0, 4.0, 2.0], [1.0, 2.0, 1.0]]) / 16


@query(f"with {IMG} select a.image_id, a.y, a.x, round(sum(b.value * (case when a.y = b.y then 2 else 1 end) * (case when a.x = b.x then 2 else 1 end) / 16.0), 4) as convolved from img a join img b on abs(a.y - b.y) <= 1 and abs(a.x - b.x) <= 1 group by 1, 2, 3")
def convolve(spark, sf_dir):
    return rounded(detection.convolve(image(spark, sf_dir), KERNEL).select("image_id", "y", "x", "convolved"))


def dao_sql(threshold: float, fwhm: float) -> str:
    """The star finder's sums over each peak's cut-out, with the kernel's and the marginal fits' weights as a table."""
    k = detection.star_kernel(fwhm)
    hy, hx = (n // 2 for n in k["kernel"].shape)
    sides = {"x": detection.marginal(k["gauss"], k["sigma"], True), "y": detection.marginal(k["gauss"], k["sigma"], False)}
    names = [f"{n}_{c}" for n in "xy" for c in ("d", "dk", "ds", "dx")]
    rows = ", ".join("(" + ", ".join([str(j - hy), str(i - hx), *(f"{float(v)!r}::double" for v in (k["kernel"][j, i], k["mask"][j, i], *(sides[n][0][c][j, i] for n in "xy" for c in ("d", "dk", "ds", "dx"))))]) + ")" for j in range(2 * hy + 1) for i in range(2 * hx + 1))
    limit, reach = threshold * k["rel_err"], max(hx, int(2.5 * fwhm))

    def fits(n: str) -> str:
        o = sides[n][1]
        high = f"(case when {n}_dk - {n}_d * {float(o['k'] / o['w'])!r} > 0 then ({n}_dk - {n}_d * {float(o['k'] / o['w'])!r}) / {float(o['kk'] - o['k'] ** 2 / o['w'])!r} end)"
        raw = f"(({float(o['ks'])!r} - ({n}_ds - {float(o['s'])!r} * {n}_d)) / ({high} * {float(o['ss'] / o['sigma'] ** 2)!r}))"
        mean = f"coalesce({n}_dx / nullif({n}_d, 0), 0)"
        return f"{high} as high_{n}, case when {high} is null then null when abs({raw}) > {o['size'] / 2} then case when abs({mean}) > {o['size'] / 2} then 0 else {mean} end else {raw} end as shift_{n}"

    return f"""with {img_sql(64, 64)}, ker as (select * from (values {rows}) t(j, i, k, m, {', '.join(names)})),
conv as (select a.image_id, a.y, a.x, any_value(a.value) as value, sum(b.value * k) as c from img a join ker on true join img b on b.y = a.y + j and b.x = a.x + i group by 1, 2, 3),
peaks as (select a.image_id, a.y, a.x, any_value(a.value) as value, any_value(a.c) as peak from conv a join conv b on abs(a.y - b.y) <= {reach} and abs(a.x - b.x) <= {reach} group by 1, 2, 3 having any_value(a.c) = max(b.c) and any_value(a.c) > {float(limit)!r}),
sums as (select p.image_id, row_number() over (order by p.y, p.x) as id, p.y, p.x, any_value(p.value) as value, any_value(p.peak) as peak, sum(c.value) filter (m > 0 and not (i = 0 and j = 0)) as rest, sum(abs(c.c)) as whole, sum(c.value) as flux,
  sum(c.c * case when i = 0 and j = 0 then 0 when i > 0 and j >= 0 then -1 when i <= 0 and j > 0 then 1 when i < 0 and j <= 0 then -1 else 1 end) as turned, {', '.join(f'sum(c.value * {n}) as {n}' for n in names)}
  from peaks p join ker on true join conv c on c.y = p.y + j and c.x = p.x + i group by p.image_id, p.y, p.x),
fit as (select *, {fits('x')}, {fits('y')} from sums),
out_ as (select image_id, id, x + shift_x as x_centroid, y + shift_y as y_centroid, (value - rest / {k['n'] - 1}) / peak as sharpness, 2 * turned / whole as roundness1, 2 * (high_x - high_y) / (high_x + high_y) as roundness2, value as peak, flux, -2.5 * log10(peak / {float(limit)!r}) as daofind_mag, {k['n']} as n_pixels from fit)
select image_id, id, {rounds('x_centroid y_centroid sharpness roundness1 roundness2 peak flux daofind_mag')}, n_pixels from out_ where sharpness between 0.2 and 1.0 and roundness1 between -1.0 and 1.0 and roundness2 between -1.0 and 1.0"""


@query(dao_sql(0.1, 2.5))
def dao_star_finder(spark, sf_dir):
    return rounded(detection.dao_find(image(spark, sf_dir, 64, 64), 0.1, 2.5))


def star_sql(threshold: float, kernel: np.ndarray) -> str:
    """Peaks of the convolution with the kernel less its mean, and moments of the light above 0 in each cut-out."""
    kernel = kernel / kernel.sum()
    zero = kernel - kernel.mean()
    zero = zero / (zero * zero).sum()
    h = kernel.shape[0] // 2
    rows = ", ".join(f"({j - h}, {i - h}, {float(zero[j, i])!r}::double)" for j in range(2 * h + 1) for i in range(2 * h + 1))
    return f"""with {img_sql(64, 64)}, ker as (select * from (values {rows}) t(j, i, k)),
conv as (select a.image_id, a.y, a.x, sum(b.value * k) as c from img a join ker on true join img b on b.y = a.y + j and b.x = a.x + i group by 1, 2, 3),
peaks as (select a.image_id, a.y, a.x from conv a join conv b on abs(a.y - b.y) <= {h} and abs(a.x - b.x) <= {h} group by 1, 2, 3 having any_value(a.c) = max(b.c) and any_value(a.c) > {threshold}),
m as (select p.image_id, row_number() over (order by p.y, p.x) as id, sum(v.value) as flux, max(v.value) as max_value, sum(greatest(v.value, 0)) as m, sum(greatest(v.value, 0) * v.x) as mx, sum(greatest(v.value, 0) * v.y) as my, sum(greatest(v.value, 0) * v.x * v.x) as mxx, sum(greatest(v.value, 0) * v.y * v.y) as myy, sum(greatest(v.value, 0) * v.x * v.y) as mxy
  from peaks p join ker on true join img v on v.y = p.y + j and v.x = p.x + i group by p.image_id, p.y, p.x),
c as (select *, mx / m as cx, my / m as cy, mxx / m - (mx / m) ** 2 as vx, myy / m - (my / m) ** 2 as vy, mxy / m - mx * my / (m * m) as vxy from m)
select image_id, id, round(cx, 4) as x_centroid, round(cy, 4) as y_centroid, round(2 * sqrt(ln(2.0::double) * (vx + vy)), 4) as fwhm, round(sqrt((vx - vy) ** 2 + 4 * vxy * vxy) / (vx + vy), 4) as roundness, round(degrees(atan2(2 * vxy, vx - vy) / 2), 4) as orientation, round(max_value, 4) as max_value, round(flux, 4) as flux, round(case when flux > 0 then -2.5 * log10(flux) end, 4) as mag from c"""


@query(star_sql(0.1, detection.gaussian_kernel(2.5, 5)))
def star_finder(spark, sf_dir):
    return rounded(detection.star_find(image(spark, sf_dir, 64, 64), 0.1, detection.gaussian_kernel(2.5, 5)))


@query()
def iraf_star_finder(spark, sf_dir):
    return rounded(finders.iraf_find(image(spark, sf_dir, 64, 64), 0.1, 2.5, rounds=(0.0, 0.8)))


@query("select a.p_partkey as a, b.p_partkey as b, round(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2), 6) as d from (select p_partkey, p_retailprice % 100 as x, p_partkey % 97 as y from part) a join (select p_partkey, p_retailprice % 100 as x, p_partkey % 97 as y from part) b on a.p_partkey < b.p_partkey and (a.x - b.x) ** 2 + (a.y - b.y) ** 2 <= 9")
def close_pairs(spark, sf_dir):
    points = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("id"), (F.col("p_retailprice") % 100).alias("x"), (F.col("p_partkey") % 97).cast("double").alias("y"))
    return rounded(detection.close_pairs(points, 3.0), 6)


@query(f"""with {IMG}, {SRC} select 'all' as image_id, s.id, round(sum(i.x * i.value) / sum(i.value), 5) as x_centroid, round(sum(i.y * i.value) / sum(i.value), 5) as y_centroid
from src s join img i on abs(i.x - floor(s.x + 0.5)) <= 5 and abs(i.y - floor(s.y + 0.5)) <= 5 where not mask group by 2""")
def centroid_com(spark, sf_dir):
    return rounded(centroids.centre_of_mass(image(spark, sf_dir), stars(spark).withColumn("image_id", F.lit("all"))), 5)


@query()
def centroid_windowed(spark, sf_dir):
    return rounded(centroids.windowed(image(spark, sf_dir), stars(spark).withColumn("image_id", F.lit("all")), 1.5), 5)


@query()
def centroid_gaussian(spark, sf_dir):
    scene = psf.render(image(spark, sf_dir), stars(spark).withColumn("flux", 1000.0 * F.col("id")), 1.5, 8).withColumn("value", F.col("model")).withColumn("mask", F.lit(False))
    return rounded(centroids.gaussian_fit(scene, stars(spark).withColumn("image_id", F.lit("all"))), 4)


@query()
def centroid_quadratic(spark, sf_dir):
    pixels = image(spark, sf_dir).withColumn("mask", F.lit(False))
    return rounded(centroids.quadratic(pixels, stars(spark).withColumn("image_id", F.lit("all"))), 5)


SMALL = f"{img_sql(16, 16)}, hot as (select image_id, y, x from img where value > (select quantile_cont(value, 0.8) from img))"
LABELS = f"""recursive {SMALL}, walk as (select y, x, y * 16 + x as root from hot union select h.y, h.x, w.root from walk w join hot h on abs(w.y - h.y) <= 1 and abs(w.x - h.x) <= 1),
roots as (select y, x, min(root) as root from walk group by 1, 2), big as (select root, dense_rank() over (order by root) as label from (select root from roots group by root having count(*) >= 2)),
segments as (select 'all' as image_id, y, x, label::int as label from roots join big using (root))"""


def labelled(spark, sf_dir, n_pixels: int = 2) -> DataFrame:
    pixels = image(spark, sf_dir, 16, 16)
    cut = pixels.agg(F.percentile("value", 0.8)).first()[0]
    return segmentation.label(pixels, F.col("value") > cut, n_pixels)


@query(f"with {LABELS} select image_id, y, x, label from segments")
def detect_sources(spark, sf_dir):
    return labelled(spark, sf_dir)


MOD = f"{img_sql(64, 64)}, segments as (select image_id, y, x, (1 + (y // 16) * 4 + x // 16)::int * 2 as label from img where value > (select avg(value) from img))"


def tiled(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """An image, and labels by tiles of its brighter pixels."""
    pixels = image(spark, sf_dir, 64, 64)
    mean = pixels.agg(F.avg("value")).first()[0]
    return pixels, pixels.where(F.col("value") > mean).select("image_id", "y", "x", (2 * (1 + F.floor(F.col("y") / 16) * 4 + F.floor(F.col("x") / 16))).cast("int").alias("label"))


@query(f"with {MOD} select image_id, label, count(*) as area from segments group by 1, 2")
def label_areas(spark, sf_dir):
    return segmentation.areas(tiled(spark, sf_dir)[1])


@query(f"with {MOD} select image_id, label, min(x) as x_min, max(x) as x_max, min(y) as y_min, max(y) as y_max from segments group by 1, 2")
def label_boxes(spark, sf_dir):
    return segmentation.boxes(tiled(spark, sf_dir)[1])


@query(f"with {MOD} select image_id, y, x, (dense_rank() over (order by label) + 9)::int as label from segments")
def label_relabel(spark, sf_dir):
    return segmentation.relabel(tiled(spark, sf_dir)[1], 10)


@query(f"with {MOD} select image_id, y, x, label from segments where label in (select n_nationkey from nation)")
def label_keep(spark, sf_dir):
    return segmentation.keep_labels(tiled(spark, sf_dir)[1], spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.col("n_nationkey").alias("label")))


@query(f"with {MOD} select image_id, y, x, label from segments where label not in (select n_nationkey from nation)")
def label_remove(spark, sf_dir):
    return segmentation.remove_labels(tiled(spark, sf_dir)[1], spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.col("n_nationkey").alias("label")))


@query(f"with {MOD} select image_id, y, x, case when label = 4 then 2 else label end as label from segments where label <> 6")
def label_reassign(spark, sf_dir):
    return segmentation.reassign(tiled(spark, sf_dir)[1], {4: 2, 6: 0})


@query(f"with {MOD} select image_id, y, x, label from segments where label not in (select label from segments where y < 2 or x < 2 or y >= 62 or x >= 62)")
def label_remove_border(spark, sf_dir):
    return segmentation.remove_border_labels(tiled(spark, sf_dir)[1], 64, 64, 2)


@query(f"with {MOD} select image_id, y, x, label from segments where label not in (select label from segments join img using (image_id, y, x) where mask and value > (select quantile_cont(value, 0.98) from img))")
def label_remove_masked(spark, sf_dir):
    pixels, segments = tiled(spark, sf_dir)
    high = pixels.agg(F.percentile("value", 0.98)).first()[0]
    return segmentation.remove_masked_labels(segments, pixels.where(F.col("mask") & (F.col("value") > high)))


@query(f"with {MOD} select 'all' as image_id, unnest(range(1, (select max(label) + 1 from segments)))::int as label except select image_id, label from segments")
def label_missing(spark, sf_dir):
    return segmentation.missing_labels(tiled(spark, sf_dir)[1])


@query(f"with {MOD} select distinct image_id, y + a.i as y, x + b.j as x from segments, (select unnest([-1, 0, 1])::int as i) a, (select unnest([-1, 0, 1])::int as j) b where label = 6")
def label_source_mask(spark, sf_dir):
    return segmentation.source_mask(tiled(spark, sf_dir)[1].where("label = 6"), 1)


@query(f"with {MOD} select image_id, label, count(distinct (y // 8) * 8 + x // 8) as n, min((y // 8) * 8 + x // 8)::int as first from segments group by 1, 2")
def label_mapping(spark, sf_dir):
    segments = tiled(spark, sf_dir)[1]
    finer = segments.withColumn("label", (F.floor(F.col("y") / 8) * 8 + F.floor(F.col("x") / 8)).cast("int"))
    return segmentation.label_mapping(segments, finer).select("image_id", "label", F.size("children").cast("long").alias("n"), F.element_at("children", 1).alias("first"))


@query(f"""with {MOD}, e as (select s.*, (select count(*) from segments t where t.label = s.label and abs(t.y - s.y) + abs(t.x - s.x) = 1) as n from segments s), b as (select * from e where n < 4),
c as (select b.label, b.y, b.x, sum(case when abs(t.y - b.y) + abs(t.x - b.x) = 0 then 1 when abs(t.y - b.y) + abs(t.x - b.x) = 1 then 2 else 10 end) as code from b join b t on t.label = b.label and abs(t.y - b.y) <= 1 and abs(t.x - b.x) <= 1 group by 1, 2, 3)
select 'all' as image_id, label, round(sum(case when code in (5, 7, 15, 17, 25, 27) then 1.0 when code in (21, 33) then sqrt(2.0::double) when code in (13, 23) then (1 + sqrt(2.0::double)) / 2 else 0 end), 5) as perimeter from c group by label""")
def label_perimeter(spark, sf_dir):
    return rounded(segmentation.perimeter(tiled(spark, sf_dir)[1]), 5)


def outline_sql(diagonal: int) -> str:
    """Areas, outline lengths, corners and rings less twice the holes from the numbers of a label's pixels around each corner. diagonal: -2 where pixels that touch by a corner are joined, 2 where not."""
    return f"""with {MOD}, q as (select image_id, label, y + o.j as vy, x + o.i as vx, count(*) as n, sum(o.bit) as bits from segments, (values (0, 0, 1), (0, 1, 2), (1, 0, 4), (1, 1, 8)) o(j, i, bit) group by 1, 2, 3, 4),
c as (select image_id, label, n, n = 2 and bits in (6, 9) as diagonal from q)
select image_id, label, sum(n)::double / 4 as area, sum(case when diagonal then 2 when n < 4 then 1 else 0 end)::double as length, sum(case when diagonal then 2 when n in (1, 3) then 1 else 0 end)::bigint as n_corners,
  ((count(*) filter (n = 1) - count(*) filter (n = 3) + ({diagonal}) * count(*) filter (diagonal)) // 4)::bigint as n_outer_less_holes from c group by 1, 2"""


@query(outline_sql(-2))
def label_polygons(spark, sf_dir):
    found = outlines.outlines(outlines.polygons(tiled(spark, sf_dir)[1]))
    return found.select("image_id", "label", "area", "length", "n_corners", (F.col("n_rings") - 2 * F.col("n_holes")).alias("n_outer_less_holes"))


@query(outline_sql(2))
def label_polygons_by_edges(spark, sf_dir):
    found = outlines.outlines(outlines.polygons(tiled(spark, sf_dir)[1], 4))
    return found.select("image_id", "label", "area", "length", "n_corners", (F.col("n_rings") - 2 * F.col("n_holes")).alias("n_outer_less_holes"))


def part_stars(spark, sf_dir) -> DataFrame:
    """A star for each part, on the image of a supplier."""
    rows = spark.read.parquet(f"{sf_dir}/part.parquet")
    owner = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_suppkey").alias("image_id"))
    n = owner.count()
    named = rows.select((F.col("p_partkey") % n + 1).alias("image_id"), F.col("p_partkey").alias("id"), (4 + F.col("p_retailprice") * 7 % 24).alias("x"), (4 + F.col("p_partkey") * 5.3 % 23).alias("y"))
    return named.join(owner, "image_id")


PART_STARS = """ps as (select p_partkey % (select count(*) from supplier) + 1 as image_id, p_partkey as id, 4 + p_retailprice * 7 % 24 as x, 4 + p_partkey * 5.3::double % 23 as y from part)"""


@query(f"""with {img_sql(32, 32, 'l_suppkey')}, {PART_STARS},
c as (select s.image_id, s.id, s.x as sx, s.y as sy, i.x, i.y, i.value from ps s join img i on i.image_id = s.image_id and abs(i.x - floor(s.x + 0.5)) <= 3 and abs(i.y - floor(s.y + 0.5)) <= 3),
f as (select image_id, id, sum(value) as flux from c group by 1, 2)
select (floor((y - sy) * 2 + 0.5) + 7)::int as j, (floor((x - sx) * 2 + 0.5) + 7)::int as i, count(*) as n, round(sum(value / flux), 4) as total, round(sum(value * value / flux / flux), 4) as squares from c join f using (image_id, id) where flux > 0 group by 1, 2""")
def epsf_cells(spark, sf_dir):
    found = epsf.cut_outs(image(spark, sf_dir, 32, 32, "l_suppkey").drop("mask"), part_stars(spark, sf_dir), 3)
    side = epsf.shape_of(3, 2)
    return rounded(epsf.cell_sums(found, np.zeros((side, side)), 2))


@query()
def epsf_build(spark, sf_dir):
    grid, _ = epsf.build(image(spark, sf_dir, 32, 32, "l_suppkey").drop("mask"), part_stars(spark, sf_dir), 3, over=2, rounds=2)
    return rounded(epsf.as_table(spark, grid, 2), 6)


GRID_LINES = (1, 401, 800, 801, 1201, 1600)


def written_grids(spark, sf_dir) -> DataFrame:
    """Grids of four detectors written as a file for each return flag, planes by part, samples by supplier and order, and read from there."""
    cents = F.round(F.col("l_extendedprice") * 100).cast("long")
    keys = [F.concat(F.lit("GRID_"), "l_returnflag", F.lit("_ALL.fits")).alias("file"), (F.col("l_partkey") % 36).cast("int").alias("plane"), (F.col("l_suppkey") % 5).cast("int").alias("y"), (F.col("l_orderkey") % 5).cast("int").alias("x")]
    cells = spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy(*keys).agg((F.sum(cents) / 131072.0).alias("value"))
    lines = {f"{key}{k + 1:02d}": v for key in ("IPSFX", "JPSFY") for k, v in enumerate(GRID_LINES)}
    return psf_grids.read_grids(spark, psf_grids.write_cubes(cells, {"NXPSFS": 6, "NYPSFS": 6} | lines, (36, 5, 5)))


GRID_SQL = """cells as (select l_returnflag as instrument, l_partkey % 36 as node, l_suppkey % 5 as j, l_orderkey % 5 as i, sum(cast(round(l_extendedprice * 100) as bigint)) / 131072.0 as value from lineitem group by 1, 2, 3, 4),
grids as (
  select f.instrument, p.node::int as node, case (p.node // 18) * 2 + (p.node % 6) // 3 when 0 then 3 when 1 then 4 when 2 then 2 else 1 end as detector,
    case p.node % 3 when 0 then 0 when 1 then 400 else 799 end::double as gx, case p.node // 6 % 3 when 0 then 0 when 1 then 400 else 799 end::double as gy, a.j::int as j, b.i::int as i, coalesce(c.value, 0) as value
  from (select distinct l_returnflag as instrument from lineitem) f cross join (select unnest(range(36)) as node) p cross join (select unnest(range(5)) as j) a cross join (select unnest(range(5)) as i) b
  left join cells c on c.instrument = f.instrument and c.node = p.node and c.j = a.j and c.i = b.i)"""


@query(f"with {GRID_SQL} select instrument, detector, node, gx, gy, j, i, round(value, 4) as value from grids")
def psf_grid_nodes(spark, sf_dir):
    return rounded(written_grids(spark, sf_dir).select("instrument", "detector", "node", "gx", "gy", "j", "i", "value"))


@query(f"""with {GRID_SQL},
p as (select p_partkey as id, p_size % 4 + 1 as detector, least(greatest(p_partkey * 7.3::double % 830 - 15, 0), 799) as x, least(greatest(p_retailprice * 3.1::double % 830 - 15, 0), 799) as y from part),
n as (select *, case when x < 400 then 0 when x < 799 then 400 else 799 end as x0, case when x < 400 then 400 else 799 end as x1, case when y < 400 then 0 when y < 799 then 400 else 799 end as y0, case when y < 400 then 400 else 799 end as y1 from p),
t as (select *, case when x1 > x0 then (x - x0) / (x1 - x0) else 0 end as tx, case when y1 > y0 then (y - y0) / (y1 - y0) else 0 end as ty from n),
w as (select id, detector, x0 as gx, y0 as gy, (1 - tx) * (1 - ty) as w from t union all select id, detector, x1, y0, tx * (1 - ty) from t union all select id, detector, x0, y1, (1 - tx) * ty from t union all select id, detector, x1, y1, tx * ty from t)
select instrument, detector, id, j, i, round(sum(w * value), 3) as value from w join grids using (detector, gx, gy) where w > 0 group by 1, 2, 3, 4, 5""")
def psf_grid_shapes(spark, sf_dir):
    """The shape at a place for each part, between the nodes of its detector's grids."""
    parts = spark.read.parquet(f"{sf_dir}/part.parquet")
    at = parts.select(F.col("p_partkey").alias("id"), (F.col("p_size") % 4 + 1).cast("int").alias("detector"), (F.col("p_partkey") * 7.3 % 830 - 15).alias("x"), (F.col("p_retailprice") * 3.1 % 830 - 15).alias("y"))
    found = psf_grids.evaluate(written_grids(spark, sf_dir), at)
    return rounded(found.select(F.regexp_extract("path", r"GRID_(\w+)_ALL", 1).alias("instrument"), "detector", "id", "j", "i", "value"), 3)


@query(f"""with {img_sql(64, 64, 'l_returnflag')}, k0 as (select * from img where not mask), """ + ", ".join(f"k{n + 1} as materialized (select c.* from k{n} c join (select image_id, avg(value) as m, stddev_pop(value) as s from k{n} group by 1) b using (image_id) where abs(value - m) <= 3 * s)" for n in range(10)) + " select image_id, round(avg(value) + 2 * stddev_pop(value), 5) as threshold from k10 group by 1")
def detect_threshold(spark, sf_dir):
    return rounded(segmentation.threshold(image(spark, sf_dir, 64, 64, "l_returnflag"), 2.0), 5)


@query()
def deblend_sources(spark, sf_dir):
    pixels, segments = tiled(spark, sf_dir)
    return deblend.deblend(pixels, segments, 4, 8, 0.01)


JOINED = f"{MOD}, rows as (select s.label, i.* from segments s join img i using (image_id, y, x))"


@query(f"""with {JOINED} select image_id, label, count(*) as area, round(sum(value), 4) as segment_flux, round(sqrt(sum(error * error)), 4) as segment_flux_err, round(min(value), 4) as min_value, round(max(value), 4) as max_value,
  (arg_min(y * 64 + x, (value, y * 64 + x)) // 64)::int as min_y, (arg_min(y * 64 + x, (value, y * 64 + x)) % 64)::int as min_x, (arg_min(y * 64 + x, (-value, y * 64 + x)) // 64)::int as max_y, (arg_min(y * 64 + x, (-value, y * 64 + x)) % 64)::int as max_x,
  min(x) as x_min, max(x) as x_max, min(y) as y_min, max(y) as y_max, round(sqrt(count(*) / pi()), 4) as equivalent_radius from rows group by 1, 2""")
def catalog_sums(spark, sf_dir):
    return rounded(catalog.measured(*tiled(spark, sf_dir)))


@query(f"with {JOINED}, {shape_sql('rows', 'image_id, label')} select image_id, label, {rounds(SHAPE, 5)} from shapes")
def catalog_shapes(spark, sf_dir):
    return rounded(catalog.shapes(*tiled(spark, sf_dir)), 5)


KRON = f"""{JOINED}, {shape_sql('rows', 'image_id, label')}, r as (select s.image_id, s.label, i.value, sqrt(greatest(ellipse_cxx * (i.x - x_centroid) ** 2 + ellipse_cyy * (i.y - y_centroid) ** 2 + ellipse_cxy * (i.x - x_centroid) * (i.y - y_centroid), 0)) as r, g.label as there
  from shapes s join img i on i.image_id = s.image_id and abs(i.x - floor(x_centroid + 0.5)) <= ceil(2 * semimajor_axis) + 1 and abs(i.y - floor(y_centroid + 0.5)) <= ceil(2 * semimajor_axis) + 1 and not i.mask left join segments g on g.image_id = i.image_id and g.y = i.y and g.x = i.x),
kr as (select image_id, label, sum(r * value) / sum(value) as raw from r where (there is null or there = label) and r < 2 group by 1, 2)"""


@query(f"with {KRON} select image_id, label, round(case when raw > 0 and raw <= 2 then greatest(raw, 1.0) end, 5) as kron_radius from kr")
def catalog_kron_radius(spark, sf_dir):
    return rounded(catalog.kron_radii(*tiled(spark, sf_dir), scale=1.5, least=1.0, reach=2.0, neighbours="mask").select("image_id", "label", "kron_radius"), 5)


FLAGGED = f"{img_sql(64, 64, 'l_returnflag')}, det as (select * from img where image_id = 'A'), segments as (select y, x, (1 + (y // 16) * 4 + x // 16)::int * 2 as label from det where value > (select avg(value) from det))"


@query(f"""with {FLAGGED}, rows as (select 'A' as image_id, s.label, d.value, d.y, d.x from segments s join det d using (y, x)), {shape_sql('rows', 'image_id, label')},
r as (select s.label, i.value, sqrt(greatest(ellipse_cxx * (i.x - x_centroid) ** 2 + ellipse_cyy * (i.y - y_centroid) ** 2 + ellipse_cxy * (i.x - x_centroid) * (i.y - y_centroid), 0)) as r
  from shapes s join det i on abs(i.x - floor(x_centroid + 0.5)) <= ceil(6 * semimajor_axis) + 1 and abs(i.y - floor(y_centroid + 0.5)) <= ceil(6 * semimajor_axis) + 1 and not i.mask left join segments g on g.y = i.y and g.x = i.x where g.label is null or g.label = s.label),
kr as (select label, sum(r * value) / sum(value) as raw from r where r < 6 group by 1),
sums as (select i.image_id, s.label, sum(i.value) as segment_flux, sqrt(sum(i.error * i.error)) as segment_flux_err from img i join segments s using (y, x) group by 1, 2),
circle as (select i.image_id, i.label, sum(w * i.value) as circle_flux, sqrt(sum(w * w * i.error * i.error)) as circle_flux_err from (select i.*, s.label, {disc_sql('i.x - s.x_centroid', 'i.y - s.y_centroid', '3.0::double')} as w
    from shapes s join img i on abs(i.x - s.x_centroid) < 5 and abs(i.y - s.y_centroid) < 5 and not i.mask) i left join segments g on g.y = i.y and g.x = i.x where (g.label is null or g.label = i.label) and w > 1e-15 group by 1, 2)
select image_id, label, round(s.x_centroid, 4) as x_centroid, round(s.y_centroid, 4) as y_centroid, round(case when raw > 0 and raw <= 6 then greatest(raw, 1.4) end, 4) as kron_radius, round(segment_flux, 4) as segment_flux, round(segment_flux_err, 4) as segment_flux_err, round(circle_flux, 4) as circle_flux, round(circle_flux_err, 4) as circle_flux_err
from sums join (select label, x_centroid, y_centroid from shapes) s using (label) join kr using (label) join circle using (image_id, label)""")
def catalog_by_detection(spark, sf_dir):
    """All return flags' images measured by the labels of image A."""
    pixels = image(spark, sf_dir, 64, 64, "l_returnflag")
    found = pixels.where("image_id = 'A'")
    mean = found.agg(F.avg("value")).first()[0]
    labels = found.where(F.col("value") > mean).select("image_id", "y", "x", (2 * (1 + F.floor(F.col("y") / 16) * 4 + F.floor(F.col("x") / 16))).cast("int").alias("label"))
    bands = pixels.select("image_id").distinct().withColumn("detection", F.lit("A"))
    return rounded(catalog.by_detection(pixels, labels, bands, neighbours="mask").drop("kron_flux", "kron_flux_err"))


@query()
def catalog_kron(spark, sf_dir):
    return rounded(catalog.kron(*tiled(spark, sf_dir)), 4)


@query()
def catalog_flux_radius(spark, sf_dir):
    return rounded(catalog.flux_radius(*tiled(spark, sf_dir)))


@query(f"""with {JOINED}, {shape_sql('rows', 'image_id, label')}, t as (select r.image_id, r.label, sum(r.value * (r.x - x_centroid) ** 2) as inertia_xx, -sum(r.value * (r.x - x_centroid) * (r.y - y_centroid)) as inertia_xy, sum(r.value * (r.y - y_centroid) ** 2) as inertia_yy from rows r join c using (image_id, label) group by 1, 2)
select t.image_id, t.label, round(inertia_xx, 2) as inertia_xx, round(inertia_xy, 2) as inertia_xy, round(inertia_yy, 2) as inertia_yy, round(semimajor_axis ** 2, 2) as eigenvalue_1, round(semiminor_axis ** 2, 2) as eigenvalue_2 from t left join shapes using (image_id, label)""")
def catalog_tensors(spark, sf_dir):
    return rounded(catalog.tensors(*tiled(spark, sf_dir)), 2)


@query(f"""with {JOINED}, {shape_sql('rows', 'image_id, label')}, e as (select r.image_id, r.label, sum(error ** 2 * (r.x - x_centroid) ** 2) / sum(value) ** 2 as vx, sum(error ** 2 * (r.y - y_centroid) ** 2) / sum(value) ** 2 as vy, sum(error ** 2 * (r.x - x_centroid) * (r.y - y_centroid)) / sum(value) ** 2 as v, sum(error ** 2) / sum(value) ** 2 / 12 as f from rows r join c using (image_id, label) group by 1, 2),
a as (select e.*, case when m.xx0 * m.yy0 - m.xy ** 2 < 1.0 / 144 and vx * vy - v * v < f * f then f else 0 end as more from e join m using (image_id, label))
select image_id, label, round(sqrt(vx + more), 6) as x_err, round(sqrt(vy + more), 6) as y_err, round(v, 6) as xy_cov from a""")
def catalog_centroid_errors(spark, sf_dir):
    return rounded(catalog.centroid_errors(*tiled(spark, sf_dir)), 6)


@query(f"""with {JOINED}, {shape_sql('rows', 'image_id, label')} select image_id, label, round(sum(y * 0.5 + x * 0.25), 4) as background_sum, round(avg(y * 0.5 + x * 0.25), 4) as background_mean, round(any_value(y_centroid) * 0.5 + any_value(x_centroid) * 0.25, 4) as background_centroid from rows join c using (image_id, label) group by 1, 2""")
def catalog_backgrounds(spark, sf_dir):
    pixels, segments = tiled(spark, sf_dir)
    return rounded(catalog.backgrounds(pixels, segments, pixels.withColumn("background", F.col("y") * 0.5 + F.col("x") * 0.25)))


@query(f"""with {JOINED}, q as (select image_id, label, abs(value) as v, row_number() over (partition by image_id, label order by abs(value)) as i, count(*) over (partition by image_id, label) as n from rows)
select image_id, label, round(case when max(n) > 1 then sum((2 * i - n - 1) * v) / (avg(v) * max(n) * (max(n) - 1)) else 0 end, 6) as gini from q group by 1, 2""")
def catalog_gini(spark, sf_dir):
    return rounded(catalog.gini(*tiled(spark, sf_dir)), 6)


@query(f"""with {JOINED}, {shape_sql('rows', 'image_id, label')}, w as (select c.image_id, c.label, {disc_sql('i.x - x_centroid', 'i.y - y_centroid', '3.0::double')} as w, i.value, i.error from c join img i on i.image_id = c.image_id and abs(i.x - x_centroid) < 5 and abs(i.y - y_centroid) < 5 and not i.mask)
select image_id, label, round(sum(w * value), 4) as flux, round(sqrt(sum((w * error) ** 2)), 4) as flux_err from w where w > 0 group by 1, 2""")
def catalog_circular_flux(spark, sf_dir):
    return rounded(catalog.circular_photometry(*tiled(spark, sf_dir), 3.0))


@query(f"""with {JOINED}, {shape_sql("(select * from rows where not mask)", 'image_id, label').replace('from (select', 'from (select').replace("(select * from rows where not mask) join c", "(select * from rows where not mask) q join c")}
select r.image_id, r.label, (case when bool_or(r.mask) then 1 else 0 end + case when bool_and(r.mask) then 8 else 0 end + case when bool_or(r.y in (0, 63) or r.x in (0, 63)) then 16 else 0 end + case when coalesce(sum(r.value) filter (not r.mask) <= 0, true) then 256 else 0 end
  + case when any_value((m.xx0 + m.yy0) / 2 - sqrt(((m.xx0 - m.yy0) / 2) ** 2 + m.xy ** 2) < 1.0 / 12) then 512 else 0 end)::int as flags from rows r left join m using (image_id, label) group by 1, 2""")
def catalog_flags(spark, sf_dir):
    return catalog.flags(*tiled(spark, sf_dir))


@query(f"""with {IMG}, {SRC}, cells as (select s.id, ceil(s.y - 2.5)::int as y_min, ceil(s.x - 3.5)::int as x_min, j::int as j, i::int as i from src s, (select unnest(range(5)) as j), (select unnest(range(7)) as i))
select 'all' as image_id, c.id, c.j, c.i, round(v.value, 4) as value from cells c left join img v on v.y = c.y_min + c.j and v.x = c.x_min + c.i""")
def source_cutouts(spark, sf_dir):
    found = catalog.cutouts(image(spark, sf_dir), stars(spark).withColumn("image_id", F.lit("all")), 5, 7)
    lines = found.select("image_id", "id", F.posexplode("data").alias("j", "line"))
    return rounded(lines.select("image_id", "id", "j", F.posexplode("line").alias("i", "value")))


@query(f"with {MOD} select image_id, count(distinct label) as n_labels, max(label) as max_label, false as is_consecutive, 4096 - count(*) as background_area from segments group by 1")
def label_summary(spark, sf_dir):
    return segmentation.summary(*tiled(spark, sf_dir))


@query(f"""with {img_sql(by='l_returnflag')}, src as (select i.image_id, s.* from (select distinct image_id from img) i join (values {VALUES}) s(id, x, y) on (i.image_id = 'A') = (s.id % 2 = 0)),
w as (select s.id, i.*, case when (i.x - s.x) ** 2 + (i.y - s.y) ** 2 < 16.0 then 1.0 else 0.0 end as w from src s join img i on i.image_id = s.image_id and abs(i.x - s.x) < 6 and abs(i.y - s.y) < 6)
select image_id, id, round(sum(value), 4) as flux, sum(w) as area from w where w > 0 and not mask group by 1, 2""")
def aperture_own_image(spark, sf_dir):
    """Sources that name their image are measured there alone."""
    pixels = image(spark, sf_dir, by="l_returnflag")
    listed = stars(spark).crossJoin(pixels.select("image_id").distinct()).where((F.col("image_id") == "A") == (F.col("id") % 2 == 0))
    return rounded(aperture.photometry(pixels, listed, aperture.circle(4), method="center").select("image_id", "id", "flux", "area"))


@query(f"""with {IMG}, {SRC}, b as (select id, floor(x - 2.2 + 0.5)::int as x0, ceil(x + 2.2 + 0.5)::int as x1, floor(y - 1.4 + 0.5)::int as y0, ceil(y + 1.4 + 0.5)::int as y1 from src), u as (select a.id as a, b.id as b, least(a.x0, b.x0) as ux0, greatest(a.x1, b.x1) as ux1, least(a.y0, b.y0) as uy0, greatest(a.y1, b.y1) as uy1,
  greatest(a.x0, b.x0) as ix0, least(a.x1, b.x1) as ix1, greatest(a.y0, b.y0) as iy0, least(a.y1, b.y1) as iy1, greatest(a.x0, 0) as ox0, least(a.x1, 32) as ox1, greatest(a.y0, 0) as oy0, least(a.y1, 32) as oy1 from b a join b b on a.id <= b.id)
select a, b, (ux1 - ux0) * (uy1 - uy0) as union_area, case when ix1 > ix0 and iy1 > iy0 then (ix1 - ix0) * (iy1 - iy0) else 0 end as shared_area, (ox1 - ox0) * (oy1 - oy0) as inside_area from u""")
def bounding_boxes(spark, sf_dir):
    b = stars(spark).select("id", boxes.from_float(F.col("x") - 2.2, F.col("x") + 2.2, F.col("y") - 1.4, F.col("y") + 1.4).alias("box"))
    pairs = b.select(F.col("id").alias("a"), F.col("box").alias("p")).join(b.select(F.col("id").alias("b"), F.col("box").alias("q")), F.col("a") <= F.col("b"))
    area = lambda c: boxes.shape(c)["height"] * boxes.shape(c)["width"]
    made = pairs.withColumns({"u": boxes.union(F.col("p"), F.col("q")), "i": boxes.intersection(F.col("p"), F.col("q")), "o": boxes.overlap(F.col("p"), F.lit(32), F.lit(32))[0]})
    return made.select("a", "b", area(F.col("u")).alias("union_area"), F.coalesce(area(F.col("i")), F.lit(0)).alias("shared_area"), area(F.col("o")).alias("inside_area"))


@query(f"""with {IMG}, {SRC}, cells as (select s.id, s.x, s.y, py::int as py, px::int as px from src s, (select unnest(range(-6, 40)) as py), (select unnest(range(-6, 40)) as px)),
m as (select id, py, px, 1.0 as w from cells where (px - x) ** 2 + (py - y) ** 2 < 6.25), e as (select id, min(py) as a, max(py) as b, min(px) as c, max(px) as d from m group by 1)
select c.id, c.py, c.px, round(coalesce(i.value * m.w, 0), 4) as value from cells c join e on e.id = c.id and c.py between a and b and c.px between e.c and e.d left join m on m.id = c.id and m.py = c.py and m.px = c.px left join img i on i.y = c.py and i.x = c.px""")
def mask_products(spark, sf_dir):
    return rounded(masks.multiply(image(spark, sf_dir), masks.weights(stars(spark), aperture.circle(2.5), method="center")))


@query(f"""with {IMG}, {SRC} select 'all' as image_id, s.id, i.y, i.x, round(i.value, 4) as value from src s join img i on (i.x - s.x) ** 2 + (i.y - s.y) ** 2 < 6.25 where not mask""")
def mask_values(spark, sf_dir):
    return rounded(masks.values(image(spark, sf_dir), stars(spark), aperture.circle(2.5), method="center"))


@query(f"""with {BOXES}, k as (select * from {MESH}) select i.image_id, i.y, i.x, k.n from img i join k on k.box_y = i.y // 8 and k.box_x = i.x // 8""")
def background_n_pixels_map(spark, sf_dir):
    pixels = image(spark, sf_dir, 64, 64)
    return background.n_pixels_map(pixels, background.mesh(pixels, 8), 8)


@query(f"with {BOXES}, k as (select * from {MESH}) select image_id, round(median(background), 4) as background_median, round(median(rms), 4) as rms_median from k group by 1")
def background_medians(spark, sf_dir):
    return rounded(background.medians(background.mesh(image(spark, sf_dir, 64, 64), 8)))


@query(map_sql("rms", "rms"))
def background_rms_map(spark, sf_dir):
    pixels = image(spark, sf_dir, 64, 64)
    return rounded(background.rms_to_pixels(pixels, background.mesh(pixels, 8), 8))


@query(f"""with {BOXES}, k as (select * from {MESH} where background is not null), p as (select i.y, i.x, k.background as v, sqrt((i.y - (box_y * 8 + 3.5)) ** 2 + (i.x - (box_x * 8 + 3.5)) ** 2) as d, row_number() over (partition by i.y, i.x order by sqrt((i.y - (box_y * 8 + 3.5)) ** 2 + (i.x - (box_x * 8 + 3.5)) ** 2), box_y, box_x) as r from img i, k)
select 'all' as image_id, y, x, round(sum(v / d) / sum(1 / d), 4) as background from p where r <= 4 group by 2, 3""")
def background_idw_map(spark, sf_dir):
    pixels = image(spark, sf_dir, 64, 64)
    return rounded(background.idw_to_pixels(pixels, background.mesh(pixels, 8).where("background is not null"), 8, 4))


FIELD = Tan(15.5, 14.0, 120.0, 35.0, ((-0.0011, 0.0002), (0.0001, 0.0012)))


def sky_sql(x: str, y: str) -> tuple[str, str]:
    u, v = f"radians(({x} - 15.5) * -0.0011 + ({y} - 14.0) * 0.0002)", f"radians(({x} - 15.5) * 0.0001 + ({y} - 14.0) * 0.0012)"
    low = f"(cos(radians(35.0::double)) - {v} * sin(radians(35.0::double)))"
    return f"(120.0 + degrees(atan2({u}, {low})))", f"degrees(atan2(sin(radians(35.0::double)) + {v} * cos(radians(35.0::double)), sqrt({u} ** 2 + {low} ** 2)))"


LON, LAT = sky_sql("x", "y")


@query(f"with {SRC} select id, round({LON}, 9) as lon, round({LAT}, 9) as lat, round(x, 6) as x, round(y, 6) as y from src")
def sky_round_trip(spark, sf_dir):
    there = sky.with_sky(stars(spark), FIELD).select("id", "lon", "lat")
    back = sky.with_pixel(there, FIELD)
    return back.select("id", F.round("lon", 9).alias("lon"), F.round("lat", 9).alias("lat"), F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


def jacobian_sql() -> str:
    (ex, nx), (fx, mx), (ey, ny), (fy, my) = (sky_sql(*p) for p in (("(x + 0.5)", "y"), ("(x - 0.5)", "y"), ("x", "(y + 0.5)"), ("x", "(y - 0.5)")))
    return f"select id, ({ex} - {fx}) * cos(radians({LAT})) * 3600 as a, ({ey} - {fy}) * cos(radians({LAT})) * 3600 as b, ({nx} - {mx}) * 3600 as c, ({ny} - {my}) * 3600 as d from src"


@query(f"""with {SRC}, j as ({jacobian_sql()}) select id, round(sqrt(abs(a * d - b * c)), 5) as mean_scale, round(abs(a * d - b * c) / sqrt(a * a + b * b), 5) as north_scale, round(degrees(atan2(a / (a * d - b * c), -b / (a * d - b * c))), 4) as north_angle from j""")
def sky_scales(spark, sf_dir):
    x, y = F.col("x"), F.col("y")
    north, angle = FIELD.scale_and_angle(x, y)
    return stars(spark).select("id", F.round(FIELD.mean_scale(x, y), 5).alias("mean_scale"), F.round(north, 5).alias("north_scale"), F.round(angle, 4).alias("north_angle"))


@query(f"""with {SRC}, j as ({jacobian_sql()}), m as (select id, a * cos(0.3) + b * sin(0.3) as p, c * cos(0.3) + d * sin(0.3) as q, b * cos(0.3) - a * sin(0.3) as r, d * cos(0.3) - c * sin(0.3) as s from j),
k as (select id, 9 * p * p + 4 * r * r as xx, 9 * q * q + 4 * s * s as yy, 9 * p * q + 4 * r * s as xy from m)
select id, round(sqrt((xx + yy) / 2 + sqrt(((xx - yy) / 2) ** 2 + xy * xy)), 4) as major, round(sqrt((xx + yy) / 2 - sqrt(((xx - yy) / 2) ** 2 + xy * xy)), 4) as minor, 3.0 as a, 2.0 as b, round(degrees(atan2(2 * xy, xx - yy) / 2), 3) as angle from k""")
def sky_ellipses(spark, sf_dir):
    """Ellipses taken to the sky, and their axes after the way back."""
    there = sky.ellipses_to_sky(stars(spark).withColumns({"a": F.lit(3.0), "b": F.lit(2.0), "theta": F.lit(0.3)}), FIELD)
    back = sky.ellipses_to_pixel(there.select("id", "lon", "lat", "major", "minor", "angle"), FIELD)
    return back.select("id", F.round("major", 4).alias("major"), F.round("minor", 4).alias("minor"), F.round("a", 6).alias("a"), F.round("b", 6).alias("b"), F.round(F.degrees("angle"), 3).alias("angle"))


@query()
def sky_apertures(spark, sf_dir):
    """Circles on the sky, measured in pixels."""
    targets = sky.with_sky(stars(spark), FIELD).select("id", "lon", "lat")
    return rounded(sky.sky_photometry(image(spark, sf_dir), targets, FIELD, 12.0).drop("flags"))


@query(f"with {JOINED}, {shape_sql('rows', 'image_id, label')} select image_id, label, round({sky_sql('x_centroid', 'y_centroid')[0]}, 8) as lon, round({sky_sql('x_centroid', 'y_centroid')[1]}, 8) as lat from c")
def catalog_sky_centroids(spark, sf_dir):
    found = sky.with_sky(catalog.source_list(*tiled(spark, sf_dir)), FIELD)
    return found.select("image_id", F.col("id").cast("int").alias("label"), F.round("lon", 8).alias("lon"), F.round("lat", 8).alias("lat"))


RADII = [1.0, 2.0, 3.0, 4.5, 6.0]
GROWTH = f"{IMG}, {SRC}, rad as (select * from (values " + ", ".join(f"({k}, {r}::double)" for k, r in enumerate(RADII)) + f") t(step, radius)), g as (select s.id, r.step::int as step, r.radius, sum({disc_sql('i.x - s.x', 'i.y - s.y', 'r.radius')} * i.value) as flux, sum({disc_sql('i.x - s.x', 'i.y - s.y', 'r.radius')}) as area, sqrt(sum(({disc_sql('i.x - s.x', 'i.y - s.y', 'r.radius')} * i.error) ** 2)) as flux_err from src s join img i on abs(i.x - s.x) < 8 and abs(i.y - s.y) < 8 and not mask join rad r on true group by 1, 2, 3)"


@query(f"with {GROWTH} select 'all' as image_id, id, step, radius, {rounds('flux area flux_err')} from g")
def curve_of_growth(spark, sf_dir):
    return rounded(profiles.growth(image(spark, sf_dir), stars(spark), RADII))


RINGS = "(values (3.0::double, 0.3::double, 0.4::double), (6.5, 0.5, 1.1), (9.0, 0.1, -0.6)) t(sma, eps, pa)"


@query(f"""with {IMG}, g as (select sma, 15.3 as x0, 16.2 as y0, eps, pa from {RINGS}), c as (select g.sma, i.value, sqrt(((i.x - x0) * cos(pa) + (i.y - y0) * sin(pa)) ** 2 + (((i.y - y0) * cos(pa) - (i.x - x0) * sin(pa)) / (1 - eps)) ** 2) as e, sqrt((i.x - x0) ** 2 + (i.y - y0) ** 2) as r from g, img i where not mask and abs(i.x - x0) < sma + 3 and abs(i.y - y0) < sma + 3)
select 'all' as image_id, sma, round(sum(value) filter (e <= sma), 4) as flux_ellipse, round(sum(value) filter (r <= sma), 4) as flux_circle, count(*) filter (e <= sma) as n_ellipse, count(*) filter (r <= sma) as n_circle from c group by 2""")
def ellipse_growth(spark, sf_dir):
    rows = spark.createDataFrame([("all", 3.0, 15.3, 16.2, 0.3, 0.4), ("all", 6.5, 15.3, 16.2, 0.5, 1.1), ("all", 9.0, 15.3, 16.2, 0.1, -0.6)], "image_id string, sma double, x0 double, y0 double, eps double, pa double")
    return rounded(ellipses.growth(image(spark, sf_dir), rows))


@query(f"""with {IMG}, g as (select sma, 15.3 as x0, 16.2 as y0, eps, pa, greatest(24, ceil(2 * pi() * sma))::int as n from {RINGS}), s as (select sma, x0, y0, pa, 2 * pi() * k / n as phi, sma * (1 - eps) / sqrt(((1 - eps) * cos(2 * pi() * k / n)) ** 2 + sin(2 * pi() * k / n) ** 2) as r from g, lateral (select unnest(range(n)) as k)),
p as (select sma, phi, floor(x0 + r * cos(phi + pa) + 0.5)::int as x, floor(y0 + r * sin(phi + pa) + 0.5)::int as y from s)
select 'all' as image_id, sma, count(*) as n, round(avg(value), 4) as intensity, round(2 * avg(value * sin(phi)), 4) as s1, round(2 * avg(value * cos(phi)), 4) as c1 from p join img i using (y, x) where not mask group by 2""")
def ellipse_samples_nearest(spark, sf_dir):
    rows = spark.createDataFrame([("all", 3.0, 15.3, 16.2, 0.3, 0.4), ("all", 6.5, 15.3, 16.2, 0.5, 1.1), ("all", 9.0, 15.3, 16.2, 0.1, -0.6)], "image_id string, sma double, x0 double, y0 double, eps double, pa double")
    found = ellipses.samples(image(spark, sf_dir), rows, mode="nearest").where("not outer")
    term = lambda f: 2 * F.avg(F.col("value") * f("phi"))
    return rounded(found.groupBy("image_id", "sma").agg(F.count("*").alias("n"), F.avg("value").alias("intensity"), term(F.sin).alias("s1"), term(F.cos).alias("c1")))


def sectors_sql(how: str) -> str:
    return f"""with {IMG}, g as (select sma, 15.3 as x0, 16.2 as y0, eps, pa, greatest(24, ceil(2 * pi() * sma))::int as n from {RINGS}),
p as (select g.*, i.value, atan2(i.y - y0, i.x - x0) - pa as turn, sqrt(((i.x - x0) * cos(pa) + (i.y - y0) * sin(pa)) ** 2 + (((i.y - y0) * cos(pa) - (i.x - x0) * sin(pa)) / (1 - eps)) ** 2) as e from g, img i where not mask)
select 'all' as image_id, sma, (floor((turn - 2 * pi() * floor(turn / (2 * pi()))) * n / (2 * pi()) + 0.5)::int % n)::int as k, count(*) as n, round({how}(value), 4) as value from p where e >= sma * 0.8 and e < sma * 1.2 group by 2, 3"""


def sectors(spark, sf_dir, how: str) -> DataFrame:
    rows = spark.createDataFrame([("all", 3.0, 3.0, 15.3, 16.2, 0.3, 0.4), ("all", 6.5, 6.5, 15.3, 16.2, 0.5, 1.1), ("all", 9.0, 9.0, 15.3, 16.2, 0.1, -0.6)], "image_id string, sma double, axis double, x0 double, y0 double, eps double, pa double")
    return rounded(ellipses.sectors(image(spark, sf_dir), rows.withColumn("outer", F.lit(False)), 0.4, how).drop("outer"))


@query(sectors_sql("avg"))
def ellipse_sectors_mean(spark, sf_dir):
    return sectors(spark, sf_dir, "mean")


@query(sectors_sql("median"))
def ellipse_sectors_median(spark, sf_dir):
    return sectors(spark, sf_dir, "median")


@query()
def isophote_model(spark, sf_dir):
    """Each return flag's image from the ellipses of its own light, with harmonics."""
    pixels = image(spark, sf_dir, 32, 32, "l_returnflag")
    found = ellipses.fit(pixels, ellipses.starts(pixels, [4.0, 8.0, 12.0], 15.5, 15.5), rounds=1, fix=("centre", "eps", "pa"), mode="mean")
    return rounded(ellipses.harmonic_image(pixels, found), 3)


@query()
def isophotes(spark, sf_dir):
    """Ellipses of three axes fitted to the table's image, whose noise mostly uses the rounds up."""
    pixels = image(spark, sf_dir, 64, 64)
    return rounded(ellipses.fit(pixels, ellipses.starts(pixels, [6.0, 10.0, 16.0], 31.5, 31.5), rounds=4), 3)


@query()
def psf_photometry(spark, sf_dir):
    sources = stars(spark).withColumn("image_id", F.lit("all"))
    found = photometry.fit(image(spark, sf_dir), sources, Model("gaussian_prf", (1.5,)), 3, 4.0, 3.0, (6.0, 9.0), within=1.0)
    return rounded(found.drop("params"), 3)


@query(f"""with {IMG}, {SRC}, a as (select s.id, sum({disc_sql('i.x - s.x', 'i.y - s.y', '3.0::double')} * i.value) as f, sum({disc_sql('i.x - s.x', 'i.y - s.y', '3.0::double')}) as area from src s join img i on abs(i.x - s.x) < 5 and abs(i.y - s.y) < 5 and not mask group by 1),
b as (select s.id, median(i.value) as local_bkg from src s join img i on (i.x - s.x) ** 2 + (i.y - s.y) ** 2 < 81 and (i.x - s.x) ** 2 + (i.y - s.y) ** 2 >= 36 where not mask group by 1)
select 'all' as image_id, id, round(local_bkg, 4) as local_bkg, round(f - area * local_bkg, 4) as flux from a join b using (id)""")
def psf_initial_values(spark, sf_dir):
    sources = stars(spark).withColumn("image_id", F.lit("all"))
    return rounded(photometry.initial(image(spark, sf_dir), sources, 3.0, (6.0, 9.0)).select("image_id", "id", "local_bkg", "flux"))


@query(f"""with {IMG}, {SRC} select i.image_id, i.y, i.x, round(sum(case when abs(i.x - floor(s.x + 0.5)) <= 4 and abs(i.y - floor(s.y + 0.5)) <= 4 then 900.0 * s.id * 2.0 / (pi() * 6.25) * (1 + ((i.x - s.x) ** 2 + (i.y - s.y) ** 2) / 6.25) ** -3.0 else 0 end), 5) as model from img i, src s group by 1, 2, 3""")
def moffat_image(spark, sf_dir):
    sources = stars(spark).withColumns({"image_id": F.lit("all"), "flux": 900.0 * F.col("id"), "local_bkg": F.lit(0.0)})
    return rounded(photometry.model_image(image(spark, sf_dir), sources, Model("moffat", (2.5, 3.0)), 4).select("image_id", "y", "x", "model"), 5)


SIDE = lambda d: f"greatest(least({d} + 0.5, r.radius) - greatest({d} - 0.5, -r.radius), 0)"


@query(f"""with {IMG}, {SRC}, rad as (select * from (values """ + ", ".join(f"({k}, {r}::double)" for k, r in enumerate(RADII)) + f""") t(step, radius)), g as (select s.id, r.step::int as step, r.radius, {SIDE('(i.x - s.x)')} * {SIDE('(i.y - s.y)')} as w, i.value from src s join img i on abs(i.x - s.x) < 8 and abs(i.y - s.y) < 8 and not mask join rad r on true)
select 'all' as image_id, id, step, radius, round(sum(w * value), 4) as flux, round(sum(w), 4) as area from g group by 2, 3, 4""")
def ensquared_growth(spark, sf_dir):
    return rounded(profiles.growth(image(spark, sf_dir), stars(spark), RADII, outline="square").drop("flux_err"))


@query()
def elliptical_growth(spark, sf_dir):
    return rounded(profiles.growth_elliptical(image(spark, sf_dir), stars(spark), RADII, 0.6, 0.4))


@query()
def profile_fits(spark, sf_dir):
    return rounded(profiles.fitted(profiles.radial(image(spark, sf_dir), stars(spark), [0.0, *RADII]), "gaussian"), 3)


@query(f"with {IMG}, {SRC} select 'all' as image_id, s.id, round(sqrt((i.x - s.x) ** 2 + (i.y - s.y) ** 2), 5) as radius, round(i.value, 4) as value from src s join img i on (i.x - s.x) ** 2 + (i.y - s.y) ** 2 <= 16 where not mask")
def data_profile(spark, sf_dir):
    return profiles.data_profile(image(spark, sf_dir), stars(spark), 4.0).select("image_id", "id", F.round("radius", 5).alias("radius"), F.round("value", 4).alias("value"))


@query(f"""with {GROWTH}, d as (select *, flux - lag(flux) over w as df, area - lag(area) over w as da, radius - lag(radius) over w as dr, flux_err ** 2 - lag(flux_err ** 2) over w as dv from g window w as (partition by id order by step))
select 'all' as image_id, id, step, round(radius - dr / 2, 4) as radius, round(df / da, 4) as profile, round(sqrt(greatest(dv, 0)) / da, 4) as profile_err, round(da, 4) as area from d where df is not null""")
def radial_profile(spark, sf_dir):
    return rounded(profiles.radial(image(spark, sf_dir), stars(spark), RADII))


@query(f"""with {GROWTH}, s as (select id, step, radius, flux / last_value(flux) over (partition by id order by step rows between unbounded preceding and unbounded following) as share from g),
b as (select *, lag(share) over w as before, lag(radius) over w as inner_ from s window w as (partition by id order by step))
select 'all' as image_id, id, round(min(inner_ + (0.5 - before) * (radius - inner_) / (share - before)), 4) as radius from b where share >= 0.5 and before < 0.5 group by id""")
def half_flux_radius(spark, sf_dir):
    return rounded(profiles.radius_of(profiles.growth(image(spark, sf_dir), stars(spark), RADII), 0.5))


MODEL = f"""{IMG}, {SRC}, model as (select i.image_id, i.y, i.x, any_value(i.value) as value, sum(case when abs(i.x - floor(s.x + 0.5)) <= 5 and abs(i.y - floor(s.y + 0.5)) <= 5 then 1000.0 * s.id / (2 * pi() * 2.25) * exp(-((i.x - s.x) ** 2 + (i.y - s.y) ** 2) / 4.5) else 0 end) as model from img i, src s group by 1, 2, 3)"""


@query(f"with {MODEL} select image_id, y, x, round(model, 5) as model from model")
def render_model(spark, sf_dir):
    sources = stars(spark).withColumn("flux", 1000.0 * F.col("id"))
    return rounded(psf.render(image(spark, sf_dir), sources, 1.5, 5).select("image_id", "y", "x", "model"), 5)


@query(f"with {MODEL} select image_id, y, x, round(value - model, 5) as value from model")
def residual_image(spark, sf_dir):
    sources = stars(spark).withColumn("flux", 1000.0 * F.col("id"))
    return rounded(psf.residual(image(spark, sf_dir), sources, 1.5, 5).select("image_id", "y", "x", "value"), 5)


@query()
def source_groups(spark, sf_dir):
    points = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("id"), (F.col("p_retailprice") % 100).alias("x"), (F.col("p_partkey") % 97).cast("double").alias("y"))
    return psf.groups(points, 2.0)


@query()
def psf_repeated(spark, sf_dir):
    scene = psf.render(image(spark, sf_dir), stars(spark).withColumn("flux", 1000.0 * F.col("id")), 1.5, 6).withColumn("value", F.col("model")).withColumn("error", F.lit(1.0)).withColumn("mask", F.lit(False)).drop("model")
    return rounded(finders.repeated_photometry(scene, 5.0, 1.5, 2).select("image_id", "id", "round", "x_fit", "y_fit", "flux_fit"), 2)


@query()
def psf_fit(spark, sf_dir):
    truth = stars(spark).withColumn("flux", 1000.0 * F.col("id"))
    scene = psf.render(image(spark, sf_dir), truth, 1.5, 6).withColumn("value", F.col("model")).withColumn("error", F.lit(1.0)).withColumn("mask", F.lit(False)).drop("model")
    return rounded(psf.fit(scene, truth.withColumn("group_id", F.col("id")).withColumn("x", F.col("x") + 0.2), 1.5), 3)


@query(f"with {IMG} select image_id, y, x, round(sqrt(4.0 + greatest(value / 1.5, 0)), 6) as total_error from img")
def total_error(spark, sf_dir):
    return image(spark, sf_dir).select("image_id", "y", "x", F.round(F.sqrt(F.lit(4.0) + F.greatest(F.col("value") / 1.5, F.lit(0.0))), 6).alias("total_error"))


@query()
def isophote_harmonics(spark, sf_dir):
    return rounded(harmonic.harmonics(harmonic.ellipse_samples(image(spark, sf_dir), 16.0, 15.0, [3.0, 5.0, 8.0], 0.3, 0.4)))


@query()
def isophote_fit(spark, sf_dir):
    pixels = image(spark, sf_dir, 64, 64)
    u, v = F.col("x") - 31.2, F.col("y") - 30.4
    a, b = u * np.cos(0.6) + v * np.sin(0.6), v * np.cos(0.6) - u * np.sin(0.6)
    galaxy = pixels.withColumn("value", 1000 * F.exp(-F.sqrt(a * a + b * b / 0.49) / 6))
    return rounded(harmonic.fit_ellipse(galaxy, 31.0, 31.0, 9.0), 3)


SKY = Tan(15.5, 15.5, 10.0, 30.0, ((-0.001, 0.0002), (0.0002, 0.001)))


@query(f"""with {SRC}, t as (select id, x, y, radians((x - 15.5) * -0.001 + (y - 15.5) * 0.0002) as u, radians((x - 15.5) * 0.0002 + (y - 15.5) * 0.001) as v, sin(radians(30.0)) as s, cos(radians(30.0)) as k from src)
select id, round(degrees(atan2(u, k - v * s)) + 10.0, 8) as lon, round(degrees(atan2(s + v * k, sqrt(u * u + (k - v * s) ** 2))), 8) as lat, x, y from t""")
def sky_positions(spark, sf_dir):
    rows = stars(spark)
    lon, lat = SKY.to_sky(F.col("x"), F.col("y"))
    rows = rows.select("id", lon.alias("lon"), lat.alias("lat"))
    x, y = SKY.to_pixel(F.col("lon"), F.col("lat"))
    return rows.select("id", F.round("lon", 8).alias("lon"), F.round("lat", 8).alias("lat"), F.round(x, 6).alias("x"), F.round(y, 6).alias("y"))


@query(f"""with {IMG}, {SRC} select i.image_id, i.y, i.x, round(any_value(i.value) + sum(case when abs(i.x - floor(s.x + 0.5)) <= 12 and abs(i.y - floor(s.y + 0.5)) <= 12 then 50.0 * s.id * exp(-(((i.x - s.x) * cos(0.3) + (i.y - s.y) * sin(0.3)) ** 2 / 8.0 + ((i.y - s.y) * cos(0.3) - (i.x - s.x) * sin(0.3)) ** 2 / 2.0)) else 0 end), 4) as value from img i, src s group by 1, 2, 3""")
def simulate_gaussians(spark, sf_dir):
    sources = stars(spark).select("x", "y", (50.0 * F.col("id")).alias("amplitude"), F.lit(2.0).alias("sx"), F.lit(1.0).alias("sy"), F.lit(0.3).alias("theta"))
    return rounded(simulate.add_gaussians(image(spark, sf_dir), sources).select("image_id", "y", "x", "value"))


@query()
def simulate_noise(spark, sf_dir):
    return rounded(simulate.add_noise(simulate.blank(spark, 64, 64, 5.0), 2.0, 7).select("image_id", "y", "x", "value"))


@query()
def image_depth(spark, sf_dir):
    spots = positions(spark, [(k, 5.0 + 6 * (k % 4), 5.0 + 6 * (k // 4)) for k in range(16)])
    return rounded(simulate.depth(image(spark, sf_dir).withColumn("mask", F.lit(False)), spots, aperture.circle(2.5)))


@query("select vec_id as image_id, round(sum(v * (i % 8)) / sum(v), 4) as x_centroid, round(sum(v * (i // 8)) / sum(v), 4) as y_centroid from (select vec_id, unnest(embedding)::double ** 2 as v, unnest(range(64)) as i from embeddings) group by 1")
def stamp_centroids(spark, sf_dir):
    return rounded(stats.centroid(stamps(spark, sf_dir).withColumn("value", F.col("value") * F.col("value")), ["image_id"]))


@query("select date_trunc('day', ts) as start, event_type as source, count(*) as n, round(avg(value), 6) as mean, min(value) as min, max(value) as max from events group by 1, 2")
def light_curves(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").withColumnRenamed("event_type", "source")
    return frames.light_curves(rows).withColumn("mean", F.round("mean", 6))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aperture_circle_exact(spark, sf_dir)


__all__ = ["Q", "SQL", "flagship"]
