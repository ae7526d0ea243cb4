"""Deblending: labels split into the sources whose light touches, over tiles, whatever a label's size.

Markers come from a tree of components: the pixels over each of several levels between a label's faintest and brightest are labelled at once,
and joined with those of the level below by one of their pixels. A component counts if it has n_pixels; where one falls into several, these are
new, and a new one without newer ones in it is a marker.

The rest of the pixels are flooded from the markers along the maximum spanning forest of neighbouring pixels, whose
edges are ordered by the fainter pixel, then the brighter one, then place. An edge that is the best of all edges of a markerless
component belongs to the forest, so tiles contract what they surely can, with what leaves them in view; what stays open is at most
as much as a tile has border. The contracted graph goes on with tiles of twice the side until nothing is open. A task
holds some tiles' edges, by hash.

Last, where the faintest part of a label has less than `contrast` of its light, its marker goes, which joins its tree to
the neighbour along their best edge, again and again; here the parts of one label, not its pixels, meet in one task.

Defined results: labels of fewer than 2 n_pixels, of one value, or without two markers stay whole; a null or NaN value counts as the label's
lowest; pixels that no marker reaches go with the label's first part in the end, and count for none before; parts are numbered by image, label and first
marker pixel; no segments give no rows.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pixelloom.functions.tables import kept
from pixelloom.operators.segmentation import EIGHT, FOUR, label

OF, PIXEL = ["image_id", "label"], ["image_id", "label", "y", "x"]


def code(y: str = "y", x: str = "x") -> Column:
    """One number for a pixel, in raster order."""
    return F.shiftleft(F.col(y).cast("long"), 32) + F.col(x)


def cuts(low: Column, high: Column, levels: int, mode: str) -> Column:
    """The levels between low and high, ascending: exponential (linear unless low > 0), linear or sinh."""
    t = np.arange(1, levels + 1) / (levels + 1)
    if mode == "sinh":
        t = np.sinh(t / 0.25) / np.sinh(1 / 0.25)
    steps = F.array(*(F.lit(float(v)) for v in t))
    even = F.transform(steps, lambda v: low + (high - low) * v)
    return even if mode != "exponential" else F.when(low > 0, F.transform(steps, lambda v: low * F.pow(high / low, v))).otherwise(even)


def lit(pixels: DataFrame, segments: DataFrame) -> DataFrame:
    """The labels' pixels with values, low, high and n of their label; null and NaN values are the lowest."""
    rows = segments.select(*PIXEL).join(pixels.select("image_id", "y", "x", F.when(~F.isnan("value"), F.col("value").cast("double")).alias("value")), ["image_id", "y", "x"], "left")
    span = rows.groupBy(*OF).agg(F.coalesce(F.min("value"), F.lit(0.0)).alias("low"), F.coalesce(F.max("value"), F.lit(0.0)).alias("high"), F.count("*").alias("n"))
    return rows.join(span, OF).withColumn("value", F.coalesce("value", "low"))


def markers(rows: DataFrame, n_pixels: int, levels: int, mode: str, connectivity: int) -> DataFrame:
    """(image_id, label, y, x, seed): pixels of markers, of labels with two or more; seed: the marker's first pixel."""
    some = rows.where((F.col("n") >= 2 * n_pixels) & (F.col("high") > F.col("low")))
    deep = some.withColumn("deep", F.size(F.filter(cuts(F.col("low"), F.col("high"), levels, mode), lambda c: c < F.col("value")))).where("deep > 0")
    each = deep.withColumn("level", F.explode(F.sequence(F.lit(1), F.col("deep")))).select(F.struct(*OF, "level").alias("image_id"), "y", "x")
    parts = kept(label(each, F.lit(True), n_pixels, connectivity).select("image_id.*", "y", "x", F.col("label").alias("part")), "parts")
    first = parts.groupBy(*OF, "level", "part").agg(F.min(code()).alias("seed"))
    below = parts.select(*PIXEL, (F.col("level") + 1).alias("level"), F.col("part").alias("parent"))
    tree = first.withColumns({"y": F.shiftright("seed", 32).cast("int"), "x": F.col("seed").bitwiseAND(0xFFFFFFFF).cast("int")}).join(below, [*PIXEL, "level"], "left")
    siblings = Window.partitionBy(*OF, "level", F.coalesce("parent", F.lit(0)))
    new = kept(tree.withColumn("siblings", F.count("*").over(siblings)).where("siblings > 1").select(*OF, "level", "part", "seed", "y", "x"), "new")
    inside = parts.join(new.select(*OF, "level", "part", "seed"), [*OF, "level", "part"])
    newer = new.select(*PIXEL, F.col("level").alias("above"))
    split = inside.join(newer, PIXEL).where("above > level").select(*OF, "level", "part").distinct()
    return kept(inside.join(split, [*OF, "level", "part"], "left_anti").select(*PIXEL, "seed"), "markers")


def order() -> Column:
    """What is larger for better edges: lo and hi, the fainter and the brighter pixel, then the smaller u and v, its ends."""
    return F.struct("lo", "hi", (-F.col("u")).alias("u"), (-F.col("v")).alias("v"))


def edges_of(rows: DataFrame, connectivity: int) -> DataFrame:
    """(image_id, label, u, v, lo, hi) of each two neighbouring pixels of a label."""
    own = rows.select(*PIXEL, code().alias("u"), F.col("value").alias("a"))
    found = None
    for dy, dx in EIGHT if connectivity == 8 else FOUR:
        other = rows.select(*OF, (F.col("y") - dy).alias("y"), (F.col("x") - dx).alias("x"), code().alias("v"), F.col("value").alias("b"))
        met = own.join(other, PIXEL).select(*OF, F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"), F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi"))
        found = met if found is None else found.unionByName(met)
    return found


def contracted(a: np.ndarray, b: np.ndarray, rank: np.ndarray, rooted: np.ndarray) -> np.ndarray:
    """Of each node the one it is contracted into. a, b: ends of edges (b: -1 outside), rank: higher is better, rooted: nodes that hold a marker."""
    top = np.arange(len(rooted))
    while True:
        x, y = top[a], np.where(b < 0, -1, top[b])
        live = (x != y) & ~(rooted[x] & (y >= 0) & rooted[y])
        e = np.flatnonzero(live)
        best = np.full(len(rooted), -1)
        np.maximum.at(best, x[e], rank[e])
        inner = e[y[e] >= 0]
        np.maximum.at(best, y[inner], rank[inner])
        to = np.arange(len(rooted))
        for own, other in ((x, y), (y, x)):
            hook = inner[(rank[inner] == best[own[inner]]) & ~rooted[own[inner]]]
            to[own[hook]] = other[hook]
        mutual = (to[to] == np.arange(len(to))) & (to > np.arange(len(to)))
        to[mutual] = np.flatnonzero(mutual)
        if (to == np.arange(len(to))).all():
            return top
        while (to != to[to]).any():
            to = to[to]
        top = to[top]


def renamed(edges: DataFrame, names: DataFrame) -> DataFrame:
    """Edges (a at u, b at v, with ra and rb) with their ends under new names (node, comp, rooted); those within one component or between markers' trees go, and of several between two components the best stays."""
    for end in "ab":
        new = names.select(*OF, F.col("node").alias(end), "comp", F.col("rooted").alias("own"))
        edges = edges.join(new, [*OF, end], "left").withColumns({end: F.coalesce("comp", end), f"r{end}": F.coalesce("own", f"r{end}")}).drop("comp", "own")
    edges = edges.where("a <> b and not (ra and rb)")
    best = edges.groupBy(*OF, F.least("a", "b").alias("one"), F.greatest("a", "b").alias("other")).agg(F.max_by(F.struct("a", "b", "ra", "rb", "u", "v", "lo", "hi"), order()).alias("e"))
    return kept(best.select(*OF, "e.*"), "edges")


def contract(group: pd.DataFrame) -> pd.DataFrame:
    """(image_id, label, node, comp, rooted) of the nodes that go into another, among edges of some tiles: inner ones, and those whose b lies outside."""
    image, inner = pd.factorize(group.image_id)[0], group.inner.to_numpy()
    names = pd.MultiIndex.from_arrays([np.concatenate([image, image[inner]]), np.concatenate([group.a, group.b[inner]])])
    number, nodes = names.factorize()
    a, b = number[: len(group)], np.full(len(group), -1)
    b[inner] = number[len(group) :]
    rooted = np.zeros(len(nodes), bool)
    rooted[a], rooted[b[inner]] = group.ra.to_numpy(), group.rb.to_numpy()[inner]
    rank = np.empty(len(group), np.int64)
    rank[np.lexsort([-group.v, -group.u, group.hi, group.lo])] = np.arange(len(group))
    top = contracted(a, b, rank, rooted)
    where = np.empty(len(nodes), np.int64)
    where[a], where[b[inner]] = np.arange(len(group)), np.flatnonzero(inner)
    moved, ids = np.flatnonzero(top != np.arange(len(top))), nodes.get_level_values(1).to_numpy()
    at = where[moved]
    return pd.DataFrame({"image_id": group.image_id.to_numpy()[at], "label": group.label.to_numpy()[at], "node": ids[moved], "comp": ids[top[moved]], "rooted": rooted[top[moved]]})


def forest(edges: DataFrame, roots: DataFrame, side: int = 64, rows_per_task: int = 50_000) -> DataFrame:
    """(image_id, label, node, seed): the marker that each pixel reached belongs to, by edges (edges_of) and roots (image_id, label, node, seed)."""
    kind = ", ".join(f"{c} {t}" for c, t in edges.select(*OF).dtypes) + ", node long, comp long, rooted boolean"
    none = F.lit(False)
    first = roots.select(*OF, "node", F.col("seed").alias("comp"), F.lit(True).alias("rooted"))
    ends = renamed(edges.select(*OF, F.col("u").alias("a"), F.col("v").alias("b"), none.alias("ra"), none.alias("rb"), "u", "v", "lo", "hi"), first)
    maps, shift = [], side.bit_length() - 1
    while n := ends.count():
        tile = lambda e: F.struct(F.shiftright(e, 32 + shift).alias("ty"), F.shiftright(F.col(e).bitwiseAND(0xFFFFFFFF), shift).alias("tx"))  # noqa: B023, E731
        from_ = lambda p, q, t: F.struct(*(F.col(c).alias(n) for c, n in ((p, "a"), (q, "b"), (f"r{p}", "ra"), (f"r{q}", "rb"))), tile(t).alias("tile"))  # noqa: B023, E731
        inner = tile("u") == tile("v")
        sides = F.when(inner, F.array(from_("a", "b", "u"))).otherwise(F.array(from_("a", "b", "u"), from_("b", "a", "v")))
        sent = ends.select(*OF, "u", "v", "lo", "hi", inner.alias("inner"), F.explode(sides).alias("s")).select(*OF, "s.*", "u", "v", "lo", "hi", "inner")
        tasks = -(-n // rows_per_task)
        maps.append(kept(sent.withColumn("task", F.pmod(F.xxhash64(*OF, "tile"), F.lit(tasks))).drop("tile").groupBy("task").applyInPandas(lambda g: contract(g), kind), "contracted"))
        ends, shift = renamed(ends, maps[-1]), shift + 1
        if shift > 32:
            break
    whole = None
    for m in reversed(maps):
        if whole is not None:
            on = whole.select(*OF, F.col("node").alias("comp"), F.col("comp").alias("last"), F.col("rooted").alias("there"))
            m = m.join(on, [*OF, "comp"], "left").select(*OF, "node", F.coalesce("last", "comp").alias("comp"), F.coalesce("there", "rooted").alias("rooted")).unionByName(whole)
        whole = m
    found = first if whole is None else first.unionByName(whole.where("rooted"))
    return kept(found.select(*OF, "node", F.col("comp").alias("seed")), "forest")


def merged(parts: DataFrame, borders: DataFrame, contrast: float) -> DataFrame:
    """(image_id, label, seed, part): the parts of each label, numbered from 0, that its basins (seed, light; total: the label's) make when the faintest with less than contrast of the total go, one after another, along the best border (one, other, best) to a neighbour."""
    kind = ", ".join(f"{c} {t}" for c, t in parts.select(*OF).dtypes)

    def run(basins: pd.DataFrame, edges: pd.DataFrame) -> pd.DataFrame:
        basins = basins.sort_values("seed")
        seeds = basins.seed.tolist()
        light, top = dict(zip(seeds, basins.light.tolist(), strict=True)), {v: v for v in seeds}
        near: dict = {v: {} for v in seeds}
        for one, other, order in zip(edges.one, edges.other, zip(edges.lo, edges.hi, -edges.u, -edges.v, strict=True), strict=True):
            near[one][other] = near[other][one] = order
        total, heap = float(basins.total.iloc[0]), [(v, k) for k, v in light.items()]
        heapq.heapify(heap)
        while len(light) > 1 and total > 0:
            least, k = heap[0]
            if light.get(k) != least:
                heapq.heappop(heap)
                continue
            if least / total >= contrast:
                break
            heapq.heappop(heap)
            to = max(near[k], key=near[k].get) if near[k] else min(v for v in light if v != k)
            top[k] = to
            light[to] += light.pop(k)
            heapq.heappush(heap, (light[to], to))
            for other, order in near.pop(k).items():
                del near[other][k]
                if other != to and order > near[to].get(other, (-np.inf,)):
                    near[to][other] = near[other][to] = order

        def head(v):
            while top[v] != v:
                v = top[v]
            return v

        number = {v: n for n, v in enumerate(sorted(light))}
        return basins[[*OF, "seed"]].assign(part=[number[head(v)] for v in basins.seed])

    return parts.groupBy(*OF).cogroup(borders.groupBy(*OF)).applyInPandas(run, f"{kind}, seed long, part int")


def deblend(pixels: DataFrame, segments: DataFrame, n_pixels: int, levels: int = 32, contrast: float = 0.001, mode: str = "exponential", connectivity: int = 8, side: int = 64) -> DataFrame:
    """Segments (image_id, y, x, label, parent) with labels split into parts by levels, flooding and contrast; labels are numbered anew."""
    rows = kept(lit(pixels, segments), "lit")
    found = markers(rows, n_pixels, levels, mode, connectivity)
    some = rows.join(found.select(*OF).distinct(), OF, "left_semi")
    edges = kept(edges_of(some, connectivity), "neighbours")
    owner = forest(edges, found.select(*OF, code().alias("node"), "seed"), side)
    basins = kept(some.withColumn("node", code()).join(owner, [*OF, "node"], "left").select(*PIXEL, "node", "value", "seed"), "basins")
    light = basins.where("seed is not null").groupBy(*OF, "seed").agg(F.sum("value").alias("light")).join(basins.groupBy(*OF).agg(F.sum("value").alias("total")), OF)
    at = lambda end, to: basins.select(*OF, F.col("node").alias(end), F.col("seed").alias(to))
    across = edges.join(at("u", "one"), [*OF, "u"]).join(at("v", "other"), [*OF, "v"]).where("one <> other")
    borders = across.groupBy(*OF, F.least("one", "other").alias("one"), F.greatest("one", "other").alias("other")).agg(F.max(order()).alias("e"))
    borders = borders.select(*OF, "one", "other", "e.lo", "e.hi", (-F.col("e.u")).alias("u"), (-F.col("e.v")).alias("v"))
    parts = kept(merged(light, borders, contrast), "parts")
    split = basins.join(parts, [*OF, "seed"]).select(*PIXEL, "part")
    out = kept(rows.select(*PIXEL).join(split, PIXEL, "left").withColumn("part", F.coalesce("part", F.lit(0))), "split")
    numbers = out.select(*OF, "part").distinct().withColumn("new", F.row_number().over(Window.partitionBy("image_id").orderBy("label", "part")))
    return out.join(numbers, [*OF, "part"]).select("image_id", "y", "x", F.col("new").alias("label"), F.col("label").alias("parent"))
