"""Segmentation: thresholds, connected labels, label algebra. `segments`: image_id, y, x, label (> 0 only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pixelloom.functions.tables import kept
from pixelloom.operators import stats

FOUR = [(0, 1), (1, 0)]
EIGHT = [*FOUR, (1, 1), (1, -1)]


def threshold(pixels: DataFrame, n_sigma: float, rounds: int = 10) -> DataFrame:
    """(image_id, threshold): clipped mean plus n_sigma clipped standard deviations."""
    rest = stats.sigma_clip(pixels.where(~F.coalesce("mask", F.lit(False))).select("image_id", "value"), ["image_id"], rounds=rounds, centre="mean")
    return rest.groupBy("image_id").agg((F.avg("value") + n_sigma * F.stddev_pop("value")).alias("threshold"))


def label(pixels: DataFrame, over: Column, n_pixels: int = 1, connectivity: int = 8) -> DataFrame:
    """segments of the connected pixels where `over` holds. Components of fewer than n_pixels are dropped, the rest numbered in raster order of their first pixel.

    Runs along rows come first (one window), then the least run number spreads over touching runs by large and
    small steps of joins, each round written down; so a large component costs few rounds and no task sees it whole.
    """
    on = pixels.where(over).select("image_id", "y", "x")
    row = Window.partitionBy("image_id", "y").orderBy("x")
    start = F.when(F.coalesce(F.col("x") - F.lag("x").over(row), F.lit(2)) != 1, F.col("x"))
    runs = on.withColumn("x_start", F.last(start, ignorenulls=True).over(row.rowsBetween(Window.unboundedPreceding, 0)))
    runs = runs.withColumn("run", F.col("y").cast("long") * (1 << 31) + F.col("x_start"))
    runs = kept(runs, "runs")
    steps = EIGHT if connectivity == 8 else FOUR
    edges = None
    for dy, dx in steps:
        if dy:
            other = runs.select("image_id", (F.col("y") - dy).alias("y"), (F.col("x") - dx).alias("x"), F.col("run").alias("b"))
            found = runs.join(other, ["image_id", "y", "x"]).select("image_id", F.col("run").alias("a"), "b").distinct()
            edges = found if edges is None else edges.unionByName(found)
    both = kept(edges.unionByName(edges.select("image_id", F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    names = kept(runs.select("image_id", "run", F.col("run").alias("root")).distinct(), "roots")
    while True:
        low = both.join(names, (both["image_id"] == names["image_id"]) & (both["b"] == names["run"])).select(both["image_id"], "a", "root").groupBy("image_id", F.col("a").alias("run")).agg(F.min("root").alias("low"))
        new = names.join(low, ["image_id", "run"], "left").select("image_id", "run", F.least("root", "low").alias("root"))
        jump = new.select("image_id", F.col("run").alias("root"), F.col("root").alias("further"))
        new = kept(new.join(jump, ["image_id", "root"], "left").select("image_id", "run", F.least("root", "further").alias("root")), "roots")
        changed = new.join(names.withColumnRenamed("root", "was"), ["image_id", "run"]).where("root <> was").isEmpty()
        names = new
        if changed:
            break
    found = runs.join(names, ["image_id", "run"])
    sizes = found.groupBy("image_id", "root").agg(F.count("*").alias("n")).where(F.col("n") >= n_pixels)
    order = sizes.withColumn("label", F.dense_rank().over(Window.partitionBy("image_id").orderBy("root")))
    return found.join(order, ["image_id", "root"]).select("image_id", "y", "x", "label")


def summary(pixels: DataFrame, segments: DataFrame) -> DataFrame:
    """(image_id, n_labels, max_label, is_consecutive, background_area) of each image; labels are consecutive if they run from 1 without a gap."""
    own = segments.groupBy("image_id").agg(F.count_distinct("label").alias("n_labels"), F.max("label").alias("max_label"), F.min("label").alias("low"), F.count("*").alias("n"))
    whole = pixels.groupBy("image_id").agg(F.count("*").alias("all"))
    n, top = F.coalesce("n_labels", F.lit(0)), F.coalesce("max_label", F.lit(0))
    consecutive = (n > 0) & (F.col("low") == 1) & (n == top)
    return whole.join(own, "image_id", "left").select("image_id", n.cast("long").alias("n_labels"), top.cast("int").alias("max_label"), F.coalesce(consecutive, F.lit(False)).alias("is_consecutive"), (F.col("all") - F.coalesce("n", F.lit(0))).alias("background_area"))


def get_segments(pixels: DataFrame, segments: DataFrame, labels: list[int]) -> DataFrame:
    """The pixels of these labels, with values; labels that no pixel has are refused."""
    check_labels(segments, labels)
    return pixels.join(segments.where(F.col("label").isin([int(v) for v in labels])), ["image_id", "y", "x"])


def check_labels(segments: DataFrame, labels: list[int]) -> None:
    """Raises for labels that no pixel has."""
    lacking = set(labels) - {r["label"] for r in segments.where(F.col("label").isin([int(v) for v in labels])).select("label").distinct().collect()}
    if lacking:
        raise ValueError(f"no such labels: {sorted(lacking)}")


def children_of(found: DataFrame) -> DataFrame:
    """(image_id, parent, children): the sorted labels that deblending made of each parent that was split, from (label, parent) of deblend()."""
    return found.select("image_id", "label", "parent").distinct().groupBy("image_id", "parent").agg(F.array_sort(F.collect_set("label")).alias("children")).where(F.size("children") > 1)


def areas(segments: DataFrame) -> DataFrame:
    return segments.groupBy("image_id", "label").agg(F.count("*").alias("area"))


def boxes(segments: DataFrame) -> DataFrame:
    """Inclusive bounding boxes."""
    return segments.groupBy("image_id", "label").agg(F.min("x").alias("x_min"), F.max("x").alias("x_max"), F.min("y").alias("y_min"), F.max("y").alias("y_max"))


def relabel(segments: DataFrame, start: int = 1) -> DataFrame:
    """Labels without gaps, in the same order. Ranks run over labels, not pixels."""
    ranks = segments.select("image_id", "label").distinct().withColumn("new", (F.dense_rank().over(Window.partitionBy("image_id").orderBy("label")) + (start - 1)).cast("int"))
    return segments.join(ranks, ["image_id", "label"]).select("image_id", "y", "x", F.col("new").alias("label"))


def keep_labels(segments: DataFrame, labels: DataFrame) -> DataFrame:
    return segments.join(labels.select("label").distinct(), "label", "left_semi").select("image_id", "y", "x", "label")


def remove_labels(segments: DataFrame, labels: DataFrame) -> DataFrame:
    return segments.join(labels.select("label").distinct(), "label", "left_anti").select("image_id", "y", "x", "label")


def reassign(segments: DataFrame, mapping: dict[int, int]) -> DataFrame:
    """Labels replaced by others; 0 removes."""
    table = F.create_map(*[F.lit(v) for pair in mapping.items() for v in pair])
    return segments.withColumn("label", F.coalesce(F.try_element_at(table, F.col("label")), F.col("label"))).where("label > 0")


def remove_border_labels(segments: DataFrame, height: int, width: int, border: int, partly: bool = True) -> DataFrame:
    """Without the labels that touch the border (partly), or that lie in it whole."""
    edge = (F.col("y") < border) | (F.col("x") < border) | (F.col("y") >= height - border) | (F.col("x") >= width - border)
    return _without(segments, segments.withColumn("hit", edge), partly)


def remove_masked_labels(segments: DataFrame, mask: DataFrame, partly: bool = True) -> DataFrame:
    """Without the labels that lie in the mask (image_id, y, x) with a pixel (partly), or whole."""
    marked = segments.join(mask.select("image_id", "y", "x").distinct().withColumn("hit", F.lit(True)), ["image_id", "y", "x"], "left").withColumn("hit", F.coalesce("hit", F.lit(False)))
    return _without(segments, marked, partly)


def _without(segments: DataFrame, marked: DataFrame, partly: bool) -> DataFrame:
    bad = marked.groupBy("image_id", "label").agg((F.max("hit") if partly else F.min("hit")).alias("hit")).where("hit")
    return segments.join(bad, ["image_id", "label"], "left_anti").select("image_id", "y", "x", "label")


def missing_labels(segments: DataFrame) -> DataFrame:
    """Labels between 1 and the largest that no pixel has."""
    every = segments.groupBy("image_id").agg(F.max("label").alias("top")).select("image_id", F.explode(F.sequence(F.lit(1), F.col("top").cast("int"))).alias("label"))
    return every.join(segments.select("image_id", "label").distinct(), ["image_id", "label"], "left_anti")


def source_mask(segments: DataFrame, half: int) -> DataFrame:
    """Pixels within a box of 2 half + 1 around any labelled pixel."""
    steps = F.sequence(F.lit(-half), F.lit(half))
    rows = segments.select("image_id", "x", F.explode(F.transform(steps, lambda i: F.col("y") + i)).alias("y")).distinct()
    return rows.select("image_id", "y", F.explode(F.transform(steps, lambda i: F.col("x") + i)).alias("x")).distinct()


def label_mapping(parents: DataFrame, children: DataFrame) -> DataFrame:
    """For each label of parents the sorted labels of children on its pixels."""
    c = children.select("image_id", "y", "x", F.col("label").alias("child"))
    return parents.join(c, ["image_id", "y", "x"]).groupBy("image_id", "label").agg(F.array_sort(F.collect_set("child")).alias("children"))


def perimeter(segments: DataFrame) -> DataFrame:
    """Perimeter of each label from its border pixels (those with a 4-neighbour outside): a border pixel counts by the border pixels around it."""
    shift = lambda dy, dx: segments.select("image_id", "label", (F.col("y") + dy).alias("y"), (F.col("x") + dx).alias("x"))
    near = shift(0, 1).union(shift(0, -1)).union(shift(1, 0)).union(shift(-1, 0)).groupBy("image_id", "label", "y", "x").agg(F.count("*").alias("n"))
    border = segments.join(near, ["image_id", "label", "y", "x"], "left").where(F.coalesce("n", F.lit(0)) < 4).select("image_id", "label", "y", "x")
    code = None
    for dy in (-1, 0, 1):
        for dx in (-1, 0, 1):
            w = 1 if not dy and not dx else 2 if not dy or not dx else 10
            part = border.select("image_id", "label", (F.col("y") + dy).alias("y"), (F.col("x") + dx).alias("x"), F.lit(w).alias("w"))
            code = part if code is None else code.union(part)
    codes = code.groupBy("image_id", "label", "y", "x").agg(F.sum("w").alias("code")).join(border, ["image_id", "label", "y", "x"])
    one, root2 = F.col("code").isin(5, 7, 15, 17, 25, 27), F.col("code").isin(21, 33)
    length = F.when(one, 1.0).when(root2, 2**0.5).when(F.col("code").isin(13, 23), (1 + 2**0.5) / 2).otherwise(0.0)
    return codes.groupBy("image_id", "label").agg(F.sum(length).alias("perimeter"))
