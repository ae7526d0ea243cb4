"""Outlines of labels as polygons: straight sides chained to ordered rings. `segments`: image_id, y, x, label (> 0 only).

A pixel reaches half a pixel from its centre on each side, so corners lie at halves. Sides have their label on the left (x to the
right, y upwards): outer rings turn one way and have positive areas, rings around holes the other way and negative ones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pixelloom.functions.tables import kept

LABEL = ["image_id", "label"]
EAST, NORTH, WEST, SOUTH = range(4)


def sides(segments: DataFrame) -> DataFrame:
    """(image_id, label, ax, ay, bx, by, way): the longest straight sides from corner a to corner b; corner (0, 0) is the lower left one of pixel (0, 0).

    A pixel's edge that two pixels of a label share is none of its outline. What remains of one line of a label and one direction is one window.
    """
    edge = lambda axis, line, at, forward: F.struct(F.lit(axis).alias("axis"), line.cast("int").alias("line"), at.cast("int").alias("at"), F.lit(forward).alias("forward"))
    x, y = F.col("x"), F.col("y")
    four = F.array(edge(0, y, x, True), edge(0, y + 1, x, False), edge(1, x + 1, y, True), edge(1, x, y, False))
    single = segments.select(*LABEL, F.inline(four)).groupBy(*LABEL, "axis", "line", "at").agg(F.count("*").alias("n"), F.first("forward").alias("forward")).where("n = 1")
    line = [*LABEL, "axis", "line", "forward"]
    stretch = single.withColumn("stretch", F.col("at") - F.row_number().over(Window.partitionBy(*line).orderBy("at")))
    found = stretch.groupBy(*line, "stretch").agg(F.min("at").alias("low"), (F.max("at") + 1).alias("high"))
    a, b = F.when(F.col("forward"), F.col("low")).otherwise(F.col("high")), F.when(F.col("forward"), F.col("high")).otherwise(F.col("low"))
    flat = F.col("axis") == 0
    way = F.when(flat, F.when(F.col("forward"), EAST).otherwise(WEST)).otherwise(F.when(F.col("forward"), NORTH).otherwise(SOUTH))
    pick = lambda c, d, name: F.when(flat, c).otherwise(d).alias(name)
    return found.select(*LABEL, pick(a, F.col("line"), "ax"), pick(F.col("line"), a, "ay"), pick(b, F.col("line"), "bx"), pick(F.col("line"), b, "by"), way.alias("way"))


def _side(x, y, way):
    """The number of the side that leaves a corner in a direction."""
    return y.cast("long") * (1 << 32) + (x.cast("long") + (1 << 29)) * 4 + way


def polygons(segments: DataFrame, connectivity: int = 8) -> DataFrame:
    """(image_id, label, ring, place, x, y, x_next, y_next): the corners of each label's rings in order, from 0, each with the corner that follows.

    ring numbers are unique within a label. Where two pixels of a label touch by a corner alone, the ring goes on to the other pixel
    (connectivity 8) or turns back along its own (4). Each side finds its ring's least side and the steps to it by pointers that
    double their reach: as many small joins as the longest ring's number of sides has binary digits, and no ring is one task's.
    An empty table gives no rows; rows that repeat a pixel count once.
    """
    found = kept(sides(segments.select(*LABEL, "y", "x").distinct()).withColumn("id", _side(F.col("ax"), F.col("ay"), F.col("way"))), "sides")
    leaving = found.groupBy(*LABEL, F.col("ax").alias("bx"), F.col("ay").alias("by")).agg(F.count("*").alias("n"), F.min("way").alias("only"))
    turn = (F.col("way") + (3 if connectivity == 8 else 1)) % 4
    on = _side(F.col("bx"), F.col("by"), F.when(F.col("n") > 1, turn).otherwise(F.col("only")))
    state = found.join(leaving, [*LABEL, "bx", "by"]).select(*LABEL, "id", on.alias("next"), F.col("id").alias("low"), F.lit(0).cast("long").alias("steps"))
    state, reach = kept(state, "pointers"), 1
    while True:
        there = state.select(*LABEL, F.col("id").alias("next"), F.col("next").alias("beyond"), F.col("low").alias("its_low"), F.col("steps").alias("its_steps"))
        lower = F.col("its_low") < F.col("low")
        new = state.join(there, [*LABEL, "next"]).select(*LABEL, "id", F.col("beyond").alias("next"), F.least("low", "its_low").alias("low"), F.when(lower, F.col("its_steps") + reach).otherwise(F.col("steps")).alias("steps"), lower.alias("changed"))
        new = kept(new, "pointers")
        done = new.where("changed").isEmpty()
        state, reach = new.drop("changed"), 2 * reach
        if done:
            break
    sizes = state.groupBy(*LABEL, "low").agg(F.count("*").alias("n"))
    placed = state.join(sizes, [*LABEL, "low"]).select(*LABEL, "id", F.col("low").alias("ring"), ((F.col("n") - F.col("steps")) % F.col("n")).alias("place"))
    half = lambda c, name: (F.col(c) - 0.5).alias(name)
    return found.join(placed, [*LABEL, "id"]).select(*LABEL, "ring", "place", half("ax", "x"), half("ay", "y"), half("bx", "x_next"), half("by", "y_next"))


def rings(corners: DataFrame) -> DataFrame:
    """(image_id, label, ring, n_corners, area, length, is_hole) of polygons(); a hole's area is negative."""
    area = F.sum(F.col("x") * F.col("y_next") - F.col("x_next") * F.col("y")) / 2
    length = F.sum(F.abs(F.col("x_next") - F.col("x")) + F.abs(F.col("y_next") - F.col("y")))
    return corners.groupBy(*LABEL, "ring").agg(F.count("*").alias("n_corners"), area.alias("area"), length.alias("length")).withColumn("is_hole", F.col("area") < 0)


def outlines(corners: DataFrame) -> DataFrame:
    """(image_id, label, n_rings, n_holes, n_corners, area, length) of each label; the area is its number of pixels."""
    hole = F.col("is_hole").cast("int")
    return rings(corners).groupBy(*LABEL).agg(F.count("*").alias("n_rings"), F.sum(hole).alias("n_holes"), F.sum("n_corners").alias("n_corners"), F.sum("area").alias("area"), F.sum("length").alias("length"))
