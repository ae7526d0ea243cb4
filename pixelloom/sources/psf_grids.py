"""Grids of point-source shapes in files: a cube of planes whose header says where on the detector each one belongs.

Two layouts are read. "standard" cubes have the grid's lines in IPSFXnn and JPSFYnn, counted from 1 (or several to a card,
IPSFXA5 ...), 4 samples a pixel, and may hold the grids of several detectors side by side. "simulated" cubes have a place
(y, x) for each plane in DET_YXn, and OVERSAMP. Files of neither kind are left out. What is read is a row a sample, so that a
detector is chosen by a filter, which Spark takes to the grid's nodes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelloom.functions.tables import shared_path
from pixelloom.sources.fits import BLOCK, CARD
from pixelloom.sources.units import located, pixels, units

#: By number of planes, the detectors across and up, pixels a side of one, and the detectors' numbers from the lowest row up, from left to right.
LAYOUTS = {
    36: (2, 2, 800, (3, 4, 2, 1)),
    56: (1, 2, 2048, (1, 2)),
    90: (1, 2, 2048, (1, 2)),
    200: (4, 2, 2048, (1, 3, 8, 6, 2, 4, 7, 5)),
}
#: Cards that hold several lines of the grid each.
SEVERAL_X, SEVERAL_Y = ("IPSFXA5", "IPSFXB5", "IPSFXC5", "IPSFXD5"), ("JPSFYA5", "JPSFYB5")
NODES = "path string, instrument string, filter string, detector int, node int, gx double, gy double, oversampling int"


def standard_places(cards: dict[str, str], planes: int) -> list[tuple[int | None, float, float]]:
    """Detector, x and y (from 0, on that detector) of each plane of a standard cube."""
    across, up = int(cards["NXPSFS"]), int(cards["NYPSFS"])
    if "IPSFX01" in cards:
        xs, ys = ([float(cards[f"{key}{k:02d}"]) - 1 for k in range(1, n + 1)] for key, n in (("IPSFX", across), ("JPSFY", up)))
    elif SEVERAL_X[0] in cards:
        xs, ys = ([float(v) - 1 for key in keys for v in cards[key].split()] for keys in (SEVERAL_X, SEVERAL_Y))
    else:
        raise ValueError("no lines of the grid (IPSFX01 or IPSFXA5)")
    if planes != across * up or (len(xs), len(ys)) != (across, up):
        raise ValueError(f"{planes} planes, but a grid of {across} x {up}")
    columns, rows, side, numbers = LAYOUTS.get(planes, (1, 1, 0, (None,)))
    out = []
    for plane in range(planes):
        line, column = divmod(plane, across)
        row, part = line // (up // rows), column // (across // columns)
        out.append((numbers[row * columns + part], xs[column] - part * side, ys[line] - row * side))
    return out


def simulated_places(cards: dict[str, str], planes: int) -> list[tuple[int | None, float, float]]:
    """x and y of each plane of a simulated cube, in order of the cards' numbers."""
    keys = sorted((int(k[6:]), k) for k in cards if k.startswith("DET_YX") and k[6:].isdigit())
    if len(keys) != planes:
        raise ValueError(f"{planes} planes, but {len(keys)} places (DET_YX)")
    pairs = [[float(v) for v in cards[k].strip("() ").split(",")] for _, k in keys]
    return [(None, x, y) for y, x in pairs]


def nodes(found: DataFrame) -> DataFrame:
    """NODES: a row for each plane of the cubes among `found` (rows of units()). instrument and filter come from a file's name, parted by "_"; null where it has not three or four parts."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = []
            for path, cards, axes in zip(rows["path"], rows["cards"], rows["axes"], strict=True):
                cards = dict(cards)
                planes = int(axes[0]) if len(axes) == 3 else 1
                kind = "standard" if {"NAXIS3", "NXPSFS", "NYPSFS"} <= cards.keys() else "simulated" if "OVERSAMP" in cards and any(c.startswith("DET_YX") for c in cards) else None
                if kind is None or len(axes) not in (2, 3):
                    continue
                try:
                    places = standard_places(cards, planes) if kind == "standard" else simulated_places(cards, planes)
                except (KeyError, ValueError) as e:
                    raise ValueError(f"{path}: {e}") from e
                parts = path.rsplit("/", 1)[-1].split(".")[0].split("_")
                named = parts[1:3] if len(parts) in (3, 4) else [None, None]
                over = 4 if kind == "standard" else int(float(cards["OVERSAMP"]))
                out += [(path, *named, d, n, x, y, over) for n, (d, x, y) in enumerate(places)]
            frame = pd.DataFrame(out, columns=[c.split()[0] for c in NODES.split(", ")])
            yield frame.astype({"detector": "Int32"})

    return found.where("unit = 0").select("path", "cards", "axes").mapInPandas(run, NODES)


def read_grids(spark: SparkSession, path: str) -> DataFrame:
    """NODES and (j, i, value): the samples of all grids under a path."""
    found = units(spark, path)
    samples = pixels(found.where("unit = 0")).select("path", F.col("plane").alias("node"), F.col("y").alias("j"), F.col("x").alias("i"), "value")
    return samples.join(nodes(found), ["path", "node"]).select(*(c.split()[0] for c in NODES.split(", ")), "j", "i", "value")


def evaluate(grids: DataFrame, at: DataFrame) -> DataFrame:
    """(path, detector, id, j, i, value): the shape of each grid at the places `at` (id, x, y; detector, path where given), bilinear between the four nodes around, and the nearest edge's outside the grid.

    A grid's lines are arrays, joined with the places by grid; the four nodes of a place are looked up by an equi-join on (grid, x, y). Places on a detector without a grid give no row; so do those with a null x or y.
    """
    own = ["path", "detector"]
    at = at.where("x is not null and y is not null")
    lines = grids.groupBy(*own).agg(F.array_sort(F.collect_set("gx")).alias("xs"), F.array_sort(F.collect_set("gy")).alias("ys"))
    given = [c for c in own if c in at.columns]
    place = at.select("id", "x", "y", *(F.col(c).alias(f"at_{c}") for c in given))
    condition = F.lit(True)
    for c in given:
        condition &= F.col(c).eqNullSafe(F.col(f"at_{c}"))
    rows = place.join(lines, condition).drop(*(f"at_{c}" for c in given))
    for c in "xy":
        rows = rows.withColumn(c, F.expr(f"least(greatest({c}, {c}s[0]), element_at({c}s, -1))"))
        rows = rows.withColumn(f"{c}0", F.expr(f"array_max(filter({c}s, g -> g <= {c}))")).withColumn(f"{c}1", F.expr(f"coalesce(array_min(filter({c}s, g -> g > {c})), {c}0)"))
        rows = rows.withColumn(f"t{c}", F.coalesce(F.try_divide(F.col(c) - F.col(f"{c}0"), F.col(f"{c}1") - F.col(f"{c}0")), F.lit(0.0)))
    share = lambda c, far: F.col(f"t{c}") if far else 1 - F.col(f"t{c}")
    corners = F.array(*(F.struct(F.col(f"x{a}").alias("gx"), F.col(f"y{b}").alias("gy"), (share("x", a) * share("y", b)).alias("w")) for a in (0, 1) for b in (0, 1)))
    sent = rows.select(*own, "id", F.inline(corners)).where("w > 0")
    node = grids.groupBy(*own, "gx", "gy").agg(F.collect_list(F.struct("j", "i", "value")).alias("samples"))
    right = node.select(*(F.col(c).alias(f"n_{c}") for c in node.columns))
    met = sent.join(right, (F.col("gx") == F.col("n_gx")) & (F.col("gy") == F.col("n_gy")) & (F.col("path") == F.col("n_path")) & F.col("detector").eqNullSafe(F.col("n_detector")))
    return met.select(*own, "id", "w", F.inline("n_samples")).groupBy(*own, "id", "j", "i").agg(F.sum(F.col("w") * F.col("value")).alias("value"))


def write_cubes(cells: DataFrame, cards: dict, shape: tuple[int, int, int], name: str = "grids") -> str:
    """Writes a cube of doubles for each `file` of cells (file, plane, y, x, value; what has no row is 0) into a new folder of the session's shared one, and returns it.

    cards go into each header. A file is one task's work, and its size is the shape's. It gets its name once it is whole, so that a repeated task does no harm.
    """
    folder = shared_path(cells.sparkSession, name)
    own = {"SIMPLE": True, "BITPIX": -64, "NAXIS": 3, "NAXIS1": shape[2], "NAXIS2": shape[1], "NAXIS3": shape[0]} | cards
    said = lambda v: f"{'T' if v else 'F':>20}" if isinstance(v, bool) else f"'{v:<8}'" if isinstance(v, str) else f"{v:>20}"
    text = "".join(f"{k:<8}= {said(v)}".ljust(CARD) for k, v in own.items()) + "END".ljust(CARD)
    head = text.ljust(-(-len(text) // BLOCK) * BLOCK).encode()

    def write(rows: pd.DataFrame) -> pd.DataFrame:
        cube = np.zeros(shape, ">f8")
        cube[rows.plane, rows.y, rows.x] = rows.value
        body = cube.tobytes()
        file = str(rows.file.iloc[0])
        system, there = located(f"{folder}/{file}")
        parent = there.rsplit("/", 1)[0]
        system.create_dir(parent, recursive=True)
        part = f"{parent}/.{file}.{np.random.default_rng().integers(1 << 62)}"  # Spark doesn't list names that begin with a dot
        with system.open_output_stream(part) as out:
            out.write(head + body.ljust(-(-len(body) // BLOCK) * BLOCK, b"\0"))
        system.move(part, there)
        return pd.DataFrame({"file": [file]})

    cells.select("file", "plane", "y", "x", "value").groupBy("file").applyInPandas(write, "file string").count()
    return folder
