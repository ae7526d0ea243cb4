"""FITS files by byte ranges: a table of units, then a task for each range of rows, however large a file is.

Spark lists the files (their content is never loaded whole), tasks walk the headers and pass over the data, and
each unit is cut into pieces of whole rows that tasks read on their own. Files are opened through pyarrow, so paths may
be of any file system that it reads (local or shared folders, HDFS, S3, GCS).

Defined results: units without data and tables have a row of `units` but no pixels; integers equal to BLANK and floats
that are not finite are null and NaN; arrays of more than two axes are counted as planes, the last axis of the header being
the slowest; one-dimensional units are one row of pixels; a file that ends early or has no END is an error that names it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from math import prod

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelloom.sources.fits import BLOCK, TYPES, header

UNITS = "path string, unit int, cards map<string,string>, at long, axes array<long>, bitpix int"
#: Units with pixels.
IMAGE = "(unit = 0 or coalesce(cards['XTENSION'], 'IMAGE') = 'IMAGE') and size(axes) > 0 and not exists(axes, a -> a = 0)"
#: Values of a piece that leave a task at once.
EMITTED = 1 << 16


def located(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path as Spark names it, and the path there."""
    plain = re.sub(r"^file:/*", "/", path)
    if "://" not in plain:
        return fs.LocalFileSystem(), plain
    return fs.FileSystem.from_uri(plain)


def read_header(file, at: int) -> tuple[dict, int]:
    """Cards of the header at a place, read block by block, and where its data begins."""
    raw = b""
    file.seek(at)
    while True:
        block = file.read(BLOCK)
        if len(block) < BLOCK:
            raise ValueError("a FITS header without END")
        raw += block
        if any(block[k : k + 8].rstrip() == b"END" for k in range(0, BLOCK, 80)):
            return header(raw)[0], at + len(raw)


def walk(file, size: int) -> Iterator[tuple[int, dict, int, list[int]]]:
    """Number, cards, place of the data and axes (slowest first) of each unit."""
    at = number = 0
    while at < size:
        cards, at = read_header(file, at)
        axes = [int(cards[f"NAXIS{k}"]) for k in range(int(cards.get("NAXIS", 0)), 0, -1)]
        yield number, cards, at, axes
        length = (prod(axes) if axes else 0) * abs(int(cards["BITPIX"])) // 8 + int(cards.get("PCOUNT", 0))
        at += -(-length // BLOCK) * BLOCK
        number += 1


def units(spark: SparkSession, path: str, files_a_task: int = 64) -> DataFrame:
    """(path, unit, cards, at, axes, bitpix): all units of all files under a path; at: the byte where a unit's data begins; axes: slowest first."""
    listed = spark.read.format("binaryFile").load(path).select("path", "length")
    tasks = max(1, -(-listed.count() // files_a_task))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for files in batches:
            for name, size in zip(files.path, files.length, strict=True):
                system, there = located(name)
                with system.open_input_file(there) as file:
                    try:
                        rows = [(name, n, {k: str(v) for k, v in cards.items()}, at, axes, int(cards["BITPIX"])) for n, cards, at, axes in walk(file, size)]
                    except (ValueError, KeyError) as e:
                        raise ValueError(f"{name}: {e}") from e
                yield pd.DataFrame(rows, columns=["path", "unit", "cards", "at", "axes", "bitpix"])

    return listed.repartition(tasks, "path").mapInPandas(run, UNITS)


def pixels(found: DataFrame, piece: int = 16 << 20) -> DataFrame:
    """(path, unit, plane, y, x, value) of the image units in `found` (rows of units()), each read by ranges of whole rows of about `piece` bytes."""
    image = found.where(IMAGE)
    width = F.element_at("axes", -1)
    lines = F.aggregate(F.slice("axes", 1, F.size("axes") - 1), F.lit(1).cast("long"), lambda n, a: n * a)
    each = F.greatest(F.lit(1).cast("long"), F.floor(F.lit(piece) / (width * F.abs("bitpix") / 8)))
    number = lambda key, usual: F.coalesce(F.col("cards")[key].cast("double"), F.lit(float(usual)))
    sized = image.select("path", "unit", "at", "bitpix", width.alias("width"), lines.alias("lines"), each.alias("each"), F.when(F.size("axes") > 1, F.element_at("axes", -2)).otherwise(F.lit(1)).alias("height"), number("BSCALE", 1).alias("scale"), number("BZERO", 0).alias("zero"), F.col("cards")["BLANK"].cast("long").alias("blank"))
    pieces = sized.withColumn("first", F.explode(F.expr("sequence(0L, lines - 1, each)")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for p in batch.to_pylist():
                kind, n = np.dtype(TYPES[p["bitpix"]]), min(p["each"], p["lines"] - p["first"]) * p["width"]
                begin = p["first"] * p["width"]
                system, there = located(p["path"])
                with system.open_input_file(there) as file:
                    raw = file.read_at(int(n * kind.itemsize), int(p["at"] + begin * kind.itemsize))
                if len(raw) < n * kind.itemsize:
                    raise ValueError(f"{p['path']}: unit {p['unit']} ends early")
                data = np.frombuffer(raw, kind)
                for k in range(0, n, EMITTED):
                    some = data[k : k + EMITTED]
                    line, x = np.divmod(np.arange(begin + k, begin + k + len(some)), p["width"])
                    plane, y = np.divmod(line, p["height"])
                    empty = some == p["blank"] if p["blank"] is not None and p["bitpix"] > 0 else None
                    value = pa.array(some.astype(float) * p["scale"] + p["zero"], mask=empty)
                    same = [pa.array([p[c]]).take(pa.array(np.zeros(len(some), np.int32))) for c in ("path", "unit")]
                    yield pa.record_batch([same[0], same[1].cast(pa.int32()), *(pa.array(v.astype(np.int32)) for v in (plane, y, x)), value], names=["path", "unit", "plane", "y", "x", "value"])

    # a piece a task or nearly so: pieces are few bytes as rows and many as data
    return pieces.repartition("path", "unit", "first").mapInArrow(run, "path string, unit int, plane int, y int, x int, value double")
