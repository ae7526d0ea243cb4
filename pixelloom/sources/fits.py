"""FITS images as pixels, read by ranges (see units), and files of one image."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession

BLOCK, CARD = 2880, 80
NAME = "element_at(split(path, '/'), -1) as image_id"
#: NumPy types by BITPIX.
TYPES = {8: ">u1", 16: ">i2", 32: ">i4", 64: ">i8", -32: ">f4", -64: ">f8"}


def header(data: bytes, at: int = 0) -> tuple[dict, int]:
    """The cards of the header at a place, and where its data begins."""
    cards: dict = {}
    while at < len(data):
        for k in range(at, at + BLOCK, CARD):
            card = data[k : k + CARD].decode("ascii", "replace")
            key = card[:8].strip()
            if key == "END":
                return cards, at + BLOCK
            if card[8:10] == "= ":
                text = card[10:].strip()
                if text.startswith("'"):
                    cards[key] = text[1:].split("'")[0].rstrip()
                else:
                    word = text.split("/")[0].strip()
                    cards[key] = word == "T" if word in "TF" else float(word.replace("D", "E")) if any(c in word for c in ".ED") else int(word)
        at += BLOCK
    raise ValueError("a FITS header without END")


def read_fits(spark: SparkSession, path: str) -> DataFrame:
    """(image_id, unit, y, x, value) of all two-dimensional units under a path; image_id is the file's name."""
    from pixelloom.sources.units import pixels, units

    return pixels(units(spark, path).where("size(axes) = 2")).selectExpr(NAME, "unit", "y", "x", "value")


def read_headers(spark: SparkSession, path: str) -> DataFrame:
    """(image_id, unit, cards) of all image units with data under a path."""
    from pixelloom.sources.units import IMAGE, units

    return units(spark, path).where(IMAGE).selectExpr(NAME, "unit", "cards")


def to_fits(plane: np.ndarray, cards: dict | None = None) -> bytes:
    """A FITS file of one image of doubles."""
    own = {"SIMPLE": True, "BITPIX": -64, "NAXIS": 2, "NAXIS1": plane.shape[1], "NAXIS2": plane.shape[0]} | (cards or {})
    said = lambda v: f"{'T' if v else 'F':>20}" if isinstance(v, bool) else f"'{v:<8}'" if isinstance(v, str) else f"{v:>20}"
    text = "".join(f"{k:<8}= {said(v)}".ljust(CARD) for k, v in own.items()) + "END".ljust(CARD)
    text = text.ljust(-(-len(text) // BLOCK) * BLOCK)
    body = plane.astype(">f8").tobytes()
    return text.encode() + body.ljust(-(-len(body) // BLOCK) * BLOCK, b"\0")
