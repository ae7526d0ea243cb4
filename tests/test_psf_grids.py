"""FITS files by byte ranges, and grids of point-source shapes read from them."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from pixelloom.sources import psf_grids, units
from pixelloom.sources.fits import BLOCK, CARD, to_fits


def unit(data: np.ndarray, cards: dict, extension: bool = False) -> bytes:
    bits = {"u1": 8, "i2": 16, "i4": 32, "i8": 64, "f4": -32, "f8": -64}[data.dtype.str[1:]]
    own = ({"XTENSION": "IMAGE"} if extension else {"SIMPLE": True}) | {"BITPIX": bits, "NAXIS": data.ndim} | {f"NAXIS{k + 1}": n for k, n in enumerate(data.shape[::-1])} | cards
    said = lambda v: f"{'T' if v else 'F':>20}" if isinstance(v, bool) else f"'{v:<8}'" if isinstance(v, str) else f"{v:>20}"
    text = "".join(f"{k:<8}= {said(v)}".ljust(CARD) for k, v in own.items()) + "END".ljust(CARD)
    body = data.tobytes()
    return text.ljust(-(-len(text) // BLOCK) * BLOCK).encode() + body.ljust(-(-len(body) // BLOCK) * BLOCK, b"\0")


def test_units_by_ranges(spark, tmp_path):
    rng = np.random.default_rng(2)
    cube = rng.normal(size=(3, 7, 5)).astype(">f4")
    small = rng.integers(0, 9, (4, 6)).astype(">i2")
    empty = {"XTENSION": "IMAGE", "BITPIX": 8, "NAXIS": 0}
    head = "".join(x.ljust(CARD) for x in [f"{k:<8}= " + (f"'{v:<8}'" if isinstance(v, str) else f"{v:>20}") for k, v in empty.items()]) + "END".ljust(CARD)
    many = {f"KEY{k}": k for k in range(60)}  # a header of three blocks
    (tmp_path / "a b.fits").write_bytes(unit(cube, many) + head.ljust(BLOCK).encode() + unit(small, {"BLANK": 3, "BSCALE": 2.0, "BZERO": 1.0}, True) + unit(np.arange(4).astype(">i4"), {}, True))
    found = units.units(spark, str(tmp_path))
    assert [(r.unit, r.axes) for r in found.orderBy("unit").collect()] == [(0, [3, 7, 5]), (1, []), (2, [4, 6]), (3, [4])]
    assert found.where("unit = 0").first().cards["KEY59"] == "59"
    for piece in (1, 50, 1 << 20):  # a row a piece, some rows, whole units
        rows = units.pixels(found, piece).collect()
        got = {(r.unit, r.plane, r.y, r.x): r.value for r in rows}
        want = {(0, *at): float(v) for at, v in np.ndenumerate(cube)} | {(2, 0, *at): None if v == 3 else v * 2.0 + 1 for at, v in np.ndenumerate(small)} | {(3, 0, 0, k): float(k) for k in range(4)}
        assert len(rows) == len(want) and got == want


def test_broken_files_are_named(spark, tmp_path):
    whole = to_fits(np.ones((50, 50)))
    (tmp_path / "short.fits").write_bytes(whole[: BLOCK * 2])
    with pytest.raises(Exception, match="short.fits"):
        units.pixels(units.units(spark, str(tmp_path))).count()
    (tmp_path / "short.fits").write_bytes(b"SIMPLE".ljust(BLOCK))
    with pytest.raises(Exception, match="without END"):
        units.units(spark, str(tmp_path)).count()


@pytest.mark.parametrize(("across", "up", "size", "numbers"), [(6, 6, 800, {3: (0, 0), 4: (1, 0), 2: (0, 1), 1: (1, 1)}), (7, 8, 2048, {1: (0, 0), 2: (0, 1)}), (20, 10, 2048, {1: (0, 0), 3: (1, 0), 8: (2, 0), 6: (3, 0), 2: (0, 1), 4: (1, 1), 7: (2, 1), 5: (3, 1)})])
def test_detectors_apart(across, up, size, numbers):
    wide, high = max(c for c, _ in numbers.values()) + 1, 2
    xs, ys = ([1 + 10 * (k % (n // parts)) + size * (k // (n // parts)) for k in range(n)] for n, parts in ((across, wide), (up, high)))
    cards = {"NXPSFS": str(across), "NYPSFS": str(up)} | {f"IPSFX{k + 1:02d}": str(v) for k, v in enumerate(xs)} | {f"JPSFY{k + 1:02d}": str(v) for k, v in enumerate(ys)}
    places = psf_grids.standard_places(cards, across * up)
    assert len(set(places)) == across * up
    for plane, (detector, x, y) in enumerate(places):
        line, column = divmod(plane, across)
        assert numbers[detector] == (column // (across // wide), line // (up // high))
        assert (x, y) == (10 * (column % (across // wide)), 10 * (line % (up // high)))


def test_several_lines_a_card():
    cards = {"NXPSFS": "4", "NYPSFS": "2", "IPSFXA5": "1 11", "IPSFXB5": "21", "IPSFXC5": "31", "IPSFXD5": "", "JPSFYA5": "1", "JPSFYB5": "101"}
    assert psf_grids.standard_places(cards, 8)[5] == (None, 10.0, 100.0)
    with pytest.raises(ValueError, match="9 planes"):
        psf_grids.standard_places(cards, 9)
    with pytest.raises(ValueError, match="no lines"):
        psf_grids.standard_places({"NXPSFS": "2", "NYPSFS": "1"}, 2)


def test_grids_evaluated(spark, tmp_path):
    rng = np.random.default_rng(4)
    cube, one = rng.normal(size=(4, 3, 3)), rng.normal(size=(5, 5))
    places = {"DET_YX0": "(0.0, 0.0)", "DET_YX1": "(0.0, 10.0)", "DET_YX2": "(20.0, 0.0)", "DET_YX3": "(20.0, 10.0)", "OVERSAMP": 2}
    (tmp_path / "a_NRCA1_F100W.fits").write_bytes(unit(cube.astype(">f8"), places))
    (tmp_path / "single.fits").write_bytes(unit(one.astype(">f8"), {"DET_YX0": "(7.0, 8.0)", "OVERSAMP": 3}))
    (tmp_path / "other.fits").write_bytes(to_fits(np.ones((4, 4))))
    grids = psf_grids.read_grids(spark, str(tmp_path)).cache()
    assert {(r.instrument, r["filter"], r.oversampling, r.n) for r in grids.groupBy("instrument", "filter", "oversampling").agg(F.count("*").alias("n")).collect()} == {("NRCA1", "F100W", 2, 36), (None, None, 3, 25)}
    at = spark.createDataFrame([(1, 2.5, 5.0), (2, 10.0, 20.0), (3, -5.0, 50.0), (4, None, 1.0), (5, 10.0, 3.0)], "id long, x double, y double")
    got = {(r.path.rsplit("/", 1)[-1], r.id, r.j, r.i): r.value for r in psf_grids.evaluate(grids, at).collect()}
    weights = {1: (0.5625, 0.1875, 0.1875, 0.0625), 2: (0, 0, 0, 1), 3: (0, 0, 1, 0), 5: (0, 0.85, 0, 0.15)}
    want = {("a_NRCA1_F100W.fits", n, j, i): np.dot(w, cube[:, j, i]) for n, w in weights.items() for j in range(3) for i in range(3)}
    want |= {("single.fits", n, j, i): one[j, i] for n in weights for j in range(5) for i in range(5)}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)
    assert psf_grids.evaluate(grids, at.where("id < 0")).isEmpty() and psf_grids.evaluate(grids.where("j < 0"), at).isEmpty()
