"""Crossings of curves and regular grids."""

import math
import random

import pytest
from pyspark.sql import functions as F

from riffle.models import spline
from riffle.operators.curves import curve_roots, curve_thresholds, grid_ranges, regular_grid
from riffle.operators.roots import curve_segments, model_roots, model_thresholds

CURVES = {
    "none": [(0, 1.0), (1, 2.0)],
    "one": [(2, 3.0), (0, -1.0), (1, 1.0)],
    "two": [(0, 2.0), (1, -2.0), (2, 2.0)],
    "three": [(0, -1.0), (1, 1.0), (2, -1.0), (3, 1.0)],
    "vertex": [(0, -1.0), (1, 0.0), (2, 1.0)],
    "touch": [(0, 1.0), (1, 0.0), (2, 1.0)],
    "touch_below": [(0, -1.0), (1, 0.0), (2, -1.0)],
    "flat": [(0, -1.0), (1, 0.0), (2, 0.0), (3, 5.0)],
    "flat_touch": [(0, -1.0), (1, 0.0), (2, 0.0), (3, -5.0)],
    "repeat": [(0, -1.0), (0, -1.0), (1, -1.0), (1, 1.0), (2, 1.0)],
    "starts_on": [(0, 0.0), (1, 1.0)],
}
WANT = {
    "one": (0.5, None, 1), "two": (0.5, 1.5, 2), "three": (0.5, 1.5, 3), "vertex": (1.0, None, 1),
    "flat": (2.0, None, 1), "repeat": (1.0, None, 1),
}


def test_curve_roots(spark):
    points = spark.createDataFrame([(k, float(x), y) for k, ps in CURVES.items() for x, y in ps], "c string, x double, y double")
    got = {r.c: (r.Lower, r.Upper, r.n_roots) for r in curve_roots(points, ["c"], "x", "y", {"l": F.lit(0.0)}).collect()}
    assert got == WANT
    wide = {r.c: r for r in curve_thresholds(points, ["c"], "x", "y", {"l": F.lit(0.0)}).collect()}
    assert wide["none"].Thresholdl_Lower is None and wide["none"].n == 2 and wide["two"].Thresholdl_Upper == 1.5


def brute(points, level):
    """Reference rule: sides of the points off the level, in order."""
    points = sorted(set(points))
    found, side, last = [], None, None
    for x, y in points:
        if y != level:
            if side is not None and (side > level) != (y > level):
                x0, y0 = last
                found.append(x0 if y0 == level else x0 - (y0 - level) * (x - x0) / (y - y0))
            side = y
        last = (x, y)
    return found


@pytest.mark.parametrize("seed", [1, 2])
def test_roots_against_brute_force(spark, seed):
    rng = random.Random(seed)
    curves = {f"c{i}": [(float(rng.randint(0, 40)), float(rng.randint(-2, 2))) for _ in range(rng.choice([3, 30, 120]))] for i in range(8)}
    points = spark.createDataFrame([(k, x, y) for k, ps in curves.items() for x, y in ps], "c string, x double, y double")
    levels = {"zero": F.lit(0.0), "one": F.lit(1.0), "half": F.lit(0.5)}
    got = {(r.c, r.level): r for r in curve_roots(points, ["c"], "x", "y", levels).collect()}
    for name, value in [("zero", 0.0), ("one", 1.0), ("half", 0.5)]:
        for c, ps in curves.items():
            want = sorted(brute(ps, value))
            row = got.get((c, name))
            assert (row.n_roots if row else 0) == len(want)
            assert [v for v in ([row.Lower, row.Upper] if row else []) if v is not None] == pytest.approx(want[:2])


def test_regular_grid(spark):
    ranges = spark.createDataFrame([("a", 0.0, 1.0, 0.1), ("b", 0.0, 1.0, 0.0), ("c", -1.0, 30000.0, 1.0), ("d", 2.0, 2.0, 0.5)],
                                   "k string, lo double, hi double, step double")
    grid = regular_grid(ranges, "lo", "hi", "step", "x")
    sizes = {r.k: (r.n, r.lo_x, r.hi_x) for r in grid.groupBy("k").agg(F.count("*").alias("n"), F.min("x").alias("lo_x"), F.max("x").alias("hi_x")).collect()}
    assert sizes == {"a": (11, 0.0, 1.0), "c": (30002, -1.0, 30000.0), "d": (1, 2.0, 2.0)}


MODEL = "g string, family string, n long, status string, breaks array<double>, pieces array<double>"
# Pieces of (u - 1/4)(u - 3/4) and the like, over ranges of several widths.
PIECES = {
    "two": ([0.0, 4.0], [0.1875, -1.0, 1.0, 0.0], [1.0, 3.0]),
    "three": ([-1.0, 1.0], [-0.09375, 0.6875, -1.5, 1.0], [-0.5, 0.0, 0.5]),
    "touch": ([0.0, 1.0], [0.25, -1.0, 1.0, 0.0], []),
    "touch_below": ([0.0, 1.0], [-0.25, 1.0, -1.0, 0.0], []),
    "inflection": ([0.0, 1.0], [-0.125, 0.75, -1.5, 1.0], [0.5]),
    "at_border": ([0.0, 1.0, 3.0], [-1.0, 1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0], [1.0]),
    "level_stretch": ([0.0, 1.0, 2.0, 3.0], [-1.0, 1.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 2.0, 0.0, 0.0], [2.0]),
    "level_touch": ([0.0, 1.0, 2.0, 3.0], [-1.0, 1.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, -2.0, 0.0, 0.0], []),
    "starts_on": ([0.0, 1.0], [0.0, 1.0, 0.0, 0.0], []),
    "constant": ([0.0, 1.0], [2.0, 0.0, 0.0, 0.0], []),
}


def test_roots_of_pieces(spark):
    rows = [(g, "gaussian", 9, "ok", b, p) for g, (b, p, _) in PIECES.items()]
    rows += [("failed", "gaussian", 2, "too_few_rows", None, None), ("log", "gamma", 9, "ok", [0.0, 1.0], [-1.0, 2.0, 0.0, 0.0]), (None, "gaussian", 5, "ok", [0.0, 2.0], [-1.0, 2.0, 0.0, 0.0])]
    models = spark.createDataFrame(rows, MODEL)
    got = {(r.g, r.level): r for r in model_roots(models, ["g"], {"zero": F.lit(0.0), "one": F.lit(1.0), "none": F.lit(None)}).collect()}
    for g, (_, _, want) in PIECES.items():
        row = got.get((g, "zero"))
        assert (row.n_roots if row else 0) == len(want), g
        assert [v for v in ([row.Lower, row.Upper] if row else []) if v is not None] == pytest.approx(want[:2], abs=1e-12), g
    assert got["log", "one"].Lower == pytest.approx(0.5) and ("log", "zero") not in got and got[None, "zero"].Lower == pytest.approx(1.0)
    wide = {r.g: r for r in model_thresholds(models, ["g"], {"l": F.lit(0.0)}).collect()}
    assert len(wide) == len(rows) and wide["failed"].status == "too_few_rows" and wide["failed"].Thresholdl_Lower is None and wide["two"].Thresholdl_Upper == pytest.approx(3.0)
    assert model_thresholds(models.limit(0), ["g"], {"l": F.lit(0.0)}).count() == 0


def test_roots_agree_with_a_grid(spark):
    rng = random.Random(3)
    frame = spark.createDataFrame([(g, x, math.sin(k * x) + rng.gauss(0, 0.2)) for k, g in enumerate("abc", 1) for x in [rng.uniform(-3, 3) for _ in range(300)]],
                                  "g string, x double, y double")
    models = spline.fit_gaussian(frame, ["g"], [6, 12])
    grid = regular_grid(grid_ranges(frame, ["g"], "x").withColumn("x_step", F.lit(0.001)), "x_min", "x_max", "x_step", "x").select("g", "x")
    points = spline.predict(models, grid, ["g"], 6)
    levels = {"low": F.lit(-0.31), "mid": F.lit(0.07), "high": F.lit(0.45)}
    want = {(r.g, r.smooth, r.level): r for r in curve_roots(points, ["g", "smooth"], "x", "predictedVals", levels).collect()}
    got = {(r.g, r.smooth, r.level): r for r in model_roots(models, ["g", "smooth"], levels).collect()}
    assert want and set(got) == set(want)
    for k, r in got.items():
        assert r.n_roots == want[k].n_roots and r.Lower == pytest.approx(want[k].Lower, abs=1e-4) and (r.Upper or 0) == pytest.approx(want[k].Upper or 0, abs=1e-4)


def test_segments_do_not_turn(spark):
    models = spark.createDataFrame([(g, "gaussian", 9, "ok", b, p) for g, (b, p, _) in PIECES.items()], MODEL)
    for r in curve_segments(models, ["g"]).collect():
        slopes = [r.c1 + 2 * r.c2 * u + 3 * r.c3 * u * u for u in (r.u0 + (r.u1 - r.u0) * i / 50 for i in range(51))]
        assert min(slopes) > -1e-9 or max(slopes) < 1e-9
