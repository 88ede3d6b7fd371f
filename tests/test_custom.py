"""A user's function for every configuration."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from riffle.models.custom import fit_each

NAMES = ["n", "sx", "sy", "sxx", "sxy"]


@pytest.fixture(scope="module")
def sums(spark):
    return dict(zip(NAMES, [F.count("*"), F.sum("x"), F.sum("y"), F.sum(F.col("x") * F.col("x")), F.sum(F.col("x") * F.col("y"))]))


def line(cells):
    n, sx, sy, sxx, sxy = (cells[k].sum() for k in NAMES)
    if n < 3:
        return None
    spread = n * sxx - sx * sx
    if spread <= 0:
        raise ZeroDivisionError("x is constant")
    return {"slope": (n * sxy - sx * sy) / spread, "rows": int(n), "cells": len(cells["cell"])}


@pytest.fixture(scope="module")
def frame(spark):
    rng = np.random.default_rng(8)
    rows = [(f"g{i}", float(x), float(2 * x + i)) for i in range(4) for x in rng.uniform(-5, 5, 200)]
    rows += [("flat", 1.0, float(i)) for i in range(5)] + [("few", 1.0, 1.0), (None, 0.0, 1.0), (None, 1.0, 3.0), (None, 2.0, 5.0)]
    rows += [("g0", math.nan, 1.0), ("g0", None, 1.0), ("lost", None, 2.0)]
    return spark.createDataFrame(rows, "g string, x double, y double")


@pytest.mark.parametrize("cells", [1, 16])
def test_one_failure_leaves_the_others(frame, sums, cells):
    got = {r.g: r for r in fit_each(frame, ["g"], sums, line, "slope double, rows long, cells int, unused string", cells).collect()}
    assert set(got) == {"g0", "g1", "g2", "g3", "flat", "few", None}
    for g in ("g0", "g1", "g2", "g3"):
        assert got[g].status == "ok" and got[g].slope == pytest.approx(2.0) and got[g].rows == 200 and got[g].error is None and got[g].unused is None
        assert got[g].cells <= cells
    assert got["flat"].status == "failed" and got["flat"].error == "ZeroDivisionError: x is constant" and got["flat"].slope is None
    assert got["few"].status == "no_result" and got[None].slope == pytest.approx(2.0)


def test_values_that_do_not_fit_and_empty_frames(frame, sums):
    got = fit_each(frame.filter("g = 'g1'"), ["g"], sums, lambda c: {"slope": "steep"}, "slope double").first()
    assert got.status == "failed" and got.slope is None and got.error
    assert fit_each(frame.limit(0), ["g"], sums, line, "slope double").count() == 0
    with pytest.raises(ValueError):
        fit_each(frame, ["g"], sums, line, "g double")
