"""Exact quantiles of groups of any size and shape."""

import math
import random

from riffle.operators import ranks


def quantile(values, q):
    """The smallest value that at least the given share does not exceed."""
    rows = sorted(values)
    return rows[max(len(rows) - math.floor(len(rows) - q * len(rows)), 1) - 1]


def groups():
    rng = random.Random(6)
    return {
        "even": [rng.uniform(0, 1) for _ in range(4000)], "tied": [float(rng.randrange(3)) for _ in range(500)], "one": [2.5], "level": [7.0] * 9,
        "tails": [math.exp(rng.gauss(0, 40)) * rng.choice([-1, 1]) for _ in range(800)], "ends": [-math.inf, -1.0, 0.0, 1.0, math.inf, math.inf],
        "only": [math.inf] * 3, "widest": [-1.7e308, 0.0, 1.7e308], None: [rng.gauss(1e6, 1) for _ in range(900)]}


def test_quantiles_of_odd_groups(spark, monkeypatch):
    asked = [0.0, 0.25, 0.5, 0.7, 0.9, 1.0]
    rows = [(g, v) for g, values in groups().items() for v in values] + [("even", None), ("even", math.nan), ("nothing", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    want = {(g, q): quantile(values, q) for g, values in groups().items() for q in asked}
    got = ranks.discrete_quantiles(df, ["g"], "v", asked)
    assert got.columns == ["g", "Quantile", "x"] and {(r.g, r.Quantile): r.x for r in got.collect()} == want and got.count() == len(want)
    monkeypatch.setattr(ranks, "BROADCAST_ROWS", 0)
    assert {(r.g, r.Quantile): r.x for r in ranks.discrete_quantiles(df, ["g"], "v", asked).collect()} == want


def test_only_slices_with_an_asked_rank_are_ranked(spark, monkeypatch):
    rng = random.Random(7)
    values = [rng.uniform(0, 1) for _ in range(6000)]
    ranked, real = [], ranks.stretches
    monkeypatch.setattr(ranks, "stretches", lambda df, *a: ranked.append(df.count()) or real(df, *a))
    got = ranks.discrete_quantiles(spark.createDataFrame([("a", v) for v in values], "g string, v double"), ["g"], "v", [0.5, 0.9])
    assert {r.Quantile: r.x for r in got.collect()} == {q: quantile(values, q) for q in (0.5, 0.9)}
    assert sum(ranked) < 600
