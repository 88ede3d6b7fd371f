"""Fits against NumPy and known values."""

import math

import numpy as np
import pytest

from riffle.models import lines, logistic, small, spline


def table(spark, groups):
    return spark.createDataFrame([(g, float(x), float(y)) for g, xs, ys in groups for x, y in zip(xs, ys)], "g string, x double, y double")


@pytest.fixture(scope="module")
def wave():
    rng = np.random.default_rng(5)
    x = rng.uniform(-3, 3, 600)
    return x, 1.5 + np.sin(x) + rng.normal(0, 0.2, 600)


def test_tails():
    assert small.normal_tail(1.959963984540054) == pytest.approx(0.05, abs=1e-12)
    # One degree of freedom: F is the square of Student's t; two: (1 + 2 f / n) ** (-n / 2).
    assert small.f_tail(4.0, 2.0, 10.0) == pytest.approx((1 + 2 * 4.0 / 10) ** -5, rel=1e-10)
    assert small.f_tail(1.0, 1.0, 1.0) == pytest.approx(0.5, rel=1e-10)
    assert math.isnan(small.f_tail(float("nan"), 2.0, 3.0))


def test_basis_is_a_partition_of_unity():
    pieces = small.basis_pieces(np.array([0.0, 0.1, 2.0, 7.0]), 3)
    total = pieces.sum(axis=1)
    assert np.allclose(total[:, 0], 1) and np.allclose(total[:, 1:], 0)


def test_logistic_statuses_and_score_equations(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(2, 5, 400)
    y = (rng.uniform(size=400) < 1 / (1 + np.exp(-(0.3 - 0.2 * x)))).astype(float)
    groups = [("good", x, y), ("sep", range(8), [0, 0, 0, 0, 1, 1, 1, 1]), ("one", range(5), [1] * 5), ("few", [1, 2], [0, 1]), ("const", [3] * 6, [0, 1] * 3)]
    frame = table(spark, groups)
    models = logistic.fit_logistic(frame, ["g"])
    got = {r.g: r for r in logistic.summarize_logistic(models).collect()}
    assert {g: r.status for g, r in got.items()} == {"good": "ok", "sep": "separated", "one": "one_class", "few": "too_few_rows", "const": "constant_x"}
    assert all(got[g].slope is None and got[g].AIC is None for g in ("sep", "one", "few", "const"))
    r = got["good"]
    p = 1 / (1 + np.exp(-(r.intercept + r.slope * x)))
    assert abs(np.sum(y - p)) < 1e-6 and abs(np.sum((y - p) * x)) < 1e-5
    deviance = -2 * np.sum(y * np.log(p) + (1 - y) * np.log(1 - p))
    null = -2 * (y.sum() * np.log(y.mean()) + (1 - y).sum() * np.log(1 - y.mean()))
    assert r.AIC == pytest.approx(deviance + 4) and r.McFaddensR2 == pytest.approx(1 - deviance / null) and r.n == 400
    info = np.array([[np.sum(p * (1 - p)), np.sum(p * (1 - p) * x)], [np.sum(p * (1 - p) * x), np.sum(p * (1 - p) * x * x)]])
    assert r.slope_se == pytest.approx(np.sqrt(np.linalg.inv(info)[1, 1]), rel=1e-5)
    assert r.PValue == pytest.approx(small.normal_tail(r.slope / r.slope_se))
    fitted = logistic.predict_logistic(models, frame, ["g"], 5)
    assert fitted.filter("g = 'good'").count() == 400 and fitted.filter("x IS NULL").count() == 4


def test_spline_follows_the_curve(spark, wave):
    x, y = wave
    frame = table(spark, [("a", x, y), ("flat", [2.0] * 5, [1, 2, 3, 4, 5]), ("few", [1, 2], [1, 2])])
    models = spline.fit_gaussian(frame, ["g"], [3, 6, 12])
    got = {(r.g, r.smooth): r for r in spline.summarize(models).collect()}
    assert got["flat", 6].status == "constant_x" and got["few", 6].status == "too_few_rows" and got["few", 6].AIC is None
    best = got["a", 12]
    assert best.status == "ok" and best.R2 > 0.9 and best.PValue < 1e-6 and 3 < best.EDF < 11
    pred = spline.predict(models, frame, ["g"], 9).filter("g = 'a' AND smooth = 12").toPandas()
    assert np.mean((pred.predictedVals - (1.5 + np.sin(pred.x))) ** 2) < 0.003
    rss = float(((pred.y - pred.predictedVals) ** 2).sum())
    n, edf = 600, best.EDF + 1
    assert best.DevExplained == pytest.approx(1 - rss / float(((pred.y - pred.y.mean()) ** 2).sum()), rel=1e-6)
    assert best.AIC == pytest.approx(n * (math.log(2 * math.pi * rss / n) + 1) + 2 * (edf + 1), rel=1e-6)


def test_prediction_uses_every_interval(spark, wave):
    x, y = wave
    y = y + np.sin(9 * x)
    frame = table(spark, [("a", x, y)])
    models = spline.fit_gaussian(frame, ["g"], [30])
    pred = spline.predict(models, frame, ["g"], 1).toPandas()
    assert float(((pred.y - pred.predictedVals) ** 2).sum()) == pytest.approx(models.first().rss, rel=1e-6)


def test_unsettled_curve_is_no_result(spark, wave):
    x, y = wave
    row = spline.fit_quantile(table(spark, [("a", x, y)]), ["g"], [6], [0.9], steps=0).first()
    assert row.status == "no_convergence" and row.pieces is None


def test_heavy_tails_are_not_separation(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(0, 1, 2000)
    y = (rng.uniform(size=2000) < 1 / (1 + np.exp(-2 * x))).astype(float)
    x, y = np.append(x, [3000.0, -4000.0]), np.append(y, [1, 0])
    row = logistic.fit_logistic(table(spark, [("a", x, y)]), ["g"]).first()
    p = 1 / (1 + np.exp(-np.clip(row.intercept + row.slope * x, -500, 500)))
    assert row.status == "ok" and row.slope == pytest.approx(2, abs=0.3) and abs(np.sum((y - p) * x)) < 1e-3 * len(x)


def test_heavy_smoothing_is_the_straight_line(wave):
    x, y = wave
    breaks = np.quantile(x, np.linspace(0, 1, 4))
    pieces = small.basis_pieces(breaks, 3)
    m = np.clip(np.searchsorted(breaks, x, side="right") - 1, 0, 2)
    u = (x - breaks[m]) / np.diff(breaks)[m]
    moments = {i: np.array([np.sum(u[m == i] ** p) for p in range(7)]) for i in range(3)}
    cross = {i: np.array([np.sum(y[m == i] * u[m == i] ** p) for p in range(4)]) for i in range(3)}
    g, b = small.gram(pieces, moments, cross)
    beta, edf, rss, _ = small.penalised_fit(g, b, small.roughness(pieces, breaks), float(y @ y), 600.0, 2.0 + 1e-7)
    slope, intercept = np.polyfit(x, y, 1)
    c = small.to_pieces(beta, pieces).reshape(3, 4)
    fit = sum(c[m, p] * u**p for p in range(4))
    assert edf == pytest.approx(2, abs=1e-4) and np.abs(fit - (intercept + slope * x)).max() < 1e-3


def test_lines(spark, wave):
    x, y = wave
    frame = table(spark, [("a", x, y), ("const", [1.0] * 4, [1, 2, 3, 4])])
    got = {r.g: r for r in lines.fit_lines(frame, ["g"]).collect()}
    slope, intercept = np.polyfit(x, y, 1)
    assert (got["a"].slope, got["a"].intercept) == (pytest.approx(slope), pytest.approx(intercept))
    assert got["const"].slope is None


def test_quantiles_split_the_residuals(spark, wave):
    x, y = wave
    frame = table(spark, [("a", x, y)])
    rows = spline.summarize(spline.fit_quantile(frame, ["g"], [9], [0.9, 0.5])).collect()
    for r in rows:
        assert r.below / r.n == pytest.approx(r.quantile, abs=0.02) and r.loss < r.null_loss and r.DevExplained > 0.5
    line = {r.quantile: r for r in lines.fit_quantile_lines(frame, ["g"], [0.5, 0.1]).collect()}
    for q, r in line.items():
        assert r.share_below == pytest.approx(q, abs=0.02)
        residual = y - (r.intercept + r.slope * x)
        loss = np.sum(residual * (q - (residual < 0)))
        for da, db in [(0.05, 0), (-0.05, 0), (0, 0.05), (0, -0.05)]:
            other = y - (r.intercept + da + (r.slope + db) * x)
            assert loss <= np.sum(other * (q - (other < 0))) * 1.001


def test_narrow_bands_find_the_same_optimum(spark):
    """Rows solved in a band that narrows round by round, the others as sums: the loss is that of all rows at once."""
    rng = np.random.default_rng(9)
    x = rng.uniform(-3, 3, 6000)
    frame = table(spark, [("a", x, np.sin(x) + rng.standard_t(3, 6000)), ("ties", np.round(x), np.round(rng.normal(0, 2, 6000)))])
    asked = (["g"], [2, 9], [0.99, 0.5, 0.1])
    narrow, whole = (spline.fit_quantile(frame, *asked, band=b).toPandas().sort_values(["g", "smooth", "quantile"]) for b in (300, 10_000))
    assert set(narrow.status) <= {"ok", "reduced_k"} and len(narrow) == 12
    assert np.allclose(narrow.loss, whole.loss, rtol=1e-6)
    for m in (narrow, whole):
        assert (m.below <= m["quantile"] * m.n + 1e-6).all() and (m.below + m.on_curve >= m["quantile"] * m.n - 1e-6).all()


@pytest.mark.parametrize("tau", [0.1, 0.5, 0.9])
def test_quantile_line_against_all_pairs(tau):
    """An optimal line runs through two of the points."""
    rng = np.random.default_rng(3)
    x, y = rng.uniform(-2, 2, 50), rng.normal(0, 1, 50)
    b = np.column_stack([np.ones(50), x])
    loss = lambda beta: float(np.sum((r := y - b @ beta) * (tau - (r < 0))))
    best = min(loss(np.linalg.solve(b[[i, j]], y[[i, j]])) for i in range(50) for j in range(i))
    beta, closed = small.quantile_fit(b, y, np.ones(50), tau, np.zeros((2, 2)), np.zeros(2), np.zeros(2))
    assert closed and loss(beta) == pytest.approx(best, rel=1e-9)


def test_rank_scores_keep_their_level(spark):
    """Of constant data one curve in ten is significant at 0.1; a wave is always."""
    rng = np.random.default_rng(12)
    x = rng.uniform(0, 1, 150)
    frame = table(spark, [(f"g{i}", x, rng.normal(0, 1, 150)) for i in range(200)] + [("wave", x, np.sin(7 * x) + rng.normal(0, 0.2, 150))])
    p = spline.summarize(spline.fit_quantile(frame, ["g"], [6], [0.7])).select("g", "PValue").toPandas().set_index("g").PValue
    assert p.pop("wave") < 1e-6 and 0.04 < (p < 0.1).mean() < 0.17 and 0.4 < p.mean() < 0.6


def test_chi_tail():
    assert small.chi_tail(3.841458820694124, 1) == pytest.approx(0.05, rel=1e-9)
    assert small.chi_tail(11.070497693516351, 5) == pytest.approx(0.05, rel=1e-9)
    assert small.chi_tail(9.487729036781154, 4) == pytest.approx(0.05, rel=1e-9)
    assert math.isnan(small.chi_tail(float("nan"), 2))


def test_gamma(spark):
    rng = np.random.default_rng(8)
    x = rng.uniform(0, 4, 800)
    mu = np.exp(0.5 + 0.4 * np.sin(2 * x))
    y = mu * rng.gamma(9.0, 1 / 9.0, 800)
    frame = table(spark, [("a", x, y), ("neg", [1, 2, 3, 4, 5], [1, -1, 2, 2, 2])])
    models = spline.fit_gamma(frame, ["g"], smooths=[12], dfs=[4.0])
    got = {(r.g, r.df): r for r in spline.summarize(models).collect()}
    assert got["neg", None].status == "nonpositive_y" and got["neg", None].AIC is None
    assert got["a", 4.0].EDF == pytest.approx(4.0, abs=1e-3)
    best = got["a", None]
    assert best.status == "ok" and best.PValue < 1e-6
    pred = spline.predict(models, frame, ["g"], 4).filter("g = 'a' AND df IS NULL").toPandas()
    assert np.mean((np.log(pred.predictedVals) - (0.5 + 0.4 * np.sin(2 * pred.x))) ** 2) < 0.005
    deviance = float(2 * np.sum(-np.log(pred.y / pred.predictedVals) + (pred.y - pred.predictedVals) / pred.predictedVals))
    assert best.deviance == pytest.approx(deviance, rel=1e-4)


def test_reduced_basis(spark):
    frame = table(spark, [("a", [1.0] * 50 + [2.0] * 3 + [3.0] * 3, list(range(56)))])
    row = spline.fit_gaussian(frame, ["g"], [20]).first()
    assert row.status == "reduced_k" and all(math.isfinite(v) for v in row.pieces)


def test_moments_between_all_borders_give_those_of_each_model():
    rng = np.random.default_rng(4)
    x, y = rng.uniform(0, 10, 500), rng.normal(size=500)
    cuts, breaks = np.array([0, 1, 2.5, 4, 7.5, 10.0]), np.array([0, 2.5, 10.0])

    def sums(borders):
        at = np.clip(np.searchsorted(borders, x, "right") - 1, 0, len(borders) - 2)
        u = (x - borders[at]) / np.diff(borders)[at]
        return {m: np.array([np.sum(y[at == m] * u[at == m] ** p) for p in range(7)]) for m in range(len(borders) - 1)}

    want, got = sums(breaks), small.rebased(cuts, breaks, sums(cuts))
    assert set(got) == set(want) and all(np.allclose(got[m], want[m], atol=1e-9) for m in want)


def test_all_sizes_are_fitted_in_one_pass(spark, wave, monkeypatch):
    x, y = wave
    frame = table(spark, [("a", x, y), ("b", x ** 3, y), ("tied", np.round(x), y)])
    joined, real = [], spline._with_models
    monkeypatch.setattr(spline, "_with_models", lambda f, models, keys, *a: joined.append(models.groupBy(*keys).count().agg({"count": "max"}).first()[0]) or real(f, models, keys, *a))
    sizes = [1, 2, 3, 6, 9, 12, 15, 18, 20, 31]
    together = {(r.g, r.smooth): r for r in spline.fit_gaussian(frame, ["g"], sizes).collect()}
    assert joined == [1]  # one row of borders for each configuration, whatever the number of sizes
    for k in (1, 3, 9, 20):
        for r in spline.fit_gaussian(frame, ["g"], [k]).collect():
            other = together[r.g, k]
            assert r.status == other.status and np.allclose(r.breaks, other.breaks)
            assert np.allclose(r.pieces, other.pieces, atol=1e-6) and r.rss == pytest.approx(other.rss, rel=1e-7) and r.edf_total == pytest.approx(other.edf_total, rel=1e-5)


def test_quantile_curves_are_not_joined_to_the_rows(spark, monkeypatch):
    """Rows meet the curves in one sum per task; the curves of the joined path, for very many of them, are the same."""
    rng = np.random.default_rng(21)
    x = rng.uniform(-3, 3, 4000)
    groups = [("a", x, np.sin(x) + rng.standard_t(3, 4000)), (None, np.round(x), np.round(rng.normal(0, 2, 4000))), ("flat", [2.0] * 5, [1, 2, 3, 4, 5])]
    frame = table(spark, groups)
    joined, real = [], spline._with_models
    monkeypatch.setattr(spline, "_with_models", lambda *a: joined.append(a) or real(*a))
    fit = lambda: spline.summarize(spline.fit_quantile(frame, ["g"], [2, 9], [0.9, 0.5], band=300)).toPandas().sort_values(["g", "smooth", "quantile"])
    summed = fit()
    assert len(joined) == 1  # the mean curves, one row of borders for each configuration
    monkeypatch.setattr(spline, "BROADCAST_ROWS", 0)
    other = fit()
    assert len(joined) > 3 and len(summed) == len(other) == 12
    assert list(summed.status) == list(other.status) and (summed.status == "constant_x").sum() == 4
    for c in ("loss", "below", "on_curve", "null_loss", "sum_r", "sum_rr", "R2", "PValue", "DevExplained"):
        assert np.allclose(summed[c].astype(float), other[c].astype(float), rtol=1e-6, atol=1e-6, equal_nan=True), c


def test_gamma_curves_are_not_joined_to_the_rows(spark, monkeypatch):
    rng = np.random.default_rng(22)
    x = rng.uniform(0, 4, 500)
    y = np.exp(0.5 + 0.4 * np.sin(2 * x)) * rng.gamma(9.0, 1 / 9.0, 500)
    # Equal rows count as often as they come; a configuration may have no name.
    frame = table(spark, [("a", [*x, *x[:90]], [*y, *y[:90]]), (None, np.round(x), y), ("neg", [1, 2, 3, 4, 5], [1, -1, 2, 2, 2])])
    joined, real = [], spline._with_models
    monkeypatch.setattr(spline, "_with_models", lambda *a: joined.append(a) or real(*a))
    fit = lambda: spline.fit_gamma(frame, ["g"], smooths=[6], dfs=[4.0]).toPandas().sort_values(["g", "smooth", "df"])
    summed = fit()
    assert not joined and set(summed.status) <= {"ok", "reduced_k", "nonpositive_y"} and (summed.status == "nonpositive_y").sum() == 2
    monkeypatch.setattr(spline, "BROADCAST_ROWS", 0)
    other = fit()
    assert joined and len(summed) == len(other) == 6 and list(summed.status) == list(other.status)
    for c in ("n", "deviance", "sse", "edf_total"):
        assert np.allclose(summed[c].astype(float), other[c].astype(float), rtol=1e-6, equal_nan=True), c
