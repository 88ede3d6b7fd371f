"""The fitted queries ask for every model of the analysis."""

import pytest

from riffle import constants as C
from riffle.models import spline
from riffle.plans import catalog, fitted

SF = "/root/testdata/sf0.001"


class Asked(Exception):
    pass


@pytest.fixture
def asked(monkeypatch):
    def stop(frame, keys, smooths=(), quantiles=(), dfs=()):
        raise Asked(sorted(smooths), sorted(quantiles), sorted(dfs))

    monkeypatch.setattr(fitted, "frame", lambda r: None)
    monkeypatch.setattr(fitted, "materialize", lambda df, name: df)
    for name in ("fit_gaussian", "fit_gamma", "fit_quantile"):
        monkeypatch.setattr(spline, name, stop)


SIZES, QUANTILES, DFS = sorted(C.SMOOTHS), sorted(C.QUANTILES), sorted(map(float, C.SMOOTHS))


@pytest.mark.parametrize(("names", "grid"), [
    (["MD9_quantile_spline", "MD10_quantile_summary", "MD11_grid_prediction", "DM10_fitted_thresholds", "MD9_quantile_grid", "MD11_range_grid"], (SIZES, QUANTILES, [])),
    (["MD6_gamma_spline", "MD6_spline_means_grid"], (SIZES, [], [])),
    (["MD4_gamma_smooth", "MD4_gamma_by_class", "MD5_gamma_summary", "MD4_gamma_grid"], ([], [], DFS)),
])
def test_whole_grid(spark, asked, names, grid):
    for name in names:
        with pytest.raises(Asked) as got:
            catalog.QUERIES[name](spark, SF)
        assert got.value.args == grid, name
