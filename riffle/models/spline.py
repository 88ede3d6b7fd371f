"""Penalised splines for many configurations at once: Gaussian, Gamma and quantile.

Rows never leave Spark. A configuration's x range is cut into intervals; within an interval
every basis function is a polynomial in the local coordinate u, so the Gram matrix follows from
the sums of w * u^p per interval. Those sums are one aggregate, combined before the shuffle;
only a few dozen numbers per model reach the solver.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from statistics import NormalDist

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riffle.models import small
from riffle.models.passes import indexed, moments, sums_per_interval, value
from riffle.operators.joins import join, lookup
from riffle.operators.reshape import stack_rows
from riffle.session import BROADCAST_ROWS, materialize

MOMENTS = 7
CROSS = 4
GAMMA_STEPS = 60
# From this step on the smoothness of a Gamma fit is held, so that the fit itself converges.
HOLD_STEP = 5
# Rounds of a quantile fit, and rows of a model that are solved together.
QUANTILE_STEPS, BAND = 30, 6_000
# A sample of fewer rows for each coefficient says too little about where the curve runs.
ROWS_PER_COEFFICIENT = 200
# Up to so many intervals are found by comparing with every border; more by halving.
COMPARED = 20

_ARRAY = T.ArrayType(T.DoubleType())
FITTED = [
    T.StructField("pieces", _ARRAY), T.StructField("edf_total", T.DoubleType()), T.StructField("rss", T.DoubleType()),
    T.StructField("lambda", T.DoubleType()), T.StructField("status", T.StringType()),
]


# ---- knots -------------------------------------------------------------------------------

def place_knots(frame: DataFrame, keys: Sequence[str], grid: Sequence[tuple[int, float | None]]) -> DataFrame:
    """One row per configuration and (basis size, target df): the interval borders.

    Borders are quantiles of x from one bounded sketch per configuration. Equal borders
    collapse, which reduces the basis.
    """
    fractions = sorted({i / small.intervals_of(k) for k, _ in grid for i in range(1, small.intervals_of(k))})
    sketch = F.percentile_approx("x", fractions, 10_000) if fractions else F.array().cast("array<double>")
    per_config = frame.groupBy(*keys).agg(
        F.count("*").alias("n"), F.min("x").alias("x_min"), F.max("x").alias("x_max"), F.avg("y").alias("y_mean"),
        F.var_pop("y").alias("y_var"), F.min("y").alias("y_min"),
        F.avg(F.when(F.col("y") > 0, F.log("y"))).alias("y_log"), sketch.alias("quantiles"),
    )

    def model(size: int, df: float | None) -> Column:
        inner = [F.get("quantiles", F.lit(fractions.index(i / small.intervals_of(size)))) for i in range(1, small.intervals_of(size))]
        # Adding zero makes -0 and 0 one border.
        borders = F.array_distinct(F.array_sort(F.transform(F.array(F.col("x_min"), *inner, F.col("x_max")), lambda b: b + 0.0)))
        return F.struct(
            F.lit(size).alias("smooth"), F.lit(df).cast("double").alias("df"), borders.alias("breaks"),
            (F.size(borders) <= small.intervals_of(size)).alias("reduced"),
        )

    opened = per_config.select(
        *keys, "n", "y_mean", "y_var", "y_min", "y_log", F.inline(F.array(*[model(k, df) for k, df in grid]))
    )
    return materialize(opened, "knots")


def _with_models(frame: DataFrame, models: DataFrame, keys: Sequence[str], rows: int, most: int | None = None) -> DataFrame:
    """Every observation with every model of its configuration, its interval and place in it.

    The model table is broadcast when its row count, known here, is small; otherwise the
    configurations are shuffled, and a hot one is split by the adaptive skew handling.
    ``most`` bounds the number of intervals of any model, which lets the search be compiled; without it the borders
    of each model are searched, however many there are.
    """
    other = F.broadcast(models) if rows <= BROADCAST_ROWS else models
    if most is None:
        passed = "greatest(0, least(size(breaks) - 2, size(filter(breaks, b -> x >= b)) - 1))"
    elif most <= COMPARED:
        passed = " + ".join(
            [f"cast(coalesce(x >= get(breaks, {j}) AND size(breaks) - 2 >= {j}, false) AS int)" for j in range(1, most)] or ["0"])
    located = join(frame, other, keys)
    if most is not None and most > COMPARED:
        # The last border ends the last interval; beyond the others there is nothing to pass.
        located = located.withColumns({"inner_": F.expr("slice(breaks, 1, greatest(size(breaks) - 1, 1))"), "interval": F.lit(0)})
        for p in reversed(range(int(most).bit_length())):
            step = 1 << p
            located = located.withColumn("interval", F.expr(f"interval + if(x >= get(inner_, interval + {step}), {step}, 0)"))
        located = located.drop("inner_")
    else:
        located = located.withColumn("interval", F.expr(passed))
    place = "(x - get(breaks, interval)) / nullif(get(breaks, interval + 1) - get(breaks, interval), 0d)"
    return located.withColumn("u", F.expr(place))


def curve_value(pieces: str = "pieces") -> Column:
    """The fitted curve at u of the interval."""
    return F.expr(
        f"get({pieces}, interval * 4) + u * (get({pieces}, interval * 4 + 1) + u * (get({pieces}, interval * 4 + 2)"
        f" + u * get({pieces}, interval * 4 + 3)))"
    )


def _aggregate(rows: DataFrame, model_keys: Sequence[str], weight: str, right: str, sums: dict[str, str]) -> DataFrame:
    """One row per model: the moments of every interval, and sums over all its rows."""
    powers = ["1d", "u", "u2", "u3", "u2 * u2", "u2 * u3", "u3 * u3"]
    total = lambda factor, count: F.expr("array(" + ", ".join(f"sum({factor} * {p})" for p in powers[:count]) + ")")
    rows = rows.withColumns({"w_": F.expr(weight), "r_": F.expr(right), "u2": F.expr("u * u")}).withColumn("u3", F.expr("u2 * u"))
    per_interval = rows.groupBy(*model_keys, "interval").agg(
        total("w_", MOMENTS).alias("s"), total("r_", CROSS).alias("t"),
        *[F.expr(f"sum({v})").alias(name) for name, v in sums.items()],
    )
    return _per_model(per_interval, model_keys, list(sums))


def _per_model(per_interval: DataFrame, model_keys: Sequence[str], sums: Sequence[str]) -> DataFrame:
    """The sums of all intervals of a model; at most as many rows per model as it has intervals."""
    return per_interval.groupBy(*model_keys).agg(
        F.expr("collect_list(struct(interval, s, t))").alias("stats"), *[F.sum(n).alias(n) for n in sums]
    )


def _solve(models: DataFrame, keep: Sequence[str]) -> DataFrame:
    """Solve each model from its statistics; keeps the columns named in ``keep``."""
    keep = list(keep)
    schema = T.StructType([models.schema[c] for c in keep] + FITTED)
    needed = [*keep, *[c for c in ("smooth", "breaks", "n", "reduced", "target_edf", "stats", "zz", "cuts") if c in models.columns and c not in keep]]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            fits = [_solve_one(row) for row in batch.to_dict("records")]
            fitted = pd.DataFrame(fits, columns=[f.name for f in FITTED], index=batch.index)
            yield pd.concat([batch[keep], fitted], axis=1)

    return models.select(*needed).mapInPandas(run, schema)


def _solve_one(row: dict) -> tuple:
    breaks = np.asarray(row["breaks"], dtype=float)
    if row["n"] < 4:
        return None, None, None, None, "too_few_rows"
    if len(breaks) < 2:
        return None, None, None, None, "constant_x"
    degree = small.degree_of(int(row["smooth"]))
    pieces = small.basis_pieces(breaks, degree)
    moments = {int(s["interval"]): np.asarray(s["s"], dtype=float) for s in row["stats"]}
    cross = {int(s["interval"]): np.asarray(s["t"], dtype=float) for s in row["stats"]}
    if row.get("cuts") is not None:
        cuts = np.asarray(row["cuts"], dtype=float)
        moments, cross = small.rebased(cuts, breaks, moments), small.rebased(cuts, breaks, cross)
    g, b = small.gram(pieces, moments, cross)
    if not (np.isfinite(g).all() and np.isfinite(b).all()):
        return None, None, None, None, "no_convergence"
    target = row.get("target_edf")
    target = None if target is None or np.isnan(target) else min(float(target), len(g) - 1e-6)
    try:
        beta, edf, rss, lam = small.penalised_fit(g, b, small.roughness(pieces, breaks), float(row["zz"]), float(row["n"]), target)
        beta = small.levelled(beta, g, b, breaks, degree) if degree else beta
    except np.linalg.LinAlgError:
        return None, None, None, None, "no_convergence"
    return small.to_pieces(beta, pieces).tolist(), edf, rss, lam, "reduced_k" if row["reduced"] else "ok"


def _iterate(start: DataFrame, step: Callable[[DataFrame, int], DataFrame], steps: int, name: str) -> DataFrame:
    """Repeat a step on the models that have not converged; failed models stop at once.

    The models of every step are written out, so lineage does not grow and a lost executor
    costs one step. Only the model tables are kept, never rows of the data.
    """
    active, parts = start, []
    for i in range(steps):
        solved = materialize(step(active, i), name)
        over = F.col("converged") | F.col("pieces").isNull()
        parts.append(solved.filter(over))
        active = solved.filter(~over)
        if active.isEmpty():
            break
    else:
        # A curve that has not settled is no result.
        parts.append(active.withColumns({"status": F.lit("no_convergence"), "pieces": F.lit(None).cast(_ARRAY)}))
    return stack_rows(*parts)


# ---- fits --------------------------------------------------------------------------------

def fit_gaussian(frame: DataFrame, keys: Sequence[str], smooths: Sequence[int]) -> DataFrame:
    """Gaussian spline per configuration and basis size; smoothing by generalised cross-validation.

    ``frame`` has the key columns, ``x`` and ``y``. One row per model with its status, curve
    and statistics; failed models have no curve.
    """
    # No more borders than different fractions of all sizes.
    most = 1 + len({i / m for m in map(small.intervals_of, smooths) for i in range(1, m)})
    return fit_gaussian_on(place_knots(frame, keys, [(k, None) for k in smooths]), frame, keys, most)


def fit_gaussian_on(knots: DataFrame, frame: DataFrame, keys: Sequence[str], most: int | None = None) -> DataFrame:
    """Gaussian fits of all models in one pass over the rows, each of which is used once per configuration.

    The sums are taken between the borders of all models of a configuration; sums between the borders of one model
    follow from them. ``most`` bounds the number of those intervals.
    """
    model_keys = [*keys, "smooth"]
    cuts = knots.groupBy(*keys).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("breaks")))).alias("breaks"))
    rows = _with_models(frame, cuts, keys, knots.count(), most)
    stats = join(_aggregate(rows, keys, "1d", "y", {"zz": "y * y"}), cuts.withColumnRenamed("breaks", "cuts"), keys)
    solved = _solve(
        join(knots.withColumn("target_edf", F.col("df") + 1), stats, keys),
        [*model_keys, "df", "breaks", "n", "y_mean", "y_var", "reduced"],
    )
    return materialize(solved.withColumn("family", F.lit("gaussian")), "gaussian")


def fit_gamma(
    frame: DataFrame, keys: Sequence[str], smooths: Sequence[int] = (), dfs: Sequence[float] = (), steps: int = GAMMA_STEPS
) -> DataFrame:
    """Gamma spline with log link, by iterated least squares (all working weights are one).

    ``smooths`` are basis sizes with smoothing by cross-validation; ``dfs`` are degrees of
    freedom to be met, on a basis that leaves room for them.
    """
    grid = [(int(k), None) for k in smooths] + [(int(df) + 4, float(df)) for df in dfs]
    most = max(small.intervals_of(k) for k, _ in grid)
    knots = place_knots(frame, keys, grid)
    ids = ["smooth", "df"]
    model_keys = [*keys, *ids]
    count = knots.count()
    configs, points = indexed(frame, keys)
    positive = join(knots.filter(F.col("y_min") > 0).withColumn("target_edf", F.col("df") + 1), configs, keys)
    carried = [*model_keys, "config", "breaks", "n", "y_mean", "y_var", "y_log", "reduced", "target_edf", "deviance", "sse", "converged"]

    def step(active: DataFrame, i: int) -> DataFrame:
        stats = _working_sums(points, active.select("config", *ids, "breaks", "pieces"), ids, count, most)
        held = F.expr("coalesce(target_edf, edf_total)") if i >= HOLD_STEP else F.col("target_edf")
        new = join(active.drop("pieces"), stats, ["config", *ids]).withColumns({
            "converged": F.expr("coalesce(abs(loss - deviance) < 1e-7 * (abs(loss) + 0.1), false)"),
            "deviance": F.col("loss"), "sse": F.col("new_sse"), "target_edf": held,
        })
        return _solve(new, carried)

    start = positive.withColumns({
        "pieces": F.lit(None).cast(_ARRAY), **{n: F.lit(None).cast("double") for n in ("deviance", "sse", "edf_total")}})
    done = _iterate(start, step, steps, "gamma")
    failed = knots.filter(~(F.col("y_min") > 0)).select(
        *model_keys, "breaks", "n", "y_mean", "y_var", "y_log", "reduced", F.lit("nonpositive_y").alias("status"))
    return materialize(
        done.drop("target_edf", "config").unionByName(failed, allowMissingColumns=True).withColumn("family", F.lit("gamma")), "gamma")


def _working_sums(points: DataFrame, active: DataFrame, ids: Sequence[str], rows: int, most: int) -> DataFrame:
    """One row per Gamma curve: the sums of its next least squares (``stats``, ``zz``), its deviance ``loss`` and the squares of its residuals."""
    names = ["zz", "loss", "new_sse"]
    if rows <= BROADCAST_ROWS:
        def work(model, at, powers, y, w):
            size, ln_y = len(model["breaks"]) - 1, np.log(y)
            eta = value(model["pieces"], at, powers[1]) if model["pieces"] is not None else ln_y
            mu = np.exp(eta)
            z = eta + (y - mu) / mu
            return {
                "s": moments(at, size, w, powers), "t": moments(at, size, w * z, powers[:CROSS]), "zz": np.bincount(at, w * z * z, size),
                "loss": np.bincount(at, w * 2 * ((y - mu) / mu - ln_y + eta), size), "new_sse": np.bincount(at, w * (y - mu) * (y - mu), size)}

        return _per_model(sums_per_interval(points, active, ids, work, {"s": MOMENTS, "t": CROSS, **dict.fromkeys(names, 1)}), ["config", *ids], names)
    located = _with_models(points, active, ["config"], rows, most)
    located = located.withColumn("eta", F.coalesce(curve_value(), F.expr("ln(y)"))).withColumn("mu", F.expr("exp(eta)"))
    return _aggregate(located.withColumn("z", F.expr("eta + (y - mu) / mu")), ["config", *ids], "w", "w * z", {
        "zz": "w * z * z", "loss": "w * 2 * ((y - mu) / mu - ln(y) + eta)", "new_sse": "w * (y - mu) * (y - mu)"})


def fit_quantile(
    frame: DataFrame, keys: Sequence[str], smooths: Sequence[int], quantiles: Sequence[float], steps: int = QUANTILE_STEPS,
    band: int = BAND,
) -> DataFrame:
    """Quantile spline per configuration, basis size and quantile: the exact minimum of the penalised check loss.

    The penalty on curvature is that of the Gaussian fit with the same basis, times the density that normal residuals
    have at the quantile: near the curve the check loss bends that much, so both have the same freedom. Basis size 2 is a
    straight line, without penalty.

    A row far from the curve only pulls it, by a slope that depends on its side. So only rows in a band around the curve
    are solved, by interior points (Portnoy and Koenker 1997); the others are sums per interval. Where the band holds
    more than ``band`` rows a sample of them is solved, which narrows the band to a fraction. When all of it was solved,
    the next pass counts the rows outside whose side has changed: without one the curve is optimal, otherwise the band
    is moved and widened. A configuration of at most ``band`` rows is solved whole at once.
    """
    base = fit_gaussian(frame, keys, sorted({*smooths, 1}))
    most = max(small.intervals_of(k) for k in smooths)
    ids = ["smooth", "quantile"]
    model_keys = [*keys, *ids]
    density = [NormalDist().pdf(NormalDist().inv_cdf(q)) for q in quantiles]
    each = F.explode(F.array(*[F.struct(F.lit(float(q)).alias("quantile"), F.lit(p).alias("density")) for q, p in zip(quantiles, density)])).alias("q")
    kept = ["df", "breaks", "n", "y_mean", "y_var", "reduced"]
    spread = F.sqrt(F.greatest(F.col("rss") / F.col("n"), 1e-12 * F.greatest("y_var", F.lit(1e-12))))
    opened = base.select(*keys, "smooth", *kept, "edf_total", "lambda", "pieces", "status", spread.alias("spread"), each).select("*", "q.*").drop("q")
    none = lambda kind: F.lit(None).cast(kind)
    # Equal observations are one point with a weight, so that ties cannot fill a band.
    configs, points = indexed(frame, keys)
    held = join(configs, points.groupBy("config").agg(F.count("*").alias("n_points")), ["config"])
    start = materialize(join(opened.filter("pieces IS NOT NULL"), held, keys).select(
        *model_keys, *kept, "config", "n_points", "edf_total", (F.col("lambda") * F.col("density") / F.col("spread")).alias("bend"), none(_ARRAY).alias("beta"),
        none(_ARRAY).alias("pieces"), none("double").alias("half"), F.least(F.lit(1.0), F.greatest(F.lit(band), ROWS_PER_COEFFICIENT * F.col("smooth")) / F.col("n_points")).alias("rate"),
        none(_ARRAY).alias("before"), none("double").alias("half_before"), F.lit(False).alias("whole"), F.lit(False).alias("converged")), "quantile")
    count = start.count()

    def step(active: DataFrame, i: int) -> DataFrame:
        place = F.pmod(F.xxhash64("x", "y", F.lit(i)), F.lit(1 << 30)) / (1 << 30)
        source = points.withColumn("place", place)
        if i == 0:  # no curve yet: only a sample is looked at
            rates = active.groupBy("config").agg(F.max("rate").alias("rate"))
            source = lookup(source, rates, ["config"], count).where((F.col("rate") >= 1) | (F.col("place") < F.col("rate"))).select(*source.columns)
        stats = _band_sums(source, active.select("config", *ids, "breaks", "pieces", "half", "rate", "before", "half_before"), ids, count, most)
        stats = stats.groupBy("config", *ids).agg(
            F.collect_list(F.struct("interval", "t", "taken")).alias("stats"), F.sum("n_inside").cast("long").alias("n_inside"), F.sum("n_lost").cast("long").alias("n_lost"))
        return _solve_bands(join(active, stats, ["config", *ids]), [*model_keys, "config"], band)

    done = _iterate(start, step, steps, "quantile")
    settled = F.when(F.col("pieces").isNull(), "no_convergence").when(F.col("reduced"), "reduced_k").otherwise("ok")
    curves = materialize(done.withColumn("status", settled).select(
        *model_keys, "config", *kept, "edf_total", "pieces", "status"), "curves")
    flat = curves.filter("smooth = 1").select("config", "quantile", F.get("pieces", F.lit(0)).alias("null_value"))
    curves = join(curves if 1 in smooths else curves.filter("smooth <> 1"), flat, ["config", "quantile"], "left")
    total = _loss_sums(points, curves.filter("pieces IS NOT NULL").select("config", *ids, "breaks", "pieces", "null_value"), ids, count, most)
    tested = _rank_scores(join(curves, total, ["config", *ids], "left").drop("config"))
    failed = opened.filter("pieces IS NULL").select(*model_keys, *kept, "status")
    failed = failed if 1 in smooths else failed.filter("smooth <> 1")
    return materialize(tested.unionByName(failed, allowMissingColumns=True).withColumn("family", F.lit("quantile")), "quantile")


def _band_sums(points: DataFrame, active: DataFrame, ids: Sequence[str], rows: int, most: int) -> DataFrame:
    """Of each interval of each curve: the pull ``t`` of the points outside its band, and those of the band that were drawn (``taken``).

    ``n_inside`` counts the points in the band, ``n_lost`` those outside the band before that have changed their side.
    """
    if rows <= BROADCAST_ROWS:
        def work(model, at, powers, y, w, place):
            size, u = len(model["breaks"]) - 1, powers[1]
            gap = y - value(model["pieces"], at, u) if model["pieces"] is not None else np.zeros(len(y))
            inside = np.abs(gap) <= model["half"] if model["half"] is not None else np.ones(len(y), dtype=bool)
            lost = np.zeros(len(y), dtype=bool)
            if model["before"] is not None and model["half_before"] is not None:
                before = y - value(model["before"], at, u)
                lost = (np.abs(before) > model["half_before"]) & (np.sign(before) * np.sign(gap) < 0)
            out = np.flatnonzero(~inside)
            slope = w[out] * (model["quantile"] - (gap[out] < 0))
            drawn = np.flatnonzero(inside & (place < model["rate"]) if model["rate"] < 1 else inside)
            return {
                "t": moments(at[out], size, slope, [None, *(p[out] for p in powers[1:CROSS])]), "n_inside": np.bincount(at[inside], minlength=size),
                "n_lost": np.bincount(at[lost], minlength=size), "taken": (at[drawn], u[drawn], y[drawn], w[drawn])}

        return sums_per_interval(points.select("config", "x", "y", "w", "place"), active, ids, work, {"t": CROSS, "n_inside": 1, "n_lost": 1}, ["u", "y", "w"])
    located = _with_models(points, active, ["config"], rows, most)
    located = located.withColumns({"gap": F.col("y") - curve_value(), "gap_before": F.col("y") - curve_value("before")})
    located = located.withColumns({
        "inside": F.expr("coalesce(abs(gap) <= half, true)"),
        "lost": F.expr("coalesce(abs(gap_before) > half_before AND signum(gap_before) * signum(gap) < 0, false)")})
    slope, u = F.expr("if(inside, 0d, w * (quantile - if(gap < 0, 1d, 0d)))"), F.col("u")
    group = ["config", *ids, "interval"]
    sums = located.groupBy(*group).agg(
        F.array(*[F.sum(slope * p) for p in (F.lit(1.0), u, u * u, u * u * u)]).alias("t"), F.count_if("inside").alias("n_inside"), F.count_if("lost").alias("n_lost"))
    # What is collected is the band, or a sample of it.
    taken = located.where(F.col("inside") & ((F.col("rate") >= 1) | (F.col("place") < F.col("rate")))).groupBy(*group).agg(F.collect_list(F.struct("u", "y", "w")).alias("taken"))
    return join(sums, taken, group, "left")


def _loss_sums(points: DataFrame, curves: DataFrame, ids: Sequence[str], rows: int, most: int) -> DataFrame:
    """One row per quantile curve: the moments of its intervals and rank scores (``stats``), its loss, and the points below and on it."""
    if rows <= BROADCAST_ROWS:
        def work(model, at, powers, y, w):
            size, tau, null = len(model["breaks"]) - 1, model["quantile"], model["null_value"]
            # A curve runs through rows of the data; rounding does not put them below it.
            gap, slack = y - value(model["pieces"], at, powers[1]), 1e-9 * (np.abs(y) + 1e-3)
            found = {
                "s": moments(at, size, w, powers), "loss": w * gap * (tau - (gap < 0)), "below": w * (gap < -slack), "on_curve": w * (np.abs(gap) <= slack),
                "sum_r": w * gap, "sum_rr": w * gap * gap}
            null = math.nan if null is None else null
            score = w * (tau - (y < null - slack)) if null == null else np.full(len(y), math.nan)
            found |= {"t": moments(at, size, score, powers[:CROSS]), "scores": score, "null_loss": w * (y - null) * (tau - (y < null))}
            return {k: v if v.ndim > 1 else np.bincount(at, v, size) for k, v in found.items()}

        names = ["loss", "below", "on_curve", "null_loss", "sum_r", "sum_rr", "scores"]
        found = sums_per_interval(points, curves, ids, work, {"s": MOMENTS, "t": CROSS, **dict.fromkeys(names, 1)})
        return _per_model(found, ["config", *ids], names)
    located = _with_models(points, curves, ["config"], rows, most)
    located = located.withColumn("gap", F.col("y") - curve_value()).withColumn("slack", F.expr("1e-9 * (abs(y) + 1e-3)"))
    score = "w * (quantile - if(y < null_value - slack, 1d, 0d))"
    return _aggregate(located, ["config", *ids], "w", score, {
        "loss": "w * gap * (quantile - if(gap < 0, 1d, 0d))", "below": "if(gap < -slack, w, 0d)", "on_curve": "if(abs(gap) <= slack, w, 0d)",
        "null_loss": "w * (y - null_value) * (quantile - if(y < null_value, 1d, 0d))", "sum_r": "w * gap", "sum_rr": "w * gap * gap", "scores": score})


def _solve_bands(models: DataFrame, model_keys: Sequence[str], band: int) -> DataFrame:
    """Solve each model on the rows of its band; what it hands on is the state of the next round."""
    schema = T.StructType([f for f in models.schema if f.name not in ("stats", "n_inside", "n_lost")])
    state = ["beta", "pieces", "half", "rate", "before", "half_before", "whole", "converged"]
    same = [f.name for f in schema if f.name not in state]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [_solve_band(batch, i, band) for i in range(len(batch))]
            new = {c: pa.array([o[c] for o in out], batch.schema.field(c).type) for c in state}
            yield pa.RecordBatch.from_arrays([new[f.name] if f.name in state else batch.column(f.name) for f in schema], [f.name for f in schema])

    return models.select(*same, *state, "stats", "n_inside", "n_lost").mapInArrow(run, schema)


def _solve_band(batch: pa.RecordBatch, i: int, band: int) -> dict:
    value = lambda c: batch.column(c)[i].as_py()
    now = {c: value(c) for c in ("beta", "pieces", "half", "rate", "before", "half_before", "whole", "converged")}
    if now["whole"] and value("n_lost") == 0:
        return now | {"converged": True}
    breaks, tau = np.asarray(value("breaks")), value("quantile")
    pieces = small.basis_pieces(breaks, small.degree_of(int(value("smooth"))))
    width, size = pieces.shape[1], pieces.shape[0] + pieces.shape[1] - 1
    band = max(band, ROWS_PER_COEFFICIENT * size)
    pull, intervals, points = np.zeros(size), [], []
    for m, t, *found in _stats(batch.column("stats")[i]):
        pull[m:m + width] += pieces[m] @ t[:width]
        intervals.append(np.full(len(found[0]), m))
        points.append(found)
    interval, (u, y, weight) = np.concatenate(intervals), (np.concatenate(x) for x in zip(*points))
    half = now["half"]
    inside = value("n_points") if half is None else value("n_inside")
    wider = now | {"half": None if half is None else 2 * half, "whole": False}
    if len(y) < size:
        # Fewer rows than coefficients: a wider band; if there are no more, the penalty alone decides the rest.
        if half is not None and inside < value("n_points"):
            return wider
    b = small.design(pieces, interval, u)
    penalty = value("bend") * small.roughness(pieces, breaks)
    penalty = penalty + np.eye(size) * 1e-12 * max(len(y) / size, 1.0)
    start = np.asarray(now["beta"]) if now["beta"] is not None else np.linalg.lstsq(b, y, rcond=None)[0]
    weight = weight * (inside / max(len(y), 1))
    beta, closed = small.quantile_fit(b, y, weight, tau, penalty, pull, start)
    # A curve that leaves its band has left the rows whose side was taken for granted: a wider band, and more rows of it.
    if half is not None and not (closed and np.abs(b @ (beta - start)).max() <= 2 * half):
        return wider
    if not closed and now["rate"] >= 1:
        return now | {"pieces": None}
    curve = small.to_pieces(beta, pieces).tolist()
    new = now | {"beta": beta.tolist(), "pieces": curve, "before": now["pieces"], "half_before": half}
    if now["rate"] >= 1:
        # The whole band was solved. Without rows outside it that is the end; else the next pass looks at those, and a
        # band that turned out too narrow grows until it is not.
        return new | {"whole": True, "converged": half is None, "half": half if half is None or not now["whole"] else 1.5 * half}
    following = max(0.7 * band, min(0.8, 6 * math.sqrt(size / len(y))) * inside)
    near = float(np.quantile(np.abs(y - b @ beta), min(1.0, following / inside)))
    return new | {"half": max(near, 1e-12 * float(np.abs(y).max())), "rate": min(1.0, band / following), "whole": False}


def _stats(column: pa.Scalar) -> Iterator[tuple]:
    """(interval, sums, places, values, weights) of each interval of a model."""
    held = column.values
    for k in range(len(held)):
        taken = held.field("taken")[k].values
        if taken is None:
            taken = held.field("taken").values.slice(0, 0)
        yield (held.field("interval")[k].as_py(), np.asarray(held.field("t")[k].values), *(taken.field(c).to_numpy(zero_copy_only=False) for c in ("u", "y", "w")))


def _rank_scores(models: DataFrame) -> DataFrame:
    """Adds the rank-score statistic of each quantile curve against the constant at its level (Gutenbrunner et al. 1993)."""
    kept = [c for c in models.columns if c != "stats"]
    schema = T.StructType([models.schema[c] for c in kept] + [T.StructField("chi", T.DoubleType()), T.StructField("chi_df", T.DoubleType())])

    def tested(row: dict) -> tuple:
        if row["stats"] is None or row["null_value"] is None:
            return None, None
        breaks = np.asarray(row["breaks"], dtype=float)
        pieces = small.basis_pieces(breaks, small.degree_of(int(row["smooth"])))
        moments = {int(s["interval"]): np.asarray(s["s"], dtype=float) for s in row["stats"]}
        cross = {int(s["interval"]): np.asarray(s["t"], dtype=float) for s in row["stats"]}
        g, scores = small.gram(pieces, moments, cross)
        ones = np.zeros(len(g))
        for m, s in moments.items():
            ones[m:m + pieces.shape[1]] += pieces[m] @ s[:pieces.shape[1]]
        chi, df = small.rank_score(g, ones, scores, float(row["scores"]), float(row["n"]), float(row["quantile"]))
        return (chi, float(df)) if df else (None, None)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = pd.DataFrame([tested(row) for row in batch.to_dict("records")], columns=["chi", "chi_df"], index=batch.index, dtype=float)
            yield pd.concat([batch[kept], found], axis=1)

    return models.mapInPandas(run, schema).drop("scores")


# ---- results -----------------------------------------------------------------------------

def summarize(models: DataFrame) -> DataFrame:
    """AIC, EDF of the smooth, p-value, R2 and deviance explained; NULL where the fit failed.

    p-values of mean curves are F tests on the effective degrees of freedom: approximate, as for any
    penalised fit. Those of quantile curves are rank-score tests of a constant against all curves of
    the basis, which need no density of the residuals. The model tables are small, so this is arithmetic on a few columns.
    """
    n, edf, family = F.col("n").cast("double"), F.col("edf_total"), F.col("family")
    has = lambda name: F.col(name) if name in models.columns else F.lit(None).cast("double")
    nonzero = lambda c: F.nullif(c, F.lit(0.0))
    tss = n * F.col("y_var")
    rss = (
        F.when(family == "gaussian", has("rss")).when(family == "gamma", has("sse"))
        .otherwise(has("sum_rr") - has("sum_r") * has("sum_r") / n)
    )
    full = F.when(family == "gaussian", has("rss")).when(family == "gamma", has("deviance")).otherwise(has("loss"))
    null = (
        F.when(family == "gaussian", tss).when(family == "gamma", 2 * n * (F.log("y_mean") - has("y_log")))
        .otherwise(has("null_loss"))
    )
    shape = n / nonzero(has("deviance"))
    gamma_loglik = n * shape * F.log(shape) - shape * has("deviance") / 2 - shape * n - n * has("y_log") - n * log_gamma(shape)
    aic = (
        F.when(family == "gaussian", n * (F.log(2 * np.pi * nonzero(rss) / n) + 1) + 2 * (edf + 1))
        .when(family == "gamma", -2 * gamma_loglik + 2 + 2 * edf)
    )
    out = models.withColumns({
        "EDF": edf - 1, "AIC": aic, "DevExplained": 1 - full / nonzero(null),
        "F": (null - full) / nonzero(edf - 1) / nonzero(full) * (n - edf),
        "R2": 1 - rss / nonzero(n - edf) / nonzero(tss) * (n - 1),
    })
    p = f_tail(F.col("F"), F.col("EDF"), n - edf)
    if "chi" in models.columns:
        p = F.when(family == "quantile", chi_tail("chi", "chi_df")).otherwise(p)
    return out.withColumn("PValue", p)


@F.pandas_udf(T.DoubleType())
def log_gamma(a: pd.Series) -> pd.Series:
    return pd.Series([math.lgamma(v) if v > 0 else math.nan for v in a], dtype=float)


@F.pandas_udf(T.DoubleType())
def f_tail(f: pd.Series, df1: pd.Series, df2: pd.Series) -> pd.Series:
    return pd.Series([small.f_tail(a, b, c) for a, b, c in zip(f, df1, df2)], dtype=float)


@F.pandas_udf(T.DoubleType())
def chi_tail(x: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series([small.chi_tail(a, int(b)) if b == b else math.nan for a, b in zip(x, df)], dtype=float)


def predict(models: DataFrame, points: DataFrame, keys: Sequence[str], rows: int) -> DataFrame:
    """Curve value of every model of the configuration at every point (``x``).

    ``rows`` is the number of models. Failed models give NULL.
    """
    extra = [c for c in ("smooth", "df", "quantile", "family", "status") if c in models.columns]
    located = _with_models(points, models.select(*keys, *extra, "breaks", "pieces"), keys, rows)
    value = curve_value()
    predicted = F.when(F.col("family") == "gamma", F.exp(value)).otherwise(value)
    return located.withColumn("predictedVals", predicted).drop("breaks", "pieces", "interval", "u")
