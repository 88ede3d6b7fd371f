"""Response curves on the given tables: logistic, spline, quantile and straight lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from riffle import constants as C
from riffle.functions import semantics as S
from riffle.models import lines, logistic, spline
from riffle.models.custom import fit_each
from riffle.models.frame import condition, direction, model_frame
from riffle.operators.curves import class_levels, grid_ranges, regular_grid
from riffle.operators.joins import join, lookup
from riffle.operators.outcomes import fit_profile
from riffle.operators.roots import model_thresholds
from riffle.operators.scores import drop_augmented_peaks, flag_augmented_peaks
from riffle.plans.registry import query
from riffle.session import materialize, new_path
from riffle.sources import tables as IO

KEYS = ["Metric", "flow_metric"]
GLM_KEYS = [*KEYS, "direction", "Class2"]
# The whole grid of the analysis; the chosen basis sizes and quantiles are picked from it later.
SMOOTHS, QUANTILES, DFS = C.SMOOTHS, C.QUANTILES, [float(k) for k in C.SMOOTHS]


def scored(r):
    return r.all_data().filter(F.col("Metric").isin(C.INDICES))


def frame(r):
    """Scores and deltas per index and metric, without augmented peaks.

    An observation is distinct with its channel class: equal values of two classes are two observations.
    """
    rows = drop_augmented_peaks(flag_augmented_peaks(scored(r)))
    return materialize(model_frame(rows, [*KEYS, "channel_engineering_class"], "deltah_final", "MetricValue").drop("channel_engineering_class"), "frame")


def glm_frame(r, keys=GLM_KEYS):
    """Condition and delta per index, metric, direction and class; the class is the last key."""
    rows = model_frame(
        scored(r).withColumn("direction", direction(F.col("deltah_final"))).filter(F.col("direction").isNotNull() & F.col(keys[-1]).isNotNull()),
        keys, "deltah_final", "MetricValue")
    if keys[-1] == "Class2":
        level = S.recode(F.col("Metric"), C.STANDARD_THRESHOLDS)
    else:
        level = S.by_index(F.col("Metric"), F.col(keys[-1]), C.CONDITION_THRESHOLDS)
    return materialize(rows.withColumn("y", condition(F.col("y"), level)), "glm")


def rounded(df, **places):
    return df.withColumns({c: F.round(c, p) for c, p in places.items()})


_NEWTON_STEPS = 9


def _glm_frame(cls: str, level: str) -> str:
    return f"""f0 AS MATERIALIZED (SELECT Metric, flow_metric, direction, {cls}, x, score, CASE WHEN score < t THEN 0.0::double ELSE 1.0::double END AS y
    FROM (SELECT DISTINCT Metric, flow_metric, CASE WHEN deltah_final > 0 THEN 'Pos' ELSE 'Neg' END AS direction, {cls}, deltah_final AS x, MetricValue AS score,
      {level} AS t
      FROM v_all WHERE Metric IN ('csci', 'asci') AND deltah_final <> 0 AND MetricValue IS NOT NULL AND {cls} IS NOT NULL)),
  base AS MATERIALIZED (SELECT Metric, flow_metric, direction, {cls}, count(*) AS n, avg(x) AS mx, stddev_pop(x) AS sx, sum(y) AS ones,
    min(x) FILTER (y = 1) AS one_low, max(x) FILTER (y = 1) AS one_high, min(x) FILTER (y = 0) AS zero_low, max(x) FILTER (y = 0) AS zero_high FROM f0 GROUP BY ALL),
  f AS MATERIALIZED (SELECT f0.*, (x - mx) / sx AS z FROM f0 JOIN base USING (Metric, flow_metric, direction, {cls}) WHERE n >= 3 AND ones > 0 AND ones < n AND sx > 0
    AND zero_high > one_low AND one_high > zero_low),
  c0 AS (SELECT Metric, flow_metric, direction, {cls}, 0.0::double AS a, 0.0::double AS b FROM f GROUP BY ALL)"""


_STATUS = """CASE WHEN n < 3 THEN 'too_few_rows' WHEN ones = 0 OR ones = n THEN 'one_class' WHEN NOT sx > 0 THEN 'constant_x'
    WHEN zero_high <= one_low OR one_high <= zero_low THEN 'separated' ELSE 'ok' END"""


def _glm_sql(cls: str, level: str) -> str:
    """Newton's method as a chain of tables, each step an aggregate."""
    steps = ", ".join(
        f"""s{i} AS MATERIALIZED (SELECT Metric, flow_metric, direction, {cls}, a, b, sum(p * (1 - p)) AS w, sum(p * (1 - p) * z) AS wz, sum(p * (1 - p) * z * z) AS wzz,
      sum(y - p) AS g, sum((y - p) * z) AS gz, sum(2 * (greatest(eta, 0) + ln(1 + exp(-abs(eta))) - y * eta)) AS dev FROM (
      SELECT f.*, a, b, a + b * z AS eta, 1 / (1 + exp(-(a + b * z))) AS p FROM f JOIN c{i} USING (Metric, flow_metric, direction, {cls})) GROUP BY ALL),
    c{i + 1} AS MATERIALIZED (SELECT Metric, flow_metric, direction, {cls}, a + (wzz * g - wz * gz) / (w * wzz - wz * wz) AS a, b + (w * gz - wz * g) / (w * wzz - wz * wz) AS b,
      dev, sqrt(w / (w * wzz - wz * wz)) AS se FROM s{i})"""
        for i in range(_NEWTON_STEPS)
    )
    return f"WITH {_glm_frame(cls, level)}, {steps}"


_STANDARD = "CASE WHEN Metric = 'csci' THEN 0.79 ELSE 0.86 END"
_PER_CLASS = "CASE Metric || channel_engineering_class " + " ".join(
    f"WHEN '{m}{c}' THEN {v}" for m, row in C.CONDITION_THRESHOLDS.items() for c, v in row.items()) + " END"
_GLM_FRAME = _glm_frame("Class2", _STANDARD)
_GLM = _glm_sql("Class2", _STANDARD)
_GLM_LAST = f"c{_NEWTON_STEPS}"
CLASS_KEYS = [*KEYS, "direction", "channel_engineering_class"]


@query("MD1_logistic", f"""{_GLM} SELECT Metric, flow_metric, direction, Class2, n, round(b, 5) AS scaled_slope, round(a, 5) AS scaled_intercept
    FROM base JOIN {_GLM_LAST} USING (Metric, flow_metric, direction, Class2)""")
def md1(r):
    models = logistic.fit_logistic(glm_frame(r), GLM_KEYS)
    return models.select(
        *GLM_KEYS, "n", F.round(F.col("slope") * F.col("x_sd"), 5).alias("scaled_slope"),
        F.round(F.col("intercept") + F.col("slope") * F.col("x_mean"), 5).alias("scaled_intercept"))


@query("MD1_logistic_by_class", f"""{_glm_sql('channel_engineering_class', _PER_CLASS)}
    SELECT Metric, flow_metric, direction, channel_engineering_class, n, {_STATUS} AS status, round(b, 4) AS scaled_slope
    FROM base LEFT JOIN {_GLM_LAST} USING (Metric, flow_metric, direction, channel_engineering_class)""")
def md1_by_class(r):
    """One model per channel class, with the threshold of the class; small groups and failed ones are there with their status."""
    models = logistic.fit_logistic(glm_frame(r, CLASS_KEYS), CLASS_KEYS)
    return models.select(
        *CLASS_KEYS, "n", "status", F.round(F.col("slope") * F.col("x_sd"), 4).alias("scaled_slope"))


@query("MD2_logistic_summary", f"""{_GLM} SELECT Metric, flow_metric, direction, Class2, n, round(dev + 4, 4) AS AIC,
    round(1 - dev / (-2 * (ones * ln(ones / n) + (n - ones) * ln(1 - ones / n))), 6) AS McFaddensR2
    FROM base JOIN {_GLM_LAST} USING (Metric, flow_metric, direction, Class2)""")
def md2(r):
    summary = logistic.summarize_logistic(logistic.fit_logistic(glm_frame(r), GLM_KEYS))
    return rounded(summary.select(*GLM_KEYS, "n", "AIC", "McFaddensR2"), AIC=4, McFaddensR2=6)


def _tail_sql(z: str) -> str:
    """The approximation of :func:`riffle.models.logistic.normal_tail` in SQL."""
    x, t = f"(abs({z}) / sqrt(2.0::double))", f"(1 / (1 + abs({z}) / sqrt(2.0::double) / 2))"
    polynomial = str(logistic.ERFC[-1])
    for c in logistic.ERFC[-2::-1]:
        polynomial = f"({polynomial} * {t} + ({c}))"
    return f"{t} * exp({polynomial} - {x} * {x})"


@query("MD2_logistic_pvalues", f"""{_GLM} SELECT Metric, flow_metric, direction, Class2, {_STATUS} AS status, round({_tail_sql('(b / se)')}, 5) AS PValue
    FROM base LEFT JOIN {_GLM_LAST} USING (Metric, flow_metric, direction, Class2)""")
def md2_pvalues(r):
    summary = logistic.summarize_logistic(logistic.fit_logistic(glm_frame(r), GLM_KEYS))
    return rounded(summary.select(*GLM_KEYS, "status", "PValue"), PValue=5)


@query("MD3_logistic_fitted", f"""{_GLM} SELECT Metric, flow_metric, direction, Class2, x, y, round(1 / (1 + exp(-(a + b * z))), 4) AS predictedVals
    , 'ok' AS status FROM f JOIN {_GLM_LAST} USING (Metric, flow_metric, direction, Class2)
    UNION ALL SELECT Metric, flow_metric, direction, Class2, NULL, NULL, NULL, {_STATUS} FROM base WHERE {_STATUS} <> 'ok'""")
def md3(r):
    """Fitted values, and one row without values for each configuration that could not be fitted."""
    rows = glm_frame(r)
    models = logistic.fit_logistic(rows, GLM_KEYS)
    fitted = logistic.predict_logistic(models, rows, GLM_KEYS, models.count())
    return rounded(fitted, predictedVals=4).withColumn("y", F.col("y").cast("double"))


@query("MD4_gamma_smooth")
def md4(r):
    return spline.fit_gamma(frame(r), KEYS, dfs=DFS).select(*KEYS, "df", "n", "status", "edf_total", "pieces")


@query("MD4_gamma_by_class")
def md4_by_class(r):
    keys = [*KEYS, "Class2"]
    rows = model_frame(scored(r).filter(F.col("Class2").isNotNull()), keys, "deltah_final", "MetricValue")
    models = spline.fit_gamma(materialize(rows, "frame"), keys, dfs=DFS)
    return spline.summarize(models).select(*keys, "df", "n", "status", "AIC", "PValue", "R2")


@query("MD5_gamma_summary")
def md5(r):
    models = spline.fit_gamma(frame(r), KEYS, dfs=DFS)
    return spline.summarize(models).select(*KEYS, "df", "n", "status", "AIC", "PValue", "R2")


@query("MD6_spline")
def md6(r):
    return spline.fit_gaussian(frame(r), KEYS, [6]).select(*KEYS, "smooth", "n", "status", "edf_total", "lambda", "breaks", "pieces")


@query("MD6_gamma_spline")
def md6_gamma(r):
    return spline.fit_gamma(frame(r), KEYS, smooths=SMOOTHS).select(*KEYS, "smooth", "n", "status", "edf_total", "pieces")


@query("MD7_spline_summary")
def md7(r):
    models = spline.fit_gaussian(frame(r), KEYS, C.SMOOTHS)
    return spline.summarize(models).select(*KEYS, "smooth", "n", "status", "AIC", "EDF", "PValue", "R2", "DevExplained")


@query("DM22_fit_profile")
def dm22(r):
    summary = spline.summarize(spline.fit_gaussian(frame(r), KEYS, C.SMOOTHS))
    return fit_profile(summary, KEYS, "smooth", ["AIC", "EDF", "PValue", "R2", "DevExplained"])


@query("MD8_spline_fitted")
def md8(r):
    rows = frame(r)
    models = spline.fit_gaussian(rows, KEYS, [6])
    return spline.predict(models, rows, KEYS, models.count())


@query("MD9_quantile_spline")
def md9(r):
    return spline.fit_quantile(frame(r), KEYS, SMOOTHS, QUANTILES).select(
        *KEYS, "smooth", "quantile", "n", "status", "loss", (F.col("below") / F.col("n")).alias("share_below"), "pieces")


@query("MD10_quantile_summary")
def md10(r):
    models = spline.fit_quantile(frame(r), KEYS, SMOOTHS, QUANTILES)
    return spline.summarize(models).select(*KEYS, "smooth", "quantile", "n", "status", "DevExplained", "PValue", "R2", "EDF")


def curves(r, smooths=SMOOTHS, quantiles=QUANTILES):
    """Predictions of the quantile curves on a regular grid, tagged with their configuration."""
    rows = frame(r)
    models = spline.fit_quantile(rows, KEYS, smooths, quantiles)
    grid = regular_grid(grid_ranges(rows, KEYS, "x"), "x_min", "x_max", "x_step", "x").select(*KEYS, "x")
    return spline.predict(models, grid, KEYS, models.count())


@query("MD11_grid_prediction")
def md11(r):
    """Size and range of every predicted curve."""
    return curves(r).groupBy(*KEYS, "smooth", "quantile").agg(
        F.count("*").alias("n"), F.min("x").alias("x_min"), F.max("x").alias("x_max"),
        F.min("predictedVals").alias("lowest"), F.max("predictedVals").alias("highest"))


def curve_names(models):
    """Models under the column names of thresholds."""
    named = models.withColumns({"Index": F.col("Metric"), "Hydro_endpoint": S.recode(F.col("flow_metric"), C.METRIC_CODES)})
    return named.withColumnsRenamed({"smooth": "SmoothingFunc", "quantile": "Quantile"})


@query("DM10_fitted_thresholds")
def dm10_fitted(r):
    """Crossings of the fitted curves with the threshold of every limit class; curves without result have a row that says so."""
    models = curve_names(spline.fit_quantile(frame(r), KEYS, SMOOTHS, QUANTILES))
    return model_thresholds(models, ["Index", "Hydro_endpoint", "SmoothingFunc", "Quantile"], class_levels())


def mean_thresholds(r, smooths):
    """Crossings of the mean curves, the observations behind each, and how well observed and fitted values agree."""
    rows = frame(r)
    models = spline.fit_gaussian(rows, KEYS, smooths)
    fitted = spline.predict(models, rows, KEYS, models.count())
    agreement = fitted.groupBy(*KEYS, "smooth").agg(F.corr("y", "predictedVals").alias("correlation"))
    return join(model_thresholds(models, [*KEYS, "smooth"], class_levels("Metric")), agreement, [*KEYS, "smooth"], "left")


@query("DM10_mean_thresholds")
def dm10_mean(r):
    return mean_thresholds(r, SMOOTHS)


_LINES = """SELECT Metric, flow_metric, count(*) AS n, round(regr_slope(y, x), 8) AS slope, round(regr_intercept(y, x), 6) AS intercept, round(regr_r2(y, x), 6) AS R2 FROM (
    SELECT DISTINCT Metric, flow_metric, channel_engineering_class, deltah_final AS x, MetricValue AS y FROM v_all
    WHERE Metric IN ('csci', 'asci') AND deltah_final IS NOT NULL AND MetricValue IS NOT NULL
      AND NOT (flow_metric IN ('d_peak_10', 'd_peak_2', 'd_peak_5', 'delta_q99') AND deltah_final > 0)) GROUP BY ALL"""


@query("MD12_quantile_lines")
def md12(r):
    return lines.fit_quantile_lines(frame(r), KEYS)


# ---- what SQL can state exactly about the fits -------------------------------------------

_OBSERVED = """SELECT DISTINCT Metric, flow_metric, channel_engineering_class, deltah_final AS x, MetricValue AS y FROM v_all
    WHERE Metric IN ('csci', 'asci') AND deltah_final IS NOT NULL AND MetricValue IS NOT NULL
      AND NOT (flow_metric IN ('d_peak_10', 'd_peak_2', 'd_peak_5', 'delta_q99') AND deltah_final > 0)"""
_MEANS = f"""WITH f AS ({_OBSERVED}) SELECT Metric, flow_metric, {{size}} AS smooth, count(*) AS n, round(avg(y), 5) AS mean_fitted,
    round(avg(y * x) / avg(abs(x)), 4) AS weighted_fitted FROM f GROUP BY ALL"""


def fitted_means(fitted, by=()):
    """Mean of the fitted values, plain and weighted by x: a penalty on curvature moves neither away from those of y."""
    return fitted.groupBy(*KEYS, "smooth", *by).agg(
        F.count("*").alias("n"), F.round(F.avg("predictedVals"), 5).alias("mean_fitted"),
        F.round(F.avg(F.col("predictedVals") * F.col("x")) / F.avg(F.abs("x")), 4).alias("weighted_fitted"))


@query("MD6_spline_means", _MEANS.format(size=3))
def md6_means(r):
    rows = frame(r)
    models = spline.fit_gaussian(rows, KEYS, [3])
    return fitted_means(spline.predict(models, rows, KEYS, models.count()))


@query("MD8_fitted_means", _MEANS.format(size=6))
def md8_means(r):
    rows = frame(r)
    models = spline.fit_gaussian(rows, KEYS, [6])
    return fitted_means(spline.predict(models, rows, KEYS, models.count()))


@query("IO5_reloaded_means", _MEANS.format(size=6))
def io5_means(r):
    rows, path = frame(r), new_path(r.spark, "models")
    IO.save_models(spline.fit_gaussian(rows, KEYS, [6]), path)
    models = IO.load_models(r.spark, path)
    return fitted_means(spline.predict(models, rows, KEYS, models.count()))


@query("UF1_one_model_each", f"""WITH f AS ({_OBSERVED}), n AS (SELECT Metric, flow_metric, count(*) AS n FROM f GROUP BY ALL)
    SELECT Metric, flow_metric, smooth, n, true AS fitted FROM n, (SELECT unnest({C.SMOOTHS}) AS smooth)""")
def uf1_each(r):
    """A curve for every configuration and basis size, if need be on fewer knots."""
    return spline.fit_gaussian(frame(r), KEYS, C.SMOOTHS).select(*KEYS, "smooth", "n", F.col("status").isin("ok", "reduced_k").alias("fitted"))


@query("MD7_summary_balance", f"""WITH f AS ({_OBSERVED}) SELECT Metric, flow_metric, smooth, count(*) AS n, round(var_pop(y), 6) AS y_var, 0.0::double AS gap
    FROM f, (SELECT unnest({C.SMOOTHS}) AS smooth) GROUP BY ALL""")
def md7_balance(r):
    """Explained and residual variance add up to that of y."""
    s = spline.summarize(spline.fit_gaussian(frame(r), KEYS, C.SMOOTHS))
    gap = F.abs(F.col("DevExplained") + F.col("rss") / (F.col("n") * F.col("y_var")) - 1)
    return s.select(*KEYS, "smooth", "n", F.round("y_var", 6).alias("y_var"), F.round(gap, 9).alias("gap"))


@query("DM22_profile_sizes", f"""WITH f AS ({_OBSERVED}), n AS (SELECT Metric, flow_metric, count(*) AS n FROM f GROUP BY ALL)
    SELECT Metric, flow_metric, smooth, true AS fitted, smooth - 1 >= 1 AS within FROM n, (SELECT unnest({C.SMOOTHS}) AS smooth)""")
def dm22_sizes(r):
    """The profile holds every basis size once, with all measures, and no curve uses more freedom than its basis has."""
    summary = spline.summarize(spline.fit_gaussian(frame(r), KEYS, C.SMOOTHS))
    profile = fit_profile(summary, KEYS, "smooth", ["AIC", "EDF", "R2", "DevExplained"])
    fitted = F.col("AIC").isNotNull() & F.col("EDF").isNotNull() & F.col("R2").isNotNull() & F.col("DevExplained").isNotNull()
    return profile.select(*KEYS, "smooth", fitted.alias("fitted"), (F.col("EDF") <= F.col("smooth") - 1 + 1e-9).alias("within"))


@query("MD4_gamma_ratio", f"""WITH f AS ({_OBSERVED}) SELECT Metric, flow_metric, count(*) AS n, CASE WHEN min(y) > 0 THEN 1.0::double END AS ratio,
    CASE WHEN min(y) > 0 THEN 'ok' ELSE 'nonpositive_y' END AS status FROM f GROUP BY ALL""")
def md4_ratio(r):
    """Mean of observed over fitted: 1 in a Gamma fit with log link and an unpenalised constant."""
    rows = frame(r)
    models = spline.fit_gamma(rows, KEYS, dfs=[4.0])
    fitted = spline.predict(models, rows, KEYS, models.count())
    return fitted.groupBy(*KEYS, "status").agg(F.count("*").alias("n"), F.round(F.avg(F.col("y") / F.col("predictedVals")), 4).alias("ratio"))


@query("MD5_gamma_freedom", f"""WITH f AS ({_OBSERVED}) SELECT Metric, flow_metric, count(*) AS n, 4.0::double AS df,
    CASE WHEN min(y) > 0 THEN 4.0::double END AS EDF, CASE WHEN min(y) > 0 THEN 'ok' ELSE 'nonpositive_y' END AS status FROM f GROUP BY ALL""")
def md5_freedom(r):
    """The degrees of freedom asked for are the ones the fit has."""
    models = spline.summarize(spline.fit_gamma(frame(r), KEYS, dfs=[4.0]))
    return models.select(*KEYS, "n", "df", F.round("EDF", 3).alias("EDF"), "status")


def on_level():
    """What an exact minimum of the check loss fulfils whatever the data; a curve without result does not."""
    level = F.col("quantile") * F.col("n")
    return F.coalesce((F.col("below") <= level + 1e-6) & (level <= F.col("below") + F.col("on_curve") + 1e-6), F.lit(False))


_SHARES = f"""WITH f AS ({_OBSERVED}), n AS (SELECT Metric, flow_metric, count(*) AS n FROM f GROUP BY ALL)
    SELECT Metric, flow_metric, {{columns}} FROM n"""


@query("MD9_quantile_shares", _SHARES.format(columns="3 AS smooth, unnest([0.9, 0.5])::double AS quantile, n, true AS on_level"))
def md9_shares(r):
    """No more observations lie below a quantile curve than its level asks for, and with those on it no fewer."""
    models = spline.fit_quantile(frame(r), KEYS, [3], C.CHOSEN_QUANTILES)
    return models.select(*KEYS, "smooth", "quantile", "n", on_level().alias("on_level"))


@query("MD10_quantile_gain", _SHARES.format(columns="3 AS smooth, unnest([0.9, 0.5])::double AS quantile, n, true AS better"))
def md10_gain(r):
    """No quantile curve has a larger check loss than the constant at the same level."""
    models = spline.summarize(spline.fit_quantile(frame(r), KEYS, [3], C.CHOSEN_QUANTILES))
    return models.select(*KEYS, "smooth", "quantile", "n", ((F.col("DevExplained") > -1e-9) & F.col("R2").isNotNull()).alias("better"))


@query("MD12_line_shares", _SHARES.format(columns=f"unnest({C.LINE_QUANTILES})::double AS quantile, n, true AS on_level"))
def md12_shares(r):
    models = lines.fit_quantile_lines(frame(r), KEYS)
    close = F.abs(F.col("share_below") - F.col("quantile")) <= 2 / F.col("n") + 1e-4
    return models.select(*KEYS, "quantile", "n", F.coalesce(close, F.lit(False)).alias("on_level"))


_CONSTANTS = f"""WITH f AS ({_OBSERVED}), l AS (SELECT unnest({{levels}})::double AS quantile),
    q AS (SELECT Metric, flow_metric, quantile, quantile_disc(y, {{levels}})[i] AS level FROM f, (SELECT unnest(range(1, len({{levels}}) + 1)) AS i, unnest({{levels}})::double AS quantile) l
      GROUP BY Metric, flow_metric, quantile, i)
    SELECT Metric, flow_metric, quantile, count(*) AS n, round(sum((y - level) * (quantile - CASE WHEN y < level THEN 1 ELSE 0 END)), 5) AS null_loss
    FROM f JOIN q USING (Metric, flow_metric) GROUP BY Metric, flow_metric, quantile"""


@query("MD10_constant_loss", _CONSTANTS.format(levels=C.QUANTILES))
def md10_constants(r):
    """Check loss of the best constant of each configuration and quantile, against which a curve is judged."""
    models = spline.fit_quantile(frame(r), KEYS, [1], C.QUANTILES)
    return models.select(*KEYS, "quantile", "n", F.round("loss", 5).alias("null_loss"))


_LINE_CHECK = f"""WITH f AS ({_OBSERVED}), n AS (SELECT Metric, flow_metric, count(*) AS n, avg(x) AS mx, stddev_pop(x) AS sx FROM f GROUP BY ALL)
    SELECT Metric, flow_metric, unnest({C.LINE_QUANTILES})::double AS quantile, n, 0::bigint AS better_lines FROM n"""


@query("MD12_line_optimum", _LINE_CHECK)
def md12_optimum(r):
    """Lines next to the fitted one, turned and moved by small and large steps, that have a smaller check loss: none."""
    rows = frame(r)
    models = lines.fit_quantile_lines(rows, KEYS)
    moves = [(a * s, b * s) for s in (1e-5, 1e-3, 0.05, 1.0) for a, b in ((1, 0), (-1, 0), (0, 1), (0, -1), (1, 1), (-1, 1), (1, -1), (-1, -1))]
    size = rows.groupBy(*KEYS).agg(F.avg("x").alias("mx"), F.stddev_pop("x").alias("sx"), F.stddev_pop("y").alias("sy"))
    near = F.col("y") - F.col("intercept") - F.col("slope") * F.col("x")

    def loss(a: float, b: float):
        gap = near - a * F.col("sy") - b * F.col("sy") * (F.col("x") - F.col("mx")) / F.col("sx")
        return F.sum(gap * (F.col("quantile") - F.when(gap < 0, 1.0).otherwise(0.0)))

    placed = lookup(rows, join(models.select(*KEYS, "quantile", "slope", "intercept"), size, KEYS), KEYS, rows=models.count())
    tried = placed.groupBy(*KEYS, "quantile").agg(F.count("*").alias("n"), loss(0, 0).alias("own"), F.array(*[loss(a, b) for a, b in moves]).alias("others"))
    return tried.select(*KEYS, "quantile", "n", F.size(F.filter("others", lambda x: x < F.col("own") * (1 - 1e-6))).cast("long").alias("better_lines"))


def grid_size(tagged):
    return tagged.groupBy(*KEYS, "smooth", "quantile").agg(
        F.count("*").alias("n"), F.min("x").alias("x_min"), (F.count("predictedVals") == F.count("*")).alias("whole"))


@query("MD11_grid_range", f"""WITH f AS ({_OBSERVED}), s AS (SELECT Metric, flow_metric, min(x) AS lo, max(x) AS hi, abs(avg(x) / 500) AS step FROM f GROUP BY ALL)
    SELECT Metric, flow_metric, 3 AS smooth, unnest([0.9, 0.5])::double AS quantile, cast(floor((hi - lo) / step + 1e-10) AS bigint) + 1 AS n, lo AS x_min, true AS whole
    FROM s WHERE step > 0""")
def md11_range(r):
    """Every point of the grid has a prediction of every curve."""
    return grid_size(curves(r, [3], C.CHOSEN_QUANTILES))


# ---- the same on the whole grid; the queries above keep the part that their SQL states ------

_EACH_SIZE = f"(SELECT unnest({C.SMOOTHS}) AS smooth)"
_EACH_CURVE = f"{_EACH_SIZE}, (SELECT unnest({C.QUANTILES})::double AS quantile)"


@query("MD6_spline_means_grid", f"""WITH f AS ({_OBSERVED}), m AS (SELECT Metric, flow_metric, count(*) AS n, round(avg(y), 5) AS mean_fitted,
      round(avg(y * x) / avg(abs(x)), 4) AS weighted_fitted FROM f GROUP BY ALL)
    SELECT Metric, flow_metric, smooth, n, mean_fitted, weighted_fitted FROM m, {_EACH_SIZE}""")
def md6_means_grid(r):
    rows = frame(r)
    models = spline.fit_gaussian(rows, KEYS, SMOOTHS)
    return fitted_means(spline.predict(models, rows, KEYS, models.count()))


@query("MD4_gamma_grid", f"""WITH f AS ({_OBSERVED}), m AS (SELECT Metric, flow_metric, count(*) AS n, min(y) > 0 AS positive FROM f GROUP BY ALL)
    SELECT Metric, flow_metric, df, n, CASE WHEN positive THEN 1.0::double END AS ratio, positive AS fitted FROM m, (SELECT unnest({DFS})::double AS df)""")
def md4_grid(r):
    """Mean of observed over fitted, and whether there is a curve, for all seven degrees of freedom."""
    rows = frame(r)
    models = spline.fit_gamma(rows, KEYS, dfs=DFS)
    fitted = spline.predict(models, rows, KEYS, models.count())
    return fitted.groupBy(*KEYS, "df").agg(
        F.count("*").alias("n"), F.round(F.avg(F.col("y") / F.col("predictedVals")), 4).alias("ratio"),
        F.bool_and(F.col("status").isin("ok", "reduced_k")).alias("fitted"))


@query("MD9_quantile_grid", f"""WITH f AS ({_OBSERVED}), n AS (SELECT Metric, flow_metric, count(*) AS n FROM f GROUP BY ALL)
    SELECT Metric, flow_metric, smooth, quantile, n, true AS fitted, true AS on_level, true AS better FROM n, {_EACH_CURVE}""")
def md9_grid(r):
    """All 28 curves of a configuration: settled, on their level, and no worse than the best constant."""
    models = spline.summarize(spline.fit_quantile(frame(r), KEYS, SMOOTHS, QUANTILES))
    return models.select(
        *KEYS, "smooth", "quantile", "n", F.col("status").isin("ok", "reduced_k").alias("fitted"),
        on_level().alias("on_level"), ((F.col("DevExplained") > -1e-9) & F.col("R2").isNotNull()).alias("better"))


@query("MD11_range_grid", f"""WITH f AS ({_OBSERVED}), s AS (SELECT Metric, flow_metric, min(x) AS lo, max(x) AS hi, abs(avg(x) / 500) AS step FROM f GROUP BY ALL)
    SELECT Metric, flow_metric, smooth, quantile, cast(floor((hi - lo) / step + 1e-10) AS bigint) + 1 AS n, lo AS x_min, true AS whole
    FROM s, {_EACH_CURVE} WHERE step > 0""")
def md11_range_grid(r):
    return grid_size(curves(r))


@query("MD13_line", _LINES)
def md13(r):
    return rounded(lines.fit_lines(frame(r), KEYS), slope=8, intercept=6, R2=6)


@query("IO4_save_models", _LINES)
def io4(r):
    path = new_path(r.spark, "models")
    IO.save_models(lines.fit_lines(frame(r), KEYS), path)
    return rounded(IO.load_models(r.spark, path), slope=8, intercept=6, R2=6)


@query("IO5_reload_models")
def io5(r):
    """Curves saved, reloaded and used for prediction."""
    rows, path = frame(r), new_path(r.spark, "models")
    IO.save_models(spline.fit_gaussian(rows, KEYS, [6]), path)
    models = IO.load_models(r.spark, path)
    return spline.predict(models, rows, KEYS, models.count()).groupBy(*KEYS, "smooth").agg(
        F.count("*").alias("n"), F.min("predictedVals").alias("lowest"), F.max("predictedVals").alias("highest"))


@query("UF1_function_per_configuration")
def uf1(r):
    """One model per row of the grid; the Python function sees aggregated statistics only."""
    return spline.fit_gaussian(frame(r), KEYS, C.SMOOTHS).select(*KEYS, "smooth", "status", "edf_total", "rss")


@query("UF2_failure_isolation", f"""WITH {_GLM_FRAME} SELECT Metric, flow_metric, direction, Class2, n,
    {_STATUS} AS status FROM base""")
def uf2(r):
    return logistic.fit_logistic(glm_frame(r), GLM_KEYS).select(*GLM_KEYS, "n", "status")


_CLASS_LEVELS = ", ".join(f"({m!r}, {c!r}, {v}::double)" for m, row in C.BIO_THRESHOLDS.items() for c, v in row.items())


@query("DM10_line_thresholds", f"""WITH f AS ({_OBSERVED}), m AS (SELECT Metric, flow_metric, count(*) AS n, min(x) AS lo, max(x) AS hi, regr_slope(y, x) AS b,
      regr_intercept(y, x) AS a, abs(corr(y, x)) AS correlation FROM f GROUP BY ALL HAVING count(*) >= 4 AND min(x) < max(x)),
    t AS (SELECT * FROM (VALUES {_CLASS_LEVELS}) v(Metric, class, level)),
    c AS (SELECT Metric, flow_metric, class, (level - a) / b AS root FROM m JOIN t USING (Metric) WHERE b <> 0 AND (level - a) / b > lo AND (level - a) / b < hi)
    SELECT Metric, flow_metric, n, round(correlation, 5) AS correlation, """ + ", ".join(
        f"round(max(root) FILTER (class = '{n}'), 3) AS Threshold{n}_Lower" for n in C.LIMIT_CLASSES) + """
    FROM m LEFT JOIN c USING (Metric, flow_metric) GROUP BY Metric, flow_metric, n, correlation""")
def dm10_line(r):
    """Crossings of straight mean curves: what SQL states of the mean curves."""
    rows = mean_thresholds(r, [2]).filter(F.col("status").isin("ok", "reduced_k"))
    return rows.select(*KEYS, "n", F.round("correlation", 5).alias("correlation"),
                       *[F.round(f"Threshold{n}_Lower", 3).alias(f"Threshold{n}_Lower") for n in C.LIMIT_CLASSES])


@query("UF1_user_function", f"""WITH f AS ({_OBSERVED}), m AS (SELECT Metric, flow_metric, count(*) AS n, avg(y) FILTER (x > 0) AS above, avg(y) FILTER (x < 0) AS below
      FROM f GROUP BY ALL)
    SELECT Metric, flow_metric, CASE WHEN above IS NOT NULL AND below IS NOT NULL THEN n END AS n, round(above - below, 6) AS gap,
      CASE WHEN above IS NULL OR below IS NULL THEN 'failed' ELSE 'ok' END AS status,
      CASE WHEN above IS NULL OR below IS NULL THEN 'ValueError: one side has no rows' END AS error FROM m""")
def uf1_user(r):
    """A user's function that fails for configurations with one side only; the others keep their rows."""

    def gap(cells):
        n_above, n_below = cells["n_above"].sum(), cells["n_below"].sum()
        if not n_above or not n_below:
            raise ValueError("one side has no rows")
        return {"n": int(cells["n"].sum()), "gap": cells["sum_above"].sum() / n_above - cells["sum_below"].sum() / n_below}

    above, below = F.col("x") > 0, F.col("x") < 0
    found = fit_each(frame(r), KEYS, {
        "n": F.count("*"), "n_above": F.count_if(above), "n_below": F.count_if(below),
        "sum_above": F.sum(F.when(above, F.col("y")).otherwise(0.0)), "sum_below": F.sum(F.when(below, F.col("y")).otherwise(0.0)),
    }, gap, "n long, gap double", cells=32)
    return rounded(found, gap=6)
