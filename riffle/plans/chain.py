"""From curves of the given tables to limits, outcomes and reports: the whole chain, without any fixed limit.

Two kinds of curves feed it. Step curves are exact quantiles of the scores per interval of the delta, which SQL can state,
so every stage of the chain has its SQL here; the fitted quantile splines take the same way.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from riffle import constants as C
from riffle.functions import semantics as S
from riffle.models import spline
from riffle.operators import outcomes as O
from riffle.operators.curves import class_levels, curve_thresholds
from riffle.operators.limits import choose_models, limits_long
from riffle.operators.ranks import discrete_quantiles
from riffle.operators.roots import model_thresholds
from riffle.operators.scores import sites_per_class, score_sites
from riffle.plans import analysis, domain, fitted
from riffle.plans.registry import query
from riffle.session import materialize

CURVE = ["Index", "Hydro_endpoint", "SmoothingFunc", "Quantile"]
#: Width of the intervals that stands for a basis size, and the quantiles of the step curves.
WIDTHS, LEVELS = {3: 20.0, 6: 10.0, 9: 5.0}, [0.9, 0.7, 0.5]
#: Chosen curves times limit classes, at most.
LIMIT_ROWS = len(C.INDICES) * len(C.METRIC_CODES) * len(C.CHOSEN_QUANTILES) * len(C.LIMIT_CLASSES)
COLUMNS = [f"Threshold{n}_{side}" for n in C.LIMIT_CLASSES for side in ("Lower", "Upper")]


def step_curves(r):
    """Quantiles of the score in each interval of the delta, for each index, metric and interval width."""
    each = F.inline(F.array(*[F.struct(F.lit(k).alias("SmoothingFunc"), F.lit(w).alias("w")) for k, w in WIDTHS.items()]))
    rows = fitted.frame(r).select(
        F.col("Metric").alias("Index"), S.recode(F.col("flow_metric"), C.METRIC_CODES).alias("Hydro_endpoint"), F.col("x").alias("delta"), "y", each)
    rows = rows.withColumn("at", F.col("w") * F.floor(F.col("delta") / F.col("w")) + F.col("w") / 2)
    found = discrete_quantiles(rows, ["Index", "Hydro_endpoint", "SmoothingFunc", "at"], "y", LEVELS)
    return materialize(found.select(*CURVE, F.col("at").alias("x"), F.col("x").alias("y")), "step-curves")


def thresholds(r):
    return materialize(curve_thresholds(step_curves(r), CURVE, "x", "y", class_levels()).select(*CURVE, *COLUMNS), "thresholds")


def fitted_thresholds(r):
    """Crossings of the quantile splines of the chosen basis sizes and quantiles."""
    models = fitted.curve_names(spline.fit_quantile(fitted.frame(r), fitted.KEYS, [3, 6], C.CHOSEN_QUANTILES))
    return materialize(model_thresholds(models, CURVE, class_levels()).select(*CURVE, *COLUMNS), "thresholds")


def limits(r, found=thresholds):
    flow = r.written_flow()
    return analysis.adjusted_limits(found(r), flow)


def _on_sites(r, step, found):
    known = materialize(limits(r, found), "limits")
    return domain.on_sites(r, step, r.written_flow(), known, LIMIT_ROWS)


def outcomes(r, found=thresholds):
    return _on_sites(r, analysis.outcomes, found)


def report(r, found=thresholds):
    return _on_sites(r, analysis.report, found)


_CODES = "CASE flow_metric " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in C.METRIC_CODES.items()) + " END"
_EACH_WIDTH = "(SELECT unnest({}) AS SmoothingFunc, unnest({}::double[]) AS w)".format(list(WIDTHS), list(WIDTHS.values()))
_LEVEL_ROWS = ", ".join(f"('{i}', '{n}', {v}::double)" for i, row in C.BIO_THRESHOLDS.items() for n, v in row.items())
_CURVES = "obs AS MATERIALIZED (" + fitted._OBSERVED + "), cur AS MATERIALIZED (" + " UNION ALL ".join(
    f"""SELECT Metric AS Index, {_CODES} AS Hydro_endpoint, SmoothingFunc, {q}::double AS Quantile, w * floor(x / w) + w / 2 AS x, quantile_disc(y, {q}) AS y
    FROM obs, {_EACH_WIDTH} GROUP BY ALL""" for q in LEVELS) + ")"
_WIDE = ", ".join(f"max(root) FILTER (level = '{n}' AND rn = {i}) AS Threshold{n}_{side}" for n in C.LIMIT_CLASSES for i, side in ((1, "Lower"), (2, "Upper")))
THRESHOLDS_SQL = f"""{_CURVES}, lev AS (SELECT * FROM (VALUES {_LEVEL_ROWS}) t(Index, level, l)),
  seg AS (SELECT *, lag(x) OVER w AS x0, lag(y) OVER w AS y0 FROM cur WINDOW w AS (PARTITION BY Index, Hydro_endpoint, SmoothingFunc, Quantile ORDER BY x)),
  hits AS (SELECT seg.*, level, x0 - (y0 - l) * (x - x0) / (y - y0) AS root FROM seg JOIN lev USING (Index) WHERE (y0 - l) * (y - l) < 0),
  num AS (SELECT *, row_number() OVER (PARTITION BY Index, Hydro_endpoint, SmoothingFunc, Quantile, level ORDER BY root) AS rn FROM hits),
  wide AS (SELECT Index, Hydro_endpoint, SmoothingFunc, Quantile, {_WIDE} FROM num GROUP BY ALL),
  thr AS MATERIALIZED (SELECT * FROM (SELECT DISTINCT Index, Hydro_endpoint, SmoothingFunc, Quantile FROM cur) LEFT JOIN wide USING (Index, Hydro_endpoint, SmoothingFunc, Quantile))"""


def _on_tables(sql: str) -> str:
    return f"{THRESHOLDS_SQL}, " + sql.replace("FROM v_thresholds", "FROM thr")


def _rounded(df, *columns):
    return df.withColumns({c: F.round(c, 6) for c in columns})


@query("DM10_step_curves", f"WITH {_CURVES} SELECT * FROM cur")
def dm10_curves(r):
    return step_curves(r)


@query("DM10_table_thresholds", f"WITH {THRESHOLDS_SQL} SELECT * REPLACE (" + ", ".join(f"round({c}, 6) AS {c}" for c in COLUMNS) + ") FROM thr")
def dm10_thresholds(r):
    return _rounded(thresholds(r), *COLUMNS)


@query("DM12_choose_curves", f"WITH {_on_tables(domain.LIMITS_SQL)} SELECT Index, Hydro_endpoint, SmoothingFunc, Quantile, ChosenSmth, 'Yes' AS ModelstoUse FROM chosen")
def dm12(r):
    return choose_models(thresholds(r)).select(*CURVE, "ChosenSmth", "ModelstoUse")


@query("DM11_table_limits_long", f"""WITH {_on_tables(domain.LIMITS_SQL)} SELECT Index, Hydro_endpoint, SmoothingFunc, Quantile, metric, Threshold, round(Lower, 6) AS Lower,
    round(Upper, 6) AS Upper, BioThresh, mc AS MetricCurve FROM lim1""")
def dm11(r):
    return _rounded(limits_long(choose_models(thresholds(r))), "Lower", "Upper")


@query("DM13_table_limits", f"WITH {_on_tables(domain.LIMITS_SQL)} SELECT * REPLACE (round(Lower2, 6) AS Lower2, round(Upper2, 6) AS Upper2) FROM lim")
def dm13(r):
    return _rounded(limits(r), "Lower2", "Upper2")


@query("DM15_table_outcomes", f"""WITH {_on_tables(domain.OUTCOMES_SQL)} SELECT Index, Hydro_endpoint, Threshold, Quantile, WithinHydroLimits, WithinBioLimits, Result,
    count(*) AS n, min(deltah_final) AS lowest, max(deltah_final) AS highest, max(IndexValueMax) AS best FROM outc GROUP BY ALL""")
def dm15(r):
    return outcomes(r).groupBy("Index", "Hydro_endpoint", "Threshold", "Quantile", "WithinHydroLimits", "WithinBioLimits", "Result").agg(
        F.count("*").alias("n"), F.min("deltah_final").alias("lowest"), F.max("deltah_final").alias("highest"), F.max("IndexValueMax").alias("best"))


@query("DM16_table_share", f"WITH {_on_tables(domain.TALLY_SQL)} SELECT * REPLACE (round(PercChans, 6) AS PercChans) FROM shares")
def dm16(r):
    return _rounded(O.outcome_share(outcomes(r), sites=True, unique=True), "PercChans")


@query("DM17_table_report", f"WITH {_on_tables(domain._CLASS_REPORT)} SELECT * FROM byclass")
def dm17(r):
    return _rounded(O.report_by_class(report(r)), *C.OUTCOMES)


@query("DM18_table_report", f"WITH {_on_tables(domain.TALLY_SQL)} SELECT Index, FlowMetric, Impact, Quantile, " + ", ".join(
    f"""round(coalesce(max(PercentageOfSites) FILTER (ModifiedClass = '{n}'), 0), 6) AS "{n}" """ for n in C.CLASS_NAMES.values()
) + " FROM rep GROUP BY ALL")
def dm18(r):
    return _rounded(O.report_by_outcome(report(r)), *C.CLASS_NAMES.values())


@query("DM20_table_extract", f"WITH {_on_tables(domain._EXTRACT)} SELECT * FROM ext2 WHERE FlowMetric = 'Dry-season median baseflow'")
def dm20(r):
    table = _rounded(O.report_by_class(report(r)), *C.OUTCOMES)
    return O.report_extract(table, "csci", domain.EXTRACT_CLASSES, "Dry-season median baseflow")


@query("DM21_table_points", f"""WITH {_on_tables(domain.OUTCOMES_SQL)} SELECT masterid, longitude, latitude, Threshold, Quantile, sampleyear, deltah_final FROM outc
    WHERE Hydro_endpoint = 'DS_Mag_50' AND Index = 'csci' AND Result = 'BothImpact' AND Threshold NOT IN ('NATLow', 'NATMed', 'NATHigh')""")
def dm21(r):
    return O.impact_points(outcomes(r), "csci", "DS_Mag_50").select(
        "masterid", "longitude", "latitude", "Threshold", "Quantile", "sampleyear", "deltah_final")


@query("DM13_fitted_limits")
def dm13_fitted(r):
    """Limits of the fitted curves; the extremes of the flow table close the open sides."""
    return limits(r, fitted_thresholds)


@query("DM17_fitted_report")
def dm17_fitted(r):
    """Outcome percentages per class by the limits of the fitted curves: all steps of the analysis on the tables."""
    return O.report_by_class(report(r, fitted_thresholds))


@query("DM5_sites_per_class", """SELECT Metric, channel_engineering_class, count(*) AS n FROM (
    SELECT DISTINCT * EXCLUDE (sampleyear, MetricValue) FROM v_engsites) GROUP BY ALL""")
def dm5_sites(r):
    return sites_per_class(score_sites(r.scores(), r.channel_class()))
