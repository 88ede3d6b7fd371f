"""Scores, alteration, limits, outcomes and reports on the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from riffle import constants as C
from riffle.functions import semantics as S
from riffle.operators import alteration as A
from riffle.operators import outcomes as O
from riffle.operators import scores as SC
from riffle.operators.joins import join
from riffle.operators.limits import choose_models, limits_long
from riffle.plans import analysis
from riffle.plans.registry import query
from riffle.plans.relational import LABELLED, labelled
from riffle.plans.roles import CURVES, LABELS

LIMIT_ROWS = len(CURVES) * len(C.LIMIT_CLASSES)
EXTRACT_CLASSES = {"Natural": "Natural", "Hard Bottom": "Hard Bottom",
                   "Soft Bottom (no hard sides)": "Soft Bottom (0)", "Soft Bottom (two hard sides)": "Soft Bottom (2)"}


def _rounded(df, *columns, places=6):
    return df.withColumns({c: F.round(c, places) for c in columns})


# ---- scores and the joined site table ----------------------------------------------------

@query("DM1_normalize_scores", "SELECT masterid, sampleyear, Metric, MetricValue, longitude, latitude, COMID FROM v_scores")
def dm1(r):
    return r.scores()


@query("DM2_class2", """SELECT masterid, channel_engineering_class,
    CASE WHEN channel_engineering_class = 'NAT' THEN 'Natural' WHEN channel_engineering_class IS NOT NULL THEN 'Modified' END AS Class2 FROM v_site""")
def dm2(r):
    return SC.add_class2(r.channel_class())


@query("DM3_assemble", "SELECT * FROM v_all")
def dm3(r):
    return r.all_data()


@query("DM4_flow_coverage", """WITH a AS (SELECT coalesce(e.masterid, f.masterid) AS masterid, e.longitude, e.latitude, e.COMID, e.channel_engineering_class,
      e.Class2, coalesce(HasFFM, 'No') AS HasFFM
      FROM v_engsites e FULL JOIN (SELECT DISTINCT masterid, 'Yes' AS HasFFM FROM v_flow_wide) f ON e.masterid = f.masterid)
    SELECT channel_engineering_class, HasFFM, count(*) AS n FROM (SELECT DISTINCT * FROM a WHERE channel_engineering_class IS NOT NULL) GROUP BY ALL""")
def dm4(r):
    return SC.flow_coverage(r.scores(), r.channel_class(), r.flow_wide())


_SIGNS = """nullif(count_if(deltah_final < 0), 0) AS Negative, nullif(count_if(deltah_final >= 0), 0) AS Positive,
    nullif(count_if(deltah_final IS NULL), 0) AS "NA", nullif(count_if(deltah_final < 0), 0) + nullif(count_if(deltah_final >= 0), 0) AS Total"""


@query("DM5_sign_tally", f"""SELECT flow_metric, channel_engineering_class, Metric, {_SIGNS}
    FROM v_all WHERE channel_engineering_class IS NOT NULL AND Metric IS NOT NULL GROUP BY ALL""")
def dm5(r):
    known = r.all_data().na.drop(subset=["channel_engineering_class", "Metric"])
    return SC.sign_tally(known, ["flow_metric", "channel_engineering_class", "Metric"])


@query("DM5_sign_tally_readings", f"SELECT flow_metric, class, status, {_SIGNS} FROM v_reading GROUP BY ALL")
def dm5_readings(r):
    return SC.sign_tally(r.reading(), ["flow_metric", "class", "status"])


@query("DM6_model_frame", """SELECT DISTINCT Metric, flow_metric, channel_engineering_class, Class2, deltah_final AS x, MetricValue AS y
    FROM v_all WHERE Metric IN ('csci', 'asci') AND deltah_final IS NOT NULL AND MetricValue IS NOT NULL""")
def dm6(r):
    from riffle.models.frame import model_frame

    scored = r.all_data().filter(F.col("Metric").isin(C.INDICES))
    return model_frame(scored, ["Metric", "flow_metric", "channel_engineering_class", "Class2"], "deltah_final", "MetricValue")


@query("DM7_condition", """SELECT masterid, Metric, MetricValue, channel_engineering_class,
    CASE WHEN MetricValue < t THEN 0 WHEN MetricValue >= t THEN 1 END AS Condition FROM (SELECT *, CASE WHEN Metric = 'csci' THEN
      CASE channel_engineering_class WHEN 'SB0' THEN 0.78 WHEN 'SB1' THEN 0.78 WHEN 'SB2' THEN 0.75 WHEN 'HB' THEN 0.67 WHEN 'NAT' THEN 0.79 END ELSE
      CASE channel_engineering_class WHEN 'SB0' THEN 0.79 WHEN 'SB1' THEN 0.79 WHEN 'SB2' THEN 0.76 WHEN 'HB' THEN 0.87 WHEN 'NAT' THEN 0.86 END END AS t
      FROM v_engsites)""")
def dm7(r):
    from riffle.models.frame import condition

    sites = SC.score_sites(r.scores(), r.channel_class()).select("masterid", "Metric", "MetricValue", "channel_engineering_class")
    level = S.by_index(F.col("Metric"), F.col("channel_engineering_class"), C.CONDITION_THRESHOLDS)
    return sites.withColumn("Condition", condition(F.col("MetricValue"), level))


# ---- alteration --------------------------------------------------------------------------

_PERC = """SELECT Hydro_Metric, Biol, Bio_threshold, channel_engineering_class, {label} AS what, count(*) AS n FROM lab
    WHERE channel_engineering_class IS NOT NULL AND Threshold = 'Threshold50' {where} GROUP BY ALL"""
_WIDE = """SELECT Hydro_Metric, Biol, Bio_threshold, channel_engineering_class, max(p) FILTER (what = '{a}') AS {a}, max(p) FILTER (what = '{b}') AS {b} FROM (
    SELECT *, 100.0::double * n / sum(n) OVER (PARTITION BY Hydro_Metric, Biol, Bio_threshold, channel_engineering_class) AS p FROM {src}) GROUP BY ALL"""
_ALTERED = f"t1 AS ({_PERC.format(label='Alteration_Current', where='')}), alt AS ({_WIDE.format(a='Altered', b='Unaltered', src='t1')})"
_DIRECTED = (
    "t2 AS (" + _PERC.format(label="CASE WHEN deltah_final > Positive THEN 'High' WHEN deltah_final <= Positive THEN 'Low' END",
                             where="AND Alteration_Current = 'Altered'")
    + f"), dir AS ({_WIDE.format(a='High', b='Low', src='t2')})"
)


@query("DM8_alteration_share", f"""{LABELLED}, {_ALTERED} SELECT Hydro_Metric, Biol, Bio_threshold, channel_engineering_class,
    round(Altered, 6) AS Altered, round(Unaltered, 6) AS Unaltered FROM alt""")
def dm8(r):
    return _rounded(A.alteration_share(labelled(r)), "Altered", "Unaltered")


@query("DM9_alteration_direction", f"""{LABELLED}, {_ALTERED}, {_DIRECTED} SELECT
    coalesce(alt.Hydro_Metric, dir.Hydro_Metric) AS Hydro_Metric, coalesce(alt.Biol, dir.Biol) AS Biol,
    coalesce(alt.Bio_threshold, dir.Bio_threshold) AS Bio_threshold, coalesce(alt.channel_engineering_class, dir.channel_engineering_class) AS channel_engineering_class,
    round(Altered, 6) AS Altered, round(Unaltered, 6) AS Unaltered, round(High, 6) AS High, round(Low, 6) AS Low,
    CASE WHEN High > 50 THEN 'High' WHEN High <= 50 THEN 'Low' END AS Direction
    FROM alt FULL JOIN dir ON alt.Hydro_Metric = dir.Hydro_Metric AND alt.Biol = dir.Biol AND alt.Bio_threshold = dir.Bio_threshold
      AND alt.channel_engineering_class = dir.channel_engineering_class""")
def dm9(r):
    return _rounded(A.alteration_direction(labelled(r)), "Altered", "Unaltered", "High", "Low")


# ---- limits ------------------------------------------------------------------------------

_CHOSEN = """SELECT *, CASE WHEN Hydro_endpoint IN ('DS_Mag_50', 'FA_Mag') OR (Index = 'asci' AND Hydro_endpoint = 'SP_Mag') THEN 6 ELSE 3 END AS ChosenSmth
    FROM v_thresholds"""
_LONG = "lim0 AS (" + " UNION ALL ".join(
    f"""SELECT Index, Hydro_endpoint, SmoothingFunc, Quantile, Index || '_' || Hydro_endpoint AS metric, '{n}' AS Threshold,
    Threshold{n}_Lower AS Lower, Threshold{n}_Upper AS Upper,
    CASE WHEN Index = 'asci' THEN {C.BIO_THRESHOLDS['asci'][n]}::double ELSE {C.BIO_THRESHOLDS['csci'][n]}::double END AS BioThresh FROM chosen"""
    for n in C.LIMIT_CLASSES) + ")"
LIMITS_SQL = f"""chosen AS (SELECT * FROM ({_CHOSEN}) WHERE SmoothingFunc = ChosenSmth AND Quantile IN (0.9, 0.5)), {_LONG},
  ext AS (SELECT min(deltah_final) AS mn, max(deltah_final) AS mx FROM v_flow_long),
  lim1 AS (SELECT *, metric || '_' || SmoothingFunc || '_' || Quantile AS mc FROM lim0),
  lim2 AS (SELECT *, CASE WHEN Lower IS NULL AND mc IN {tuple(C.BELOW_CURVES)} THEN 'Below'
      WHEN Upper IS NULL AND mc IN {tuple(C.ABOVE_CURVES)} THEN 'Above' ELSE 'Passes' END AS st,
      CASE WHEN Upper < 0 THEN Upper WHEN Lower <= 0 THEN Lower END AS lo,
      CASE WHEN Lower > 0 THEN Lower WHEN Lower <= 0 AND Upper >= 0 THEN Upper END AS hi FROM lim1),
  lim3 AS (SELECT *, CASE WHEN st = 'Passes' AND lo IS NULL AND hi IS NULL THEN CASE WHEN Quantile = 0.5 THEN 'Below' ELSE 'Above' END ELSE st END AS CurveStatus FROM lim2),
  lim AS (SELECT Index, Hydro_endpoint, SmoothingFunc, Quantile, metric, Threshold, BioThresh, CurveStatus,
      CASE CurveStatus WHEN 'Below' THEN 0 WHEN 'Above' THEN mn ELSE coalesce(lo, mn) END AS Lower2,
      CASE CurveStatus WHEN 'Below' THEN 0 WHEN 'Above' THEN mx ELSE coalesce(hi, mx) END AS Upper2 FROM lim3, ext)"""


def limits(r):
    return analysis.adjusted_limits(r.thresholds(), r.flow())


def on_sites(r, step, flow, limits, limit_rows=LIMIT_ROWS):
    """A step of the analysis on the sites of the tables."""
    return step(r.scores(), r.channel_class(), flow, r.labels(), limits, limit_rows, len(LABELS))


def outcomes(r):
    flow = r.written_flow()
    return on_sites(r, analysis.outcomes, flow, analysis.adjusted_limits(r.thresholds(), flow))


def report(r):
    flow = r.written_flow()
    return on_sites(r, analysis.report, flow, analysis.adjusted_limits(r.thresholds(), flow))


# The limits of the next two are fixed values; the site counts make the work grow with the tables.

@query("DM11_limits_long", f"""WITH chosen AS (SELECT * FROM v_thresholds), {_LONG}, n AS (
      SELECT Metric AS tag, channel_engineering_class, count(*) AS n_scores, count_if(MetricValue >= 0.75) AS n_high FROM v_engsites GROUP BY ALL)
    SELECT lim0.*, metric || '_' || SmoothingFunc || '_' || Quantile AS MetricCurve, n_scores, n_high
    FROM lim0 LEFT JOIN n ON Index = n.tag AND Threshold = channel_engineering_class""")
def dm11(r):
    return join(limits_long(r.thresholds()), _scores_per_class(r), {"Index": "Metric", "Threshold": "channel_engineering_class"}, "left")


def _scores_per_class(r):
    return SC.score_sites(r.scores(), r.channel_class()).groupBy("Metric", "channel_engineering_class").agg(
        F.count("*").alias("n_scores"), F.count_if(F.col("MetricValue") >= 0.75).alias("n_high"))


@query("DM12_choose_models", f"""WITH n AS (SELECT Metric, count(*) AS n_scores FROM v_engsites GROUP BY ALL)
    SELECT c.*, 'Yes' AS ModelstoUse, n_scores FROM ({_CHOSEN}) c LEFT JOIN n ON Index = Metric
    WHERE SmoothingFunc = ChosenSmth AND Quantile IN (0.9, 0.5)""")
def dm12(r):
    counts = SC.score_sites(r.scores(), r.channel_class()).groupBy("Metric").agg(F.count("*").alias("n_scores"))
    return join(choose_models(r.thresholds()), counts, {"Index": "Metric"}, "left")


@query("DM13_adjust_limits", f"WITH {LIMITS_SQL} SELECT * FROM lim")
def dm13(r):
    return limits(r)


# ---- outcomes ----------------------------------------------------------------------------

_VALUES = """vals AS (SELECT masterid, sampleyear, Metric AS Index, MetricValue AS IndexValue, longitude, latitude, COMID,
    channel_engineering_class AS Threshold, flow_metric, deltah_final, Flow_Metric_Name, hydro_endpoints AS Hydro_endpoint, Flow_Component
    FROM v_all WHERE Metric IN ('csci', 'asci') AND deltah_final IS NOT NULL),
  best AS (SELECT DISTINCT * EXCLUDE (IndexValue) FROM (SELECT *,
    CASE WHEN count(*) OVER w = count(IndexValue) OVER w THEN max(IndexValue) OVER w END AS IndexValueMax FROM vals WINDOW w AS (PARTITION BY masterid, Index)))"""
OUTCOMES_SQL = f"""{LIMITS_SQL}, {_VALUES},
  cls AS (SELECT DISTINCT * REPLACE (unnest([Threshold, 'NATLow', 'NATMed', 'NATHigh']) AS Threshold) FROM best),
  j AS (SELECT coalesce(cls.Index, lim.Index) AS Index, coalesce(cls.Hydro_endpoint, lim.Hydro_endpoint) AS Hydro_endpoint,
      coalesce(cls.Threshold, lim.Threshold) AS Threshold, cls.* EXCLUDE (Index, Hydro_endpoint, Threshold),
      lim.* EXCLUDE (Index, Hydro_endpoint, Threshold)
      FROM cls FULL JOIN lim ON cls.Index = lim.Index AND cls.Hydro_endpoint = lim.Hydro_endpoint AND cls.Threshold = lim.Threshold),
  lab AS (SELECT *, CASE WHEN deltah_final BETWEEN Lower2 AND Upper2 THEN 'Within' WHEN NOT (deltah_final BETWEEN Lower2 AND Upper2) THEN 'NotWithin' END AS WithinHydroLimits,
      CASE WHEN IndexValueMax >= BioThresh THEN 'Within' WHEN IndexValueMax < BioThresh THEN 'NotWithin' END AS WithinBioLimits FROM j),
  outc AS (SELECT *, CASE WHEN WithinHydroLimits = 'Within' AND WithinBioLimits = 'Within' THEN 'NoImpact'
      WHEN WithinHydroLimits = 'Within' AND WithinBioLimits = 'NotWithin' THEN 'BioImpact'
      WHEN WithinHydroLimits = 'NotWithin' AND WithinBioLimits = 'Within' THEN 'HydroImpact'
      WHEN WithinHydroLimits = 'NotWithin' AND WithinBioLimits = 'NotWithin' THEN 'BothImpact' END AS Result FROM lab)"""
TALLY_SQL = f"""{OUTCOMES_SQL}, tal AS (SELECT Index, Hydro_endpoint, Flow_Metric_Name, Threshold, Quantile, metric, Result, count(*) AS n,
      count(DISTINCT masterid) AS n_sites FROM outc WHERE metric IS NOT NULL AND WithinBioLimits IS NOT NULL GROUP BY ALL),
  shares AS (SELECT *, 100.0::double * n / sum(n) OVER (PARTITION BY Index, Hydro_endpoint, Flow_Metric_Name, Threshold, Quantile, metric) AS PercChans FROM tal),
  rep AS (SELECT Index, Flow_Metric_Name AS FlowMetric, CASE Threshold {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in C.CLASS_NAMES.items())} END AS ModifiedClass,
      Result AS Impact, n AS NumberOfSites, PercChans AS PercentageOfSites, Quantile FROM shares)"""
_CLASS_REPORT = f"""{TALLY_SQL}, byclass AS (SELECT Index, FlowMetric, ModifiedClass, Quantile, """ + ", ".join(
    f"round(coalesce(max(PercentageOfSites) FILTER (Impact = '{n}'), 0), 6) AS {n}" for n in C.OUTCOMES
) + ", cast(sum(NumberOfSites) AS bigint) AS NumberSitesPerClass FROM rep GROUP BY ALL)"


@query("DM14_best_score", f"WITH {_VALUES} SELECT masterid, sampleyear, Index, Threshold, Hydro_endpoint, deltah_final, IndexValueMax FROM best")
def dm14(r):
    return analysis.scored_values(r.scores(), r.channel_class(), r.written_flow(), r.labels(), len(LABELS)).select(
        "masterid", "sampleyear", "Index", "Threshold", "Hydro_endpoint", "deltah_final", "IndexValueMax")


@query("DM15_classify_outcome", f"""WITH {OUTCOMES_SQL} SELECT Index, Hydro_endpoint, Threshold, Quantile, WithinHydroLimits, WithinBioLimits, Result,
    CASE Result WHEN 'NoImpact' THEN 1 WHEN 'BioImpact' THEN 2 WHEN 'HydroImpact' THEN 3 WHEN 'BothImpact' THEN 4 END AS ResultOrder,
    count(*) AS n, min(deltah_final) AS lowest, max(deltah_final) AS highest, max(IndexValueMax) AS best FROM outc GROUP BY ALL""")
def dm15(r):
    labels = ["Index", "Hydro_endpoint", "Threshold", "Quantile", "WithinHydroLimits", "WithinBioLimits", "Result", "ResultOrder"]
    return outcomes(r).groupBy(*labels).agg(
        F.count("*").alias("n"), F.min("deltah_final").alias("lowest"), F.max("deltah_final").alias("highest"),
        F.max("IndexValueMax").alias("best"))


@query("DM16_outcome_share", f"WITH {TALLY_SQL} SELECT * REPLACE (round(PercChans, 6) AS PercChans) FROM shares")
def dm16(r):
    return _rounded(O.outcome_share(outcomes(r), sites=True, unique=True), "PercChans")


@query("DM16_rows_left_out", f"""WITH {OUTCOMES_SQL} SELECT count_if(metric IS NULL) AS without_limit,
    count_if(metric IS NOT NULL AND WithinBioLimits IS NULL) AS without_score, count_if(Result IS NULL) AS without_result FROM outc""")
def dm16_left_out(r):
    return O.unlabelled_rows(outcomes(r))


@query("DM17_report_by_class", f"WITH {_CLASS_REPORT} SELECT * FROM byclass")
def dm17(r):
    return _rounded(O.report_by_class(report(r)), *C.OUTCOMES)


@query("DM17_sites_per_class", f"""WITH {TALLY_SQL} SELECT Index, FlowMetric, ModifiedClass, Quantile,
    cast(sum(NumberOfSites) AS bigint) AS NumberSitesPerClass FROM rep GROUP BY ALL""")
def dm17_sites(r):
    return O.sites_per_cell(report(r))


@query("DM18_report_by_outcome", f"WITH {TALLY_SQL} SELECT Index, FlowMetric, Impact, Quantile, " + ", ".join(
    f"""round(coalesce(max(PercentageOfSites) FILTER (ModifiedClass = '{n}'), 0), 6) AS "{n}" """ for n in C.CLASS_NAMES.values()
) + " FROM rep GROUP BY ALL")
def dm18(r):
    return _rounded(O.report_by_outcome(report(r)), *C.CLASS_NAMES.values())


_FLAGGED = """fl AS (SELECT DISTINCT *, CASE WHEN flow_metric IN ('d_peak_10', 'd_peak_2', 'd_peak_5', 'delta_q99') AND deltah_final > 0 THEN 'Yes' ELSE 'No' END AS PeakAug
    FROM v_all WHERE Metric IN ('csci', 'asci') AND deltah_final IS NOT NULL)"""


def flagged(r):
    return SC.flag_augmented_peaks(r.all_data().filter(F.col("Metric").isin(C.INDICES)))


@query("DM19_peak_augmented", f"WITH {_FLAGGED} SELECT Metric, flow_metric, count_if(PeakAug = 'Yes') AS NoSitesAugmented FROM fl GROUP BY ALL")
def dm19(r):
    return SC.count_augmented_peaks(flagged(r))


@query("DM19_peaks_removed", f"WITH {_FLAGGED} SELECT masterid, sampleyear, Metric, MetricValue, flow_metric, deltah_final FROM fl WHERE PeakAug = 'No'")
def dm19_removed(r):
    return SC.drop_augmented_peaks(flagged(r)).select("masterid", "sampleyear", "Metric", "MetricValue", "flow_metric", "deltah_final")


_EXTRACT = f"""{_CLASS_REPORT}, ext2 AS (SELECT * REPLACE (CASE ModifiedClass {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in EXTRACT_CLASSES.items())} END AS ModifiedClass),
    CASE ModifiedClass {' '.join(f"WHEN '{k}' THEN {i}" for i, k in enumerate(EXTRACT_CLASSES, 1))} END AS ClassOrder
    FROM byclass WHERE Index = 'csci' AND ModifiedClass IN {tuple(EXTRACT_CLASSES)})"""


@query("DM20_report_extract", f"WITH {_EXTRACT} SELECT * FROM ext2 WHERE FlowMetric = 'Dry-season median baseflow'")
def dm20(r):
    table = _rounded(O.report_by_class(report(r)), *C.OUTCOMES)
    return O.report_extract(table, "csci", EXTRACT_CLASSES, "Dry-season median baseflow")


@query("DM20_report_stacked", f"""WITH {_EXTRACT} SELECT Index, FlowMetric, ModifiedClass, Quantile, NumberSitesPerClass, ClassOrder,
    unnest({list(C.OUTCOME_NAMES.values())}) AS Result, cast(unnest([1, 2, 3, 4]) AS integer) AS ResultOrder, unnest([{', '.join(C.OUTCOMES)}]) AS PercChans FROM ext2""")
def dm20_stacked(r):
    table = _rounded(O.report_by_class(report(r)), *C.OUTCOMES)
    return O.report_stacked(O.report_extract(table, "csci", EXTRACT_CLASSES))


@query("DM21_impact_points", f"""WITH {OUTCOMES_SQL} SELECT masterid, longitude, latitude, Threshold, Quantile, sampleyear, deltah_final FROM outc
    WHERE Hydro_endpoint = 'DS_Mag_50' AND Index = 'csci' AND Result = 'BothImpact' AND Threshold NOT IN ('NATLow', 'NATMed', 'NATHigh')""")
def dm21(r):
    return O.impact_points(outcomes(r), "csci", "DS_Mag_50").select(
        "masterid", "longitude", "latitude", "Threshold", "Quantile", "sampleyear", "deltah_final")
