"""Limits, best score and outcomes."""

import pytest
from pyspark.sql import functions as F

from riffle import constants as C
from riffle.operators import outcomes as O
from riffle.operators.limits import adjust_limits, choose_models, limits_long
from riffle.operators.scores import best_score, sign_tally

LOW, HIGH = -100.0, 100.0
CASCADE = [
    # lower, upper, quantile, curve -> limits
    (-5.0, None, 0.9, "c", (-5.0, HIGH)),
    (5.0, None, 0.9, "c", (LOW, 5.0)),
    (-5.0, 5.0, 0.9, "c", (-5.0, 5.0)),
    (-9.0, -5.0, 0.9, "c", (-5.0, HIGH)),
    (5.0, 9.0, 0.9, "c", (LOW, 5.0)),
    (None, None, 0.5, "c", (0.0, 0.0)),
    (None, None, 0.9, "c", (LOW, HIGH)),
    (-5.0, None, 0.9, "csci_SP_Mag_3_0.9", (LOW, HIGH)),
    (-5.0, 5.0, 0.9, "csci_SP_Mag_3_0.9", (-5.0, 5.0)),
    (None, None, 0.5, "asci_Q99_3_0.5", (0.0, 0.0)),
    (-5.0, None, 0.5, "asci_Q99_3_0.5", (-5.0, HIGH)),
]


def test_cascade(spark):
    rows = [(i, a, b, q, m) for i, (a, b, q, m, _) in enumerate(CASCADE)]
    limits = spark.createDataFrame(rows, "i int, Lower double, Upper double, Quantile double, MetricCurve string")
    got = adjust_limits(limits, LOW, HIGH).orderBy("i").collect()
    assert [(r.Lower2, r.Upper2) for r in got] == [want for *_, want in CASCADE]
    assert all(r.Lower2 <= r.Upper2 for r in got)


# Published crossings of three curves (rounded), in the order of the limit classes.
GOLDEN = [
    ("csci", "DS_Mag_50", 6, 0.9, [-21.4, 17.0, -21.4, 17.0, -25.6, 58.8, -17.7, 10.9, -24.6, 27.7, -21.7, 17.6, -22.5, 19.5]),
    ("csci", "SP_Mag", 3, 0.9, [None] * 14),
    ("asci", "SP_Mag", 6, 0.9, [-786.3, None, -786.3, None, None, None, -453.4, None, -745.7, None, None, None, None, None]),
]


def test_published_curves(spark):
    columns = ", ".join(f"Threshold{n}_{s} double" for n in C.LIMIT_CLASSES for s in ("Lower", "Upper"))
    wide = spark.createDataFrame([(*r[:4], *r[4]) for r in GOLDEN],
                                 f"Index string, Hydro_endpoint string, SmoothingFunc int, Quantile double, {columns}")
    chosen = choose_models(wide)
    assert chosen.count() == 3
    got = {(r.metric, r.Threshold): r for r in adjust_limits(limits_long(chosen), LOW * 1000, HIGH * 1000).collect()}
    assert len(got) == 21
    dry = got["csci_DS_Mag_50", "NATLow"]
    assert (dry.Lower2, dry.Upper2, dry.BioThresh) == (-25.6, 58.8, 0.63)
    for name in C.LIMIT_CLASSES:
        open_row = got["csci_SP_Mag", name]
        assert (open_row.Lower2, open_row.Upper2, open_row.CurveStatus) == (LOW * 1000, HIGH * 1000, "Above")
    assert (got["asci_SP_Mag", "HB"].Lower2, got["asci_SP_Mag", "HB"].Upper2) == (-745.7, HIGH * 1000)
    assert got["asci_SP_Mag", "NATLow"].CurveStatus == "Above"


def test_best_score_is_null_with_a_missing_year(spark):
    df = spark.createDataFrame(
        [("a", "csci", 2001, 0.5), ("a", "csci", 2002, 0.9), ("b", "csci", 2001, 0.8), ("b", "csci", 2002, None)],
        "masterid string, Index string, sampleyear int, IndexValue double")
    got = {(r.masterid, r.sampleyear): r.IndexValueMax for r in best_score(df).collect()}
    assert got == {("a", 2001): 0.9, ("a", 2002): 0.9, ("b", 2001): None, ("b", 2002): None}


def test_outcomes(spark):
    df = spark.createDataFrame(
        [(1, 0.0, 0.9), (2, 0.0, 0.1), (3, 99.0, 0.9), (4, 99.0, 0.1), (5, 0.0, None), (6, None, 0.9)],
        "i int, deltah_final double, IndexValueMax double",
    ).withColumns({"Lower2": F.lit(-1.0), "Upper2": F.lit(1.0), "BioThresh": F.lit(0.79)})
    got = {r.i: (r.Result, r.ResultOrder) for r in O.classify_outcome(df).collect()}
    assert got == {1: ("NoImpact", 1), 2: ("BioImpact", 2), 3: ("HydroImpact", 3), 4: ("BothImpact", 4), 5: (None, None), 6: (None, None)}


def test_sign_tally_null_total(spark):
    df = spark.createDataFrame([("a", -1.0), ("a", 0.0), ("b", 3.0), ("b", None)], "g string, deltah_final double")
    got = {r.g: tuple(r)[1:] for r in sign_tally(df, ["g"]).collect()}
    assert got == {"a": (1, 1, None, 2), "b": (None, 1, 1, None)}


def test_shares_sum_to_hundred(spark):
    import __spark_entry__ as entry

    table = entry.entry(spark)
    rows = table.collect()
    assert rows and all(sum(r[n] for n in C.OUTCOMES) == pytest.approx(100, abs=1e-4) for r in rows)


def test_reports_agree(spark):
    """The class table and the outcome table hold the same percentages; absent cells are zero."""
    from riffle.plans import catalog

    sf = "/root/testdata/sf0.001"
    by_class = catalog.QUERIES["DM17_report_by_class"](spark, sf).collect()
    by_outcome = {(r.Index, r.FlowMetric, r.Impact, r.Quantile): r for r in catalog.QUERIES["DM18_report_by_outcome"](spark, sf).collect()}
    for r in by_class:
        for n in C.OUTCOMES:
            cell = by_outcome.get((r.Index, r.FlowMetric, n, r.Quantile))
            assert r[n] == (cell[r.ModifiedClass] if cell else 0.0)


SITES = "masterid string, sampleyear int, Metric string, MetricValue double, longitude double, latitude double, COMID string"


def test_site_values_are_scored_and_merged_before_flow_multiplies_them(spark):
    """Best score, classes and duplicates are settled in the table of the sites (F13 to F20, F26 to F28, F32)."""
    from riffle.plans import analysis

    scores = spark.createDataFrame([
        ("a", 2001, "csci", 0.5, 1.0, 2.0, "10"), ("a", 2001, "csci", 0.9, 1.0, 2.0, "10"), ("a", 2002, "csci", 0.1, 9.0, 9.0, "10"),
        ("b", 2001, "asci", None, 1.0, 2.0, "20"), (None, 2001, "asci", 0.7, 1.0, 2.0, "30"), ("c", 2001, "csci", 0.7, 1.0, 2.0, "40")], SITES)
    classes = spark.createDataFrame([("a", "NAT"), ("a", "SB0"), ("b", None), (None, "HB"), ("c", "HB")], "masterid string, channel_engineering_class string")
    flow = spark.createDataFrame([
        ("a", 1.0, 2.0, "m", 3.0), ("a", 1.0, 2.0, "m", 3.0), ("a", 1.0, 2.0, "k", None), ("a", 9.0, 9.0, "m", None),
        ("b", 1.0, 2.0, "m", 4.0), (None, 1.0, 2.0, "m", 5.0)], "masterid string, longitude double, latitude double, flow_metric string, deltah_final double")
    labels = spark.createDataFrame([("M", "e", "p", "m")], "Flow_Metric_Name string, hydro_endpoints string, Flow_Component string, flow_metric string")
    got = analysis.scored_values(scores, classes, flow, labels)
    assert sorted(((r.masterid, r.Threshold, r.deltah_final, r.IndexValueMax, r.Hydro_endpoint) for r in got.collect()), key=str) == sorted(
        [("a", "NAT", 3.0, 0.9, "e"), ("a", "SB0", 3.0, 0.9, "e"), ("b", None, 4.0, None, "e"), (None, "HB", 5.0, 0.7, "e")], key=str)
    opened = analysis.scored_values(scores, classes, flow, labels, open_classes=True)
    assert {r.masterid: set(r.Threshold) for r in opened.collect()} == {
        "a": {"NAT", "SB0", *C.OVERALL_CLASSES}, "b": {None, *C.OVERALL_CLASSES}, None: {"HB", *C.OVERALL_CLASSES}}
    text = opened._jdf.queryExecution().optimizedPlan().toString()
    assert not any("flow_metric" in line for line in text.splitlines() if "collect_set" in line)
