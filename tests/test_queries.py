"""Every query with SQL against DuckDB, and the plans of the others."""

import pytest

from riffle.plans import catalog
from tests.oracle import compare, duck

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_sql(spark, con, name):
    assert compare(spark, con, catalog.QUERIES[name], catalog.ORACLES[name], SF) == ""


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["JN4_right_three_keys", "JN5_full", "JN9_config_grid", "JN10_band", "JN11_point_in_polygon", "JN12_same_watershed",
                                  "DM3_assemble", "DM10_curve_roots", "DM13_adjust_limits", "DM17_report_by_class", "DM25_upstream", "MD1_logistic"])
def test_no_product_joins_and_no_row_python(spark, name):
    text = plan(catalog.QUERIES[name](spark, SF))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    assert "BatchEvalPython" not in text and "ArrowEvalPython" not in text


def test_scans_are_narrow(spark):
    text = plan(catalog.QUERIES["PF4_filter"](spark, SF))
    assert "PushedFilters: [IsNotNull(o_orderstatus)" in text and "o_orderdate" not in text.split("ReadSchema")[1]
    assert "l_shipdate" not in plan(catalog.QUERIES["DM5_sign_tally_readings"](spark, SF))


@pytest.mark.parametrize("name", ["JN10_band", "DM9_alteration_direction"])
def test_readings_are_scanned_once(spark, name):
    assert plan(catalog.QUERIES[name](spark, SF)).count("lineitem.parquet") == 1


def test_records_are_merged_before_classes_multiply_them(spark):
    text = plan(catalog.QUERIES["AG13_overall_classes"](spark, SF))
    assert text.index("Generate explode") < text.index("collect_set")  # plans are read from the result down
