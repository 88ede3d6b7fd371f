"""Outcome of every site and metric, tallies, and the report tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riffle import constants as C
from riffle.functions.semantics import if_else, ordinal, recode, share
from riffle.operators.joins import full_lookup
from riffle.operators.reshape import long_to_wide, wide_to_long

LIMIT_KEYS = ["Index", "Hydro_endpoint", "Threshold"]
TALLY_KEYS = ["Index", "Hydro_endpoint", "Flow_Metric_Name", "Threshold", "Quantile", "metric"]
CELL = ["Index", "FlowMetric", "ModifiedClass", "Quantile"]


def site_values(all_data: DataFrame) -> DataFrame:
    """Flow values of scored sites, under the names that the limits use."""
    return (
        all_data.filter(F.col("Metric").isin(*C.INDICES))
        .na.drop(subset=["deltah_final"])
        .withColumnsRenamed({
            "hydro_endpoints": "Hydro_endpoint", "Metric": "Index",
            "channel_engineering_class": "Threshold", "MetricValue": "IndexValue", "MetricValueMax": "IndexValueMax",
        })
        .drop("Class2")
    )


def sites_with_limits(values: DataFrame, limits: DataFrame, limit_rows: int) -> DataFrame:
    """Distinct site values, their classes an array, once per class and with its limits.

    Nothing is shuffled: the classes are opened and the limits, unique per class, joined in place.
    Limits of classes without sites stay.
    """
    opened = values.withColumn("Threshold", F.explode("Threshold"))
    return full_lookup(opened, limits, LIMIT_KEYS, limit_rows, opened.select(*LIMIT_KEYS).distinct())


def classify_outcome(df: DataFrame) -> DataFrame:
    """Label each row by flow within limits and score above threshold.

    A missing value on either side leaves the outcome missing.
    """
    x, flow, bio = F.col("deltah_final"), F.col("WithinHydroLimits"), F.col("WithinBioLimits")
    inside, outside = F.lit("Within"), F.lit("NotWithin")
    return (
        df.withColumns({
            "WithinHydroLimits": if_else((x <= F.col("Upper2")) & (x >= F.col("Lower2")), inside, outside),
            "WithinBioLimits": if_else(F.col("IndexValueMax") >= F.col("BioThresh"), inside, outside),
        })
        .withColumn(
            "Result",
            if_else(
                flow == "Within",
                if_else(bio == "Within", F.lit("NoImpact"), F.lit("BioImpact")),
                if_else(bio == "Within", F.lit("HydroImpact"), F.lit("BothImpact")),
            ),
        )
        .withColumn("ResultOrder", ordinal(F.col("Result"), C.OUTCOMES))
    )


def outcome_share(
    outcomes: DataFrame, keys: Sequence[str] = TALLY_KEYS, sites: bool = False, unique: bool = False
) -> DataFrame:
    """Distinct rows per outcome and their percentage of the group.

    ``unique=True`` says that the rows are distinct, as :func:`sites_with_limits` makes them,
    and saves a shuffle of whole rows.

    Rows without a limit or a score verdict are left out. A site sampled in several years
    has several rows; ``sites=True`` adds the number of distinct sites.
    """
    kept = outcomes.na.drop(subset=["metric", "WithinBioLimits"])
    kept = kept if unique else kept.distinct()
    counts = [F.count("*").alias("n")] + ([F.count_distinct("masterid").alias("n_sites")] if sites else [])
    tally = kept.groupBy(*keys, "Result").agg(*counts)
    return tally.withColumn("PercChans", share(F.col("n"), keys))


def unlabelled_rows(outcomes: DataFrame) -> DataFrame:
    """Number of rows the tally leaves out, by reason."""
    return outcomes.agg(
        F.count_if(F.col("metric").isNull()).alias("without_limit"),
        F.count_if(F.col("metric").isNotNull() & F.col("WithinBioLimits").isNull()).alias("without_score"),
        F.count_if(F.col("Result").isNull()).alias("without_result"),
    )


def clean_names(shares: DataFrame) -> DataFrame:
    """Report names of the columns and classes."""
    return shares.select(
        "Index", F.col("Flow_Metric_Name").alias("FlowMetric"),
        recode(F.col("Threshold"), C.CLASS_NAMES).alias("ModifiedClass"),
        F.col("Result").alias("Impact"), F.col("n").alias("NumberOfSites"),
        F.col("PercChans").alias("PercentageOfSites"), "Quantile",
    )


def sites_per_cell(report: DataFrame) -> DataFrame:
    return report.groupBy(*CELL).agg(F.sum("NumberOfSites").alias("NumberSitesPerClass"))


def report_by_class(report: DataFrame) -> DataFrame:
    """One row per class: the percentage of each outcome, zero where absent, and the total.

    Percentages and totals come from the same aggregate, so nothing is joined.
    """
    percent = lambda name: F.coalesce(
        F.max(F.when(F.col("Impact") == name, F.col("PercentageOfSites"))), F.lit(0.0)
    ).alias(name)
    return report.groupBy(*CELL).agg(*[percent(n) for n in C.OUTCOMES], F.sum("NumberOfSites").alias("NumberSitesPerClass"))


def report_by_outcome(report: DataFrame) -> DataFrame:
    """One row per outcome: the percentage in each class, zero where absent."""
    keys = ["Index", "FlowMetric", "Impact", "Quantile"]
    return long_to_wide(report, keys, "ModifiedClass", "PercentageOfSites", list(C.CLASS_NAMES.values()), fill=0.0)


def report_extract(
    table: DataFrame, index: str, classes: Mapping[str, str], flow_metric: str | None = None
) -> DataFrame:
    """Rows of one index, and of one metric if given, for the listed classes under new names."""
    kept = table.filter((F.col("Index") == index) & F.col("ModifiedClass").isin(*classes))
    if flow_metric is not None:
        kept = kept.filter(F.col("FlowMetric") == flow_metric)
    named = recode(F.col("ModifiedClass"), classes)
    return kept.withColumns({"ClassOrder": ordinal(F.col("ModifiedClass"), list(classes)), "ModifiedClass": named})


def report_stacked(extract: DataFrame) -> DataFrame:
    """Long form of an extract: one row per class and outcome, outcomes under their long names."""
    long = wide_to_long(extract, C.OUTCOMES, "Result", "PercChans")
    return long.withColumns({
        "ResultOrder": ordinal(F.col("Result"), C.OUTCOMES), "Result": recode(F.col("Result"), C.OUTCOME_NAMES),
    })


def impact_points(
    outcomes: DataFrame, index: str, endpoint: str, result: str = "BothImpact", leave_out: Sequence[str] = C.OVERALL_CLASSES
) -> DataFrame:
    """Sites of one index and metric with one outcome, without the overall classes."""
    return outcomes.filter(
        (F.col("Index") == index) & (F.col("Hydro_endpoint") == endpoint) & (F.col("Result") == result)
        & ~F.col("Threshold").isin(*leave_out)
    )


def fit_profile(summary: DataFrame, keys: Sequence[str], by: str, measures: Sequence[str]) -> DataFrame:
    """Fit quality of each configuration along one grid dimension, in order."""
    return summary.select(*keys, by, *measures).orderBy(*keys, by)
