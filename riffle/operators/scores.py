"""Score feeds, channel classes, the joined site table and its tallies."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riffle import constants as C
from riffle.functions.semantics import if_else, max_or_null, to_number, year_of
from riffle.operators.joins import join, lookup
from riffle.operators.reshape import count_columns, stack_rows, wide_to_long

SCORE_COLUMNS = ["masterid", "sampleyear", "Metric", "MetricValue", "longitude", "latitude", "COMID"]
POSITION = ["masterid", "longitude", "latitude"]


def normalize_scores(raw: DataFrame, kind: str) -> DataFrame:
    """First replicate of a raw score feed in the common layout.

    ``csci`` rows carry a sample year and the score; ``asci`` rows a sample date as text and
    the score under ``result``. Text that is no number gives a NULL score.
    """
    if kind == "csci":
        kept = raw.filter(F.col("fieldreplicate") == 1)
        year, value = F.col("sampleyear"), F.col("csci")
    elif kind == "asci":
        kept = raw.filter(F.col("replicate") == 1)
        year, value = year_of(F.col("sampledate")), F.col("result")
    else:
        raise ValueError(f"unknown score feed: {kind}")
    return kept.select(
        "masterid", year.cast("int").alias("sampleyear"), F.lit(kind).alias("Metric"),
        to_number(value).alias("MetricValue"), "longitude", "latitude", F.col("comid").alias("COMID"),
    )


def all_scores(csci_raw: DataFrame, asci_raw: DataFrame) -> DataFrame:
    return stack_rows(normalize_scores(asci_raw, "asci"), normalize_scores(csci_raw, "csci"))


def add_class2(df: DataFrame) -> DataFrame:
    """Natural or Modified; a missing class stays missing."""
    return df.withColumn("Class2", if_else(F.col("channel_engineering_class") == "NAT", F.lit("Natural"), F.lit("Modified")))


def flow_long(flow_wide: DataFrame) -> DataFrame:
    return wide_to_long(flow_wide, C.FLOW_METRICS, "flow_metric", "deltah_final")


def score_sites(scores: DataFrame, channel_class: DataFrame, keep_unmatched: bool = False) -> DataFrame:
    """Scores with their channel class; optionally keep both unmatched sides."""
    return join(scores, add_class2(channel_class), ["masterid"], "full" if keep_unmatched else "inner")


def assemble(
    scores: DataFrame, channel_class: DataFrame, flow: DataFrame, labels: DataFrame, label_rows: int | None = None
) -> DataFrame:
    """Every flow value with the scores and class of its site, and the label of its metric.

    Sites are matched on identity and position; flow values without a score stay.
    """
    return with_flow(score_sites(scores, channel_class), flow, labels, label_rows)


def with_flow(sites: DataFrame, flow: DataFrame, labels: DataFrame, label_rows: int | None = None) -> DataFrame:
    """Every flow value with the rows of its site, by identity and position, and the label of its metric."""
    matched = join(sites, flow, POSITION, "right")
    return lookup(matched, labels, ["flow_metric"], label_rows)


def site_flow(scores: DataFrame, channel_class: DataFrame, flow: DataFrame) -> DataFrame:
    """Scored sites and flow sites, each flagged by whether flow values exist."""
    has_flow = flow.select("masterid").distinct().withColumn("HasFFM", F.lit("Yes"))
    joined = join(score_sites(scores, channel_class), has_flow, ["masterid"], "full")
    return joined.na.fill("No", ["HasFFM"])


def flow_coverage(scores: DataFrame, channel_class: DataFrame, flow: DataFrame) -> DataFrame:
    """Distinct sites per class, with and without flow values."""
    return (
        site_flow(scores, channel_class, flow)
        .drop("sampleyear", "MetricValue", "Metric")
        .na.drop(subset=["channel_engineering_class"])
        .distinct()
        .groupBy("channel_engineering_class", "HasFFM").agg(F.count("*").alias("n"))
    )


def sites_per_class(sites: DataFrame) -> DataFrame:
    """Distinct sites per index and class."""
    return (
        sites.drop("sampleyear", "MetricValue").distinct()
        .groupBy("Metric", "channel_engineering_class").agg(F.count("*").alias("n"))
    )


def sign_tally(df: DataFrame, keys: Sequence[str], delta: str = "deltah_final") -> DataFrame:
    """Count negative, positive and missing deltas per group, with their total.

    Zero counts as positive. A sign that does not occur is NULL, and makes Total NULL.
    """
    x = F.col(delta)
    counted = df.groupBy(*keys).agg(
        *count_columns({"Negative": x < 0, "Positive": ~(x < 0), "NA": x.isNull()})
    )
    return counted.withColumn("Total", F.col("Negative") + F.col("Positive"))


def flag_augmented_peaks(df: DataFrame, peaks: Sequence[str] = C.PEAK_METRICS) -> DataFrame:
    """Rows with a delta, flagged when a peak metric was augmented (delta above zero)."""
    augmented = F.col("flow_metric").isin(*peaks) & (F.col("deltah_final") > 0)
    return (
        df.distinct().na.drop(subset=["deltah_final"])
        .withColumn("PeakAug", if_else(augmented, F.lit("Yes"), F.lit("No")))
    )


def count_augmented_peaks(flagged: DataFrame) -> DataFrame:
    return flagged.groupBy("Metric", "flow_metric").agg(F.count_if(F.col("PeakAug") == "Yes").alias("NoSitesAugmented"))


def drop_augmented_peaks(flagged: DataFrame) -> DataFrame:
    """Rows that are not flagged; a missing flag goes too."""
    return flagged.filter(~(F.col("PeakAug") == "Yes"))


def with_best_score(df: DataFrame, keys: Sequence[str] = ("masterid", "Index"), value: str = "IndexValue") -> DataFrame:
    """Put the best score of the site on every row in place of the score; duplicates stay.

    One missing score makes the best score of the site missing. The maximum is an aggregate
    joined back, not a window, so no task holds all rows of a site.
    """
    best = df.groupBy(*keys).agg(max_or_null(F.col(value)).alias(f"{value}Max"))
    return join(df.drop(value), best, list(keys), "left")


def best_score(df: DataFrame, keys: Sequence[str] = ("masterid", "Index"), value: str = "IndexValue") -> DataFrame:
    """The best score of the site on every row, without duplicate rows."""
    return with_best_score(df, keys, value).distinct()
