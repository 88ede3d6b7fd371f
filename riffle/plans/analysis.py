"""The analyses end to end: joined site table, limits, outcomes and report tables."""

from __future__ import annotations

from pyspark.sql import DataFrame

from riffle.operators import outcomes as O
from riffle.operators.joins import within
from riffle.operators.limits import adjust_limits, choose_models, delta_range, limits_long
from riffle.operators.reshape import with_class_sets
from riffle.operators.scores import POSITION, best_score, score_sites, with_best_score, with_flow
from riffle.session import materialize


def adjusted_limits(thresholds: DataFrame, flow: DataFrame) -> DataFrame:
    """Chosen curves to adjusted limits; open sides end at the extreme deltas of the flow table."""
    lowest, highest = delta_range(flow)
    return adjust_limits(limits_long(choose_models(thresholds)), lowest, highest)


def scored_values(
    scores: DataFrame, channel_class: DataFrame, flow: DataFrame, labels: DataFrame, label_rows: int | None = None, open_classes: bool = False
) -> DataFrame:
    """Distinct site values, with the best score of the site in place of the score.

    Best scores and classes are found, and duplicates dropped, in the table of the sites, before its rows are repeated
    for every flow metric: distinct sites with distinct flow values and labels are distinct. A score counts if its
    site has a flow value. With ``open_classes`` the class is the array of all classes a value belongs to.
    ``flow`` and ``labels`` are read more than once.
    """
    flow = flow.na.drop(subset=["deltah_final"])
    sites = within(score_sites(scores, channel_class), flow, POSITION).drop("Class2")
    keys, value = ["masterid", "Metric"], "MetricValue"
    best = with_class_sets(with_best_score(sites, keys, value), "channel_engineering_class") if open_classes else best_score(sites, keys, value)
    return O.site_values(with_flow(best, flow.distinct(), labels.distinct(), label_rows))


def outcomes(
    scores: DataFrame, channel_class: DataFrame, flow: DataFrame, labels: DataFrame, limits: DataFrame, limit_rows: int, label_rows: int | None = None
) -> DataFrame:
    """Every site value with its limits, verdicts and outcome; rows are distinct.

    The site values are written once, as they are read in two places.
    """
    values = materialize(scored_values(scores, channel_class, flow, labels, label_rows, open_classes=True), "site-values")
    return O.classify_outcome(O.sites_with_limits(values, limits, limit_rows))


def report(
    scores: DataFrame, channel_class: DataFrame, flow: DataFrame, labels: DataFrame, limits: DataFrame, limit_rows: int, label_rows: int | None = None
) -> DataFrame:
    """Outcome counts and percentages under report names."""
    found = outcomes(scores, channel_class, flow, labels, limits, limit_rows, label_rows)
    return O.clean_names(O.outcome_share(found, unique=True))
