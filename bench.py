"""Run the headline queries and print one JSON line with the seconds of each."""

from __future__ import annotations

import json
import os
import time

from riffle.session import build_session

HEADLINE = [
    "IO3_save_load", "RS1_wide_to_long", "JN4_right_three_keys", "JN6_many_to_many", "JN10_band", "JN11_point_in_polygon",
    "AG8_mean_min_max", "AG11_box_summary", "WN2_group_maximum", "WN3_next_point", "WN5_first_row", "SC6_grid",
    "DM3_assemble", "DM5_sign_tally", "DM5_sign_tally_readings", "DM6_model_frame", "DM8_alteration_share",
    "DM9_alteration_direction", "DM10_curve_roots", "DM14_best_score", "DM16_outcome_share", "DM17_report_by_class",
    "DM18_report_by_outcome", "DM19_peak_augmented", "DM24_crosswalk", "DM25_upstream", "MD1_logistic", "MD7_spline_summary",
    "MD9_quantile_spline", "MD13_line",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "16g",
    })
    spark.sparkContext.setLogLevel("ERROR")
    from riffle.plans import catalog

    spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy("l_returnflag").count().collect()  # start the JVM's engine
    seconds = {}
    for name in HEADLINE:
        start = time.time()
        catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - start, 3)
    total = round(sum(seconds.values()), 3)
    print(json.dumps({"metric": "total_seconds", "value": total, "unit": "sec", "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
