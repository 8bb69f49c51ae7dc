"""Timing of the headline queries; prints one JSON line.

Every query is run whole into a sink that discards its rows: once to warm up, then the
median of the timed runs is taken.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")

from pyspark.sql import SparkSession  # noqa: E402

from staywide.checks.queries import REGISTRY  # noqa: E402

HEADLINE = (
    "wide_table",
    "interval_join_subject",
    "interval_join_admission",
    "interval_join_stay",
    "feature_transfusion_beyond_1h",
    "feature_transfer_to_surgery_beyond_1h",
    "feature_psychotropic_med_within_120min",
    "critical_procedure_code",
    "count_lab_event",
    "count_drug_routes",
    "stay_procedures",
    "resource_type_count",
    "qc_feature_totals",
    "eval_all_runs",
    "eval_report",
    "apply_model_stub",
    "two_step_chain",
    "checkpoint_resume",
    "prompt_fan_out",
    "format_cpt",
    "parse_level_documents",
    "esi_cascade",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    repeats = int(os.environ.get("BENCH_REPEATS", "3"))
    names = sys.argv[1:] or HEADLINE
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("staywide-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        # The wide plan has more generated classes than the default cache holds.
        .config("spark.sql.codegen.cache.maxEntries", "1000")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name in names:
        times = []
        for _ in range(repeats + 1):
            start = time.perf_counter()
            REGISTRY[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(times[1:]), 3)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "total_query_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
