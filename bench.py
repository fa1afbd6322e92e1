"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Stage tables (raw and clean encounters) are built first and timed on their own. Every
query then runs to a no-op sink: once cold, then warm; ``queries`` holds the median of
the warm runs, ``first`` the cold one. The model run (four fits, fairness refit, scoring)
is timed once; leave it out with BENCH_MODELS=0.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark.sql import SparkSession  # noqa: E402

from sparkrisk import queries as Q  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "4")
WARM = int(os.environ.get("BENCH_WARM", "2"))
MODELS = os.environ.get("BENCH_MODELS", "1") != "0"

HEADLINE = [
    "audit_of_cleaning", "overall_rate", "rate_by_diagnosis", "specialty_volume",
    "utilization_tiers", "length_of_stay", "admission_type_join", "admission_source_join",
    "segment_matrix", "medication_change", "insulin_status", "capped_rates", "null_report",
    "describe_numeric", "iqr_outliers", "histogram", "corr_matrix", "cardinality",
    "near_zero_variance", "ntile_gains", "qcut_lift", "global_rank", "order_price_rank",
    "rule_worklist", "group_split_exact", "roc_auc", "events_roc_auc", "describe_lineitem",
]


def session() -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]").appName("sparkrisk-bench")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "7g"))
        # call sites in error messages cost several round trips per expression
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        # a generated method longer than this is not compiled by the JVM: split it instead
        .config("spark.sql.codegen.hugeMethodLimit", "8000")
        .getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def timed(action) -> float:
    start = time.perf_counter()
    action()
    return round(time.perf_counter() - start, 3)


def main() -> None:
    spark = session()
    spark.range(1000).count()
    stages = {
        "stage_raw": timed(lambda: Q.raw(spark, SF_DIR)),
        "stage_clean": timed(lambda: Q.encounters(spark, SF_DIR)),
    }
    first, warm = {}, {}
    for name in HEADLINE:
        query = Q.QUERIES[name]
        first[name] = timed(lambda: run(query(spark, SF_DIR)))
        warm[name] = round(statistics.median(
            timed(lambda: run(query(spark, SF_DIR))) for _ in range(WARM)), 3)
    if MODELS:
        stages["model_run"] = timed(lambda: Q.model_run(spark, SF_DIR))
    times = {**stages, **warm}
    print(json.dumps({
        "metric": "total_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "first": first, "sf": SF_DIR.rstrip("/").split("sf")[-1],
        "cpus": int(CPUS)}))


if __name__ == "__main__":
    main()
