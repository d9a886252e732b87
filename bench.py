"""Runs the headline queries and prints one JSON line."""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession  # noqa: E402

from prismata import queries as core  # noqa: E402

HEADLINE = ["profile_numeric", "profile_moments", "profile_string", "profile_histogram", "profile_nulls", "correlations", "hll_distinct", "issues", "fix_impute_median", "fix_clip_p99", "fix_encode", "drift_psi", "validate_rules", "merge_union_dedup", "merge_overlap", "ask_group_mean"]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "8g").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    core.QUERIES["ask_group_mean"](spark, sf).collect()  # starts the JVM's compiler, not timed
    took = {}
    for name in HEADLINE:
        began = time.perf_counter()
        core.QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - began, 3)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
