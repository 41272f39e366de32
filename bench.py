"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]: one JSON line of seconds."""

import json
import os
import time

from pyspark.sql import SparkSession

from codeloom.plans import virtual

HEADLINE = ("inventory_files", "module_discovery", "critical_files", "graph_edges", "find_symbol", "impact", "explain_modules", "churn_last_1000", "changeset", "token_benchmark")


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    builder = SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g")
    spark = builder.config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    took = {}
    for name in HEADLINE:
        began = time.time()
        virtual.QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - began, 2)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(took.values()), 2), "unit": "sec", "queries": took, "sf": os.path.basename(sf).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
