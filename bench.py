"""Time the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS] and print one JSON line."""

from __future__ import annotations

import json
import os
import tempfile
import time

from pyspark.sql import SparkSession

from sedimenta.queries import QUERIES

HEADLINE = [
    "profile_orders_fields", "profile_distinct_exact", "profile_distinct_kmv", "profile_bottomk_sample", "profile_events_value_kinds", "profile_full",
    "rule_sum_equals_orders", "rule_item_count", "rule_unique_by", "db_fk_missing", "plan_actions", "plan_quarantine_closure",
    "norm_decimal", "norm_date", "log_template_mining", "pii_spans", "gaps_islands", "validated_dataset", "structural_sample", "name_evidence",
]


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    shared = tempfile.mkdtemp(prefix="spark-bench-")
    conf = {
        "spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.sql.session.timeZone": "UTC", "spark.driver.memory": "8g",
        "spark.checkpoint.dir": shared, "spark.local.dir": shared, "spark.ui.showConsoleProgress": "false",
    }
    spark = SparkSession.builder.master(f"local[{cpus}]").config(map=conf).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES[HEADLINE[0]](spark, sf_dir).collect()  # start-up is not a query
    took = {}
    for name in HEADLINE:
        began = time.time()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - began, 3)
    print(json.dumps({"metric": "headline queries, total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf_dir.rpartition("sf")[2]}))


if __name__ == "__main__":
    main()
