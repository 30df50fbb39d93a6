"""Time the headline queries and print one JSON line.

BENCH_SF_DIR names the data folder, BENCH_CPUS the cores. Each query is run
once to warm the session's code cache up and then timed; its whole result is
computed and dropped.
"""

from __future__ import annotations

import json
import logging
import os
import sys
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)

from tallyspark import catalog  # noqa: E402
from tallyspark.session import build_session  # noqa: E402

HEADLINE = [
    "daily_summary",
    "sales_staging",
    "customer_profile",
    "revenue_calc",
    "monthly_revenue",
    "revenue_pivot",
    "revenue_projection",
    "report_summary",
    "report_top_customers",
    "report_categories",
    "comm_base_orders",
    "comm_pricing",
    "comm_line_finals",
    "comm_seller_summary",
    "rfm_score",
    "comm_final",
    "tier_override",
    "audit_violations",
    "join_effective_date_best",
    "customer_facts",
    "customer_payload",
    "qc_rules",
    "lt_final",
    "trigger_change_audit",
    "win_ntile_global",
    "win_dense_rank",
    "win_running_sum_rows",
    "agg_count_distinct",
    "join_inner",
    "str_split_rows",
]


def run(query, spark, directory: str) -> float:
    started = time.perf_counter()
    query(spark, directory).write.format("noop").mode("overwrite").save()
    return round(time.perf_counter() - started, 4)


def main() -> None:
    directory = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus if cpus.isdigit() else "8",
            "spark.driver.memory": os.environ.get("BENCH_MEMORY", "16g"),
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.sql.autoBroadcastJoinThreshold": os.environ.get("BENCH_BROADCAST", "1m"),
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    logging.getLogger("py4j").setLevel(logging.ERROR)
    queries = catalog.callables()
    names = sys.argv[1:] or HEADLINE
    seconds = {}
    for name in names:
        run(queries[name], spark, directory)
        seconds[name] = run(queries[name], spark, directory)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "total_seconds",
                "value": round(sum(seconds.values()), 4),
                "unit": "sec",
                "queries": seconds,
                "sf": directory.rsplit("sf", 1)[-1],
            }
        )
    )


if __name__ == "__main__":
    main()
