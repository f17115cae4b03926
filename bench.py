"""Time the headline queries; prints one JSON line.

``BENCH_SF_DIR`` names the tables (default sf0.1), ``BENCH_CPUS`` the local
cores. A query is timed from building the plan to the last row, with all rows
produced and thrown away. Each runs once to warm the JVM up; the better of two
further runs counts.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from repopulse.catalog import QUERIES  # noqa: E402
from repopulse.session import build_session  # noqa: E402

HEADLINE = (
    "stats_by_language",
    "stats_by_returnflag",
    "stats_narrow",
    "stats_by_part",
    "ratio_quality",
    "dq_conservation",
    "collection_bands",
    "run_counts",
    "metric_summary",
    "summary_age",
    "summary_ratio",
    "status_histogram",
    "profile",
    "json_explode",
    "presence_count",
    "parse_instant",
    "closed_ratio",
    "staleness_status",
    "popularity_rank",
    "language_histogram",
    "banded_age_ratio",
    "corr_age_ratio",
    "corr_strength",
    "top_k_ranked",
    "top_groups",
    "order_violations",
    "dedup_last_wins",
    "reconcile_precedence",
    "reconcile_summary",
    "weekly_snapshot_counts",
    "consolidated_table",
    "sentinel_cast",
    "dq_ranges",
    "dq_keys",
    "dq_recompute",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": "16g",
            # Small files still spread over the cores of one machine.
            "spark.sql.files.maxPartitionBytes": str(4 * 1024 * 1024),
        },
    )
    spark.sparkContext.setLogLevel("ERROR")

    def run(name: str) -> float:
        started = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - started

    seconds = {}
    for name in HEADLINE:
        run(name)
        seconds[name] = round(min(run(name), run(name)), 3)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1],
            }
        )
    )


if __name__ == "__main__":
    main()
