"""Time the headline queries; prints one JSON line.

``BENCH_SF_DIR`` names the tables, ``BENCH_CPUS`` the number of local cores.
Every query runs to the end into a sink that discards rows. The clock includes
building and planning the query.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from spanloom.plans.queries import QUERIES  # noqa: E402
from spanloom.session import local_session  # noqa: E402

HEADLINE = (
    "service_usage",
    "spans_scalar",
    "prompts_flat",
    "completions_flat",
    "tool_calls_flat",
    "otlp_spans",
    "turn_texts",
    "turn_numbers",
    "conversation_rollup",
    "clusters_joined",
    "scores_joined",
    "dedup_spans",
    "trace_bounds",
    "failed_traces",
    "trace_series",
    "latest_clusters",
    "pending_inputs",
    "batch_answers",
    "batch_progress",
    "streamed_spans",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, app="spanloom-bench")
    spark.sparkContext.setLogLevel("ERROR")

    def run(name: str, folder: str) -> float:
        began = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        return round(time.perf_counter() - began, 3)

    only = sys.argv[1:] or HEADLINE
    warm_up = os.path.join(os.path.dirname(sf_dir), "sf0.001")
    for name in ("service_usage", "turn_texts"):
        run(name, warm_up if os.path.isdir(warm_up) else sf_dir)
    seconds = {name: run(name, sf_dir) for name in only}
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
