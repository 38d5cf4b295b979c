"""Time the registered queries and print one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8), BENCH_RUNS (default 3,
the median counts, after one warm-up), BENCH_QUERIES (comma-separated, default the headline
queries, ``all`` for every registered one).
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from callscope.queries import QUERIES  # noqa: E402
from callscope.session import local_session  # noqa: E402

HEADLINE = (
    "call_risk_report", "call_analysis_full", "call_analysis_turns", "entities_extract", "pii_redact_bounded",
    "rule_analysis", "asr_match", "asr_summary", "emotion_vote", "turns_split", "transcript_assemble",
    "daily_aggregate", "daily_running_totals", "latency_summary", "latency_overall", "agreement_score",
    "model_enrich", "bigram_search", "hash_embedding", "nearest_by_row", "nearest_filtered", "nearest_cells",
    "avatar_rules", "image_batch_local", "response_contract", "json_rescue", "signal_features",
    "laplacian_variance", "column_merge", "unified_browse", "stored_analysis", "sql_surface_join",
    "sql_surface_pricing", "sql_surface_window_rank", "stream_analyze", "stream_daily",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    asked = os.environ.get("BENCH_QUERIES", "")
    names = list(QUERIES) if asked == "all" else [n for n in asked.split(",") if n] or list(HEADLINE)
    spark = local_session(os.environ.get("BENCH_CPUS", "8"))
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name in names:
        spent = []
        for _ in range(runs + 1):
            started = time.perf_counter()
            QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            spent.append(time.perf_counter() - started)
        seconds[name] = round(statistics.median(spent[1:]), 4)
        print(f"{name}: {seconds[name]}", file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "total_query_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": folder.rstrip("/").rsplit("sf", 1)[-1],
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
