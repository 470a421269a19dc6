"""Headline queries on local[$BENCH_CPUS]; prints one JSON line.

Every query runs once to warm up and then BENCH_RUNS times (default 1); the fastest run counts. Results are
consumed by the no-op sink, so the whole result is computed and nothing is collected.
"""
from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from paperloom.session import local_session  # noqa: E402
from paperloom.suite import all_queries  # noqa: E402

HEADLINE = [
    "s10_chunk_text", "s16_mask_pii", "x07_quality_score", "i05_content_hash", "i06_duplicates", "i09_message_intake", "x02_best_candidate", "x04_merge_batches",
    "c01_keyword_class", "c04_resolve_issuer", "f02_amount_facts", "f05_answer_facts", "f06_merge_chunk_facts", "f09_better_payload", "m01_fact_map",
    "m02_promote_facts", "m04_utility_bills", "m06_salary_slips", "m13_name_with_fallbacks", "q01_list_documents_full", "q08_library_stats",
    "q09_recent_documents", "q10_search_documents", "q14_answer_questions", "q16_search_recipes", "a05_member_permission", "a10_assignee", "t02_duplicate_requests",
    "t08_clean_up", "p01_exclusion", "p03_load_memories", "p08_latest_person_facts", "r06_morning_briefing", "r07_conversation_history", "w02_rate_limit",
    "w03_conversation_state", "w06_task_signals", "library_stats",
]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    spark = local_session("bench", cores=cpus, shuffle_partitions=cpus)
    queries = all_queries()
    seconds: dict[str, float] = {}
    for name in os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(","):
        best = float("inf")
        for attempt in range(runs + 1):
            began = time.perf_counter()
            queries[name](spark, sf).write.format("noop").mode("overwrite").save()
            spent = time.perf_counter() - began
            best = min(best, spent) if attempt else best
        seconds[name] = round(best, 3)
    print(
        json.dumps(
            {
                "metric": "headline_total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
                "sf": os.path.basename(sf.rstrip("/")), "cpus": cpus,
            }
        )
    )


if __name__ == "__main__":
    main()
