"""Headline queries, timed: prints one JSON line.

``BENCH_SF_DIR`` (default /root/testdata/sf0.1) and ``BENCH_CPUS`` (default 8) choose data and cores.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = (
    "section_counts", "export_dedupe", "review_status_action", "split_eligible", "join_product_memory",
    "join_product_cache", "elect_representative", "rank_candidates", "memory_upsert", "intake_dedupe",
    "transcript_specs", "page_dimensions", "enrichment_summary",
)


def main() -> None:
    from skuloom.registry import all_queries
    from skuloom.session import build_session

    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench", f"local[{cpus}]",
        **{"spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.driver.memory": "16g"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries = all_queries()
    queries["section_counts"](spark, folder).write.format("noop").mode("overwrite").save()  # warm the JVM
    names = sys.argv[1:] or HEADLINE
    times = {}
    for name in names:
        start = time.time()
        queries[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
    total = round(sum(times.values()), 3)
    print(json.dumps({"metric": "headline_total", "value": total, "unit": "sec", "queries": times, "sf": os.path.basename(folder)}))


if __name__ == "__main__":
    main()
