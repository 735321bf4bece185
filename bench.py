"""Benchmark: run the headline queries on one scale factor and print one JSON line.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py

Each query is fully executed through the ``noop`` sink (every row is
produced, nothing is collected to the driver).  After one warm-up run of the
flagship, every query runs ``BENCH_REPEAT`` times (default 2) and its best
wall-clock time is kept; ``value`` is the sum over the queries.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tenderlake.plans.registry import REGISTRY  # noqa: E402
from tenderlake.session import local_session  # noqa: E402

HEADLINE = [
    "search_documents", "search_conversations", "b1_similar_tenders", "b17_cross_collection",
    "e1_embed_with_cache", "m3_evict", "f6_f9_profile_tenders", "s7_ingest_summary",
    "a9_operation_metrics", "w4_running_mean", "b2_price_benchmark", "t3_stream_kpi", "b9_hybrid_search",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, shuffle_partitions=int(cpus) * 2)
    names = [n for n in HEADLINE if n in REGISTRY]
    only = [a for a in sys.argv[1:] if a in REGISTRY]
    if only:
        names = only
    # warm-up (JIT, codegen caches) on the flagship
    REGISTRY[names[0]][0](spark, sf_dir).write.format("noop").mode("overwrite").save()
    repeat = int(os.environ.get("BENCH_REPEAT", "2"))
    times = {}
    for n in names:
        best = None
        for _ in range(repeat):
            t0 = time.time()
            REGISTRY[n][0](spark, sf_dir).write.format("noop").mode("overwrite").save()
            dt = time.time() - t0
            best = dt if best is None else min(best, dt)
        times[n] = round(best, 3)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, "sf": sf}))


if __name__ == "__main__":
    main()
