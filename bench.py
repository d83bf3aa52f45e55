"""Times the headline queries and prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from mentionlake.plans.catalog import QUERIES
from mentionlake.session import local_session

HEADLINE = [
    "prefilter", "simhash", "near_dup_pairs", "dedup", "dedup_scoped", "hashed_embedding", "relevancy", "knn_topk",
    "similar_posts", "cluster_assign", "cluster_rollup", "lemmatize_text", "prefilter_lemma", "post_messages",
    "results_flat", "ttl_sessions", "spike_alerts", "brand_monitor",
]

# These read vectors or events, not documents.
OTHER_TABLES = {"knn_topk", "cluster_assign", "cluster_rollup", "ttl_sessions", "spike_alerts"}


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), os.environ.get("BENCH_MEMORY", "12g"), "bench")
    rows = spark.read.parquet(f"{folder}/documents.parquet").count()
    seconds = {}
    for name in HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({
        "metric": "total_seconds",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "documents_per_second": {name: round(rows / s, 1) for name, s in seconds.items() if name not in OTHER_TABLES},
        "sf": folder.rstrip("/").rsplit("sf", 1)[-1],
    }))


if __name__ == "__main__":
    main()
