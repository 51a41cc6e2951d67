"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS] and prints one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import time

os.environ.setdefault("LEXIVEC_SHUFFLE", os.environ.get("BENCH_CPUS", "8"))

from lexivec import catalog
from lexivec.session import build_session

HEADLINE = (
    "bm25_topk", "bm25_batch_topk", "term_df", "vector_topk", "vector_batch_topk", "rrf_fuse", "hybrid_topk", "hybrid_explain",
    "hybrid_rerank_topk", "incremental_diff", "chunk_markdown", "content_hash",
)
RUNS = 3


def main() -> None:
    data = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = build_session(os.environ.get("BENCH_CPUS", "8"), "lexivec-bench")
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name in HEADLINE:
        times = []
        for _ in range(RUNS + 1):
            began = time.time()
            catalog.QUERIES[name](spark, data).write.format("noop").mode("overwrite").save()
            times.append(time.time() - began)
        seconds[name] = round(statistics.median(times[1:]), 3)
    print(json.dumps({"metric": "headline queries, median warm run", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": os.path.basename(data.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
