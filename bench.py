"""Times headline queries on local Spark and prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

from valograph.session import local_session
from valograph.workload import catalog

HEADLINE = [
    "semantic_quality", "dedup_best", "fused_weights", "shared_members", "hin_build", "degree_counts", "normalize_out_weights",
    "pagerank_weighted", "ablation", "future_validation", "citation_rank", "corr_kendall", "agg_quantiles", "rank_row_number",
    "agg_profile", "review_promotion", "incremental_scoring", "tfidf_word_cosine", "rule_scorer", "txt_mentions", "context_window",
    "pricing_sensitivity", "sample_stratified", "reliability_metrics",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(int(os.environ.get("BENCH_CPUS", "8")), "bench")
    spark.sparkContext.setLogLevel("ERROR")
    queries = catalog.queries()
    queries["topn"](spark, folder).collect()  # start-up is not measured
    seconds = {}
    for name in HEADLINE:
        start = time.perf_counter()
        queries[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        print(name, seconds[name], file=sys.stderr)
    total = round(sum(seconds.values()), 3)
    print(json.dumps({"metric": "headline_total", "value": total, "unit": "sec", "queries": seconds, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
