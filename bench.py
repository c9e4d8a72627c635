"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import re
import sys
import time

from titlegauge.plans.catalog import all_queries
from titlegauge.session import local_session

HEADLINE = [
    "clean_posts", "latest_per_community", "community_profile", "era_percentile",
    "structural_features", "vocabulary", "tfidf", "norm_urls", "repost_pairs", "ab_pairs",
    "dual_label_pairs", "time_matched_noise", "pair_accuracy", "score_titles", "explain",
    "ranked_report", "two_level_quota", "dedupe_posts", "fixed_model", "eval_table", "rank_drafts",
    "ridge_structural", "ridge_evaluation",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = os.environ.get("BENCH_QUERIES", "").split() or HEADLINE
    spark = local_session(cpus, shuffle_partitions=8)
    queries = all_queries()
    seconds = {}
    for name in names:
        started = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - started, 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
        spark.catalog.clearCache()
    scale = re.search(r"sf([0-9.]+)", sf_dir)
    print(
        json.dumps(
            {
                "metric": "headline_queries_wall_time",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": float(scale.group(1)) if scale else None,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
