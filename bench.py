"""Time the headline queries: one JSON line with warm seconds per query."""

from __future__ import annotations

import json
import os
import sys
import time

from threadlens.plans.registry import load
from threadlens.session import build_session

HEADLINE = [
    "style_profile", "clean_text", "length_features", "readability", "vocab_richness",
    "ngram_repetition", "hedging_rate", "pos_distribution", "sentiment_scores", "corpus_perplexity",
    "encode_tokens", "dedup_keep_first", "stratified_split", "balance_classes", "top_n_per_group",
    "first_n_clean_per_group", "comments_with_root_post", "comment_inherits_community",
    "unify_threads", "author_stats", "join_author_stats", "inter_post_gap", "inter_post_interval",
    "group_describe", "class_histogram", "correlation_matrix", "centroid_homogeneity", "knn_graph",
    "topic_terms", "roc_auc", "embed_texts", "stream_minute_budget",
]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": os.environ.get("BENCH_MEMORY", "6g"),
    })
    spark.sparkContext.setLogLevel("ERROR")
    registry, seconds = load(), {}
    names = sys.argv[1:] or HEADLINE
    for name in names:
        for _ in range(2):
            start = time.perf_counter()
            registry[name].run(spark, sf).write.format("noop").mode("overwrite").save()
            seconds[name] = round(time.perf_counter() - start, 3)
        print(f"{name} {seconds[name]}", file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "headline_queries_warm_total", "value": round(sum(seconds.values()), 3),
        "unit": "sec", "queries": seconds, "sf": os.path.basename(sf.rstrip("/")).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
